"""Counts of secrets, index and filters of the id files, scores of repeated and odd rows, stages on odd rows."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from authscope.llm import bpe, orc_tokens, secrets, toxicity
from authscope.llm.common import load_documents

SF = "/root/testdata/sf0.001"
TOKENIZER, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")

KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40), ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15), ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
]


def test_all_kinds_of_secrets(spark):
    """Counts and spans of every rule, in texts that hold several, cut ones, and very many."""
    jwt, git = "eyJhbGci.eyJzdWIi.c2ln", "ghp_" + "a1B2" * 9
    texts = [
        f"é {jwt} x {git} y xoxb-123456789012-abc -----BEGIN RSA PRIVATE KEY----- z", f"{git[:30]} ghp_{'x' * 36}xoxb-1234 eyJa.eyJb", "-----BEGIN PRIVATE KEY----------BEGIN EC PRIVATE KEY-----", f"token={git}; password = {'f' * 40} AKIA{'Z' * 12}",
        " ".join(f"api_key: secret{i:05d} {i:032x}" for i in range(3000)), None, "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan(df).collect())
    want = Counter()
    for i, t in rows:
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(KINDS) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        n = Counter(f[3] for f in found)
        want[(i, n["assign"], n["access"], n["hex"], ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found))] += 1
    assert got == want and any(k[3] == 3000 for k in got)


def test_id_files_have_stripes_index_and_filters(spark, tmp_path):
    """Run-length ids in stripes, a row index and Bloom filters on doc_id; an id beside those of a row group is refused by its filter."""
    df = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).coalesce(1)
    orc_tokens.write(orc_tokens.tokens(df, TOKENIZER).coalesce(1), str(tmp_path / "ids"))
    (file,) = Path(tmp_path / "ids").glob("*.orc")
    about = orc.ORCFile(str(file))
    assert about.nrows == 40_000 and about.row_index_stride == orc_tokens.INDEX_STRIDE and about.nstripes >= 1 and about.compression == "ZSTD"
    jvm = spark._jvm
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), options)
    every = spark.sparkContext._gateway.new_array(jvm.boolean, 5)
    for i in range(5):
        every[i] = True
    found = reader.rows().readRowIndex(0, every, every)
    groups = found.getRowGroupIndex()[1].getEntryCount()
    assert groups == found.getBloomFilterIndex()[1].getBloomFilterCount() >= 2
    read = orc_tokens.read(spark, str(tmp_path / "ids"))
    assert read.where("doc_id = 4000").count() == 1 and read.where("doc_id = 4001").count() == 0


def test_id_rows_with_clashing_names(spark):
    rows = [(2, "a b", 7, 7, 7, "x"), (1, "c", 7, 7, 7, "x"), (1, "c", 8, 8, 8, "y"), (None, None, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, n_tokens long, tie long, ids string")
    got = orc_tokens.stored(df, TOKENIZER).collect()
    assert [(r.doc_id, r.start) for r in sorted(got, key=lambda r: r.start)] == [(None, 0), (1, 1), (1, 1 + got_size(got, 1)), (2, 1 + 2 * got_size(got, 1))]


def got_size(rows, doc):
    return next(r.n_tokens for r in rows if r.doc_id == doc)


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(i, f"some plain text {'you idiot scum' if i % 3 == 0 else 'about the weather'} number{i} today") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    return toxicity.fit(rows, labels)


def test_toxicity_of_repeated_and_long_texts(spark, model):
    """Equal texts score alike, names of other columns do not matter, and a very long text is scored whole: its last words count."""
    calm = "about the weather today " * 20_000
    rows = [(1, "you idiot scum", 9, "a"), (1, "you idiot scum", 8, "b"), (2, "you idiot scum", 7, "c"), (3, calm, 1, None), (4, calm + "idiot scum " * 20_000, 1, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long, predicted string")
    got = [(r.doc_id, r.score, r.predicted) for r in toxicity.score(df, model).collect()]
    same = {s for d, s, _ in got if d in (1, 2)}
    by = {d: (s, p) for d, s, p in got}
    assert len(got) == 6 and len(same) == 1 and by[1][1] == 1 and by[3][1] == 0 and by[4][0] > by[3][0] and by[None][1] == 0
    kept = toxicity.clean(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {3, None} and not {r.doc_id for r in kept.collect()} & {1, 2}


def test_stages_on_odd_rows_keep_what_is_clean(spark, odd, empty):
    """Each stage's rows come from those before it, the last decodes to the texts it got, and nothing comes of nothing."""
    import corpus_pipeline as c

    before, docs = Counter((r.doc_id, r.source) for r in odd.collect()), odd
    for name, stage in c.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), odd.schema)
        now = Counter((r.doc_id, r.source) for r in docs.collect())
        assert now and not now - before, name
        before = now
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and r.doc_id is not None}  # rows of NULL id link with nothing
    assert len(texts) == len(set(texts.values())) and sum(t.startswith("the quick brown fox") for t in texts.values()) == 1
    mixed = spark.createDataFrame(c.mix_sources(spark, docs, SF).collect(), odd.schema)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}
    out = c.encode(spark, mixed, SF).collect()
    assert len(out) == mixed.count()
    assert Counter(r.decoded_sha256 for r in out) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed.collect())
    assert all(bpe.decode_ids([bytes(r.ids)], RANKS) and np.frombuffer(r.ids, "<u4").size == r.n_tokens for r in out)
    for _, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_documents_of_the_table_have_no_other_columns_read(spark):
    """Operators take the columns that they name: a table with two more gives the same."""
    docs = load_documents(spark, SF)
    more = docs.withColumns({"th": F.lit("x"), "rule": F.lit(3)})
    assert sorted(map(tuple, secrets.scan(more).collect())) == sorted(map(tuple, secrets.scan(docs).collect()))
