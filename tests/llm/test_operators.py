"""Operators against brute force, on odd rows and on the smallest tables."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from authscope.llm import bpe, fingerprint, flac, linededup, minhash, mixing, orc_tokens, secrets, suffix, toxicity
from authscope.llm.common import load_documents

SF = "/root/testdata/sf0.001"
RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WHITE = r"[\x20\x09-\x0D]+"


def words(t):
    return [w for w in re.split(WHITE, t or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return load_documents(spark, SF)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = st.sampled_from(["'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "B", "é", "9", "!", " ", "日", "😀", "ss", "\x00", "\x1c", "\x85", "²", " a", "<|endoftext|>", "é", "²½", "×", "ª", "ÿ", "ſ"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(SIGNS, max_size=30).map("".join), min_size=1, max_size=6))
def test_bpe_matches_library(library, texts):
    table = bpe.merger(RANKS)
    rows = bpe.encode_texts(texts, table)
    assert [np.frombuffer(r[0], "<u4").tolist() for r in rows] == [library.encode_ordinary(t) for t in texts]
    assert bpe.decode_ids([r[0] for r in rows], RANKS) == [t.encode() for t in texts]


def test_bpe_long_slices(library):
    text = "a" * 3000 + "ab" * 2000
    assert np.frombuffer(bpe.encode_texts([text], bpe.merger(RANKS))[0][0], "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_rows(odd, library, empty):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, RANKS).collect()))
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(empty, RANKS).count() == 0


def test_bpe_encode_then_decode(odd):
    encoded = bpe.encode(odd, RANKS)
    assert Counter(r.decoded for r in bpe.decode(encoded, RANKS).collect()) == Counter((r.text or "").encode() for r in odd.collect())


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 2
        out.append(hashlib.sha256((t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]).encode()).hexdigest())
    return out


def test_fingerprints(docs, odd, empty):
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprint.edited_likeness(docs).collect()}
    assert [got[r.doc_id].edited_sha256 for r in rows] == edited([r.text for r in rows])
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1
    own = fingerprint.edited_likeness(odd).collect()
    assert len(own) == odd.count() and len({r.fingerprint for r in own if r.doc_id in (1, 2, None)}) == 1
    assert {r.fingerprint for r in own if r.doc_id in (4, 5)} == {"0" * 16}
    assert fingerprint.edited_likeness(empty).count() == 0


def plain_simhash(text):
    """By its definition: pairs of neighbouring lower-cased words vote with their length; Spark's own hash of a pair is asked for."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    w = re.split(WHITE, text.lower())
    pairs = [(a, b) for a, b in zip(w, [*w[1:], None])]
    df = SparkSession.getActiveSession().createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    votes = [0] * 64
    for r in df.select("a", "b", F.xxhash64("a", "b").alias("h")).collect():
        weight = min(len(r.a) + len(r.b or ""), 16)
        for k in range(64):
            votes[k] += weight if r.h >> k & 1 else -weight
    return f"{sum(1 << k for k in range(64) if votes[k] > 0):016x}"


def test_fingerprint_by_definition_and_search(spark, docs):
    got = {r.doc_id: r for r in fingerprint.edited_likeness(docs).collect()}
    for r in docs.where("length(text) < 900").limit(6).collect():
        assert got[r.doc_id].fingerprint == plain_simhash(r.text)
    fps = {i: int(r.fingerprint, 16) for i, r in got.items()}
    for i, r in got.items():
        assert r.n_within == (sum((fps[i] ^ f).bit_count() <= 3 for f in fps.values()) - 1 if i % 20 == 0 else None)


def test_next_of_sparse_ids(spark):
    rng = np.random.default_rng(8)
    ids = sorted({int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 60)} | set(range(-3, 70)), reverse=True)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    assert {r.id: r.next_id for r in fingerprint.with_next(df, "doc_id", "text").collect()} == dict(zip(ids, [*ids[1:], ids[0]]))


def test_block_tables_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).tolist()
    near = [b ^ sum(1 << int(i) for i in rng.choice(62, n, replace=False)) for b in base for n in (1, 2, 3, 4)]
    fps = spark.createDataFrame([(x,) for x in base + near], "fp long")
    got = {(r.query_fp, r.fp) for r in fingerprint.within(fps, fps).collect()}
    every = set(base + near)
    assert got == {(a, b) for a in every for b in every if bin(a ^ b).count("1") <= 3}


def test_mixing(docs, odd, empty):
    rows = mixing.mix(docs).collect()
    want = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == want
    assert all(r.taken <= 3 * r["size"] for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    goal, free, left = dict.fromkeys(size, 0.0), set(size), float(sum(size.values()))
    while free and left > 1e-6:
        total = sum(weights[s] for s in free)
        for s in free:
            goal[s] += left * weights[s] / total
        left = 0.0
        for s in list(free):
            if goal[s] > 3 * size[s]:
                left += goal[s] - 3 * size[s]
                goal[s] = 3.0 * size[s]
                free.discard(s)
    for s in size:
        assert target[s] == pytest.approx(goal[s], rel=1e-9)
        assert abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    own = mixing.mix(odd).collect()
    assert len(own) == odd.count() and all(r.taken <= 3 * r["size"] for r in own)
    assert mixing.mix(empty).count() == 0


def test_line_dedup(spark, odd, empty):
    line = "a fairly long line of plain words that stands in several of the documents here"
    rows = [(1, f"{line}\nown first"), (2, f"own second\n{line.upper()}"), (3, line.replace("plain", "plane")), (4, "\n\nshort\nshort"), (5, None)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "own second"
    assert got[4].text == "\n\nshort" and (got[4].n_lines, got[4].n_kept) == (2, 1) and got[5].text is None
    assert linededup.dedup_lines(odd).count() == odd.count() and linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup(odd).columns == odd.columns


def test_minhash_below_the_usual_similarity(spark):
    """At 50 per cent bands are shorter, and the groups are those of brute force; a similarity that no band can find is refused."""
    rng = np.random.default_rng(9)
    rows = []
    for g in range(25):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        for v in range(4):  # each changes a run of words, so that similarities lie about the half
            at, size = int(rng.integers(0, 40)), 4 * v
            rows.append((len(rows), " ".join([*base[:at], *(f"v{x}" for x in rng.integers(0, 10**6, size)), *base[at + size :]])))
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    up = {i: i for i in sets}
    root = lambda i: i if up[i] == i else root(up[i])
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])]
    assert sum(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a, b in links) > 20
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=50).collect()}
    assert got == {i: root(i) for i in sets}
    assert minhash.rows_for(80) == minhash.rows_for(100) == minhash.ROWS and minhash.rows_for(50) == 2
    with pytest.raises(ValueError):
        minhash.rows_for(1)


def test_minhash_matches_brute_force(docs, odd, empty):
    sets = {}
    for r in docs.collect():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.groups(docs, shingle=4).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    own = {r.doc_id: r for r in minhash.groups(odd, shingle=4).collect()}
    assert own[2].component_id == 1 and own[3].component_id == 1 and own[4].component_id == 4 and own[None].kept
    assert minhash.groups(empty).count() == 0


def test_suffix_repeats(docs, odd, empty):
    texts = {r.doc_id: words(r.text) for r in docs.collect()}

    def covered(k):
        where, out = defaultdict(set), defaultdict(set)
        for i, w in texts.items():
            for j in range(len(w) - k + 1):
                where[tuple(w[j : j + k])].add(i)
        for i, w in texts.items():
            for j in range(len(w) - k + 1):
                if len(where[tuple(w[j : j + k])]) > 1:
                    out[i].update(range(j, j + k))
        return out

    got = defaultdict(set)
    for r in suffix.repeats(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    must, may = covered(50), covered(suffix.GRAM)
    assert all(must[i] <= got[i] for i in texts) and all(got[i] <= may[i] for i in texts)
    assert suffix.repeats(odd).count() == 0 and suffix.repeats(empty).count() == 0


def base_spans(text):
    rules = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= least)
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_secrets(docs, odd, empty):
    for df in (docs, odd):
        want = Counter((r.doc_id, hashlib.sha256(base_spans(r.text or "").encode()).hexdigest()) for r in df.collect())
        assert Counter((r.doc_id, r.base_sha256) for r in secrets.scan(df).collect()) == want
    assert secrets.scan(empty).count() == 0
    postings = secrets.index(odd)  # answers other rules too
    few = (secrets.RULES[1], secrets.RULES[0])
    assert {(r.id, r.start) for r in secrets.spans(odd, few, postings=postings).where("rule = 0").collect()} == {(r.id, r.start) for r in secrets.spans(odd).where("rule = 1").collect()}


def test_trigram_queries_are_necessary():
    query = secrets.trigram_query(secrets.RULES[0].pattern)
    for s in ("password=abcdefgh", "API_KEY: x", "apikey = y", "Secret:z"):
        assert any(o <= secrets.trigrams(s) for o in query[0])
    assert secrets.trigram_query(secrets.RULES[2].pattern) == []


def test_toxicity(spark, docs, odd, empty):
    bad = [(i, f"some plain text {'you idiot scum' if i % 3 == 0 else 'about the weather'} number{i} today", "s", "n") for i in range(300)]
    train = spark.createDataFrame(bad, odd.schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    held = toxicity.score(train, model).where("held_out").join(labels, "doc_id").collect()
    assert held and all(r.predicted == r.toxic for r in held)
    test = spark.createDataFrame([(1, "you 1d10t", "", ""), (2, "уou іdіot", "", ""), (3, None, "", "")], odd.schema)
    assert {r.doc_id: r.predicted for r in toxicity.score(test, model).collect()} == {1: 1, 2: 1, 3: 0}
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0 and toxicity.clean(odd, model).columns == odd.columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=900), min_size=1, max_size=5))
def test_flac_round_trip(raw):
    payloads = [r + b" " * (-len(r) % 192 if r else 192) for r in raw]
    for (back, at), p in zip(flac.decode(flac.encode(payloads)), payloads):
        assert back == p and [s for s, _ in at] == list(range(0, len(p), 192))


def test_flac_refuses_damage_and_seeks(odd, empty):
    media = flac.to_media(odd)
    stream = bytearray(media.first().media)
    stream[len(stream) // 2] ^= 8
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])
    assert flac.blocks(media).count() == sum(len(flac.payload(r.text)[0]) // 192 for r in odd.collect())
    got = Counter((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in flac.round_trip(odd).collect())
    want = Counter((n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for p, n in (flac.payload(r.text) for r in odd.collect()))
    assert got == want and flac.round_trip(empty).count() == 0


def test_orc_tokens(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    start = 0
    got = {r.doc_id: r for r in orc_tokens.stored(docs, TOKENIZER, str(tmp_path / "a")).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert orc_tokens.read(spark, str(tmp_path / "a")).where("doc_id = 3").count() == 1
    own = orc_tokens.stored(odd, TOKENIZER, str(tmp_path / "b")).collect()
    assert len(own) == odd.count() and sorted(r.start for r in own)[0] == 0
    assert orc_tokens.stored(empty, TOKENIZER, str(tmp_path / "c")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(SIGNS, max_size=30).map("".join))
def test_orc_pieces_match_library(text):
    assert orc_tokens.encode_texts([text], TOKENIZER)[0].tolist() == [*orc_tokens.library(TOKENIZER).tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_orc_added_tokens_are_the_librarys():
    assert orc_tokens.encode_texts(["a<|endoftext|>"], TOKENIZER)[0].tolist() == [64, 50256, 0]


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = load_documents(spark, SF)
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "bpe"]
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    rows = c.run(spark, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in rows)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as c

    for docs in (odd, empty):
        for _, stage in c.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and docs.count() >= 0


def test_narrowing_loses_no_link(spark):
    """Near copies on both sides of the limit: each row that goes links with nothing by brute force, and some go."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(40):
        words = list(base)
        for j in rng.sample(range(60), rng.choice([0, 1, 2, 3, 6, 9])):
            words[j] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string")
    sets = minhash.shingle_sets(df, 5)
    x = F.struct(F.col("id").alias("node"), F.size("items").cast("long").alias("n"), F.xxhash64("key").alias("d"), F.lit(None).cast("long").alias("c"))
    placed = sets.select(F.lit(1).cast("long").alias("k"), F.col("id").alias("node"), F.lit(40).cast("long").alias("n"), x.alias("x"), F.col("id").alias("comp"))
    kept = {r.node for r in minhash.narrowed(placed, sets.select(F.col("id").alias("node"), F.col("items").alias("item")), 80).collect()}
    full = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in rows}
    linked = {i for i in full for j in full if i != j and 100 * len(full[i] & full[j]) >= 80 * len(full[i] | full[j])}
    assert linked <= kept and len(kept) < len(rows)


def test_parities_never_exceed_the_difference():
    import numpy as np

    from authscope.llm import minhash

    rng = np.random.default_rng(3)
    for n, own in ((5, 1), (200, 40), (5000, 900)):
        common = rng.integers(0, 1 << 63, n, np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 1 << 63, own, np.uint64)))) for _ in "ab")
        cells = sum(int(x).bit_count() for x in (minhash.parities(a) ^ minhash.parities(b)).view(np.uint64))
        assert cells <= len(np.setxor1d(a, b)) and (cells > 0)


def test_a_line_of_very_many_copies(spark):
    """400,000 copies of one line and two variants of it, in groups of documents."""
    from pyspark.sql import functions as F

    line = " ".join(f"word{i}" for i in range(20))
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit(line), 10_000), "\n").alias("text"))
    df = df.union(spark.createDataFrame([(400, line.replace("word7", "ward7")), (401, "word0 " + line), (402, "own " * 20)], "doc_id long, text string"))
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in linededup.dedup_lines(df).where("n_kept > 0 or doc_id >= 400").collect()}
    assert got == {0: (10_000, 1), 400: (1, 0), 401: (1, 0), 402: (1, 1)}


def similarity(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return 1 - before[-1] / max(len(a), len(b))


def test_fuzzy_line_recall(spark):
    """Variants of lines of 5 to 60 words, with edit similarity 0.8 or more: found by the kind of edit."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))

    def changed(w, n):
        for at in rng.sample(range(len(w)), n):
            w = [*w[:at], word(), *w[at + 1 :]]
        return w

    def spelled(w, n):
        for at in rng.sample(range(len(w)), n):
            w = [*w[:at], w[at][:-1] + "z", *w[at + 1 :]]
        return w

    kinds = {
        "one": lambda w: changed(w, 1), "two": lambda w: changed(w, 2), "letter": lambda w: spelled(w, 1), "letters": lambda w: spelled(w, 2),
        "added": lambda w: (lambda at: [*w[:at], word(), *w[at:]])(rng.randint(0, len(w))), "gone": lambda w: (lambda at: [*w[:at], *w[at + 1 :]])(rng.randint(0, len(w) - 1)),
    }
    rows, want = [], defaultdict(list)
    for kind, edit in kinds.items():
        for n in range(5, 61):
            for _ in range(1):
                a = [word() for _ in range(n)]
                b = edit(a)
                if len(b) >= linededup.WORDS and similarity(" ".join(a), " ".join(b)) >= 0.8:
                    want[kind].append(len(rows))
                    rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    kept = {r.doc_id: r.n_kept for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(kept[i] == 1 for x in want.values() for i in x)
    recall = {kind: np.mean([kept[i + 1] == 0 for i in x]) for kind, x in want.items()}
    assert all(x >= 0.9 for x in recall.values()), recall


def test_lines_match_brute_force(spark, docs):
    """On the smallest tables: what goes has a similar line that stays earlier; equal lines all go; kept lines differ."""
    norm = lambda x: re.sub(WHITE, " ", x).strip().lower()
    first, texts = {}, {r.doc_id: r.text or "" for r in docs.collect()}
    for i in sorted(texts):
        for x in texts[i].split("\n"):
            first.setdefault(norm(x), i)
    got = {r.doc_id: r.text or "" for r in linededup.dedup_lines(docs).collect()}
    stays = Counter(norm(x) for t in got.values() for x in t.split("\n") if norm(x))
    assert max(stays.values()) == 1
    gone = [x for x in first if x and x not in stays]
    assert gone and all(any(similarity(x, y) >= 0.8 for y in stays if abs(len(x) - len(y)) <= 0.25 * max(len(x), len(y)) and set(x.split()) & set(y.split())) for x in gone[:40])


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"line one of many words here\nline {i} two of several other words", "ab"[i % 2], *[9] * 12) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _kept int, _gone int, _times int, _copy int, n_lines int, n_kept int, node int, k int, _bits int, _rate int, _lines int")


def test_names_that_clash(clashing):
    for out in (linededup.dedup(clashing), minhash.dedup(clashing), mixing.apply_mix(clashing)):
        rows = out.collect()
        assert out.columns == clashing.columns and rows and all(r._id == r._kept == r._gone == r.n_lines == r.n_kept == r._times == 9 for r in rows)


def test_linked_pair_that_no_linear_round_meets(spark):
    from pyspark.sql import functions as F

    from authscope.llm.common import linked

    nodes = spark.range(1, 9).withColumnRenamed("id", "node")
    order = lambda r: [x.node for x in nodes.orderBy(F.xxhash64("node", F.lit(r)), "node").collect()]
    buckets = nodes.select(F.lit(1).cast("long").alias("k"), "node")
    for rounds in (1, 2):
        met = {frozenset(p) for r in range(rounds) for o in [order(r)] for p in [*zip(o, o[1:]), *((o[0], x) for x in o[1:])]}
        for a, b in itertools.combinations(range(1, 9), 2):
            if frozenset((a, b)) not in met:
                break
        else:
            raise AssertionError("every pair meets in a linear round")
        near = lambda x, y: F.col(f"{x}.node").isin(a, b) & F.col(f"{y}.node").isin(a, b)  # noqa: B023, E731
        got = linked(buckets, nodes, near, lambda asked: asked.select("node", F.col("node").alias("item")), lambda pairs: pairs, rounds=rounds).collect()
        assert {(r.node, r.component) for r in got} == {(a, a), (b, a)}


def test_linked_matches_union_find(spark, monkeypatch):
    """Random graphs in overlapping buckets, small parts: the components are those of all links within the buckets."""
    import random

    from pyspark.sql import functions as F

    from authscope.llm import common

    monkeypatch.setattr(common, "PART", 3)
    for seed in range(4):
        rng = random.Random(seed)
        buckets = [(k, n) for k in range(5) for n in rng.sample(range(40), 12)]
        links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(40)}
        up = list(range(40))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            if any((k, a) in buckets and (k, b) in buckets for k in range(5)):
                x, y = sorted((root(a), root(b)))
                up[y] = x
        marks = spark.createDataFrame([(n, [b for a, b in links if a == n] or [-1]) for n in range(40)], "node long, to array<long>")
        near = lambda x, y: F.array_contains(F.col(f"{x}.to"), F.col(f"{y}.node")) | F.array_contains(F.col(f"{y}.to"), F.col(f"{x}.node"))
        got = common.linked(spark.createDataFrame(buckets, "k long, node long"), marks, near, lambda asked: asked.select("node", F.col("node").alias("item")), lambda pairs: pairs, rounds=1).collect()
        found = {r.node: r.component for r in got}
        assert {n: found.get(n, n) for n in range(40)} == {n: root(n) for n in range(40)}


def test_components_and_ordered_prefix(spark):
    from authscope.llm.common import components, ordered_prefix

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    rows = [(k, o, v) for k in ("a", None) for o, v in [(5, 1), (5, 2), (None, 4), (1 << 62, 8), (-9, 16), (None, 4)]]
    own = ordered_prefix(spark.createDataFrame(rows, "k string, o long, v long").repartition(4), ["k"], ["o"], "v", "p").collect()
    for k in ("a", None):
        assert sorted((r.p, r.v) for r in own if r.k == k) == [(0, 4), (4, 4), (8, 16), (24, 1), (25, 2), (27, 8)]


def test_each_repeated_passage_stays_once(spark):
    """Chained passages in every order: each word stays once, where its passage stands first."""
    p = [[f"p{i}_{j}" for j in range(80)] for i in range(5)]
    h, x, y = [f"h{j}" for j in range(60)], [f"x{j}" for j in range(12)], [f"y{j}" for j in range(12)]
    texts = {0: p[0], 1: p[0] + p[1], 2: p[1], 3: p[2] + p[3], 4: p[2], 5: p[3] + p[4] + p[2], 6: p[4], 7: h + x + ["a"], 8: h + y + ["b"], 9: h + y + ["c"]}
    stays = {i: [True] * len(t) for i, t in texts.items()}
    for r in suffix.repeats(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect():
        assert r.n_words == r.end_word - r.start_word
        if r.first_doc != r.doc_id:
            stays[r.doc_id][r.start_word : r.end_word] = [False] * r.n_words
    left = Counter(w for i, t in texts.items() for w, kept in zip(t, stays[i]) if kept)
    assert left == Counter({w for t in texts.values() for w in t})


def test_flac_reads_what_is_stored(odd, monkeypatch):
    stored, write = [], flac.cut
    monkeypatch.setattr(flac, "cut", lambda df, **o: stored.append(write(df, **o)) or stored[-1])
    rows = flac.round_trip(odd).collect()
    assert len(stored) == 1 and stored[0].inputFiles()
    assert Counter((r.doc_id, r.media_sha256) for r in rows) == Counter((r.id, hashlib.sha256(r.media).hexdigest()) for r in stored[0].collect())
    assert flac.blocks(stored[0]).count() == sum(r.n_blocks for r in rows)
