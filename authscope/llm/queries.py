"""Registered queries of the corpus operators. Each runs over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.llm import bpe, fingerprint, flac, lexical, linededup, minhash, mixing, orc_tokens, secrets, suffix, topk, toxicity, whitening
from authscope.llm.common import load_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load_documents(spark, sf_dir), RANKS)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(load_documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(load_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, toxicity.load_labels(spark, sf_dir)))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(load_documents(spark, sf_dir))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(load_documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(load_documents(spark, sf_dir), shingle=4)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load_documents(spark, sf_dir))


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.stored(load_documents(spark, sf_dir), TOKENIZER)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(load_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_mixing, op4_line_dedup, op5_toxicity, op6_flac, op7_suffix_repeats, op8_minhash, op9_secrets, op10_orc_tokens, op11_whitening, op12_lexical_search, op13_topk)
} | {"pipeline": corpus_pipeline.run}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_terms = lambda key, table: f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM {table}"

#: DuckDB SQL for what SQL can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op12_lexical_search": f"""
WITH d AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM ({_terms("doc_id", "documents")}) GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n), f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s), i AS (SELECT DISTINCT item_id, term FROM ({_terms("item_id", "benchmark")})),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score FROM i JOIN w USING (term) JOIN d USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
    "op13_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10""",
}
