"""Toxicity (operator 5): a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and, inside words that have letters, digits
and signs to the letters they stand for. Lexicon entries are whole words or beginnings of words; each weighs the log
of how much likelier it is in toxic documents. A document's weight is the sum over its words of the best entry, without
words inside an exception phrase, divided by the logarithm of its length; a logistic curve maps it to 0..1.

Weights and curve are learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0, from ``SAMPLE`` of them at
most (the least by a hash of the id): a documented bound on the fit alone. Every text is scored whole.
NULL and empty texts get the curve's value at no match. Rows of NULL id are scored and count as held out (their
remainder is NULL: false). Repeated rows each give a row; labels that conflict count as toxic. Without labelled rows of
both kinds the score is 0 for all. Other columns are left out (``clean`` keeps the input's).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.llm.common import slices

SAMPLE = 20_000
FOLDS = 5
#: Entries kept at most, and what an entry needs: documents that have it, a log ratio, and what is left of it after three standard errors.
ENTRIES, LEAST_DOCS, LEAST_WEIGHT, LEAST_SURE = 2_000, 4, 3.5, 0.3
PREFIXES = (4, 5, 6)
#: Phrases in which a lexicon word is harmless; a parameter.
EXCEPTIONS = ("trash can", "trash bin", "circus clown", "clown fish", "class clown")
#: Look-alikes of Latin letters in Cyrillic and Greek (fixed values), then digits and signs that stand for letters.
LOOK_ALIKES = str.maketrans("авекмнорстухіјѕԁһαεικνορτυχ", "abekmhopctyxijsdhaeiknoptux")
DIGITS = str.maketrans("013457@$!", "oieastasi")
MIXED = re.compile(r"[^\W\d_]*[013457@$!]+[^\W\d_][\w@$!]*|[^\W\d_]+[013457@$!]+[^\W\d_]+[\w@$!]*")
WORDS = re.compile(r"\w+")


class Model(NamedTuple):
    prefixes: dict[str, float]
    words: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    offset: float


def folded(text: str) -> list[str]:
    """Folded words of a text."""
    low = text.lower()
    if not low.isascii():
        low = "".join(chr(ord(x) - 0xFEE0) if "！" <= x <= "～" else x for x in low) if re.search("[！-～]", low) else low
        low = low.translate(LOOK_ALIKES) if re.search("[Ͱ-ԯ]", low) else low
    if re.search("[013457@$!]", low):
        low = MIXED.sub(lambda m: m[0].translate(DIGITS), low)
    return WORDS.findall(low)


def automaton(model: Model):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in model.prefixes.items():
        a.add_word(f" {k}", (len(k), w))
    for k, w in model.words.items():
        a.add_word(f" {k} ", (len(k) + 1, w))
    for k in model.exceptions:
        a.add_word(f" {' '.join(folded(k))} ", (len(" ".join(folded(k))) + 1, None))
    if len(a):
        a.make_automaton()
    return a


def weigh(words: list[str], a) -> float:
    """Length-normalised weight of a document's words."""
    if not words or not len(a):
        return 0.0
    best: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(f" {' '.join(words)} "):
        at = end - size
        if weight is None:
            free.append((at, end))
        elif weight > best.get(at, 0.0):
            best[at] = weight
    total = sum(w for at, w in best.items() if not any(x <= at < y - 1 for x, y in free))
    return total / math.log(math.e + len(words))


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, feature, docs): number of documents of the batch with each beginning of a word ('p...') and word ('w...')."""
    for b in slices(batches, "text"):
        counts: dict[tuple[int, str], int] = {}
        for t, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = set(folded(t or ""))
            for f in {f"w{w}" for w in words if 3 <= len(w) <= 24} | {f"p{w[:n]}" for w in words for n in PREFIXES if len(w) >= n}:
                counts[toxic, f] = counts.get((toxic, f), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["toxic", "feature", "docs"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most ``sample`` pairs of numbers


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Counts of features over the training rows are summed by Spark; the driver sees ``ENTRIES`` of them and two numbers a training row."""
    rows = training_rows(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        return Model({}, {}, exceptions, 0.0, -50.0)
    counted = rows.mapInArrow(features, "toxic int, feature string, docs long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    top = counted.where(F.col("t") >= LEAST_DOCS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT).where(F.col("w") - 3 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)) >= LEAST_SURE)
    kept = top.orderBy(F.desc("t"), F.desc("w"), "feature").limit(ENTRIES).collect()
    prefixes = {r["feature"][1:]: r["w"] for r in kept if r["feature"][0] == "p"}
    words = {r["feature"][1:]: r["w"] for r in kept if r["feature"][0] == "w" and not any(r["feature"][1 : 1 + n] in prefixes for n in PREFIXES)}
    model = Model(prefixes, words, exceptions, 1.0, 0.0)
    x = np.array([(r["z"], r["toxic"]) for r in rows.mapInArrow(weigher(model, "toxic"), "toxic int, z double").collect()], float).reshape(-1, 2)
    slope, offset = logistic(x[:, 0], x[:, 1])
    return model._replace(slope=slope, offset=offset)


def logistic(z: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a penalised logistic curve, by Newton steps."""
    a, theta = np.stack([z, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -40, 40)))
        w = p * (1 - p)
        theta = theta - np.linalg.solve((a * w[:, None]).T @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * theta)
    return float(theta[0]), float(theta[1])


def weigher(model: Model, also: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model)
        for b in slices(batches, "text"):
            z = [weigh(folded(t or ""), a) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(also), pa.array(z, pa.float64())], [also, "z"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    z = rows.mapInArrow(weigher(model, "id"), "id long, z double")
    p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("z") + F.lit(model.offset))))
    return z.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def load_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, columns as they were."""
    marks = docs.mapInArrow(keep_clean(model, text_col), docs.schema)
    return marks


def keep_clean(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model)
        for b in slices(batches, text_col):
            stays = [model.slope * weigh(folded(t or ""), a) + model.offset < 0 for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(stays, pa.bool_()))

    return run
