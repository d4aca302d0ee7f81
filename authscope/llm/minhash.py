"""MinHash near-dedup (operator 8) by min-max hashing.

A document is the set of its distinct word shingles. Under each of ``PERMUTATIONS`` hash functions both the least and the
greatest value are kept, so each evaluation gives two values of the signature. Bands of ``ROWS`` values (fewer for a similarity
under ``PERCENT``, see ``rows_for``) make buckets; documents of equal sets stand as one. Candidates are confirmed on the full sets, and the confirmed
links' components are the groups; each keeps its smallest doc_id.

NULL text counts as empty; texts without words have an empty set and link with nothing. Rows of NULL id link with
nothing, have a NULL component and are kept. Rows of equal id are one document, linked through each of their texts. Repeated
rows each give a row. An empty table gives no rows. Other columns are left out (``dedup`` keeps the input's).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authscope.llm.common import cut, forget, linked, slices, unused
from authscope.llm.wordhash import Words, mixed

PERMUTATIONS = 96
ROWS = 6
SHINGLE = 5
PERCENT = 80
#: The chance that all bands miss a pair of exactly the similarity asked for is at most this.
MISSED = 1e-4
#: Of the 192 values of two signatures, by their low four bits, at most so many differ for a candidate: 4.5 standard deviations above what 80 % allow.
MOST_DIFFERENT = 60
SKETCH = [f"s{j}" for j in range(12)]
#: Cells of a set's parities: two sets differ in at least as many shingles as cells.
CELLS = 2048
SIGNATURES = "id long, n long, key binary, bands array<long>, odd array<long>, " + ", ".join(f"{c} long" for c in SKETCH)

_rng = np.random.default_rng(20_240_601)
_mul = _rng.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_band_mul = _rng.integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def rows_for(percent: int) -> int:
    """Values in a band: the most, up to ``ROWS``, with which pairs of ``percent`` are missed by at most ``MISSED``."""
    values = 2 * PERMUTATIONS
    for rows in range(ROWS, 0, -1):
        if values % rows == 0 and (1 - (min(percent, 100) / 100) ** rows) ** (values // rows) <= MISSED:
            return rows
    raise ValueError(f"{values} values cannot find pairs of {percent} per cent")


def sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    w = Words(texts)
    runs = w.runs(k)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w.hashes[a:b]:
                h = mixed(np.array([h ^ x]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    """Least and greatest value under each hash function; a long set is folded piece by piece."""
    low = high = None
    for i in range(0, len(s), 4096):
        v = (s[i : i + 4096, None] * _mul + _add) >> np.uint64(32)
        a, b = v.min(0), v.max(0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate((low, high))


def parities(s: np.ndarray) -> np.ndarray:
    """For each of ``CELLS`` cells of the hash space, whether an odd number of the set's shingles falls there, as bits."""
    return np.packbits(np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) & 1).view(np.int64)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rows: int = ROWS) -> DataFrame:
    """(id, n, key, bands, odd, s0, ..., s11): set size, a digest of the set, band hashes, parities and four bits of each value of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = sets_of([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            sketch = np.zeros((len(sets), len(SKETCH)), np.int64)
            if full:
                sig = np.stack([signature(sets[k]) for k in full])
                low = (mixed(sig) & np.uint64(15)).astype(np.uint8)
                sketch[full] = np.ascontiguousarray(low[:, 0::2] << 4 | low[:, 1::2]).view(np.int64)
                cut_sig = sig[:, np.random.default_rng(1).permutation(sig.shape[1])[: sig.shape[1] // rows * rows]].reshape(len(full), -1, rows)
                hashed = mixed((cut_sig * _band_mul[:rows]).sum(2, dtype=np.uint64) + np.arange(cut_sig.shape[1], dtype=np.uint64)).view(np.int64)
                for k, h in zip(full, hashed):
                    bands[k] = h
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(len(SKETCH)))],
                ["id", "n", "key", "bands", "odd", *SKETCH],
            )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SIGNATURES)


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """(id, key, items): a digest of the set, and the full set, of each row of ``df(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = sets_of([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()], shingle)
            keys = pa.array([digest(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "key", "items"])

    return df.mapInArrow(run, "id long, key binary, items array<long>")


def narrowed(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``placed(k, node, n, x, comp)`` that may still link with one of their bucket; ``x`` gets ``c``.

    ``c`` counts the shingles of a set that any other of ``sets(node, item)`` has too, so no intersection is larger: two sets of n
    and m shingles link only if the smaller c comes to ``percent`` of n + m - c. Texts with many words of their own thus go
    without being compared. Exact.
    """
    asked = sets.join(placed.select("node").distinct().hint("merge"), "node")
    own = asked.select("node", F.explode("item").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).where("times = 1")
    single = asked.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).where("sets = 1").select("node")  # of an id of several texts nothing goes
    own = own.groupBy("node").agg(F.count(F.lit(1)).alias("alone")).join(single.hint("merge"), "node")
    counted = placed.join(own.hint("merge"), "node", "left")
    counted = counted.select("k", "node", "n", F.col("x").withField("c", F.col("x.n") - F.coalesce("alone", F.lit(0))).alias("x"), "comp")
    least = placed.groupBy("k").agg(F.min("x.n").alias("_least"))
    return counted.join(least.hint("merge"), "k").where(100 * F.col("x.c") >= percent * (F.col("x.n") + F.col("_least") - F.col("x.c"))).select("k", "node", "n", "x", "comp")


def near(percent: int):
    """A necessary condition on two sets: sizes, sketches and, where known, what each shares with any other."""

    def condition(x: str, y: str) -> Column:
        def values(s: str) -> Column:  # the number of fours of bits that differ
            d = f"({x}.{s} ^ {y}.{s})"
            return F.expr(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & {0x1111111111111111})")

        differ = sum((values(s) for s in SKETCH), F.lit(0))
        sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
        shared = F.coalesce(F.least(f"{x}.c", f"{y}.c"), F.least(f"{x}.n", f"{y}.n"))  # least() leaves NULLs out
        sizes = sizes & (100 * shared >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - shared))
        return sizes & (differ <= MOST_DIFFERENT) if percent >= PERCENT else sizes

    return condition


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``df``."""
    sig = cut(signatures(df, id_col, text_col, shingle, rows_for(percent)))
    reps = sig.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("node"))
    whole = sig.alias("s").join(reps.hint("merge").alias("r"), (F.col("s.key") == F.col("r.key")) & (F.col("s.id") == F.col("r.node")))
    # an id of several texts is one node, and so may have several sets
    own = cut(whole.select("r.node", "s.key", "s.n", F.lit(None).cast("long").alias("c"), "s.bands", "s.odd", *[f"s.{c}" for c in SKETCH]).dropDuplicates(["node", "key"]))

    def load(nodes: DataFrame) -> DataFrame:
        """Full sets of the nodes asked for: one shuffle of the texts."""
        texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        asked = own.select("node", "key").join(nodes.hint("merge"), "node")
        sets = shingle_sets(texts.join(nodes.withColumnRenamed("node", "id").hint("shuffle_hash"), "id"), shingle)
        rows = sets.join(asked.hint("merge"), (F.col("id") == F.col("node")) & (sets.key == asked.key)).select("node", F.col("items").alias("item"))
        return rows.dropDuplicates(["node", "item"])

    def agreed(pairs: DataFrame) -> DataFrame:
        return pairs.where((100 + percent) * F.size(F.array_intersect("x", "y")).cast("long") >= percent * (F.size("x") + F.size("y")).cast("long"))

    def narrow(placed: DataFrame, sets: DataFrame) -> DataFrame:
        few = narrowed(placed, sets, percent)
        bands = own.select("node", F.xxhash64("key").alias("_d"), "bands", "odd")
        met = few.join(bands.hint("merge"), "node").where(F.col("x.d") == F.col("_d"))
        return met.select("k", "node", "n", F.col("x").withField("bands", F.col("bands")).withField("odd", F.col("odd")).alias("x"), "comp")

    def last(k: str, x: str, y: str) -> Column:
        """No more parities differ than ``percent`` allows of shingles (exact), and ``k`` is the first band that both have."""
        differ = F.aggregate(F.zip_with(f"{x}.odd", f"{y}.odd", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, v: a + v)
        few = (100 + percent) * differ <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))
        return few & (F.get(F.array_intersect(f"{x}.bands", f"{y}.bands"), F.lit(0)) == F.col(k))

    attrs = own.withColumn("d", F.xxhash64("key")).drop("bands", "odd", "key")
    labels = linked(own.select("node", F.explode("bands").alias("k")).distinct(), attrs, near(percent), load, agreed, narrow=narrow, last=last)
    forget(own)
    named = sig.select("id", "n", "key").join(reps, "key", "left")
    # rows of one id with several texts join their texts' groups through the id itself
    named = named.join(labels.withColumnRenamed("node", "_node").hint("merge"), F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "node", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose document is the first of its group; columns as they were."""
    [name] = unused(df, "_gone")
    gone = groups(df, id_col, text_col, shingle, percent).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return df.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
