"""Token ids as ORC files (operator 10).

Documents are range-partitioned by doc_id and sorted, tokenised in place, and written as ORC: the format's integer
run-length encoding for the ids, a row index every ``INDEX_STRIDE`` rows and a Bloom filter on doc_id, so readers
split by stripe and skip stripes and row groups by id. Every document ends with id 0.

NULL text counts as empty (its only id is 0); NULL ids come first; rows of equal id are written side by side, by a hash of the text, and ``start`` counts in that order.
Repeated rows each give a row; an empty table gives empty files. Other columns are left out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.llm.common import cut, ordered_prefix, shared_dir, slices

END = 0
INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20
#: Entries of a worker's caches; beyond it the newer half stays, so that frequent pieces do.
CACHE_PIECES = 300_000
#: A space that ends one piece and begins the next: no pattern match of the tokenizer crosses it.
CUT = re.compile(r" (?=\S)")
PLAIN = re.compile(r" (?!\S)")
#: Pieces of these signs only are cut into matches here; their classes are the same in every version of Unicode.
COMMON = re.compile(r"[\n!-~¡-ſ]+")
MATCH = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ſ²³¹¼-¾]+|\s+(?!\S)|\s+")
#: The sign by which a byte-level vocabulary writes each byte: itself if it prints, else the next one from code point 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = [chr(b) if b in _PRINTS else chr(256 + sum(x not in _PRINTS for x in range(b))) for b in range(256)]
SIGN_OF_CHAR = {chr(b): s for b, s in enumerate(BYTE_SIGNS) if b < 128}


class Cache(dict):
    """key -> packed ids, made on first use; at most twice ``CACHE_PIECES`` entries."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Library:
    """The library's tokenizer; pieces of common signs are cut into pattern matches, which its model takes one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.matches = Cache(self.match)
        self.heads, self.pieces = Cache(lambda p: self.piece(p)), Cache(lambda p: self.piece(" " + p))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def match(self, text: str) -> bytes:
        shown = "".join(map(SIGN_OF_CHAR.__getitem__, text)) if text.isascii() else "".join(map(BYTE_SIGNS.__getitem__, text.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def piece(self, text: str) -> bytes:
        if not COMMON.fullmatch(text, 1 if text[:1] == " " else 0):
            return self.whole(text)
        found = MATCH.findall(text)
        return self.match(found[0]) if len(found) == 1 else b"".join(map(self.matches.__getitem__, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if any(a in t for a in self.added):  # their own rules decide what surrounds them
                out.append(self.whole(t))
                continue
            p = CUT.split(t) if PLAIN.search(t) else t.split(" ")
            if len(p) > 1 and not p[0]:  # begins with a space that belongs to the first piece
                out.append(b"".join(map(self.pieces.__getitem__, p[1:])))
            else:
                out.append(self.heads[p[0]] + b"".join(map(self.pieces.__getitem__, p[1:])))
        return out


@cache
def library(path: str) -> Library:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Library(path)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text and ``END``."""
    tail = array("I", [END]).tobytes()
    return [np.frombuffer(x + tail, "<u4") for x in library(path).encode(texts)]


def tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, ids), in ascending order of doc_id over the partitions; ``tie``, a hash of the text, orders rows of equal id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = encode_texts([t or "" for t in b.column("text").to_pylist()], path)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).view(np.int32)))], ["doc_id", "tie", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(run, "doc_id long, tie long, ids array<int>")


def write(ids: DataFrame, path: str) -> None:
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    ids.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the stripe statistics, the row index and the Bloom filters."""
    return spark.read.schema("doc_id long, tie long, ids array<int>").orc(path)


def described(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): a running offset over all documents before it, and a checksum of the packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("ids")
            raw, ends = col.values.to_numpy(zero_copy_only=False).astype("<i4"), col.offsets.to_numpy()
            sums = [zlib.crc32(raw[a:e]) for a, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "tie", "n_tokens", "ids_crc32"])

    rows = cut(ids.mapInArrow(run, "doc_id long, tie long, n_tokens long, ids_crc32 long"))  # four numbers a row; the files are read once
    return ordered_prefix(rows, [], ["doc_id", "tie"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def stored(df: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids to ``folder`` (a new one in the shared folder if None) and describes what is read back."""
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(tokens(df, tokenizer_path, id_col, text_col), folder)
    return described(read(spark, folder))
