"""Byte-level BPE encoding and decoding (operator 1).

Array pre-tokenisation (:mod:`authscope.llm.pretoken`) gives slices; a bounded cache keeps the merged ids of each
distinct slice, so pairs are merged once for a slice and not once for each place. Ids travel as little-endian
unsigned 32-bit integers in a binary column, with the code-point offset of each slice and its number of ids.

NULL and empty texts give no ids and decode to no bytes; NULL ids keep their row; repeated rows are encoded alike;
columns other than the two named are left out, so clashing names do no harm. Texts of any length are read whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.llm.common import slices
from authscope.llm.pretoken import split

#: Distinct slices a worker keeps; beyond it the cache starts anew.
CACHE_SLICES = 300_000
#: Stands for the rank of a pair that no token joins.
NO_PAIR = np.iinfo(np.int64).max
ENCODED = "id long, ids binary, slice_offsets binary, slice_sizes binary"


class Merger(dict):
    """slice -> packed ids; missing slices are merged by rank, least rank first and leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int64)[order], NO_PAIR)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def look_up(self, found: list[str]) -> list[bytes]:
        """Packed ids of each slice; slices that are new are merged together, one merge of each a round."""
        out = list(map(self.get, found))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            fresh = list({found[i] for i in new})
            if len(self) + len(fresh) > CACHE_SLICES:
                self.clear()
                fresh = list(set(found))
                new = range(len(found))
            raw = [x.encode() for x in fresh]
            self.update(zip(fresh, self.merge([x for x in raw])))
            for i in new:
                out[i] = self[found[i]]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        ids: list[bytes | None] = [None] * len(pieces)
        short = []
        for k, raw in enumerate(pieces):
            if (rank := self.ranks.get(raw)) is not None:
                ids[k] = rank.to_bytes(4, "little")
            elif len(raw) > 64:
                ids[k] = np.array(self.merge_long(raw), "<u4").tobytes()
            else:
                short.append(k)
        if short:
            for k, packed in zip(short, self.merge_short([pieces[k] for k in short])):
                ids[k] = packed
        return ids

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys.take(at) == key, self.values.take(at), NO_PAIR)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """All pieces side by side in one array; each round merges the best pair of every piece that has one."""
        part = self.bytes.take(np.frombuffer(b"".join(pieces), np.uint8))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done_part, done_piece = [], []
        rank = np.full(len(part), NO_PAIR)  # of a part and the next of its piece
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.pair_ranks(part[inner], part[inner + 1])
        while len(part):
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(part)))
            ended = best == NO_PAIR
            if ended.any():
                gone = np.repeat(ended, counts)
                done_part.append(part[gone])
                done_piece.append(piece[gone])
                part, piece, rank, counts, best = part[~gone], piece[~gone], rank[~gone], counts[~ended], best[~ended]
                first = np.cumsum(counts) - counts
                if not len(part):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            at = hit[np.append(True, piece[hit[1:]] != piece[hit[:-1]])]  # leftmost of each piece
            part[at] = best
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            part, piece, rank = part[keep], piece[keep], rank[keep]
            at = at - np.arange(len(at))
            counts = counts - 1
            first = np.cumsum(counts) - counts
            last = first + counts - 1
            rank[at] = NO_PAIR
            r = at[at < last]
            rank[r] = self.pair_ranks(part[r], part[r + 1])
            le = at[at > first]
            rank[le - 1] = self.pair_ranks(part[le - 1], part[le])
        part, piece = np.concatenate(done_part), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        packed = part[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(piece, minlength=len(pieces))) * 4
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def merge_long(self, raw: bytes) -> list[int]:
        """The same for long slices: linked parts and a heap of pairs, n log n."""
        ranks, n = self.ranks, len(raw)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, to = heapq.heappop(heap)
            if not alive[i] or end[i] != j or end[j] != to:
                continue
            alive[j] = False
            end[i] = to
            if to < n:
                prev[to] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


@cache
def merger(path: str) -> Merger:
    with open(path, "rb") as f:
        return Merger({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in a row, where each id's start, and their lengths."""
    ranks = merger(path).ranks
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    raw = np.zeros(int(lengths.sum()), np.uint8)
    for token, i in ranks.items():
        raw[begins[i] : begins[i] + len(token)] = np.frombuffer(token, np.uint8)
    return raw, begins, lengths


def encode_texts(texts: list[str], table: Merger) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Of each text: packed ids, code-point offsets of its slices, number of ids of each slice."""
    found, offsets, first = split(texts)
    ids = table.look_up(found)
    sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
    at = first.tolist()
    return [(b"".join(ids[a:b]), offsets[a:b].astype("<u4"), sizes[a:b]) for a, b in zip(at, at[1:])]


def decode_ids(packed: list[bytes], path: str) -> list[bytes]:
    """Bytes of each list of ids: token bytes are gathered at running output offsets. Unknown ids raise."""
    raw, begins, lengths = vocabulary(path)
    ids = np.frombuffer(b"".join(packed), "<u4")
    if len(ids) and int(ids.max()) >= len(lengths):
        raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
    sizes = lengths.take(ids)
    ends = np.cumsum(sizes)
    source = np.repeat(begins.take(ids) - ends + sizes, sizes)
    source += np.arange(len(source))
    out = raw.take(source).tobytes()
    text_ends = np.concatenate(([0], ends))[np.cumsum([0] + [len(p) >> 2 for p in packed])].tolist()
    return [out[a:b] for a, b in zip(text_ends, text_ends[1:])]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, slice_offsets, slice_sizes): packed little-endian 32-bit arrays, one row for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = encode_texts([t or "" for t in b.column("text").to_pylist()], merger(path))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.binary()) for c in zip(*((i, o.tobytes(), s.astype("<u4").tobytes()) for i, o, s in rows)))], ["id", "ids", "slice_offsets", "slice_sizes"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of each row's packed ids; NULL ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids"):
            out = decode_ids([x or b"" for x in b.column("ids").to_pylist()], path)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_slices, decoded): :func:`encode` and :func:`decode` in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = encode_texts([t or "" for t in b.column("text").to_pylist()], merger(path))
            ids = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(decode_ids(ids, path), pa.binary())], ["id", "ids", "n_slices", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary, n_slices long, decoded binary")


def digests(df: DataFrame, path: str) -> DataFrame:
    """The contract's row for each document, from what :func:`round_trip` returns."""
    return round_trip(df, path).select(
        F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_slices",
    )
