"""Media columns (operator 6): FLAC streams of 8-bit samples, decoded into seekable PCM blocks.

The encoder writes blocks of 192 samples and picks, for each, the cheapest of a constant, fixed predictors of order 0 to
2, a linear predictor of order 4, and verbatim samples. The decoder reads constant, verbatim, fixed (0 to 4) and linear
(1 to 32) subframes with partitioned Rice residuals of both kinds and escapes, checks the CRC-8 of each header, the CRC-16 of
each frame and the stream's MD5, and raises on any mismatch. Frames of a whole Arrow batch are coded side by side: step
i handles sample i of every frame, so the work is array operations however the frames differ.

Streams are mono, of a fixed block size, 8 bits a sample. A text's payload is its UTF-8 with spaces appended up to a
positive multiple of 192; NULL counts as empty. Equal texts give equal streams. Rows of NULL id are coded as any other;
repeated rows each give rows; an empty table gives none. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authscope.llm.common import cut, slices

BLOCK = 192
RATE = 16_000
LPC_ORDER, LPC_SHIFT, LPC_PRECISION = 4, 9, 12
#: Coefficients of the fixed predictors (fixed values of the format).
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
ZEROS = np.zeros(16, np.uint8)


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint32)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each range; shorter ranges have zeros in front, which leave a CRC of initial 0 as it is."""
    crc = np.zeros(len(starts), np.uint32)
    longest = int((ends - starts).max()) if len(starts) else 0
    for back in range(longest, 0, -1):
        at = ends - back
        byte = np.where(at >= starts, buf.take(np.maximum(at, 0)), 0)
        crc = ((crc << 8) & ((1 << bits) - 1)) ^ table.take((crc >> (bits - 8)) ^ byte)
    return crc


def number_bytes(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    out, limit = [], 0x40
    while n >= limit:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        limit = 0x20 if limit == 0x40 else limit >> 1
    lead = {1: 0xC0, 2: 0xE0, 3: 0xF0, 4: 0xF8, 5: 0xFC}[len(out)]
    return bytes([lead | n, *out[::-1]])


class Bits:
    """Fields of many frames, each at its own bit position, put into one array of bits."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum((sizes + 7) // 8 * 8)
        self.pos = self.ends - (sizes + 7) // 8 * 8
        self.begin = self.pos.copy()
        self.bits = np.zeros(int(self.ends[-1]) if len(sizes) else 0, np.uint8)

    def put(self, rows: np.ndarray, value: np.ndarray, width: int) -> None:
        v = np.broadcast_to(np.asarray(value, np.int64), rows.shape)
        for j in range(width):
            self.bits[self.pos[rows] + j] = (v >> (width - 1 - j)) & 1
        self.pos[rows] += width


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame: quantised coefficients (latest sample first) and residuals of the linear predictor."""
    n, p = len(x), LPC_ORDER
    f = x.astype(np.float64)
    auto = np.stack([(f[:, k:] * f[:, : BLOCK - k]).sum(1) for k in range(p + 1)], 1)
    lag = np.abs(np.arange(p)[:, None] - np.arange(p))
    q = np.rint(np.linalg.solve(auto[:, :p][:, lag] + np.eye(p) * (1 + 1e-3 * auto[:, :1, None]), auto[:, 1 : p + 1, None])[:, :, 0] * (1 << LPC_SHIFT))
    q = np.clip(q, -(1 << (LPC_PRECISION - 1)), (1 << (LPC_PRECISION - 1)) - 1).astype(np.int64)
    guess = np.zeros((n, BLOCK - p), np.int64)
    for k in range(p):
        guess += q[:, k : k + 1] * x[:, p - 1 - k : BLOCK - 1 - k]
    return q, x[:, p:] - (guess >> LPC_SHIFT)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of ``x`` (frames by 192 signed samples) with the given frame numbers."""
    n = len(x)
    if not n:
        return []
    x = x.astype(np.int64)
    choices = [x]
    for _ in range(2):
        choices.append(np.diff(choices[-1], axis=1))
    coefficients, lpc = predictors(x)
    choices.append(lpc)
    warm = [0, 1, 2, LPC_ORDER]
    extra = [0, 0, 0, 4 + 5 + LPC_ORDER * LPC_PRECISION]
    cost, rice = [], []
    for r, w, e in zip(choices, warm, extra):
        u = np.where(r >= 0, 2 * r, -2 * r - 1)
        mean = u.mean(1)
        k = np.clip(np.floor(np.log2(np.maximum(mean, 0.5) * 0.7 + 1e-9)) + 1, 0, 14).astype(np.int64)
        cost.append((u >> k[:, None]).sum(1) + u.shape[1] * (k + 1) + 8 * w + e + 10)
        rice.append((u, k))
    verbatim = np.full(n, BLOCK * 8)
    constant = np.where((x == x[:, :1]).all(1), 8, 1 << 40)
    every = np.stack([*cost, verbatim, constant])
    pick = every.argmin(0)
    heads = [b"\xff\xf8" + bytes([0x10, 0x02]) + number_bytes(int(i)) for i in numbers]  # block size 192, rate of the stream; mono, 8 bits
    heads = [h + bytes([crc]) for h, crc in zip(heads, header_crcs(heads).tolist())]
    bits = Bits(every.min(0) + 8)
    all_rows = np.arange(n)
    kinds = np.array([0b001000, 0b001001, 0b001010, 0b100000 | LPC_ORDER - 1, 0b000001, 0b000000])
    bits.put(all_rows, kinds[pick] << 1, 8)
    rows = np.flatnonzero(pick == 5)
    bits.put(rows, x[rows, 0] & 0xFF, 8)
    rows = np.flatnonzero(pick == 4)
    for i in range(BLOCK):
        if not len(rows):
            break
        bits.put(rows, x[rows, i] & 0xFF, 8)
    codes = []
    for c, (w, (u, k)) in enumerate(zip(warm, rice)):
        rows = np.flatnonzero(pick == c)
        if not len(rows):
            continue
        for i in range(w):
            bits.put(rows, x[rows, i] & 0xFF, 8)
        if c == 3:
            bits.put(rows, LPC_PRECISION - 1, 4)
            bits.put(rows, LPC_SHIFT, 5)
            for i in range(LPC_ORDER):
                bits.put(rows, coefficients[rows, i] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        bits.put(rows, 0, 6)  # Rice parameters of 4 bits, one partition
        bits.put(rows, k[rows], 4)
        u, k = u[rows], k[rows][:, None]
        ends = bits.pos[rows][:, None] + np.cumsum((u >> k) + 1 + k, 1)
        bits.pos[rows] = ends[:, -1]
        codes.append(((1 << k | u & ((1 << k) - 1)).ravel(), np.broadcast_to(k + 1, u.shape).ravel(), ends.ravel()))
    packed = np.packbits(bits.bits)
    if codes:
        # a code's ones lie in its last k + 1 <= 15 bits, so in three bytes; codes share no bit, so sums are unions
        value, width, end = (np.concatenate(c) for c in zip(*codes))
        at = (end - width) >> 3
        value = value << (24 - ((end - width) & 7) - width)
        for j in range(3):
            add = np.bincount(at + j, (value >> (16 - 8 * j)) & 255, len(packed) + 3)[: len(packed)]
            packed = packed + add.astype(np.uint8)
    raw = packed.tobytes()
    body = [h + raw[a:b] for h, a, b in zip(heads, (bits.begin >> 3).tolist(), (bits.ends >> 3).tolist())]
    sizes = np.cumsum([0, *map(len, body)])
    sums = crcs(np.frombuffer(b"".join(body), np.uint8), sizes[:-1], sizes[1:], CRC16, 16)
    return [b + int(s).to_bytes(2, "big") for b, s in zip(body, sums)]


def header_crcs(heads: list[bytes]) -> np.ndarray:
    sizes = np.cumsum([0, *map(len, heads)])
    return crcs(np.frombuffer(b"".join(heads), np.uint8), sizes[:-1], sizes[1:], CRC8, 8)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose length is a positive multiple of 192; byte b is the sample b - 128."""
    counts = [len(p) // BLOCK for p in payloads]
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    frames = encode_frames(x, np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, int))
    out, at = [], 0
    for p, c in zip(payloads, counts):
        own = frames[at : at + c]
        at += c
        small, large = min(map(len, own)), max(map(len, own))
        info = BLOCK.to_bytes(2, "big") * 2 + small.to_bytes(3, "big") + large.to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        out.append(b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + b"".join(own))
    return out


class Reader:
    """Bit positions in one buffer, one for each frame."""

    def __init__(self, buf: np.ndarray, pos: np.ndarray):
        wide = np.concatenate([buf, ZEROS]).astype(np.uint64)
        n = len(buf) + 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= wide[j : j + n] << np.uint64(56 - 8 * j)
        self.pos = pos

    def peek(self, rows: np.ndarray) -> np.ndarray:
        p = self.pos[rows]
        return self.words.take(p >> 3, mode="clip") << (p & 7).astype(np.uint64)

    def take(self, rows: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned fields of up to 56 bits."""
        w = np.broadcast_to(np.asarray(width, np.int64), rows.shape)
        out = np.where(w > 0, self.peek(rows) >> np.minimum(64 - w, 63).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.pos[rows] += w
        return out

    def signed(self, rows: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.take(rows, width)
        half = np.left_shift(np.int64(1), np.maximum(np.asarray(width, np.int64) - 1, 0))
        return np.where((v & half) > 0, v - 2 * half, v) if np.ndim(half) else np.where(v >= half, v - 2 * half, v)

    def unary(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            top = (self.peek(rows[left]) >> np.uint64(11)).astype(np.float64)
            zeros = 53 - np.frexp(top)[1].astype(np.int64)
            found = (top > 0) & (zeros < 48)
            step = np.where(found, zeros, 48)
            out[left] += step
            self.pos[rows[left]] += step + found
            if int(out.max(initial=0)) > 1 << 24:
                raise ValueError("a residual has no end")
            left = left[~found]
        return out


def parameters(r: Reader, rows: np.ndarray, width: np.ndarray, k: np.ndarray, escaped: np.ndarray) -> None:
    """Reads the Rice parameter, or the escape and its width, of frames at the start of a partition."""
    k[rows] = r.take(rows, width[rows])
    esc = k[rows] == (1 << width[rows]) - 1
    escaped[rows] = esc
    if esc.any():
        k[rows[esc]] = r.take(rows[esc], 5)


def residuals(r, out, i, own, size, order, part, width, k, escaped, coefficients, shift, most, check=True) -> None:
    """Sample i of the frames ``own``, whatever their states."""
    if not len(own):
        return
    new = own[(i % part[own] == 0) | (order[own] == i)] if check else own[:0]
    if len(new):
        parameters(r, new, width, k, escaped)
    raw = escaped[own] == 1
    residual = np.zeros(len(own), np.int64)
    residual[raw] = r.signed(own[raw], k[own[raw]])
    rice = own[~raw]
    u = r.unary(rice) << k[rice]
    u |= r.take(rice, k[rice])
    residual[~raw] = (u >> 1) ^ -(u & 1)
    guess = np.zeros(len(own), np.int64)
    for j in range(most):
        guess += coefficients[own, j] * out[own, i - 1 - j]
    out[own, i] = residual + (guess >> shift[own])


def decode_frames(r: Reader, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the subframes that begin at the reader's bits, ``size`` each, and where they end."""
    n = len(r.pos)
    rows = np.arange(n)
    head = r.take(rows, 8)
    kind = head >> 1
    if (head & 0x81).any():
        raise ValueError("padding or wasted bits in a subframe header")
    out = np.zeros((n, size), np.int64)
    constant, verbatim = rows[kind == 0], rows[kind == 1]
    if len(constant):
        out[constant] = r.signed(constant, 8)[:, None]
    for i in range(size if len(verbatim) else 0):
        out[verbatim, i] = r.signed(verbatim, 8)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise ValueError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    coded = rows[fixed | linear]
    if not len(coded):
        return out, r.pos
    for i in range(int(order[coded].max())):
        own = coded[order[coded] > i]
        out[own, i] = r.signed(own, 8)
    most = int(order[coded].max())
    coefficients, shift = np.zeros((n, max(most, 1)), np.int64), np.zeros(n, np.int64)
    for o, values in FIXED.items():
        if 0 < o <= most:
            coefficients[rows[fixed & (order == o)], :o] = values
    lin = rows[linear]
    if len(lin):
        precision = r.take(lin, 4) + 1
        shift[lin] = r.signed(lin, 5)
        if (precision == 16).any() or (shift < 0).any():
            raise ValueError("a reserved precision or shift")
        for i in range(int(order[lin].max())):
            own = order[lin] > i
            coefficients[lin[own], i] = r.signed(lin[own], precision[own])
    method = r.take(coded, 2)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    width = np.zeros(n, np.int64)
    width[coded] = 4 + method
    part = np.zeros(n, np.int64)
    part[coded] = size >> r.take(coded, 4)
    k, escaped = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(most):
        residuals(r, out, i, coded[order[coded] <= i], size, order, part, width, k, escaped, coefficients, shift, min(most, i))
    # from here on every coded frame has its warm-up behind it: contiguous arrays, one a column
    done = np.ascontiguousarray(out[coded].T)
    taps, down, parts, first = np.ascontiguousarray(coefficients[coded].T), shift[coded], part[coded], order[coded]
    taps = taps[:most]
    for i in range(most, size):
        new = (i % parts == 0) | (first == i)
        if new.any():
            parameters(r, coded[new], width, k, escaped)
        if escaped[coded].any() if new.any() or i == most else raw:
            raw = True
            out[coded] = done.T
            residuals(r, out, i, coded, size, order, np.full(n, size + 1), width, k, escaped, coefficients, shift, most, False)
            done[i] = out[coded, i]
            continue
        raw = False
        if new.any() or i == most:
            kk = k[coded]
            keep = np.minimum(64 - kk, 63).astype(np.uint64)
        pos = r.pos[coded]
        window = r.words.take(pos >> 3, mode="clip") << (pos & 7).astype(np.uint64)
        zeros = 53 - np.frexp((window >> np.uint64(11)).astype(np.float64))[1]
        used = zeros + 1 + kk
        if int(used.max()) <= 53 and window.all():
            low = np.where(kk > 0, (window << (zeros + 1).astype(np.uint64)) >> keep, np.uint64(0)).astype(np.int64)
            u = (zeros.astype(np.int64) << kk) | low
            r.pos[coded] = pos + used
        else:
            u = r.unary(coded) << kk
            u |= r.take(coded, kk)
        x = (u >> 1) ^ -(u & 1)
        if most:
            guess = taps[0] * done[i - 1]
            for j in range(1, most):
                guess += taps[j] * done[i - 1 - j]
            x += guess >> down
        done[i] = x
    out[coded] = done.T
    return out, r.pos


def frame_starts(stream: np.ndarray, begin: int) -> tuple[list[int], list[int]]:
    """Bytes where frames 0, 1, 2, ... start and where their subframes do: sync code, right CRC-8 and the next number."""
    starts, bodies = [], []
    sync = np.flatnonzero((stream[begin:-1] == 0xFF) & (stream[begin + 1 :] == 0xF8)) + begin
    raw = stream.tobytes()
    for at in sync.tolist():
        number = number_bytes(len(starts))
        body = at + 4 + len(number) + 1
        head = raw[at : body - 1]
        if head[4:] == number and body <= len(raw):
            crc = 0
            for b in head:
                crc = int(CRC8[crc ^ b])
            if crc == raw[body - 1]:
                starts.append(at)
                bodies.append(body)
    return starts, bodies


def walked_starts(stream: np.ndarray, begin: int, size: int) -> tuple[list[int], list[int]]:
    """As ``frame_starts``, but a frame starts where the samples of the one before it end, so samples that look like a header don't matter. A frame at a time."""
    starts, bodies, at, r = [], [], begin, Reader(stream, np.zeros(1, np.int64))
    while at < len(stream):
        number = number_bytes(len(starts))
        body = at + 4 + len(number) + 1
        head = stream[at : body - 1].tobytes()
        if head[:2] != b"\xff\xf8" or head[4:] != number or body >= len(stream) or header_crcs([head])[0] != stream[body - 1]:
            raise ValueError("a frame's header is wrong")
        r.pos = np.array([8 * body])
        _, stop = decode_frames(r, size)
        starts.append(at)
        bodies.append(body)
        at = int(stop[0] + 7) // 8 + 2
    return starts, bodies


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Of each stream: the payload, and of each block its first sample and its byte offset in the stream. Raises on any failed check.

    Frames are looked for by their headers. About one byte in 2 ** 32 looks like the next one's and isn't, so where a check fails each stream is read alone, and
    one that fails again frame by frame.
    """
    try:
        return decoded(streams)
    except ValueError:
        return [decode([s])[0] for s in streams] if len(streams) > 1 else decoded(streams, True)


def decoded(streams: list[bytes], walk: bool = False) -> list[tuple[bytes, list[tuple[int, int]]]]:
    starts, bodies, counts, base, infos = [], [], [], 0, []
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, info = 4, False, b""
        while not last:
            last, kind, size = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
            info = s[at + 4 : at + 4 + size] if kind == 0 else info
            at += 4 + size
        packed = int.from_bytes(info[10:18], "big")
        if info[:2] != info[2:4] or (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
            raise ValueError("only mono streams of 8 bits and a fixed block size are read")
        own = np.frombuffer(s, np.uint8)
        a, b = walked_starts(own, at, int.from_bytes(info[:2], "big")) if walk else frame_starts(own, at)
        infos.append((int.from_bytes(info[:2], "big"), packed & (1 << 36) - 1, info[18:34], a, len(s)))
        starts += [base + x for x in a]
        bodies += [base + x for x in b]
        counts.append(len(a))
        base += len(s)
    buf = np.frombuffer(b"".join(streams), np.uint8)
    begin = np.array(starts, np.int64)
    stream_ends = np.cumsum([len(s) for s in streams])
    ends = np.append(begin[1:], 0)
    firsts = np.cumsum([0, *counts])
    for k in range(len(streams)):
        if counts[k]:
            ends[firsts[k + 1] - 1] = stream_ends[k]
    if crcs(buf, begin, ends, CRC16, 16).any():  # over a frame and its own CRC it comes to 0
        raise ValueError("a frame's CRC-16 is wrong")
    sizes = {i[0] for i in infos}
    if len(sizes) > 1:
        raise ValueError("block sizes differ between streams of a batch")
    size = sizes.pop() if sizes else BLOCK
    samples, stop = decode_frames(Reader(buf, np.array(bodies, np.int64) * 8), size) if starts else (np.zeros((0, size), np.int64), np.empty(0, np.int64))
    if len(stop) and ((stop + 7) // 8 + 2 != ends).any():
        raise ValueError("a frame ends elsewhere than its samples")
    out = []
    for k, (n, total, md5, own, _) in enumerate(infos):
        pcm = samples[firsts[k] : firsts[k + 1]].astype(np.int8).reshape(-1)[:total]
        if len(pcm) != total or hashlib.md5(pcm.tobytes()).digest() != md5:
            raise ValueError("the samples do not match the stream's length and MD5")
        out.append(((pcm.view(np.uint8) ^ 0x80).tobytes(), [(i * n, at) for i, at in enumerate(own)]))
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_500_000):
            made = [payload(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([n for _, n in made], pa.int64()), pa.array(encode([p for p, _ in made]), pa.binary())], ["id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def blocks(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, sample_offset, byte_offset, pcm): the PCM blocks of each stream; a reader can seek by either offset. NULL media gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 1_500_000):
            ids, rows = b.column("id").to_pylist(), []
            for i, (pcm, at) in zip(ids, decode(b.column("media").to_pylist())):
                rows += [(i, s, o, pcm[s : s + BLOCK]) for s, o in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "sample_offset", "byte_offset", "pcm"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).where("media is not null")
    return rows.mapInArrow(run, "id long, sample_offset long, byte_offset long, pcm binary")


def feature(pcm: np.ndarray) -> str:
    """Mean, root mean square, peak and zero crossings of signed samples."""
    x = pcm.astype(np.float64)
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())}"


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document, of what is read back from its stream, which is stored in the shared folder first."""
    stored = cut(to_media(df, id_col, text_col), compression="zstd")  # frame headers and repeated texts shrink

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 1_500_000):
            media, rows = b.column("media").to_pylist(), []
            for n, m, (back, at) in zip(b.column("n_bytes").to_pylist(), media, decode(media)):
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(back, np.uint8).astype(np.int16) - 128), len(at)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"])

    return stored.mapInArrow(run, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long")
