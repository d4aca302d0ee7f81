"""Findings of round 4 on the corpus operators."""

import random

import numpy as np

from authscope.llm import flac, linededup


def noise(rng, n: int) -> bytes:
    """Bytes of UTF-8 that lie far apart: no predictor takes them, so their samples are stored as they are."""
    out = b""
    while len(out) < n:
        out += bytes([rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 122, 123, 124, 125, 126, 127, 11, 14))]) if rng.random() < 0.5 else chr(rng.choice((0xC0, 0xFF, 0x7C0, 0x7C1, 0x7D0, 0x7FE, 0x7FF))).encode()
    return out


def planted() -> str:
    """A text whose first block holds the bytes of a header of frame 1: sync code, number 1 and their CRC-8."""
    rng = random.Random(5)
    for a in range(32, 127):
        head = b"\xff\xf8" + bytes([a ^ 0x80, 0x43, 0x01])
        crc = int(flac.header_crcs([head])[0])
        if crc >= 0xA0:  # the samples are the bytes less 128, so this is ASCII in the text
            return (noise(rng, 60) + bytes(x ^ 0x80 for x in (*head, crc)) + noise(rng, 400)).decode()
    raise AssertionError


def test_flac_samples_that_look_like_a_header(spark):
    """reading failed at any sample bytes that look like the next frame's header; some streams in 6 GB of texts have them."""
    text = planted()
    p = flac.payload(text)[0]
    stream = flac.encode([p])[0]
    looked, walked = flac.frame_starts(np.frombuffer(stream, np.uint8), 42)[0], flac.walked_starts(np.frombuffer(stream, np.uint8), 42, flac.BLOCK)[0]
    assert looked != walked and len(walked) == len(p) // flac.BLOCK  # the text does what it is made for
    others = [flac.payload(t)[0] for t in ("one", None, "two " * 300)]
    got = flac.decode(flac.encode([others[0], p, *others[1:]]))
    assert [back for back, _ in got] == [others[0], p, *others[1:]]
    assert [s for s, _ in got[1][1]] == list(range(0, len(p), flac.BLOCK))
    assert [at for _, at in got[1][1]] == walked
    rows = flac.round_trip(spark.createDataFrame([(1, "one"), (2, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.payload_bytes, r.n_blocks) for r in rows} == {1: (192, 1), 2: (len(p), len(p) // 192)}


def test_scattered_edits_and_lines_of_any_length(spark):
    """lines of few words or of no spaces, edits all over a line, and long lines with edits in each quarter."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))

    def words(n, k):
        a = [word() for _ in range(n)]
        return " ".join(a), " ".join("".join(rng.sample("qrstuvwxyz", len(x))) if i in spots else x for spots in [set(rng.sample(range(n), k))] for i, x in enumerate(a))

    def letters(line, k):
        at = set(rng.sample([i for i, c in enumerate(line) if c != " "], k))
        return line, "".join("z" if i in at else c for i, c in enumerate(line))

    kinds = {
        "six of 40 words": lambda: words(40, 6), "25 of 200 words": lambda: words(200, 25), "three of 20 words": lambda: words(20, 3), "one of ten words": lambda: words(10, 1),
        "a letter in one word": lambda: letters("".join(rng.sample("abcdefghijklmnop", rng.randint(5, 12))), 1), "two letters in three words": lambda: letters(" ".join(word() + "ab" for _ in range(3)), 2),
        "no spaces": lambda: letters("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(120)), 6), "eight letters in 40 words": lambda: letters(words(40, 0)[0], 8),
    }
    rows, of = [], []
    for kind, make in kinds.items():
        for _ in range(20):
            rows += [(len(rows) + i, x) for i, x in enumerate(make())]
            of.append(kind)
    kept = {r.doc_id: r.n_kept for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(kept[2 * i] == 1 for i in range(len(of)))
    found = {kind: np.mean([kept[2 * i + 1] == 0 for i, k in enumerate(of) if k == kind]) for kind in kinds}
    assert all(x >= 0.9 for x in found.values()), found
