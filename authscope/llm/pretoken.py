"""Splits texts as the byte-level BPE pattern does, with arrays in place of a regular expression.

Each code point gets a symbol from its class and its next neighbour's; a small automaton over these symbols says
where a slice starts. Its transition functions form a finite monoid, whose product is associative, so the states at
all positions come from a blocked prefix scan of table look-ups.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
#: Symbols: a space or other white space with more of it (or the end) next, the same before something else, and so on.
SP_MORE, SP_LAST, WS_MORE, WS_LAST, LET, NUM, OTH, AP1, AP2 = range(9)
SYMBOLS = 9
#: States: nothing before, after a space that the next slice takes, after white space, in letters, numbers, others, one or two letters before a contraction's end, after it.
START, GLUE, BLANK, IN_L, IN_N, IN_O, NEED1, NEED2, DONE = range(9)
STATES = 9
#: Code points of Unicode's White_Space property (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts here."""
    blank = state in (GLUE, BLANK)
    if symbol in (SP_MORE, WS_MORE):
        return BLANK, not blank
    if symbol in (SP_LAST, WS_LAST):
        return (GLUE if symbol == SP_LAST else BLANK), True
    if symbol == LET and state in (NEED1, NEED2):
        return (DONE if state == NEED1 else NEED1), False
    own = {LET: IN_L, NUM: IN_N}.get(symbol, IN_O)
    joined = state in (GLUE, own)
    if symbol in (AP1, AP2) and not joined:
        return (NEED1 if symbol == AP1 else NEED2), True
    return own, not joined


@cache
def tables() -> tuple[np.ndarray, ...]:
    """Class of each code point; generator of each symbol; product, action and slice-start tables of the monoid."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    kinds[:] = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[WHITE_SPACE] = WHITE
    kinds[32] = SPACE
    maps: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
    plain = [tuple(step(s, a)[0] for s in range(STATES)) for a in range(SYMBOLS)]
    generators = plain + [tuple([m[START]] * STATES) for m in plain]  # the second half begins a text
    todo = []
    for g in generators:
        if g not in maps:
            maps[g] = len(maps)
            todo.append(g)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in maps:
                maps[h] = len(maps)
                todo.append(h)
    act = np.array(list(maps), np.uint8)
    n = len(act)
    product = np.empty((n, n), np.uint16)
    for a in range(n):
        for b in range(n):
            product[a, b] = maps[tuple(act[b][act[a]].tolist())]
    starts = np.array([[step(s, a)[1] for a in range(SYMBOLS)] for s in range(STATES)], bool)
    return kinds, np.array([maps[g] for g in generators], np.uint16), product.ravel(), act, starts


def scan(f: np.ndarray, product: np.ndarray, act: np.ndarray) -> np.ndarray:
    """State after each position, from START, for transition functions given by number."""
    n, size = len(f), len(act)
    width = max(16, int(n**0.5))
    rows = -(-n // width)
    a = np.zeros(rows * width, np.uint16)
    a[:n] = f
    a = np.ascontiguousarray(a.reshape(rows, width).T)
    for j in range(1, width):
        a[j] = product.take(a[j - 1].astype(np.int64) * size + a[j])
    state, begin = START, np.empty(rows, np.int64)
    for r, total in enumerate(a[-1].tolist()):
        begin[r] = state
        state = int(act[total, state])
    return act.ravel().take(a.astype(np.int64) * STATES + begin).T.reshape(-1)[:n]


def boundaries(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where slices start, in the code points of several texts joined; ``begins``: where each non-empty text does."""
    kinds, generator, product, act, starts = tables()
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = kinds.take(points)
    first = np.zeros(n + 3, bool)
    first[begins] = True
    first[n:] = True
    white = kind <= WHITE
    more = np.ones(n, bool)  # white space or the text's end comes next
    more[:-1] = white[1:] | first[1:n]
    symbol = np.array([SP_MORE, WS_MORE, LET, NUM, OTH], np.uint8).take(kind)
    symbol[white & ~more] += 1
    for at in np.flatnonzero(points == 39):
        if at + 1 < n and not first[at + 1]:
            b = points[at + 1]
            if b in (115, 116, 109, 100):  # s t m d
                symbol[at] = AP1
            elif at + 2 < n and not first[at + 2] and (int(b), int(points[at + 2])) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
                symbol[at] = AP2
    state = scan(generator.take(symbol + SYMBOLS * first[:n].astype(np.uint8)), product, act)
    before = np.empty(n, np.uint8)
    before[0] = START
    before[1:] = state[:-1]
    before[begins] = START
    return np.flatnonzero(starts.ravel().take(before.astype(np.int64) * SYMBOLS + symbol))


def segments(text: str, most: int = 1_000_000) -> list[str]:
    """Pieces of a very long text, cut where a slice surely starts: at a space after something else."""
    out, at = [], 0
    while len(text) - at > most:
        to = at + most
        while to < len(text) and not (text[to] == " " and not text[to - 1].isspace()):
            to += 1
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Slices of all texts in order, the code point in its text where each starts, and the first slice of each text (and one past the last)."""
    parts = [(k, s) for k, t in enumerate(texts) for s in (segments(t) if len(t) > 1_000_000 else (t,)) if s]
    found, offsets, owner = [], [], []
    group, held, shift = [], 0, {}
    for k, s in [*parts, (None, None)]:
        if group and (s is None or held + len(s) > 1_500_000):
            joined = "".join(x for _, x in group)
            sizes = np.array([len(x) for _, x in group])
            begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            at = boundaries(points, begins)
            ends = [*at[1:].tolist(), len(joined)]
            found += [joined[a:b] for a, b in zip(at.tolist(), ends)]
            piece = np.searchsorted(begins, at, "right") - 1
            base = []
            for (o, x) in group:
                base.append(shift.get(o, 0))
                shift[o] = base[-1] + len(x)
            offsets.append(at - begins[piece] + np.array(base)[piece])
            owner.append(np.array([o for o, _ in group])[piece])
            group, held = [], 0
        if s is not None:
            group.append((k, s))
            held += len(s)
    own = np.concatenate(owner) if owner else np.empty(0, np.int64)
    return found, np.concatenate(offsets) if offsets else np.empty(0, np.int64), np.searchsorted(own, np.arange(len(texts) + 1))
