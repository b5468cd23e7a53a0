"""Where the pieces of byte-level BPE begin, found without a regular expression.

The pattern is: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of digits or of other characters each with an
optional space before it, and white space, of which the last space before a piece belongs to that piece.

Each code point gets a class from a table and from its neighbours (an apostrophe that a contraction may follow, the last
white space before something else). Eight states then say what is being read, and each class is a function from state to
state. Such functions compose associatively, so the states after all code points of many texts are a prefix scan: blocks
of positions are folded side by side, the folds are scanned, and the blocks are walked again from their known states.
The functions that compositions can reach are few and are numbered once, so composing two is one table lookup.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SHORT, LONG, JOINED, LAST, BLANK = range(8)  # SHORT, LONG: an apostrophe with a contraction of 1 or 2 letters
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
BLOCK = 128
#: Unicode's White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts with this code point."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if kind in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ONE_MORE if kind == SHORT else TWO_MORE), True
    if kind in (LETTER, NUMBER, OTHER):
        own = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[kind]
        return own, state not in (own, AFTER_SPACE)
    if kind == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if kind == JOINED else FRESH), True


@cache
def kinds() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER for each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    by_category = {"L": LETTER, "N": NUMBER}
    for c in range(0x40000):  # planes above have no letters and numbers
        out[c] = by_category.get(unicodedata.category(chr(c))[0], OTHER)
    out[WHITE] = BLANK
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and piece start by (state, symbol); function by symbol; composition; state after a function from FRESH.

    A symbol is a class, plus 8 where a text begins: there the function is constant, as if the state were FRESH.
    """
    steps = [[_step(s if x < 8 else FRESH, x % 8) for x in range(16)] for s in range(8)]
    after = np.array([[a for a, _ in row] for row in steps], np.uint8)
    begins = np.array([[b for _, b in row] for row in steps])
    symbols = [tuple(int(after[s, x]) for s in range(8)) for x in range(16)]
    number: dict[tuple[int, ...], int] = {}
    queue = [tuple(range(8)), *symbols]
    while queue:  # all compositions of the sixteen functions
        f = queue.pop()
        if f not in number:
            number[f] = len(number)
            queue += [tuple(g[s] for s in f) for g in symbols]
    compose = np.array([[number[tuple(g[s] for s in f)] for g in number] for f in number], np.int32)
    return after.ravel(), begins.ravel(), np.array([number[f] for f in symbols], np.int32), compose, np.array([f[FRESH] for f in number], np.uint8)


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    out = raw[at].astype(np.int32)
    high = np.flatnonzero(out >= 0x80)
    if len(high):
        b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
        p, lead = at[high], out[high]
        two = (lead & 0x1F) << 6 | b[p + 1]
        three = (lead & 0x0F) << 12 | b[p + 1] << 6 | b[p + 2]
        four = (lead & 0x07) << 18 | b[p + 1] << 12 | b[p + 2] << 6 | b[p + 3]
        out[high] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return out, at


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of each code point; firsts: where texts begin."""
    n = len(points)
    out = kinds()[points]
    begins = np.zeros(n + 3, bool)
    begins[firsts] = True
    begins[n:] = True
    blank = np.flatnonzero(out == BLANK)
    last = blank[~begins[blank + 1] & (np.append(out, BLANK)[blank + 1] != BLANK)]
    out[last] = np.where(points[last] == 0x20, JOINED, LAST)
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        ahead = np.append(points, [0, 0, 0])
        one, two = ahead[quote + 1], ahead[quote + 2]
        near, far = ~begins[quote + 1], ~begins[quote + 1] & ~begins[quote + 2]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        pair = one * 256 + np.minimum(two, 255)
        long = far & np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (two < 255)
        out[quote[short]] = SHORT
        out[quote[long]] = LONG
    out[firsts[firsts < n]] += 8
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which pieces begin, in texts of UTF-8 that lie one after another between offsets."""
    after, begins, functions, compose, from_fresh = _tables()
    points, at = code_points(raw)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = _symbols(points, np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0]))
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat, m = compose.ravel(), len(compose)
    fold = functions[grid[0]]
    for k in range(1, BLOCK):
        fold = flat[fold * m + functions[grid[k]]]
    step = 1
    while step < blocks:  # prefix compositions, over twice as many blocks each time
        fold = np.concatenate([fold[:step], flat[fold[:-step] * m + fold[step:]]])
        step *= 2
    state = np.concatenate([[FRESH], from_fresh[fold[:-1]]]).astype(np.intp)
    found = np.empty((BLOCK, blocks), bool)
    for k in range(BLOCK):
        place = state * 16 + grid[k]
        found[k] = begins[place]
        state = after[place].astype(np.intp)
    return at[np.flatnonzero(found.T.ravel()[:n])]
