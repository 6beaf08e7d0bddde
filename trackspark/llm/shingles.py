"""Word shingles of notes as 64-bit hashes, a whole Arrow slice at a time."""

from __future__ import annotations

import numpy as np

WIDTH = 5                      # words of a shingle
BLOCK = 4 << 20                # bytes hashed at once; a longer slice is cut between words

_rng = np.random.default_rng(1127)
_odd = lambda n: _rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = _odd(256)
BYTE[ord("A"): ord("Z") + 1] = BYTE[ord("a"): ord("z") + 1]  # A-Z are lower-cased
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLACE = _odd(WIDTH)
STEP = int(_odd(1)[0])
BACK = pow(STEP, -1, 1 << 64)
_powers = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range: differences of one running sum, moved back to the origin."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _power(STEP, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _power(BACK, len(data))[start]
    return mix(h ^ (end - start).astype(np.uint64))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word); words are runs without ASCII white space and end with their row."""
    blank = SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[ends] = True
    word = ~blank
    first = word & np.concatenate(([True], blank[:-1]))[: len(data)]
    first |= word & breaks[:-1]
    last = word & (np.concatenate((blank[1:], [True]))[: len(data)] | breaks[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(ends, start, "right") - 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        a, b = start[at], end[to - 1]
        out[at:to] = _hash_words(data[a:b], start[at:to] - a, end[at:to] - a)
        at = to
    return out, row


def sets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash: (hashes, offsets of the rows).

    Fewer words than a shingle make one shingle of the whole row; a row without words has none.
    """
    h, row = words(data, ends)
    rows = len(ends) - 1
    count = np.bincount(row, minlength=rows)
    n = len(h)
    full = max(0, n - WIDTH + 1)
    mixed = np.zeros(full, np.uint64)
    for j in range(WIDTH):
        mixed += h[j: j + full] * PLACE[j]
    same = row[:full] == row[WIDTH - 1:] if full else np.zeros(0, bool)
    value, owner = mix(mixed[same]), row[:full][same]
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        begin = np.concatenate(([0], np.cumsum(count)))[few]
        short = np.zeros(len(few), np.uint64)
        for j in range(WIDTH - 1):
            has = count[few] > j
            short[has] += h[begin[has] + j] * PLACE[j]
        value = np.concatenate((value, mix(short ^ count[few].astype(np.uint64))))
        owner = np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))[: len(value)]
    value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
