"""Words of UTF-8 texts as 64-bit hashes, a buffer at a time in numpy.

A word is a maximal run of bytes that a 256-entry table maps to non-zero; the
table also lower-cases A-Z.  Both word rules used here are byte rules: every
byte of a non-ASCII character is 0x80 or more and belongs to a word.
"""

from __future__ import annotations

import numpy as np

from ledgerscope.llm.common import STEP_BYTES, mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def byte_table(is_word) -> np.ndarray:
    """Table from byte to lower-cased byte, 0 for bytes outside words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        out[b] = low if is_word(low) else 0
    return out


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters, non-ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words ``[^\x20\x09-\x0D]+`` after lower-casing; byte 0 is a word byte there and stands as 0xFF,
#: which UTF-8 never holds.
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
SPACED[0] = 0xFF


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("n", 0)
    if have < n:
        n = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def _segment(low: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of one segment; ``breaks`` end words before them."""
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    first[breaks] = inside[breaks]
    ended = breaks[breaks > 0] - 1
    last[ended] = inside[ended]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[:len(low)], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix64(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def scan(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """``(starts, ends, hashes, row_first)`` of all words of the rows.

    ``row_first`` (rows + 1) gives each row's range in the other three.  Works
    in segments cut where a word ends, so a long text needs no long temporary
    unless it is one long word.
    """
    low = table[raw]
    cuts = offsets[1:-1]
    parts, at, n = [], 0, len(low)
    while at < n:
        end = min(n, at + STEP_BYTES)
        if end < n:
            gaps = np.flatnonzero(low[at:end] == 0)
            row = int(cuts[np.searchsorted(cuts, end, side="right") - 1]) if len(cuts) and cuts[0] <= end else 0
            best = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, row)
            if best <= at:
                later = np.flatnonzero(low[end:] == 0)
                best = end + int(later[0]) + 1 if len(later) else n
                after = np.searchsorted(cuts, end, side="right")
                if after < len(cuts):
                    best = min(best, int(cuts[after]))
            end = best
        lo, hi = np.searchsorted(cuts, at, side="left"), np.searchsorted(cuts, end, side="left")
        s, e, h = _segment(low[at:end], cuts[lo:hi] - at)
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    return starts, ends, hashes, np.searchsorted(starts, offsets, side="left")


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position (``len - k + 1`` of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i:i + n]
    return mix64(out ^ np.uint64(k))
