"""A skip-and-fold lookup table over code points, and rolling polynomial hashes computed through it.

The table maps a code point to 0 (skip) or to the code point of its lower case. It is filled page by page from Python's
character database as pages turn up, so no table is stored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = np.uint64(2**31 - 1)
BASES = (np.uint64(1_000_003), np.uint64(918_273_647))

_lut = np.zeros(0x110000, dtype=np.uint32)
_pages = np.zeros(0x1100, dtype=bool)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64) for _ in BASES]


def _fill(page: int) -> None:
    for c in range(page << 8, (page + 1) << 8):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            _lut[c] = ord(ch.lower()[0])
    _pages[page] = True


def fold_points(points: np.ndarray) -> np.ndarray:
    """Folded code points; 0 where the character is skipped."""
    if len(points):
        for page in np.flatnonzero(np.bincount(points >> 8, minlength=0x1100) * ~_pages):
            _fill(int(page))
    return _lut[points]


def points_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the strings in a row, and each string's length. Nulls have length 0."""
    strings = strings.fill_null("")
    lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(strings.to_pylist())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


def _power_table(k: int, n: int) -> np.ndarray:
    have = _powers[k]
    if len(have) < n:
        size = max(n, 2 * len(have))
        out = np.empty(size, dtype=np.uint64)
        out[: len(have)] = have
        filled = len(have)
        while filled < size:  # doubling: B^(i+filled) = B^i * B^filled
            step = np.uint64(int(out[filled - 1]) * int(BASES[k]) % int(PRIME))
            m = min(filled, size - filled)
            out[filled : filled + m] = out[:m] * step % PRIME
            filled += m
        _powers[k] = have = out
    return have


def rolling_hashes(folded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 62-bit hash for each string: two polynomials over its kept characters, modulo a prime. The terms are added where they stand."""
    kept = np.concatenate(([0], np.cumsum(folded != 0)))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sizes = kept[ends] - kept[starts]
    # the place of each character among those its string keeps; a skipped one has the next one's, and adds nothing
    at = kept[:-1] - np.repeat(kept[starts], lengths)
    out = np.zeros(len(lengths), dtype=np.uint64)
    some = lengths > 0
    longest = int(sizes.max()) if len(sizes) else 0
    for k in range(len(BASES)):
        terms = _power_table(k, longest + 1)[at]
        terms *= folded
        terms %= PRIME
        h = np.zeros(len(lengths), dtype=np.uint64)
        if some.any():
            h[some] = np.add.reduceat(terms, starts[some]) % PRIME
        h = (h + sizes.astype(np.uint64) * np.uint64(7919 + k)) % PRIME
        out = (out << np.uint64(31)) | h
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words, so that their sum tells sets apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
