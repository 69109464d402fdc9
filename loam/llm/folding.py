"""Skip-and-fold lookup table, rolling polynomial hashes over it, and a comparison that skips the same way.

The table maps a byte (or code point) to 0 if it is skipped, else to its folded code.  Hashes are computed for a
whole Arrow batch at once from the column's own buffers, so canonical strings are never built.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 1_618_033_989)


@lru_cache(maxsize=None)
def folded(code_point: int) -> int:
    """Folded code of one code point plus one; 0 if it is neither a letter nor a digit."""
    kept = [c for c in chr(code_point).lower() if unicodedata.category(c)[0] in "LN"]
    return ord(kept[0].replace("ς", "σ")) + 1 if kept else 0


BYTES = np.array([folded(c) if c < 128 else 0 for c in range(256)], np.uint64)
_PAGES: dict[int, np.ndarray] = {}


def _codes(points: np.ndarray) -> np.ndarray:
    """Folded codes of code points; pages of the table are filled when first met."""
    pages, which = np.unique(points >> 8, return_inverse=True)
    for p in pages:
        if int(p) not in _PAGES:
            first = int(p) << 8
            _PAGES[int(p)] = np.array([folded(c) if not 0xD800 <= c < 0xE000 and c < 0x110000 else 0 for c in range(first, first + 256)], np.uint64)
    return np.stack([_PAGES[int(p)] for p in pages])[which, points & 255]


@lru_cache(maxsize=8)
def _powers(base: int, prime: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:  # doubling: base^(i + done) = base^i * base^done
        more = min(done, size - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


def fold_hash(column: pa.Array, primes: tuple[int, int] = PRIMES) -> pa.Array:
    """62-bit hash of the folded form of each string; null for null.  Equal folded forms have equal hashes."""
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    raw = column.fill_null("").cast(pa.large_binary())
    n = len(raw)
    if n == 0:
        return pa.array([], pa.int64())
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + n + 1]
    octets = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if octets.size and octets.max() > 127:
        heads = np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
        codes = _codes(np.frombuffer(octets.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32))
        at = heads[at]
    else:
        codes = BYTES[octets]
    kept = np.concatenate([[0], np.cumsum(codes > 0)])
    place = kept[:-1] - np.repeat(kept[at[:-1]], np.diff(at))
    size = 1 << int(max(64, place.max(initial=0) + 1)).bit_length()
    out = np.zeros(n, np.uint64)
    for base, prime in zip(BASES, primes, strict=True):
        terms = codes * _powers(base, prime, size)[place] % np.uint64(prime)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        out = (out << np.uint64(31)) | ((sums[at[1:]] - sums[at[:-1]]) % np.uint64(prime))
    return pa.array(out.astype(np.int64), pa.int64(), mask=nulls)


def same_folded(a: str, b: str) -> bool:
    """Whether two strings have one folded form: two pointers that skip what the table skips."""
    i = j = 0
    n, m = len(a), len(b)
    while True:
        x = y = 0
        while i < n and not (x := folded(ord(a[i]))):
            i += 1
        while j < m and not (y := folded(ord(b[j]))):
            j += 1
        if i >= n or j >= m:
            return i >= n and j >= m
        if x != y:
            return False
        i, j = i + 1, j + 1


def canonical(text: str) -> str:
    """The folded string itself; only for rows whose hash collided with a different text."""
    return "".join(chr(f - 1) for c in text if (f := folded(ord(c))))
