"""Words of a text as 64-bit hashes, found and hashed for all its bytes at once.

A word is a run of bytes that a table marks. Its hash is a polynomial in its bytes
modulo 2**64, read off prefix sums: the odd base has an inverse, so each word's sum is
brought to power zero. Runs of words are hashed in the same way over word hashes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that are hashed at once; longer texts are cut between words.
BLOCK = 1 << 18

#: All bytes but ASCII white space.
VISIBLE = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, at least ``n`` of each."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_words(raw: bytes, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = marked[b]
    edge = word[1:] - word[:-1]
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[stop - 1]
        p, inverse = powers(hi - lo + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((b[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=total[1:])
            s, e = starts[at:stop] - lo, ends[at:stop] - lo
            out[at:stop] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = stop
    return out, starts, ends


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(size, np.uint64)
    for at in range(0, size, BLOCK):
        stop = min(size, at + BLOCK)
        w = words[at : stop + n - 1]
        p, inverse = powers(len(w) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(w * p[: len(w)], out=total[1:])
            out[at:stop] = mix((total[n:] - total[:-n]) * inverse[: stop - at])
    return out


def raw_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
