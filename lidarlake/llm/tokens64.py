"""Words of many texts as 64-bit hashes, without an object for any word.

A word's hash is a polynomial of its bytes modulo 2**64, each byte standing for a number drawn by a fixed seed, then mixed
with the word's length. Differences of running sums give the polynomial of every word at once. Words of LONG bytes or
more, for which such polynomials could be made to collide, are hashed by xxh3.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 256
#: Bytes that are hashed at a time: some arrays of 8 bytes for each, and powers that a worker keeps.
SEGMENT = 128 << 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, np.uint64)
_LOWER = _CODE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ...; remembered."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        more = np.full(max(1 << 16, 1 << int(n - 1).bit_length()), base, np.uint64)
        more[0] = 1
        with np.errstate(over="ignore"):
            held = _POWERS[base] = np.multiply.accumulate(more)
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_BASE)
        h ^= h >> np.uint64(32)
    return h


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, a space after each, and the texts' numbers of bytes."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b" ".join(data) + b" ", np.uint8), np.fromiter(map(len, data), np.int64, len(data))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; the last byte is a space."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate((np.zeros(1, edge.dtype), edge))
    return edge[::2], edge[1::2]


def words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, one text after the other, and how many words each text has."""
    data, size = joined(texts)
    begins, ends = spans(data)
    h = np.zeros(len(begins), np.uint64)
    codes = _LOWER if lower else _CODE
    cuts = np.searchsorted(begins, np.arange(0, len(data) + SEGMENT, SEGMENT))
    with np.errstate(over="ignore"):
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            d, b, e = data[begins[i] : ends[j - 1]], begins[i:j] - begins[i], ends[i:j] - begins[i]
            sums = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(codes[d] * _powers(_BASE, len(d)), out=sums[1:])
            h[i:j] = (sums[e] - sums[b]) * _powers(_INVERSE, len(d))[b] + (e - b).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    h = mixed(h)
    for i in np.flatnonzero(ends - begins >= LONG).tolist():
        w = data[begins[i] : ends[i]].tobytes()
        h[i] = xxhash.xxh3_64_intdigest(w.lower() if lower else w)
    at = np.searchsorted(begins, np.concatenate((np.zeros(1, np.int64), np.cumsum(size + 1))))
    return h, np.diff(at)


def by_hash(h: np.ndarray) -> np.ndarray:
    """Stable argsort of 64-bit hashes: places ride in the low bits of a plain sort; where those bits would have told
    hashes apart, an ordinary argsort."""
    bits = np.uint64(max(1, len(h).bit_length()))
    order = h >> bits
    order <<= bits
    order |= np.arange(len(h), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    s = h[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(h, kind="stable")


def firsts(sorted_: np.ndarray) -> np.ndarray:
    """Whether each of some sorted numbers differs from the one before."""
    out = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=out[1:])
    return out


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes: the distinct ones, ascending; each one's first place; how often each occurs; and where among the distinct
    ones every hash stands."""
    order = by_hash(h)
    s = h[order]
    first = firsts(s)
    back = np.empty(len(h), np.int64)
    rank = np.cumsum(first)
    rank -= 1
    back[order] = rank
    starts = np.flatnonzero(first)
    return s[starts], order[starts], np.diff(np.append(starts, len(h))), back
