"""Word shingles of many texts at once, in NumPy: hashes of words, of runs of five words, and multisets of these by text."""

from __future__ import annotations

import numpy as np

from lanternfish.llm.common import BYTES

WORDS = 5
#: Bytes of text hashed at a time.
STRETCH = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a stretch of bytes begin, and a 64-bit hash of each."""
    edges = np.flatnonzero(np.diff(data != 32, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= _power(_P, len(data))
    np.cumsum(values, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _power(_P_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str | None], table: bytes = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, text after text, and the number of words of each text.

    table: what each byte counts as; spaces separate words. Bytes are hashed STRETCH at a time, up to the end of a word, so that a long text needs little more room than its words.
    """
    raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in texts]
    joined = (b" ".join(raw) + b" ").translate(table)
    data, found, at = np.frombuffer(joined, np.uint8), [], 0
    while at < len(data):
        end = joined.find(b" ", min(at + STRETCH, len(data) - 1)) + 1
        starts, hashes = _hashed(data[at:end])
        found.append((starts + at, hashes))
        at = end
    starts, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    limits = np.cumsum([len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0) if raw else np.zeros(0, np.int64)


def shingle_hashes(texts: list[str | None], size: int = WORDS, table: bytes = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of `size` words, text after text, and the number of each text.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    words, counts = word_hashes(texts, table)
    short = (counts > 0) & (counts < size)
    firsts = np.cumsum(counts) - counts
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        total[: len(words) - k] += mix(words[k:] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    number = np.where(short, 1, np.maximum(counts - size + 1, 0))
    begins = np.cumsum(number) - number
    at = np.repeat(firsts - begins, number) + np.arange(number.sum())
    out = mix(total[at])
    for i in np.flatnonzero(short):
        own = words[firsts[i] : firsts[i] + counts[i]]
        out[begins[i]] = mix(np.array([sum(int(mix(own[k : k + 1] + np.uint64(k + 1))[0]) * (2 * k + 3) for k in range(len(own))) + len(own) & (1 << 64) - 1], np.uint64))[0]
    return out, number


def multisets(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: index of the text, 48-bit hash, count. At most 65,536 texts at a time."""
    hashes, number = shingle_hashes(texts, size)
    keys = np.sort(np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(48), number) | hashes >> np.uint64(16))
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    counts = np.diff(first, append=len(keys))
    keys = keys[first]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts


def tagged(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """Per text a sorted array with a member for the first, second, ... occurrence of each shingle.

    The Jaccard similarity of two such sets is the multiset Jaccard similarity of the texts.
    """
    owner, keys, counts = multisets(texts, size)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    members = mix(np.repeat(keys, counts) + (place.astype(np.uint64) << np.uint64(48)))
    bounds = np.searchsorted(np.repeat(owner, counts), np.arange(len(texts) + 1))
    return [np.sort(members[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
