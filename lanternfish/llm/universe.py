"""Segment keys of sets: two sets of a Jaccard similarity share one, by the pigeonhole principle.

The universe of members is cut into segments by a hash. Of two sets that differ in at most d members, at least one of any d + 1
segments has the same members in both; and if segments may differ in one member, fewer of them do. So a set gives keys for
its segments, in their order, until these rule out every partner that shares no key:

* an exact segment has one key, of all its members, and counts 1;
* a segment with one deletion also has a key for each of its subsets that lack one member, and counts 2, as a partner that
  shares none of these differs in two.

Keys of few members, above all of none, are shared by many unlike sets. A set has no such keys and doesn't count their
segments; it goes on to the next ones instead. Two sets that go as far as the shorter prefix asks for still share a key: of
the counted segments of the set with the shorter prefix one has the same key in both. Only a set that runs out of segments has
its weak keys as well, and two such sets meet in these.

Sizes are cut into bands, each with a number of segments of its own. A set is in its own band and in those of its larger
partners. How many segments a band has, and how many of the last ones have deletions, is what costs fewest keys for sets of its
sizes, where members fall into segments at random and a set that runs out costs as much as OUT keys.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np

from lanternfish.llm.shingles import mix

#: Ratio of a band's sizes.
RATIO = 1.5
#: Least members of a key.
LEAST = 2
#: What a set that has too few strong segments costs, in keys.
OUT = 200
#: Up to so many segments to count, each allocation is tried.
TRIED = 16


def most_partner(size: int, percent: int) -> int:
    return 100 * size // percent


def most_apart(a: int, b: int, percent: int) -> int:
    """Most members in one but not both of two similar sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def needed(size: int, upto: int, percent: int) -> int:
    """What a set's segments must count in a band of sizes below `upto`; 1 where only equal sets are similar."""
    return most_apart(size, min(upto - 1, most_partner(size, percent)), percent) + 1


@lru_cache(maxsize=None)
def limits(band: int, percent: int) -> tuple[int, int]:
    """The sizes of a band, from and below; the first begins where sets that aren't equal can be similar."""
    if band == 0:
        low = next(n for n in range(1, 10_000) if needed(n, 1 << 40, percent) > 1)
    else:
        low = limits(band - 1, percent)[1]
    return low, max(low + 1, int(low * RATIO))


def bands_of(size: int, percent: int) -> list[int]:
    """The bands in which a set of that size may have a partner that isn't equal, its own and those of larger partners."""
    out, band = [], 0
    while (at := limits(band, percent))[0] <= most_partner(size, percent):
        if size < at[1] and needed(size, at[1], percent) > 1:
            out.append(band)
        band += 1
    return out


def _occupied(rate: float, upto: int) -> list[float]:
    """Probabilities of 0, 1, ... members of a segment that has `rate` on average."""
    out = [exp(-rate)]
    for k in range(1, upto + 1):
        out.append(out[-1] * rate / k)
    return out


def _cost(size: int, need: int, segments: int, loose: int) -> float:
    """Expected keys of a set, by what its segments count so far."""
    rate = size / segments
    p = _occupied(rate, LEAST)
    weak, edge = sum(p[:LEAST]), p[LEAST]
    at, keys = np.zeros(need + 2), 0.0
    at[0] = 1
    for k in range(segments):
        going, then = at[:need].copy(), np.zeros(need + 2)
        then[need:] = at[need:]
        then[:need] += going * weak
        if k < segments - loose:
            then[1 : need + 1] += going * (1 - weak)
            keys += going.sum() * (1 - weak)
        else:
            then[1 : need + 1] += going * edge
            then[2 : need + 2] += going * (1 - weak - edge)
            keys += going.sum() * (1 - weak) * (1 + rate)
        at = then
    return keys + at[:need].sum() * OUT


@lru_cache(maxsize=None)
def allocation(band: int, percent: int) -> tuple[int, int]:
    """The number of a band's segments, and of those at the end that have deletions."""
    low, upto = limits(band, percent)
    least = max(1, ceil(low * percent / 100))
    sizes = sorted({s for s in (least, low, (low + upto) // 2, upto - 1) if needed(s, upto, percent) > 1})
    most = max(needed(s, upto, percent) for s in sizes)
    if most <= TRIED:
        tries = [(m, q) for m in range(max(1, most // 2), 2 * most + 1) for q in {0, 1, 2, 3, m // 2, m} if q <= m and m + q >= most]
        return min(tries, key=lambda t: (sum(_cost(s, needed(s, upto, percent), *t) for s in sizes), t))
    strong = lambda s, m: 1 - sum(_occupied(s / m, LEAST - 1))
    spare = lambda s, m: m * strong(s, m) - needed(s, upto, percent) - 3 * sqrt(m * strong(s, m) * (1 - strong(s, m)))
    tries = [most + k * most // 200 for k in range(1, 200)]
    return next((m for m in tries if all(spare(s, m) >= 0 for s in sizes)), max(tries, key=lambda m: min(spare(s, m) for s in sizes))), 0


def keys(members: np.ndarray, percent: int) -> np.ndarray:
    """int64 keys of a set of distinct uint64 members, of all bands; none if only an equal set is similar."""
    out = []
    for band in bands_of(len(members), percent):
        (segments, loose), need = allocation(band, percent), needed(len(members), limits(band, percent)[1], percent)
        segment = (mix(members ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        spread = mix(members[order] + np.uint64(1))
        bounds = np.searchsorted(segment[order], np.arange(segments + 1))
        number = np.diff(bounds)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
        sums = sums[bounds[1:]] - sums[bounds[:-1]]
        counts = (number >= LEAST).astype(np.int64)
        counts[segments - loose :] += number[segments - loose :] > LEAST
        reached = np.searchsorted(np.cumsum(counts), need) + 1
        strong = LEAST if reached <= segments else 0
        reached = min(int(reached), segments)
        at = mix(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 32))
        out.append(mix(sums + at)[:reached][number[:reached] >= strong])
        first = segments - loose
        if reached > first:
            a, b = bounds[first], bounds[reached]
            owner = segment[order][a:b]
            some = number[owner] - 1 >= strong
            out.append(mix(sums[owner] - spread[a:b] + at[owner])[some])
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def sketch(members: np.ndarray) -> bytes:
    """The parities of the members in 2^b cells, with 1 to 2 cells for a member: sets that differ in few members differ in few."""
    cells = 1 << max(6, int(len(members) - 1).bit_length())
    odd = np.bincount((mix(members + np.uint64(7)) % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of equal length, that of the shortest: the parities of cells that fall together are added."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least), np.uint8)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, least), axis=0)
    return out
