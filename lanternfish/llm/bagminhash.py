"""BagMinHash signatures of multisets: hierarchical Poisson processes over discretised weights.

The weight axis of an element is cut into the dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ... Each interval of each
element has its own Poisson process, whose rate is the interval's length; a point has a time, a register and a place on
the weight axis, all from a hash of the element. A text with weight w of the element sees the points whose place is below
w. A register keeps its earliest point. As the points below w form a process of rate w, two texts have the same point in a
register with the probability that is their weighted Jaccard similarity. A process is followed only up to the time of the
text's latest register, so that most elements cost one point.
"""

from __future__ import annotations

import numpy as np

from lanternfish.llm.shingles import mix

#: Registers of a signature, and how they make bands.
BANDS, ROWS = 42, 6
SIZE = BANDS * ROWS


def signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """uint32 [texts, size]; owner (ascending), keys and integer weights as from multisets(). Texts without elements have 0."""
    best = np.full(texts * size, np.inf)
    point = np.zeros(texts * size, np.uint32)
    latest = np.full(texts, np.inf)
    levels = np.frexp(weights - 0.5)[1].clip(0)  # intervals that reach below the weight, but the first
    doc, key, weight, level = owner, mix(keys + np.uint64(1)), weights, np.zeros(len(keys), np.int64)
    if len(levels) and (top := int(levels.max())) > 0:
        more = [np.flatnonzero(levels >= k) for k in range(1, top + 1)]
        every = np.concatenate([np.arange(len(keys)), *more])
        level = np.concatenate([level, *[np.full(len(x), k) for k, x in enumerate(more, 1)]])
        doc, key, weight = owner[every], mix(key[every] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), weights[every]
    length = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, length, 0.0)
    time, done = np.zeros(len(key)), 0
    while len(key):
        n = int(np.clip(100_000 // len(key), 1, 64))
        steps = (np.arange(done, done + n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        random = mix(key[:, None] + steps[None, :])
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        other = mix(random ^ np.uint64(0xA0761D6478BD642F))
        register = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
        seen = times < latest[doc][:, None]
        if level.any():
            place = (other >> np.uint64(32)).astype(np.float64) * 2.0**-32
            seen &= low[:, None] + place * length[:, None] < weight[:, None]
        at = (doc[:, None] * size + register.astype(np.int64))[seen]
        when, name = times[seen], mix(random[seen]).astype(np.uint32)
        order = np.argsort(-when, kind="stable")
        better = when[order] < best[at[order]]
        at, when, name = at[order][better], when[order][better], name[order][better]
        best[at], point[at] = when, name  # the last of equal places, which is the earliest, stays
        latest = best.reshape(texts, size).max(axis=1, initial=0)
        time, done = times[:, -1], done + n
        on = time < latest[doc]
        doc, key, weight, level, length, low, time = (x[on] for x in (doc, key, weight, level, length, low, time))
    return point.reshape(texts, size)


def bands(signature: np.ndarray) -> np.ndarray:
    """int64 [texts, BANDS]: a hash of each band and its number."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)
