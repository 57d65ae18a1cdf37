"""Simple-8b word-aligned coding of non-negative integers, in numpy.

A 64-bit word holds a selector in its top four bits and as many equally wide values as fit below.
Selector 0 is the escape: the whole next word is one value of more than 60 bits."""

from __future__ import annotations

import numpy as np

# fixed values: how many values a word holds and how wide they are, for the selectors 1, 2, ...
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

_LIMITS = np.uint64(1) << WIDTHS.astype(np.uint64)
_ESCAPE = len(COUNTS)


_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
_STEPS = np.append(COUNTS, 1).tolist()


def _classes(v: np.ndarray) -> np.ndarray:
    """Per value the first selector (from 0) that is wide enough; the number of selectors if none is."""
    if len(v) and int(v.max()) < len(_SMALL):
        return _SMALL[v.astype(np.int64)]
    return np.searchsorted(_LIMITS, v, side="right").astype(np.uint8)


def encode(values) -> np.ndarray:
    """Words (uint64) of the values, each as full as it can be. The last word may be padded with zeros; the reader knows
    the count."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    # the widest class in a window of each count, from one count to the next (windows overlap; a maximum may)
    widest = np.concatenate((_classes(v), np.zeros(64, np.uint8)))
    choice = np.full(n, _ESCAPE, np.uint8)
    width = 1
    for k in range(_ESCAPE - 1, -1, -1):
        shift = int(COUNTS[k]) - width
        if shift:
            np.maximum(widest[:-shift], widest[shift:], out=widest[:-shift])
        width = int(COUNTS[k])
        np.copyto(choice, np.uint8(k), where=widest[:n] <= k)
    walk, at, starts = choice.tobytes(), 0, []
    while at < n:
        starts.append(at)
        at += _STEPS[walk[at]]
    starts = np.array(starts, np.int64)
    kind = choice[starts]
    place = np.cumsum(1 + (kind == _ESCAPE)) - 1
    words = np.zeros(int(place[-1]) + 1 if len(place) else 0, np.uint64)
    padded = np.concatenate((v, np.zeros(64, np.uint64)))
    for k in np.unique(kind):
        mine = kind == k
        if k == _ESCAPE:
            words[place[mine]] = padded[starts[mine]]
            continue
        part = padded[starts[mine][:, None] + np.arange(COUNTS[k])] << (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        words[place[mine]] = np.bitwise_or.reduce(part, axis=1) | (np.uint64(k + 1) << np.uint64(60))
    return words


def decode(words, n: int) -> np.ndarray:
    """The first n values of the words (uint64)."""
    w = np.asarray(words, np.uint64)
    selector = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), bool)
    for i in np.flatnonzero(selector == 0):
        if not raw[i]:
            raw[i + 1:i + 2] = True
    head = ~raw & (selector == 0)
    selector[raw] = 0
    if (selector > _ESCAPE).any():
        raise ValueError("unknown selector")
    count = np.where(raw, 1, np.where(head, 0, np.append(0, COUNTS)[selector]))
    offset = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    out[offset[raw]] = w[raw]
    for k in np.unique(selector[~raw & ~head]):
        mine = np.flatnonzero(~raw & (selector == k))
        c, width = COUNTS[k - 1], WIDTHS[k - 1]
        mask = np.uint64((1 << int(width)) - 1)
        out[offset[mine][:, None] + np.arange(c)] = (w[mine][:, None] >> (np.arange(c) * width).astype(np.uint64)) & mask
    if len(out) < n:
        raise ValueError("fewer values than expected")
    return out[:n]
