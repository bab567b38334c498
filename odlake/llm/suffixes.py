"""Exact substring dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

In each block of text that may repeat (see repeats.py), suffixes are sorted as far as the threshold
and the transform is read off. Intervals of rows start from the empty string's and are extended
backward, all strings of one length at a time: an interval's rows map to those of each preceding
byte, and where the right end of such an interval is met first, the common prefix there is as long as
the string extended. Common prefixes are so found by increasing value, and the expansion stops at
the threshold; rows between which no end was met share at least that many bytes.

Cases: null and empty texts, and those under the threshold, lose nothing; a text may repeat itself, also
overlapping; rows repeated whole (same id, same text) are one document and get equal results; texts of
one id are ordered by their hash; a null doc_id comes last. Columns other than those read are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Kind, without_repeats

LEAST = 100


def sorted_suffixes(text: np.ndarray, remaining: np.ndarray, depth: int) -> np.ndarray:
    """The places by the first `depth` bytes from each to its segment's end, an end before any byte."""
    n, at = len(text), np.arange(len(text))
    key = np.zeros(n, np.uint64)
    for k in range(7):
        byte = np.zeros(n, np.uint64)
        byte[: max(0, n - k)] = text[k:]
        byte[remaining <= k] = 0
        key = key << np.uint64(8) | byte
    key = key << np.uint64(8) | np.minimum(remaining, 7).astype(np.uint64)
    order = np.argsort(key)
    keys, length = key[order], 7
    head = np.r_[True, keys[1:] != keys[:-1]]
    rank = np.empty(n, np.int64)  # the row at which a place's class of equal beginnings starts
    while True:
        begins = np.flatnonzero(head)
        rank[order] = np.repeat(begins, np.diff(np.r_[begins, n]))
        rows = np.flatnonzero(~(head & np.r_[head[1:], True]))  # of classes of several; only these are sorted on
        if length >= depth or not len(rows):
            return order
        step = min(length, depth - length)
        places = order[rows]
        after = np.where(remaining[places] > step, rank[np.minimum(places + step, n - 1)] + 1, 0)
        key = rank[places].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        sort = np.argsort(key)
        order[rows], key = places[sort], key[sort]
        head[rows] = np.r_[True, key[1:] != key[:-1]]
        length += step


def shared_prefixes(text: np.ndarray, remaining: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each row of the sorted places, whether an end was met before it: it shares less than `depth` bytes with the row above.

    The rows of the segments' ends come first; each is preceded by a segment's last byte.
    """
    ends = np.flatnonzero(remaining == 1)
    starts = np.r_[0, ends[:-1] + 1]
    m, n = len(ends), len(text)
    before = np.full(n, -1, np.int16)  # the byte before each place, none at a segment's start
    before[1:] = text[:-1]
    before[starts] = -1
    transform = np.concatenate([text[ends].astype(np.int16), before[order]])
    back = np.empty(m + n, np.int64)  # where each row's preceded suffix stands
    by_byte = np.argsort(transform, kind="stable")
    none = int((transform < 0).sum())
    back[by_byte] = np.arange(m + n) - none + m
    met = np.zeros(m + n + 1, bool)
    met[[0, m + n]] = True
    slot = np.empty(m + n, np.int64)
    left, right = np.array([0]), np.array([m + n])
    for _ in range(depth):
        size = right - left
        interval = np.repeat(np.arange(len(left)), size)
        rows = np.arange(len(interval)) + np.repeat(left - (np.cumsum(size) - size), size)
        some = transform[rows] >= 0
        rows, interval = rows[some], interval[some]
        place, byte = back[rows], transform[rows]
        if 8 * len(place) > m + n:
            slot[:] = -1
            slot[place] = np.arange(len(place))
            by_place = slot[slot >= 0]
        else:
            by_place = np.argsort(place)
        place, interval, byte = place[by_place], interval[by_place], byte[by_place]
        fresh = np.flatnonzero(np.r_[True, (interval[1:] != interval[:-1]) | (byte[1:] != byte[:-1])]) if len(place) else np.zeros(0, np.int64)
        left, right = place[fresh], place[np.r_[fresh[1:], len(place)] - 1] + 1 if len(place) else left[:0]
        new = ~met[right]
        left, right = left[new], right[new]
        met[right] = True
        if not len(left):
            break
    return met[m:-1]


def repeated(text: np.ndarray, remaining: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether the `least` bytes from each place also start earlier; segments do not run on into each other."""
    flagged = np.zeros(len(text), bool)
    if not len(text):
        return flagged
    order = sorted_suffixes(text, remaining, least)
    met = shared_prefixes(text, remaining, order, least)
    whole = remaining[order] >= least
    cut = met | ~whole | ~np.r_[False, whole[:-1]]
    head = np.flatnonzero(cut)
    first = np.repeat(np.minimum.reduceat(order, head), np.diff(np.r_[head, len(order)]))
    flagged[order[whole & (order > first)]] = True
    return flagged


def left_bytes(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    return len(text), b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]))


BYTES = Kind(LEAST, (32, 66, 84, LEAST), lambda texts: [np.frombuffer(t, "<u1") for t in texts], "<u1", repeated, left_bytes)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept (the bytes left), spans: every byte in 100 bytes that start earlier too is removed."""
    return without_repeats(docs, BYTES, text)
