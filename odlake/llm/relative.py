"""Substring dedup by relative Lempel-Ziv parsing of word sequences.

Blocks of text that may repeat (see repeats.py) are indexed by their sorted suffixes and the prefixes
that neighbours share. The places are cut into reference blocks of 1, 2, 4, ... places, and the words of
the block that follows a reference block are factored greedily against it: a factor is the longest match
that starts in the reference block, or one word; it is found from the index, by the rows of the
reference block next above and below, followed to its end, and the parse goes on behind it. A parse
begins anew only at a block or a segment. Of any two places one lies in the reference block of the other
at just one size, so every earlier occurrence is searched.
In a factor of `LEAST` words or more, all windows repeat, as the whole factor stands earlier; windows
that cross a factor's end lie in no one factor, and are looked up one by one.

Words are compared by 64-bit hashes of their bytes.

Cases: null and empty texts, and those under `LEAST` words, lose nothing; what is kept is joined by single
spaces; a text may repeat itself, also overlapping; rows repeated whole (same id, same text) are one
document and get equal results; texts of one id are ordered by their hash; a null doc_id comes last.
Columns other than those read are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import AT_ONCE, Kind, codes_of_bytes, ladder, mixed, without_repeats

LEAST = 20
#: Words that the index sorts by; a match that reaches so far is followed on from there, to its end.
DEPTH = 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the hashes of its words."""
    made: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    table, at = codes_of_bytes(), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
            size += len(texts[to]) + 1
            to += 1
        parts = [texts[at]] if to == at + 1 else [b" ".join(texts[at:to])]
        if size > 2 * AT_ONCE:  # a long text goes in parts that end at white space
            parts, rest = [], texts[at]
            while rest:
                cut = len(rest) if len(rest) <= AT_ONCE else AT_ONCE + len(rest[AT_ONCE:]) - len(rest[AT_ONCE:].lstrip(WORDS_BYTES))
                parts.append(rest[:cut])
                rest = rest[cut:]
        hashes, starts = [], []
        for part in parts:
            data = np.frombuffer(part, np.uint8)
            inside = np.r_[False, ~SPACE[data], False]
            begin, end = (np.flatnonzero(x) for x in (inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]))
            powers, inverse = ladder(len(data) + 1)
            total = np.r_[np.uint64(0), np.cumsum(table[data] * powers[: len(data)])]
            hashes.append(mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
            starts.append(begin)
        if to == at + 1:
            made[at] = np.concatenate(hashes) if hashes else made[at]
        else:
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
            made[at:to] = np.split(hashes[0], np.searchsorted(starts[0], ends[:-1]))
        at = to
    return made


WORDS_BYTES = bytes(b for b in range(256) if not SPACE[b])


def index(text: np.ndarray, remaining: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places sorted by their next `depth` words, and the words that each row shares with the one above."""
    n, at = len(text), np.arange(len(text))
    rank, length = np.unique(text, return_inverse=True)[1] + 1, 1
    while True:
        step = min(length, depth - length)
        after = np.where(remaining > step, rank[np.minimum(at + step, n - 1)], 0) if step else rank * 0
        key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(key)
        keys = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[True, keys[1:] != keys[:-1]])
        length += step
        if length >= depth or rank[order[-1]] == n:
            break
    shared, above = np.zeros(n, np.int64), np.r_[order[:1], order[:-1]]
    room = np.minimum(np.minimum(remaining[order], remaining[above]), depth)
    room[0] = 0
    open_ = np.flatnonzero(room > 0)
    for k in range(depth):
        open_ = open_[(room[open_] > k)]
        open_ = open_[text[order[open_] + k] == text[above[open_] + k]]
        if not len(open_):
            break
        shared[open_] = k + 1
    return order, shared


class Shared:
    """The least number of words shared by neighbouring rows from one row to another: by minima over 1, 2, 4, ... rows."""

    def __init__(self, shared: np.ndarray) -> None:
        self.levels = [shared.astype(np.int16)]
        while (n := 1 << len(self.levels)) <= len(shared):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - n // 2], last[n // 2 :]))

    def between(self, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Words that rows above < below share."""
        made = np.zeros(len(above), np.int16)
        level = np.frexp((below - above).astype(np.float64))[1] - 1  # the greatest power of two that fits
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            low = self.levels[k]
            made[of] = np.minimum(low[above[of] + 1], low[below[of] + 1 - (1 << k)])
        return made


class References:
    """The reference blocks of one size: every other block of places, each by its rows of the index."""

    def __init__(self, level: int, rank: np.ndarray, order: np.ndarray, shared: Shared, remaining: np.ndarray, depth: int) -> None:
        self.level, self.rank, self.order, self.shared, self.n = level, rank, order, shared, len(rank)
        self.remaining, self.depth = remaining, depth
        place = np.flatnonzero(np.arange(self.n) >> level & 1 == 0)
        self.rows = np.sort((place >> level) * self.n + rank[place])

    def longest(self, places: np.ndarray) -> np.ndarray:
        """The words of the longest match of each place that starts in the reference block before its own; of several of `depth` words or more, one is followed."""
        block, row = (places >> self.level) - 1, self.rank[places]
        at = np.searchsorted(self.rows, block * self.n + row)
        made, source = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for nearest, behind in ((at - 1, False), (at, True)):
            ok = np.flatnonzero((nearest >= 0) & (nearest < len(self.rows)))
            ok = ok[self.rows[nearest[ok]] // self.n == block[ok]]
            other = self.rows[nearest[ok]] % self.n
            length = self.shared.between(*((row[ok], other) if behind else (other, row[ok])))
            better = length > made[ok]
            made[ok[better]], source[ok[better]] = length[better], self.order[other[better]]
        going = np.flatnonzero(made == self.depth)
        while len(going):
            length = made[going]
            going = going[(length < self.remaining[places[going]]) & (length < self.remaining[source[going]])]
            a, b = self.rank[places[going] + made[going]], self.rank[source[going] + made[going]]
            more = self.shared.between(np.minimum(a, b), np.maximum(a, b))
            made[going] += more
            going = going[more == self.depth]
        return made


def factored(flagged: np.ndarray, wanted: np.ndarray, ends: np.ndarray, references: References, least: int) -> None:
    """Parses the blocks behind the reference blocks and flags the windows found to repeat; wanted: the windows' starts, ends: of their segments."""
    n, level = len(flagged), references.level
    following = np.minimum.accumulate(np.where(wanted, np.arange(n), n)[::-1])[::-1]  # the next wanted window
    place = np.arange(n)
    fresh = np.r_[True, ends[1:] != ends[:-1]] | (place & (1 << level) - 1 == 0)
    at = np.flatnonzero(fresh)
    stop = np.r_[at[1:], n]
    right = at >> level & 1 == 1
    at, stop = at[right], stop[right]
    limit, at = stop, following[at]
    crossing = []
    while len(going := np.flatnonzero(at < limit)):
        at, limit = at[going], limit[going]
        length = np.maximum(references.longest(at), 1)
        inside = np.where(length >= least, length - least + 1, 1)  # windows of which the factor tells
        repeat = np.flatnonzero(length >= least)
        n_inside = np.minimum(inside, limit - at)[repeat]
        flagged[np.repeat(at[repeat] - (np.cumsum(n_inside) - n_inside), n_inside) + np.arange(n_inside.sum())] = True
        first, stop = at + inside, np.minimum(at + length, limit)
        size = np.maximum(stop - first, 0)
        crossing.append(np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum()))
        at = at + length
        inner = np.flatnonzero(at < limit)
        at, limit = following[at[inner]], limit[inner]
    if crossing:
        checks = np.concatenate(crossing)
        checks = checks[wanted[checks]]
        flagged[checks[references.longest(checks) >= least]] = True


def repeated(text: np.ndarray, remaining: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether the `least` words from each place also start earlier; segments do not run on into each other."""
    n = len(text)
    flagged = np.zeros(n, bool)
    if not n:
        return flagged
    depth = max(DEPTH, least)
    order, shared = index(text, remaining, depth)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    shared, ends = Shared(shared), np.arange(n) + remaining
    for level in range((n - 1).bit_length()):
        wanted = (remaining >= least) & ~flagged
        if not wanted.any():
            break
        factored(flagged, wanted, ends, References(level, rank, order, shared, remaining, depth), least)
    return flagged


def left_words(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    found = text.split()  # of bytes: at \x20 and \x09-\x0D only
    return len(found), b" ".join(w for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(found)]) for w in found[a:b])


WORDS = Kind(LEAST, (6, 13, 17, LEAST), words, "<u8", repeated, left_words)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept (the words left, joined by spaces), spans: every word in 20 words that start earlier too is removed."""
    return without_repeats(docs, WORDS, text)
