"""Byte-level BPE encoding and decoding in linear time a piece.

A piece's bytes become Latin-1 text, in which an Aho-Corasick automaton over the vocabulary finds
the longest match from each place. The leftmost-longest tiling is the encoding when every two
adjacent tokens may stand together; else a search backtracks from it to the next shorter match,
never twice to the same place. Two tokens may stand together if merging their joined bytes gives
back just those two; that is decided once a pair and remembered. A tiling of which all adjacent
pairs may stand together is the one that the merges make, so ids are exact.

Texts are split into pieces by the pattern under the library's tables of letters and numbers. Where
the pattern's own engine has other tables (of a newer Unicode), the library is asked about a character,
and a character of the class that the library gives stands for it while a text is split.

Cases: a null or empty text has no tokens; repeated rows are encoded alike; other columns pass.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import ahocorasick
import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import map_texts

#: Distinct pieces and token pairs that a worker remembers before it begins anew; bounds its memory, not its results.
REMEMBERED, PAIRS = 600_000, 2_000_000
#: Pieces of a text that are put together at a time.
AT_ONCE = 200_000


NEVER = 1 << 40


def merging(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[int, list[bytes]]]:
    """A piece's parts, from its bytes on, and the rank that made them: the adjacent pair of least rank is joined until none is left."""
    parts, rank = [piece[i : i + 1] for i in range(len(piece))], -1
    while True:
        yield rank, parts
        rank, i = min(((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairwise(parts))), default=(NEVER, 0))
        if rank == NEVER:
            return
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding by its definition."""
    for _, parts in merging(piece, ranks):
        pass
    return [ranks[p] for p in parts]


#: Planes in which characters may be assigned by one of two versions of Unicode only.
PLANES = range(0x40000)


def spans(points: Iterable[int]) -> str:
    """The points as ranges of a character class: a class that names each point is searched point by point."""
    points = np.sort(np.fromiter(points, np.int64))
    ends = np.flatnonzero(np.diff(points, append=points[-1] + 2) > 1)
    begins = np.concatenate([[0], ends[:-1] + 1])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(points[begins].tolist(), points[ends].tolist()))


class Splitter:
    """A text's pieces by a pattern, as the library splits it."""

    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        stands, self.table = {"letter": "ä", "number": "²", "other": "§"}, {}
        own = {"letter": regex.compile(r"\p{L}"), "number": regex.compile(r"\p{N}")}
        unsure = (c for c in map(chr, PLANES) if unicodedata.category(c) == "Cn")
        while some := list(islice(unsure, AT_ONCE // 16)):  # all at once would take a hundred MB
            for c, kind in zip(some, self.kinds(pattern, some)):
                if kind != next((k for k, p in own.items() if p.match(c)), "other"):
                    self.table[ord(c)] = stands[kind]
        self.differs = re.compile(f"[{spans(self.table)}]") if self.table else None

    @staticmethod
    def kinds(pattern: str, characters: list[str]) -> list[str]:
        """Each character's class: it is in one piece with a letter or number before it, if it is one."""
        ahead, high = {"letter": b"a", "number": b"1"}, range(0x80, 0x100)
        joined = {a + bytes([b]): 256 + k for k, (a, b) in enumerate((a, b) for a in ahead.values() for b in high)}
        toy = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)} | joined, special_tokens={})
        made = ["other"] * len(characters)
        for kind, a in ahead.items():
            ids = np.array(toy.encode_ordinary("".join(f"{a.decode()}{c}\n" for c in characters)))
            heads = np.flatnonzero((ids == a[0]) | (ids > 255))  # one for each character
            for k in np.flatnonzero(ids[heads] > 255):
                made[k] = kind
        return made

    def pieces(self, text: str):
        """An iterator over the pieces."""
        if self.differs is None or text.isascii() or not self.differs.search(text):
            return (m[0] for m in self.pattern.finditer(text)) if len(text) > 4 * AT_ONCE else iter(self.pattern.findall(text))
        return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.table)))


@lru_cache(2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


class Pieces(dict):
    """piece -> its ids as little-endian 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes = {b.decode("latin-1"): i for b, i in ranks.items()}, {i: b for b, i in ranks.items()}
        self.raw, self.packed = ranks, {i: i.to_bytes(4, "little") for i in self.bytes}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.most = max(self.size.values())
        self.longest = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.longest.add_word(t, i)
        self.longest.make_automaton()
        self.shorter = {i: next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1) for t, i in self.ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.seen: dict[int, tuple | None] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[piece] = b"".join([self.packed[i] for i in self.encode(piece.encode().decode("latin-1"))])
        return made

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """The parts that stand at a token's begin and at its end while it is merged, each with the rank that joins it to
        more; None, if the merges do not make the token or make it out of the ranks' order."""
        if token not in self.seen:
            begin, end, last = [], [], -1
            for rank, parts in merging(self.bytes[token], self.raw):
                for side, part in ((begin, parts[0]), (end, parts[-1])):
                    if not side or side[-1][0] != part:
                        if side:
                            side[-1] = (side[-1][0], rank)
                        side.append((part, NEVER))
                last = NEVER if rank < last else rank
            self.seen[token] = (begin, end) if last < NEVER and len(parts) == 1 else None
        return self.seen[token]

    def fit(self, pair: int) -> bool:
        """Whether no part at the first token's end is joined with one at the second's begin while both stand.

        Joins come in the order of their ranks, and the left one first of two of one rank: so a join across
        yields to one of its rank within the first token and precedes one within the second.
        """
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if (first := self.edges(a)) and (second := self.edges(b)):
            left, right, known, i, j = first[1], second[0], True, 0, 0
            while known and i < len(left) and j < len(right):
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.raw.get(x + y, NEVER)
                known = across >= x_ends or across > y_ends
                i, j = (i + 1, j) if x_ends <= y_ends else (i, j + 1)
        else:
            known = merged(self.bytes[a] + self.bytes[b], self.raw) == [a, b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = known
        return known

    def encode(self, text: str) -> list[int]:
        """text: a piece's bytes as Latin-1."""
        if text in self.ranks:
            return [self.ranks[text]]
        pairs, size, shorter = self.pairs, self.size, self.shorter
        ids, at, n, dead = [], 0, len(text), set()
        ahead = [(end + 1 - size[i], i) for end, i in self.longest.iter_long(text)]  # a tiling: place, longest match
        ahead.reverse()
        while at < n:
            while ahead and ahead[-1][0] < at:
                ahead.pop()
            token = ahead[-1][1] if ahead and ahead[-1][0] == at else self.first(text, at)
            while True:  # token: to be tried at `at`, -1 for none
                if token < 0:  # nothing from here fits what stands before
                    dead.add(at)
                    token = ids.pop()
                    at -= size[token]
                elif at + size[token] not in dead:
                    if not ids:
                        break
                    if (known := pairs.get(pair := ids[-1] << 32 | token)) is None:
                        known = self.fit(pair)
                    if known:
                        break
                token = shorter[token]
            ids.append(token)
            at += size[token]
        return ids

    def first(self, text: str, at: int) -> int:
        """The longest token that text has at this place."""
        rest, ranks = text[at : at + self.most], self.ranks  # no more than any token needs: a copy of a whole long rest each time would take quadratic time
        n = self.longest.longest_prefix(rest)  # of a word's beginning, not always a word
        while rest[:n] not in ranks:
            n -= 1
        return ranks[rest[:n]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(read_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, ids (little-endian unsigned 32-bit numbers) and decoded (the bytes that the ids stand for)."""

    def make():
        known, split = pieces(path), splitter(pattern)

        def work(texts: list[str]) -> list[list]:
            n, ids, decoded = [], [], []
            for t in texts:
                found = split.pieces(t)
                a, b = [], []
                while some := list(islice(found, AT_ONCE)):
                    a.append(b"".join([known[p] for p in some]))
                    b.append(known.decode(a[-1]))
                ids.append(b"".join(a))
                decoded.append(b"".join(b))
                n.append(len(ids[-1]) // 4)
            return [n, ids, decoded]

        work.done = known.clear  # pairs stay known
        return work

    return map_texts(df, text, keep, "n_tokens long, ids binary, decoded binary", make)
