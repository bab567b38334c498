"""Token counts by a finite-state transducer compiled from a BPE with word ends.

Over the symbols of a text's words (their bytes, the last one marked as the word's end), the last token
of every prefix is the one token that ends there and may follow the last token of the prefix before it.
So a state need hold only the places from which a vocabulary entry is still being spelled: the
node of the vocabulary's tree, the token before that place, and the count there relative to the
count here. A transition reads a symbol and emits the change of the count; a word's end leads back to the
first state. States are compiled when they are first met and shared by all words; emitted counts sum to
the library's count.

Symbols are cut into chunks, and a chunk is a map from entry states to exit states and emitted counts, over
the states in which it can be entered. A whole word is such a map of the one state in which words begin,
kept for all texts; a word of more than `CHUNK` symbols is cut at any place, and its chunks are entered in
the states that the symbols before them lead to, from the first state or from any that another chunk
ends in. Maps are composed, as composition is associative, by a balanced scan; a composed map is
completed where it is asked for a state that was not foreseen, so the count is exact. Compiled states are
dropped between words and between a long word's stretches when they are many; a word that is under way
goes on from the live places of the state it had reached, which are all that a state is.

Cases: a null or empty text has no tokens; special strings in a text count one each; repeated rows
count alike; texts in rarely used scripts are split by the library's own tables, as Unicode versions differ.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import pairwise

import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Symbols of a chunk, and of a stretch of a long word whose chunks are composed; characters of a text that are split into words at a time.
CHUNK, STRETCH, AT_ONCE = 256, 1 << 14, 1 << 20
#: Words, and states, transitions or pairs of tokens that a worker remembers before it begins anew; bounds its memory, not its results.
REMEMBERED, STATES = 600_000, 300_000
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s")
RARE = regex.compile(r"[^\x00-՗Ḁ-₎ₐ-ₜ₠-⿿぀-ヿ一-鿿]")
END = 256


def symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Transducer(dict):
    """state << 9 | symbol -> (state, emitted count); words' counts are kept in `words`."""

    def __init__(self, path: str) -> None:
        with open(path) as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.path, self.library = path, None
        vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.byte = symbols()
        spelled = {t: i for t, i in vocab.items() if t not in self.special}
        self.spelling = {i: self.spell(t, end) for t, i in spelled.items()}
        self.base = {s[0]: i for i, s in self.spelling.items() if len(s) == 1}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.tree, self.token = {}, {}  # node << 9 | symbol -> node; node -> token
        for i, s in self.spelling.items():
            node = 0
            for c in s:
                node = self.tree.setdefault(node << 9 | c, len(self.tree) + 1)
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = Words(self)
        self.restart()

    def spell(self, token: str, end: str) -> tuple[int, ...]:
        stem = token.removesuffix(end)
        codes = [self.byte[c] for c in stem]
        return (*codes[:-1], codes[-1] + END) if stem != token else tuple(codes)

    def restart(self) -> None:
        """Drops what was compiled, but not the counts of words."""
        self.clear()
        self.fits.clear()
        self.states, self.numbers = [((0, -1, 0),)], {((0, -1, 0),): 0}

    def bounded(self, state: int = 0) -> int:
        """The state, by its number after a restart if too much was compiled."""
        if max(len(self.states), len(self), len(self.fits)) <= STATES:
            return state
        places = self.states[state]
        self.restart()
        return self.number(places)

    def number(self, places: tuple[tuple[int, int, int], ...]) -> int:
        if (known := self.numbers.get(places)) is None:
            known = self.numbers[places] = len(self.states)
            self.states.append(places)
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: merging both spellings gives a and b again."""
        if (known := self.fits.get((a, b))) is None:
            ids = [self.base[s] for s in self.spelling[a] + self.spelling[b]]
            while len(ids) > 1:
                (rank, made), k = min((self.merges.get(p, (1 << 40, 0)), k) for k, p in enumerate(pairwise(ids)))
                if rank == 1 << 40:
                    break
                ids[k : k + 2] = [made]
            known = self.fits[a, b] = ids == [a, b]
        return known

    def __missing__(self, key: int) -> tuple[int, int]:
        """Compiles the transition: a state's live places are (node, token before it, count there less the count here)."""
        state, symbol = key >> 9, key & 511
        live, last, emitted = [], -1, 0
        for node, before, count in self.states[state]:
            if (after := self.tree.get(node << 9 | symbol)) is None:
                continue
            live.append((after, before, count))
            token = self.token.get(after)
            if last < 0 and token is not None and self.follows(before, token):
                last, emitted = token, count + 1
        places = (*((n, b, c - emitted) for n, b, c in live), (0, last, 0)) if symbol < END else self.states[0]
        made = self[key] = self.number(places), emitted
        return made

    def follows(self, before: int, token: int) -> bool:
        return self.fit(before, token) if before >= 0 else self.alone(token)

    def alone(self, token: int) -> bool:
        """Whether merging a token's own spelling gives it again."""
        if (known := self.fits.get((-1, token))) is None:
            ids = [self.base[s] for s in self.spelling[token]]
            while len(ids) > 1:
                (rank, made), k = min((self.merges.get(p, (1 << 40, 0)), k) for k, p in enumerate(pairwise(ids)))
                if rank == 1 << 40:
                    break
                ids[k : k + 2] = [made]
            known = self.fits[-1, token] = ids == [token]
        return known

    def through(self, state: int, symbols: tuple[int, ...]) -> tuple[int, int]:
        """The exit state and emitted count of symbols that are read from a state on."""
        total = 0
        for symbol in symbols:
            state, emitted = self[state << 9 | symbol]
            total += emitted
        return state, total

    def run(self, word: bytes, chunk: int = CHUNK) -> int:
        state, total = self.bounded(), 0
        for start in range(0, len(word), STRETCH):
            symbols = tuple(word[start : start + STRETCH])
            if start + STRETCH >= len(word):
                symbols = (*symbols[:-1], symbols[-1] + END)
            state, emitted = self.stretch(state, symbols, chunk)
            state, total = self.bounded(state), total + emitted
        return total

    def stretch(self, entry: int, symbols: tuple[int, ...], chunk: int) -> tuple[int, int]:
        """The exit state and emitted count of a stretch, by its chunks' maps."""
        if len(symbols) <= chunk:
            return self.through(entry, symbols)
        maps = [StateMap(self, symbols[at : at + chunk]) for at in range(0, len(symbols), chunk)]
        maps[0].at(entry)
        for before, after in pairwise(maps):  # each by itself: from the first state, as if the chunk before began a word
            after.at(before.at(0)[0])
        while len(maps) > 1:  # a balanced scan
            maps = [compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0].at(entry)

    def count_plain(self, text: str) -> int:
        """Of text without special strings, cut at white space only: the sum of its words' counts, each from the first state to itself."""
        words = self.words
        if RARE.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return sum(self.run(bytes(self.byte[c] for c in p)) for p, _ in pieces)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum([words[w] for w in WORD.findall(text.lower())])

    def count_text(self, text: str, at_once: int = AT_ONCE) -> int:
        """A long text goes in parts that end at white space, where the state is the first one."""
        total = at = 0
        while len(text) - at > at_once and (white := SPACE.search(text, at + at_once)):
            total += self.count_plain(text[at : white.end()])
            at = white.end()
        return total + self.count_plain(text[at:] if at else text)

    def count(self, text: str, at_once: int = AT_ONCE) -> int:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.count_text(text, at_once)
        parts = self.at_special.split(text)
        return len(parts) - 1 + sum(self.count_text(p, at_once) for p in parts)


class StateMap:
    """entry state -> (exit state, emitted count) of a chunk, or of two that were composed."""

    def __init__(self, of: Transducer, symbols: tuple[int, ...] = (), parts: tuple[StateMap, ...] = ()) -> None:
        self.of, self.symbols, self.parts, self.table = of, symbols, parts, {}

    def at(self, entry: int) -> tuple[int, int]:
        if (known := self.table.get(entry)) is None:
            if self.parts:
                middle, count = self.parts[0].at(entry)
                exit_, more = self.parts[1].at(middle)
                known = exit_, count + more
            else:
                known = self.of.through(entry, self.symbols)
            self.table[entry] = known
        return known


def compose(a: StateMap, b: StateMap) -> StateMap:
    """a, then b: over the states in which a can be entered."""
    made = StateMap(a.of, parts=(a, b))
    for entry in a.table:
        made.at(entry)
    return made


class Words(dict):
    def __init__(self, of: Transducer) -> None:
        self.of = of

    def __missing__(self, word: str) -> int:
        n = self.of.run(word.encode())
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and n_tokens, by the vocabulary file at `path`."""

    def make():
        counts = transducer(path)

        def work(texts: list[str]) -> list[list]:
            return [[counts.count(t) for t in texts]]

        work.done = counts.words.clear  # compiled states stay
        return work

    return map_texts(docs, text, keep, "n_tokens long", make)
