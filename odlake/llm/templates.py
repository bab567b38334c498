"""Benchmark decontamination by canonical templates.

Words are lower-cased, and numbers (also in words), the units after numbers, and names (capitalised inside
a sentence, several in a row being one name) become typed placeholders; once with names kept as words,
and once with names as placeholders. Every
window of `WINDOW` canonical words with enough plain words is hashed, and documents' windows join the
benchmark's by hash. Matches on one diagonal (same offset between document and item) belong together;
what stands in the slots should agree along it: a value of the item is bound to the document's value
that most windows have for it (of equally many, to itself), and windows with other values do not count.
So a question with other numbers or names is caught, also where values coincide or one was altered,
and a chance hit of equal templates is not. An item is leaked by a document if enough consistent
windows match: half of the item's windows that have enough plain words but `FEW` at least, or half of
all its windows, or `ENOUGH`, whichever is least. An item of too few such windows is compared whole,
by all its windows of words with their values, so that its exact copies are found.

The join is a shuffle join; before it, documents' windows pass a bit table of fixed size that the
benchmark's hashes set, which is broadcast and only ever lets too much through.

Cases: null and empty texts, and items under `LEAST` words, match nothing; items shorter than a
window are one window; equal items are each reported; repeated rows are reported once; a null doc_id or
item_id is reported as such; columns other than those read are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odlake.session import ship

from .common import cut, frugal, parts_of

WINDOW, LEAST, ENOUGH, FEW = 8, 4, 6, 3
#: The layer of words with their values, beside the two of templates (names as words, names as placeholders).
RAW = 2
#: log2 of the bits of the broadcast table: 4 MB, whatever the benchmark's size.
BITS = 25
#: The units that follow numbers.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons cent cents dollar dollars euro euros usd eur gbp percent degree degrees kmh mph".split())
#: The words for numbers.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice thrice".split())
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?\n]")
PLAIN, CAPITAL, NUMBER, STOP, UNIT = range(5)
#: Kinds of placeholder, as hashes, and the odd multiplier of the windows' hash.
SLOT, MULTIPLIER = {NUMBER: 0x9E3779B97F4A7C15, UNIT: 0xC2B2AE3D27D4EB4F, CAPITAL: 0x165667B19E3779F9}, np.uint64(0xD6E8FEB86659FD93)
REMEMBERED = 500_000
#: Characters of text whose windows are hashed at a time.
AT_ONCE = 1 << 20


class Codes(dict):
    """token -> its 61-bit hash and kind in the low 3 bits."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        first, low = token[0], token.lower()
        data = low.encode()
        kind = STOP if first in ".!?\n" else NUMBER if first.isdigit() or low in NUMBERS else UNIT if low in UNITS else CAPITAL if first.isupper() else PLAIN
        value = self[token] = (((crc32(data) << 32 | crc32(data, 0x5BD1E995)) * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFF8) | kind
        return value


class Canonical:
    """A text's canonical words, twice: with names as words, and with names as placeholders; and as they are."""

    def __init__(self, codes: Codes, texts: list[str]) -> None:
        """The texts' words follow each other; `text` tells which a word is of."""
        found = [TOKEN.findall(t) for t in texts]
        self.tokens = [w for f in found for w in f]
        coded = np.fromiter(map(codes.__getitem__, self.tokens), np.uint64, len(self.tokens))
        kind = (coded & np.uint64(7)).astype(np.int8)
        of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        fresh = np.r_[True, (kind[:-1] == STOP) | (of[1:] != of[:-1])][: len(kind)]  # begins a text or sentence
        self.kept = np.flatnonzero(kind != STOP)
        fresh, kind, of, coded = fresh[self.kept], kind[self.kept], of[self.kept], coded[self.kept] >> np.uint64(3)
        after_number = np.r_[False, kind[:-1] == NUMBER][: len(kind)]
        self.layers = []
        for names in (False, True):
            slot = np.where(kind == NUMBER, NUMBER, np.where((kind == UNIT) & after_number, UNIT, np.where((kind == CAPITAL) & ~fresh & names, CAPITAL, PLAIN)))
            word = coded.copy()
            for k, h in SLOT.items():
                word[slot == k] = np.uint64(h)
            begins = np.flatnonzero(~((slot == CAPITAL) & np.r_[False, slot[:-1] == CAPITAL][: len(slot)]))  # of words, or of names of several
            self.layers.append(Layer(begins, np.r_[begins[1:], len(slot)], slot[begins], word[begins], of[begins]))
        place = np.arange(len(coded))
        self.layers.append(Layer(place, place + 1, np.full(len(coded), PLAIN, np.int8), coded, of))

    def windows(self, names: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of one text each that have enough plain words; of RAW, all."""
        layer = self.layers[names]
        word, n = layer.word, len(layer.word) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h *= MULTIPLIER
            h += word[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h += np.uint64(names + 4 * size)
        plain = np.cumsum(np.r_[0, layer.slot == PLAIN])
        at = np.flatnonzero((layer.text[:n] == layer.text[size - 1 :]) & (plain[size:] - plain[:-size] >= LEAST))
        return at, h[at].view(np.int64)

    def filled(self, names: int, at: int, size: int) -> list[str]:
        """kind:value of each slot of a window, in order."""
        layer = self.layers[names]
        return [f"{layer.slot[k]}:{' '.join(self.tokens[w].lower() for w in self.kept[layer.begin[k] : layer.end[k]])}" for k in range(at, at + size) if layer.slot[k] != PLAIN]


class Layer(NamedTuple):
    """Canonical words: from which word to which, their kinds of placeholder, hashes, and texts."""

    begin: np.ndarray
    end: np.ndarray
    slot: np.ndarray
    word: np.ndarray
    text: np.ndarray


def of_items(items: DataFrame) -> DataFrame:
    """item_id, size, windows, need, names, at, hash, slots: a row for each window of each item; windows: of these, how many; need: how many must match."""

    def run(batches):
        codes = Codes()
        for batch in batches:
            rows = []
            for item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = Canonical(codes, [text or ""])
                if len(made.kept) < LEAST:
                    continue
                lengths = [len(layer.word) for layer in made.layers]
                sizes = [min(WINDOW, n) for n in lengths]
                found = [made.windows(names, size) for names, size in enumerate(sizes)]
                need = [min(-(-(n - size + 1) // 2), ENOUGH, max(-(-len(at) // 2), FEW)) for n, size, (at, _) in zip(lengths, sizes, found)][:RAW] + [len(found[RAW][0])]
                reached = [k for k in (0, 1) if len(found[k][0]) >= need[k]]
                for names in reached or [RAW]:
                    for at, h in zip(*found[names], strict=True):
                        rows.append((item_id, sizes[names], len(found[names][0]), need[names], names, int(at), int(h), made.filled(names, at, sizes[names])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["item_id", "size", "windows", "need", "names", "at", "hash", "slots"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(frugal(run), "item_id long, size int, windows long, need long, names int, at long, hash long, slots array<string>")


def of_documents(docs: DataFrame, table, layers: list[tuple[int, int]], text: str) -> DataFrame:
    """doc_id, row, at, hash, slots: the windows whose hash may be an item's. layers: each names and size of the items' windows."""
    fields = ["doc_id", "row", "at", "hash", "slots"]

    def run(batches):
        codes, bits = Codes(), np.frombuffer(table.value, np.uint8)
        for batch in (part for whole in batches for part in parts_of(whole, 1)):
            ids, texts = (c.to_pylist() for c in batch.columns)
            start = 0
            while start < len(texts):
                stop, n = start, 0
                while stop < len(texts) and (stop == start or n < AT_ONCE):
                    n += len(texts[stop])
                    stop += 1
                made, rows = Canonical(codes, texts[start:stop]), []
                for names, size in layers:
                    of = made.layers[names].text
                    first = np.searchsorted(of, np.arange(stop - start))
                    at, h = made.windows(names, size)
                    place = h.view(np.uint64) >> np.uint64(64 - BITS)
                    hit = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    for a, x in zip(at[hit].tolist(), h[hit].tolist()):
                        k = int(of[a])
                        rows.append((ids[start + k], crc32(texts[start + k].encode()), a - int(first[k]), x, made.filled(names, a, size)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], fields)
                start = stop

    inner = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return inner.mapInArrow(frugal(run), "doc_id long, row long, at long, hash long, slots array<string>")


def bit_table(windows: DataFrame) -> bytes:
    """The bits that the windows' hashes set: made of 64-bit words, of which each is OR-ed before it is gathered."""
    place = windows.select(F.shiftrightunsigned("hash", 64 - BITS).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    table = np.zeros(1 << BITS - 6, np.int64)
    for word, bits in words.toLocalIterator():  # of at most 2**(BITS - 6) rows
        table[word] = bits
    return table.tobytes()


def bound(hits: list[dict]) -> tuple[int, bool]:
    """Of a diagonal's windows, how many agree with the document's value that most have for each value of the item; and whether any slot holds another value."""
    votes = Counter((s["item"], s["doc"]) for h in hits for s in h["slots"])
    most: dict[str, tuple] = {}
    for (item, doc), n in votes.items():
        most[item] = max(most.get(item, (0, False, "")), (n, item == doc, doc))
    agree = {h["at"] for h in hits if all(most[s["item"]][2] == s["doc"] for s in h["slots"])}
    return len(agree), any(item != doc for item, doc in votes)


def consistent(batches):
    """Runs with n_windows and changed in place of hits."""
    for batch in batches:
        made = [bound(hits) for hits in batch.column("hits").to_pylist()]
        kept = [c for c in batch.schema.names if c != "hits"]
        arrays = [pa.array([n for n, _ in made], pa.int64()), pa.array([c for _, c in made], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, "n_windows", "changed"])


def leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (matched), coverage (of the item's windows), changed (whether a slot holds another value)."""
    ship(docs.sparkSession)
    known = cut(of_items(items))
    layers = sorted(tuple(r) for r in known.select("names", "size").distinct().collect())  # at most 3 * WINDOW
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(known))
    hits = of_documents(docs, shared, layers, text).alias("d").join(known.alias("i"), F.expr("d.hash = i.hash"))
    where = ["doc_id", "row", "item_id", "names", "diagonal"]
    hits = hits.selectExpr("doc_id", "row", "item_id", "names", "d.at - i.at as diagonal", "i.at as at", "windows", "need", "zip_with(i.slots, d.slots, (x, y) -> struct(x as item, y as doc)) as slots")
    runs = hits.groupBy(*where).agg(F.countDistinct("at").alias("n"), F.max("windows").alias("windows"), F.max("need").alias("need"), F.collect_set(F.struct("at", "slots")).alias("hits")).where("n >= need")
    found = runs.drop("n", "row").mapInArrow(frugal(consistent), "doc_id long, item_id long, names int, diagonal long, windows long, need long, n_windows long, changed boolean").where("n_windows >= need")
    best = F.max_by(F.struct("n_windows", (F.col("n_windows") / F.col("windows")).alias("coverage"), "changed"), F.struct("n_windows", -F.col("names"), -F.col("diagonal")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
