"""Spelling variants: words one edit apart, each led to a much more frequent form.

Words are counted where texts are read, a task at a time in a table of bounded size, and summed by Spark. To
find the words that differ by one inserted, deleted or replaced code point, letters are hashed to a few
symbols. One edit of a word is one edit, or none, of its reduced word; so every word generates the full
one-edit neighbourhood of its reduced word, which is joined with the reduced vocabulary, and what meets is
verified on the words themselves. A reduced word is a polynomial over its symbols, modulo 2^64: all neighbours
come from its prefix sums, so a word's neighbourhood grows with its length, not with the square of it. A hash
that two reduced words share only gives one more pair to verify.

A word's form is its most frequent near word (of equally frequent, the first in the order of code points), if
that is `ratio` times as frequent as the word at least; counts rise along forms, so there are no circles. The
root is found by pointer doubling.

Cases: a null text has no words; a null doc_id is written as nothing before the colon; rows of one id are
counted each; a very long text is read in pieces that end between runs; a very long run is a word like any
other. Empty tables give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odlake.session import ship

from .common import cut, parts_of

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199
#: Symbols that letters are hashed to.
SYMBOLS = 8
#: Bytes of a text read at a time, distinct words counted before they are handed on, and hashes made at a time.
PIECE, TABLE, AT_ONCE = 4_000_000, 400_000, 1 << 21
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
OTHER = re.compile(rb"[^a-z\xc0-\xff]")


def counted(name: object, text: str, least: int, drop: int) -> Counter[bytes]:
    """Words of a text by count, as Latin-1: A-Z in lower case, and of some runs one code point dropped."""
    raw = text.encode("latin-1", "replace").lower()  # of bytes: only A-Z change; what is beyond Latin-1 is no letter here
    begun, found, at = zlib.crc32(b"%s:" % ("" if name is None else str(name)).encode()), Counter(), 0
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)  # shorter runs have no word of this length
    while at < len(raw):
        end = OTHER.search(raw, min(at + PIECE, len(raw)))
        end = end.start() if end else len(raw)
        for run, n in Counter(runs.findall(raw, at, end)).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
            if h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
                if len(run) < least:
                    continue
            found[run] += n
        at = end
    return found


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, drop: int = DROP, table: int = TABLE) -> DataFrame:
    """word, n: how often each word of `least` code points or more is in all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        total: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for part in parts_of(batch, 1):
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w, n in counted(name, t or "", least, drop).items():
                        total[w] += n
                    if len(total) >= table:
                        yield handed()
        if total:
            yield handed()

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


class Reduced:
    """Reduced words of one length, of rows of symbols from 1 on."""

    def __init__(self, rows: list[str], symbols: int) -> None:
        points = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").reshape(len(rows), -1)
        self.s, self.symbols = (points % symbols + 1).astype(np.uint64), symbols
        n = self.s.shape[1]
        self.power = np.full(n + 1, BASE, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.prefix = np.zeros((len(rows), n + 1), np.uint64)
        np.cumsum(self.s * self.power[:n], axis=1, out=self.prefix[:, 1:])

    def own(self) -> np.ndarray:
        return mixed(self.prefix[:, -1])

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """row, key: of each reduced word itself, and of all that one edit makes of it, each once."""
        s, power, before, whole = self.s, self.power, self.prefix, self.prefix[:, -1:]
        every = np.arange(1, self.symbols + 1, dtype=np.uint64)
        deleted = before[:, :-1] + (whole - before[:, 1:]) * np.uint64(BACK)
        replaced = (whole - s * power[:-1])[:, :, None] + every * power[:-1, None]  # the letter's own symbol gives the word itself
        inserted = (before + (whole - before) * np.uint64(BASE))[:, :, None] + every * power[:, None]
        keys = np.sort(np.concatenate([deleted, replaced.reshape(len(s), -1), inserted.reshape(len(s), -1)], axis=1), axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        return np.nonzero(new)[0], mixed(keys[new])


def keyed(vocabulary: DataFrame, symbols: int, near: bool) -> DataFrame:
    """key, wid: of each word (word, wid), its reduced word's key, or those of its whole neighbourhood."""
    ship(vocabulary.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            lengths, ids = np.array([len(w) for w in rows], np.int64), batch.column(1).to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                step = max(1, AT_ONCE // ((2 * symbols + 1) * int(n)))
                for some in (at[k : k + step] for k in range(0, len(at), step)):
                    reduced = Reduced([rows[k] for k in some.tolist()], symbols)
                    row, keys = reduced.near() if near else (np.arange(len(some)), reduced.own())
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[some][row])], names=["key", "wid"])

    return vocabulary.select("word", "wid").mapInArrow(run, "key long, wid long")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """wid, other, other_n: for each word (word, n, wid) those that its neighbourhood meets, to be verified."""
    owners = keyed(vocabulary, symbols, near=False).join(vocabulary.select("wid", F.col("word").alias("other"), F.col("n").alias("other_n")), "wid")
    owners = owners.withColumnRenamed("wid", "other_id")
    return keyed(vocabulary, symbols, near=True).join(owners, "key").where("wid <> other_id").select("wid", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: of words (word, root: their form), the last word that forms lead to."""
    while True:
        forms = cut(forms)
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = forms.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = cut(further)
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        forms = further.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, drop: int = DROP, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word that is frequent enough."""
    vocabulary = cut(words(docs, doc_id, text, least_length, drop).where(F.col("n") >= least_count).withColumn("wid", F.xxhash64("word")))
    met = vocabulary.join(near_words(vocabulary, symbols), "wid", "left")
    near = F.levenshtein("word", "other", 1) == 1
    best = F.min_by(F.when(near, F.struct("other", "other_n")), F.when(near, F.struct((-F.col("other_n")).alias("n"), "other")))
    judged = met.groupBy("wid", "word", "n").agg(F.count_if(near).alias("n_near"), best.alias("best"))
    leads = F.col("best.other_n") >= ratio * F.col("n")
    judged = cut(judged.select("word", "n", "n_near", F.when(leads, F.col("best.other")).alias("form"), F.when(leads, F.col("best.other_n")).alias("form_n")))
    found = roots(judged.where("form is not null").select("word", F.col("form").alias("root")))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
