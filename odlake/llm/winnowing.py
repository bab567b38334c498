"""Document fingerprints by winnowing, and how like a document's is to its edited text's and its neighbour's.

Every k code points in a row give a rolling hash; of every w hashes in a row the least is chosen, of
equal ones the rightmost, and its position is kept. So two texts that share k + w - 1 code points in
a row share a chosen hash, at positions that show where; and a text's choice depends on the text alone.
Likeness is the share of distinct chosen hashes that both have, of those that either has.

`beside_next` needs each document's next one in an order over the whole table. Keys are dealt to ranges
of even numbers of rows; each range's first row goes, besides, to the end of the range before it, so a
task sees every neighbour it needs while it reads its range once, a row at a time. Only one key a
range passes the driver, and texts are shuffled once.

Cases: a null text is empty and has no hash; a text shorter than k is one gram, one with fewer grams
than w one window. Two texts without hashes are alike (1). Documents of one id follow by a hash of
their texts; null ids come last; rows equal in id and text follow each other. The next of an only
document is itself, and an empty table gives no rows. A very long text is hashed in blocks. Columns
other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odlake.session import ship

from .common import map_texts

#: Code points of a gram, and hashes of a window: any 69 code points that two texts share are found.
GRAM, WINDOW = 20, 50
#: Window starts that are looked at together.
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15
#: Rows of output that are sent together.
ROWS = 256


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads a sum's low bits over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Winnower:
    def __init__(self, gram: int = GRAM, window: int = WINDOW) -> None:
        if gram < 1 or window < 1:
            raise ValueError("gram and window are at least 1")
        self.gram, self.window = gram, window
        longest = BLOCK + window + gram
        self.up, self.down = powers(BASE, longest), powers(pow(BASE, -1, 1 << 64), longest)

    def hashes(self, points: np.ndarray) -> np.ndarray:
        """A hash for each gram: differences of one running sum, moved to a common power."""
        n = len(points)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(points * self.up[:n], out=sums[1:])
        k = min(self.gram, n)
        return mixed((sums[k:] - sums[: n + 1 - k]) * self.down[: n + 1 - k] + np.uint64(k))

    def chosen(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """hash, position of the least, rightmost hash of each window, each position once, in order."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if not len(points):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams = max(1, len(points) - self.gram + 1)
        window = min(self.window, grams)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, grams - window + 1, BLOCK):
            starts = min(BLOCK, grams - window + 1 - at)
            h = self.hashes(points[at : at + starts + window + self.gram - 2])
            least, where = self.least(h, window)
            new = np.r_[True, where[1:] != where[:-1]]
            if found and where[0] + at == found[-1][1][-1]:
                new[0] = False
            found.append((least[new], where[new] + at))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    @staticmethod
    def least(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The least hash from each start on over `window`, and its rightmost position; spans double."""
        where, span = np.arange(len(h)), 1
        while span < window:
            step = min(span, window - span)
            right = h[step:] <= h[:-step]
            h, where = np.where(right, h[step:], h[:-step]), np.where(right, where[step:], where[:-step])
            span += step
        return h, where


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = set(a.tolist()), set(b.tolist())
    either = len(a | b)
    return len(a & b) / either if either else 1.0


def as_text(hashes: np.ndarray, places: np.ndarray) -> str:
    return ",".join([f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), places.tolist())])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`keep`, and hashes (signed) and places of the chosen grams, in the order of the text."""

    def make():
        winnower = Winnower(gram, window)

        def work(texts):
            made = [winnower.chosen(t) for t in texts]
            return [[h.view(np.int64) for h, _ in made], [p for _, p in made]]

        return work

    return map_texts(docs, text, keep, "hashes array<long>, places array<long>", make)


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, text, border: in each partition a range of falling ids, then, as border, the first row of the range that follows."""
    key = F.struct(F.col("id").alias("i"), F.xxhash64("text").alias("h"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("key", key)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("key").repartitionByRange(n, F.desc("key")).groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    firsts = [r[0] for r in ranges.select("key").orderBy(F.desc("key")).collect()]  # a row a partition
    kind = rows.schema["id"].dataType
    heads = F.array(*(F.struct(F.lit(f["i"]).cast(kind).alias("i"), F.lit(f["h"]).cast("long").alias("h")) for f in firsts)) if firsts else F.array(F.col("key"))
    rows = rows.withColumn("at", F.size(F.filter(heads, lambda head: head >= F.col("key"))) - 1)
    first = F.try_element_at(heads, F.col("at") + 1) == F.col("key")
    own, before = F.struct(F.col("at").alias("range"), F.lit(False).alias("border")), F.struct(F.pmod(F.col("at") - 1, F.lit(max(1, len(firsts)))).alias("range"), F.lit(True).alias("border"))
    placed = rows.select("id", "text", "key", F.inline(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    return placed.repartitionById(max(1, len(firsts)), "range").sortWithinPartitions("border", F.desc("key")).select("id", "text", "border")


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is written as hash:position pairs. The edited text is the text with its last half
    (rounded down) replaced by as many first code points of the next document, in falling order of ids;
    the last is followed by the first.
    """
    ship(docs.sparkSession)
    schema = f"id {docs.schema[doc_id].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        pa.set_memory_pool(pa.system_memory_pool())
        winnower, types = Winnower(gram, window), to_arrow_schema(kind)

        def pairs():
            """Each row with its print, and the next one's text and print."""
            last = None
            for batch in batches:
                for k in range(batch.num_rows):
                    border = batch.column(2)[k].as_py()
                    if border and last is None:
                        return
                    now = batch.column(1)[k].as_py()
                    row = (batch.column(0)[k], now, winnower.chosen(now))
                    if last is not None:
                        yield last, row
                    if border:
                        return
                    last = row

        made: list[tuple] = []
        for (name, own, mark), (_, after, next_mark) in pairs():
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            edited_mark = winnower.chosen(edited)
            made.append((name, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_text(*mark), as_text(*edited_mark), likeness(mark[0], edited_mark[0]), likeness(mark[0], next_mark[0])))
            if len(made) == ROWS:
                yield batch_of(made, types)
                made = []
        if made:
            yield batch_of(made, types)

    kind = docs.sparkSession.createDataFrame([], schema).schema
    return in_order(docs, doc_id, text).mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[row[k].as_py() for row in rows] if k == 0 else [row[k] for row in rows] for k in range(len(schema))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
