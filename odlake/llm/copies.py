"""Near copies by the exact Jaccard similarity of sets of word shingles, found by min-hash bands.

A text's least values under `ROWS` x `BANDS` hash functions are cut into bands; texts that share a
band meet, and there the sets of shingles themselves are compared, so that no pair is linked below
`least`. A pair at a similarity of 0.8 misses all bands once in 2,900 times, one at 0.9 never in
practice. Texts may meet by other keys `also`, those of another method, whose pairs are checked in the same way.
Groups of the same texts meet once. What is linked becomes a spanning forest, never all
pairs; components of the forests' edges give the result.

Only distinct texts are compared. A group of more than `CROWD` texts or `BYTES` of them is split into
blocks, compared block by block in tasks of their own.

Cases: a text under `shingle` words is one shingle; null and empty texts, and those of white space
alone, have no shingles and are copies of each other; a null doc_id comes after all others; repeated
rows, and rows of one doc_id with different texts, are told apart by the text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odlake.session import ship

from .common import cut, frugal_groups, map_texts
from .components import components

SHINGLE, LEAST = 5, 0.8
ROWS, BANDS = 5, 20
CROWD, BYTES = 4096, 32_000_000
#: Of 64 min-hashes' lowest bits, how many may differ in a pair that is compared: at 0.8, more do once in 100,000 pairs.
APART = 18
#: Bytes of texts in a bucket of groups, and shingles hashed at a time.
EACH, AT_ONCE = 8_000_000, 4096
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, ROWS * BANDS, np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, in order; words are those of simhash.fingerprint."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= MULTIPLIER
        h += each[k : k + n]
        h ^= h >> np.uint64(31)
    return mixed(h)


def sketch(h: np.ndarray) -> tuple[np.ndarray, int]:
    """The bands' keys, and the lowest bits of 64 min-hashes."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), AT_ONCE):
        np.minimum(least, (FACTORS[:, None] * h[None, at : at + AT_ONCE]).min(1), out=least)
    least = mixed(least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * MULTIPLIER + part)
    return keys.view(np.int64), int(np.packbits((least[:64] & np.uint64(1)).astype(np.uint8)).view(np.int64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def linked(rows: pa.Table, size: int, least: float) -> pa.Table:
    """A bucket's groups: (a, b) edges of a spanning forest over the texts that are near copies."""
    key, block, part, node, bits = (rows[c].to_numpy() for c in ("key", "block", "part", "node", "bits"))
    texts, edges = rows["text"], []
    order = np.lexsort((node, block, key))
    ends = np.flatnonzero(np.r_[(key[order][1:] != key[order][:-1]) | (block[order][1:] != block[order][:-1]), True]) + 1
    for at, to in zip([0, *ends[:-1]], ends):
        some = order[at:to]
        sets, label = {}, np.arange(len(some))
        cross = len(set(part[some].tolist())) > 1
        for x in range(len(some) - 1):
            near = np.bitwise_count(bits[some[x]] ^ bits[some[x + 1 :]]) <= APART
            near &= label[x + 1 :] != label[x]
            if cross:  # pairs of one part meet in that part's own block
                near &= part[some[x + 1 :]] != part[some[x]]
            for y in (np.flatnonzero(near) + x + 1).tolist():
                if label[x] == label[y]:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = np.unique(shingles(texts[int(some[k])].as_py(), size))
                few, many = sorted((len(sets[x]), len(sets[y])))
                if few >= least * many and similarity(sets[x], sets[y]) >= least:
                    label[label == label[y]] = label[x]
                    edges.append((int(node[some[x]]), int(node[some[y]])))
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def of_few(keys: DataFrame, most: int = 200_000) -> DataFrame:
    """keys, to be broadcast only if there are at most `most`."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("shuffle_hash")


def links(texts: DataFrame, groups: DataFrame, size: int = SHINGLE, least: float = LEAST, also: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) over nodes. texts: __node, __text (bytes), as often as rows; groups: __node, bands, bits, bytes of each node; also: node, key, more keys at which nodes meet."""
    spark = groups.sparkSession
    rows = groups.select(F.col("__node").alias("node"), "bits", "bytes", F.explode("bands").alias("key"))
    if also is not None:
        rows = rows.unionByName(groups.select(F.col("__node").alias("node"), "bits", "bytes").join(also, "node"))
    who = (F.count("*").alias("count"), F.sum("bytes").alias("total"), F.min("node").alias("first"), F.max("node").alias("last"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    meet = rows.groupBy("key").agg(*who).where("count > 1")
    once = meet.groupBy("count", "total", "first", "last", "sum").agg(F.min("key").alias("key"))  # groups of the same texts
    once = once.select("key", F.greatest(F.ceil(F.col("count") / CROWD), F.ceil(F.col("total") / BYTES)).cast("long").alias("parts"))
    pairs = rows.join(once, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    with_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j))
    met = cut(pairs.select("key", "part", "node", "bits", "bytes", F.explode(with_all).alias("block")))
    total = met.agg(F.sum("bytes")).first()[0]
    if total is None:
        return spark.createDataFrame([], "a long, b long")
    needed = cut(met.select(F.col("node").alias("__need")).distinct())
    one = texts.join(of_few(needed), F.col("__node") == F.col("__need"), "left_semi").groupBy("__node").agg(F.first("__text").alias("text"))
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // EACH + 1)
    dealt = met.join(one, F.col("node") == F.col("__node")).select("key", "block", "part", "node", "bits", "text", F.pmod(F.xxhash64("key", "block"), F.lit(n)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(frugal_groups(lambda rows: linked(rows, size, least)), "a long, b long")


def one_of_each(docs: DataFrame, text: str = "text", size: int = SHINGLE, least: float = LEAST, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with one row of each component of near copies: of the smallest doc_id, and of its texts the one of the smallest hash. also: from (node, text), in as many rows as docs, the (node, key) of `links`."""
    ship(docs.sparkSession)

    def make():
        def work(texts: list[bytes]) -> list[list]:
            made = [sketch(shingles(t, size)) for t in texts]
            return [[k.tolist() for k, _ in made], [b for _, b in made]]

        return work

    content = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    keyed = docs.withColumn("__node", F.xxhash64(content)).withColumn("__bytes", F.octet_length(content).cast("long"))
    marked = cut(map_texts(keyed, text, ("doc_id", "__node", "__bytes"), "bands array<long>, bits long", make, as_bytes=True))
    groups = cut(marked.groupBy("__node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("__bytes").alias("bytes")))
    more = also and cut(also(keyed.select(F.col("__node").alias("node"), F.col(text).alias("text"))))
    labels = components(links(keyed.select("__node", content.alias("__text")), groups, size, least, more))
    of_all = groups.join(labels, groups["__node"] == labels.node, "left").select("__node", "id", F.coalesce("label", "__node").alias("label"))
    best = of_all.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("__node").alias("node"))).alias("best"))
    kept = of_all.join(best, "label").where("__node = best.node").select(F.col("__node").alias("__kept"), F.col("id").alias("__id"))
    mine = marked.groupBy("doc_id", "__node").agg(F.count("*").alias("n"))
    told = cut(mine.join(kept, (mine["__node"] == F.col("__kept")) & mine["doc_id"].eqNullSafe(F.col("__id")), "left").select(F.col("doc_id").alias("__i"), F.col("__node").alias("__k"), "n", F.col("__kept").isNull().alias("gone")))
    same = (F.col("__node") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__i"))
    left = keyed.join(of_few(told.where("gone").select("__i", "__k")), same, "left_anti")
    repeated = told.where("not gone and n > 1").select("__i", "__k")
    if not repeated.isEmpty():
        few = of_few(repeated)
        first = F.row_number().over(Window.partitionBy("doc_id", "__node").orderBy(F.lit(0)))  # equal rows but for other columns
        once = left.join(few, same, "left_semi").withColumn("__n", first).where("__n = 1").drop("__n")
        left = left.join(few, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)
