"""Near-duplicate documents by SimHash, compared at the anchors of a covering code.

A document's fingerprint has a bit for each of 64 majority votes over the hashes of its 3-word
shingles. Of two fingerprints that differ in 3 bits at most, one half differs in 1 bit at most. Over
31 bits of each half, the anchors are the words of the perfect Hamming code, within 1 bit of which
every value lies. A fingerprint is at home at its nearest anchor, and is copied to every anchor
within 1 + 1 bits, 16 at most; so the home anchor of either of two linked fingerprints holds both.
Per anchor, those at home are compared with all there, and what is linked becomes a spanning
forest, never all pairs; components of the forests' edges give the result.

Only distinct fingerprints are compared, so exact copies cost nothing. An anchor with more than
`crowd` fingerprints is split into blocks of that size, compared block by block in tasks of their own.
Documents of a fingerprint that at least one in `HOT` rows has get their component where they are, as
there can be at most `HOT` such fingerprints; the rest meet theirs by a shuffle.

Cases: null and empty texts, and those of white space alone, have fingerprint zero and link like
any other; a text under 3 words is one shingle; repeated rows share all; a null doc_id takes part,
is no component_id, and has null where no doc_id is reachable. Columns other than those read are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, frugal_groups, map_texts
from .components import components

SEED, SHINGLE, LINKED = 42, 3, 3
#: Fingerprints at one anchor from which it is split into blocks.
CROWD = 8192
#: Fingerprints that are common: the share 1 / HOT of all rows or more. At most HOT are.
HOT = 1000
#: Shingles whose votes are counted at a time, and pairs compared at a time.
AT_ONCE = 1 << 18
#: Over 31 bits, the positions (1 to 31) whose number has bit k; the parities over them give the position to flip.
PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: letters A-Z, and white space \x20 and \x09-\x0D, only
    if not words:
        return 0
    n, votes = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        some = words[at : at + AT_ONCE + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * votes > n))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and fp, the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, text, keep, "fp long", make, as_bytes=True)


def at_anchors(fps: DataFrame) -> DataFrame:
    """anchor, fp, home: a row for each anchor within 2 bits of either half of a distinct fp."""
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(0x7FFFFFFF).alias("x")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).bitwiseAND(0x7FFFFFFF).alias("x")))).alias("h")).select("fp", "h.*")
    off = sum(F.bit_count(F.col("x").bitwiseAND(mask)).bitwiseAND(1) * (1 << k) for k, mask in enumerate(PARITY))
    halves = halves.withColumn("off", off)
    home = "x ^ if(off = 0, 0L, shiftleft(1L, off - 1))"
    near = "transform(filter(sequence(1, 31), i -> i < (i ^ off)), i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ off) - 1))"
    spread = halves.select("fp", "half", F.posexplode(F.expr(f"concat(array({home}), {near})")))
    return spread.select((F.col("half") * (1 << 31) + F.col("col")).alias("anchor"), "fp", (F.col("pos") == 0).alias("home"))


def compared(rows: pa.Table) -> pa.Table:
    """A bucket's anchors: (a, b) edges of a spanning forest over its linked fingerprints."""
    key, block, fp, home = (rows[c].to_numpy() for c in ("anchor", "block", "fp", "home"))
    order = np.lexsort((~home, block, key))
    key, block, fp, home = key[order], block[order], fp[order], home[order]
    nodes, node = np.unique(fp, return_inverse=True)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    size = np.diff(np.r_[first, len(key)])
    group = np.repeat(np.arange(len(first)), size)
    at_home = np.flatnonzero(home & (size[group] > 1))
    pairs, label = np.cumsum(size[group[at_home]]), np.arange(len(nodes))
    done = 0
    while done < len(at_home):
        base = pairs[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(pairs, base + AT_ONCE * 8, "right")))
        some = at_home[done:upto]
        n = size[group[some]]
        x = np.repeat(some, n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[some]], n)
        linked = np.bitwise_count(fp[x] ^ fp[y]) <= LINKED
        a, b = node[x[linked]], node[y[linked]]
        while len(left := np.flatnonzero(label[a] != label[b])):
            a, b = a[left], b[left]
            np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
            while not np.array_equal(label, up := label[label]):
                label = up
        done = upto
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"a": nodes[joined], "b": nodes[label[joined]]})


def near_duplicates(docs: DataFrame, text: str = "text", crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links."""
    marked = cut(fingerprints(docs, text))
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    spark, rows = docs.sparkSession, at_anchors(groups.select("fp"))
    distinct, total = groups.agg(F.count("*"), F.sum("copies")).first()
    n = buckets(spark, 31 * distinct, 200_000)
    crowds = rows.groupBy("anchor").count().where(F.col("count") > crowd).withColumn("parts", F.ceil(F.col("count") / crowd).cast("int")).drop("count")
    crowds = cut(crowds)
    whole = rows.withColumn("block", F.lit(0).cast("long"))
    if not crowds.isEmpty():  # those at home in a block of the crowd meet all others block by block
        mine, others = F.pmod(F.xxhash64("fp"), "parts"), F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
        split = rows.join(crowds, "anchor")
        meet = split.where("home").select("anchor", "fp", "home", F.explode(F.transform(others, lambda j: mine * F.col("parts") + j)).alias("block"))
        meet = meet.union(split.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.transform(others, lambda i: i * F.col("parts") + mine)).alias("block")))
        whole = whole.join(crowds.select("anchor"), "anchor", "left_anti").select("anchor", "fp", "home", "block").union(meet)
    dealt = whole.withColumn("bucket", F.pmod(F.xxhash64("anchor", "block"), F.lit(n)))
    edges = dealt.groupBy("bucket").applyInArrow(frugal_groups(compared), "a long, b long")
    labels = components(edges)
    least = labels.join(groups, labels.node == groups.fp).groupBy("label").agg(F.min("least").alias("component_id"))
    of_linked = labels.join(least, "label").select(F.col("node").alias("fp"), "component_id")
    is_hot = F.col("copies") * hot >= F.lit(total or 0)
    of_all = cut(groups.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), is_hot.alias("hot")))
    common, rare = F.broadcast(of_all.where("hot").drop("hot")), of_all.where("not hot").drop("hot")  # common: `hot` rows at most
    found = marked.join(common, "fp").unionByName(marked.join(common, "fp", "left_anti").join(rare, "fp"))
    return found.select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
