"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs.

Equal vectors are one node with their smallest ids. Nodes are dealt to shards of about `SHARD_BYTES`
of vectors at most by hash; their number depends on the vectors alone.
In each shard, nodes enter a directed graph in turn: a greedy search proposes neighbours, and pruning
keeps the nearest one and drops those that it brings much closer (relaxed by `ALPHA`), and so on, so
that edges stay few and diverse; edges back are pruned alike. A query's beam search walks every shard's
graph, and the best of all shards are ranked. Graphs are built and searched for many nodes at a time in
numpy, in double precision; distances are those after the extra coordinate that gives all vectors one
length, so that nearest means largest inner product whatever the lengths.

Every query searches every shard with a beam of one width, which together with the size of a shard
decides recall: a table of one full shard is the hardest case, as with more shards each holds fewer of the best. Shards are
built from an explicit partitioning by shard, one task each. A query's row is sent to each shard once,
and a graph is read once by each of a few tasks, past which the shard's queries stream in batches.
Every vector is indexed.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do
null ids; of rows that repeat an id, the least vector counts; vectors only meet those of as many
components; ties go to the smaller id; no vectors give no rows. Columns other than those read are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odlake.session import ship

from .common import cut

#: Bytes of a shard's vectors at most, and queries for which a graph is read once.
SHARD_BYTES, BLOCK = 16_000_000, 1 << 18
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Width of a query's beam, in every shard and at every size; with shards of SHARD_BYTES, enough for a table of one full shard.
SEARCH_BEAM = 192
#: Best nodes of a beam that are expanded at a time, and nodes that are searched for at a time.
STEP, AT_ONCE = 4, 256
#: Candidates among which edges are pruned, nearest first.
PRUNED_FROM = 128


def beam_search(queries: np.ndarray, padded: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of each query's final beam and their inner products, best first; -1 and -inf where there are fewer.

    padded: the n nodes' vectors, and zeros; links: their edges to nodes, or n for none, and a row of n.
    """
    q, n = len(queries), len(padded) - 1
    each = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for no node
    beam, score = np.full((q, width), n), np.full((q, width), -np.inf)
    done = np.zeros((q, width), bool)
    new = np.broadcast_to(entries, (q, len(entries)))
    while True:
        new = np.where(seen[each, new], n, new)
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[each, new] = True
        found = np.matmul(padded[new], queries[:, :, None])[:, :, 0]
        found[new == n] = -np.inf
        beam, score, done = np.hstack([beam, new]), np.hstack([score, found]), np.hstack([done, np.zeros(new.shape, bool)])
        best = np.argsort(-score, 1, kind="stable")[:, :width]
        beam, score, done = beam[each, best], score[each, best], done[each, best]
        ready = ~done & (beam < n)
        if not ready.any():
            return np.where(beam < n, beam, -1), score
        place = np.argsort(~ready, 1, kind="stable")[:, :STEP]  # the best that are not expanded yet
        chosen = np.where(ready[each, place], beam[each, place], n)
        done[each, place] = True
        new = links[chosen].reshape(q, -1)


def with_none(vectors: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What beam_search reads, of nodes and their edges (-1: none)."""
    n = len(vectors)
    return np.vstack([vectors, np.zeros(vectors.shape[1])]), np.vstack([np.where(edges < 0, n, edges), np.full((1, edges.shape[1]), n)])


def pruned(of: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node, up to `degree` of its candidates (-1: none). All vectors have one length."""
    length = float((vectors[0] ** 2).sum())
    near = np.matmul(vectors[candidates], vectors[of][:, :, None])[:, :, 0]
    off = (candidates < 0) | (candidates == of[:, None])
    near[off] = -np.inf
    order = np.argsort(-near, 1, kind="stable")[:, :PRUNED_FROM]
    each = np.arange(len(of))[:, None]
    candidates, near = candidates[each, order], near[each, order]
    twice = np.zeros(candidates.shape, bool)
    by_id = np.argsort(candidates, 1, kind="stable")
    sorted_ids = candidates[each, by_id]
    twice[each, by_id[:, 1:]] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    alive = np.isfinite(near) & ~twice
    given = vectors[candidates]
    among = 2 * (length - np.matmul(given, given.transpose(0, 2, 1)))  # squared distances
    away = 2 * (length - near)
    kept, row = np.full((len(of), degree), -1), np.arange(len(of))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[row, first]
        if not some.any():
            break
        kept[some, k] = candidates[row, first][some]
        alive &= alpha * alpha * among[row, first] > away
        alive[row, first] = False
    return kept


def built(vectors: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, degree; -1: none) and entry nodes of a shard's graph."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    squares = (vectors**2).sum(1)
    long = np.hstack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]])
    middle = int((long @ long.mean(0)).argmax())
    entries = np.unique(np.r_[middle, rng.choice(n, min(n, 8), replace=False)])
    edges = np.full((n, degree), -1)
    edges[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    padded, links = with_none(long, edges)
    long = padded[:n]
    for at in range(0, n, AT_ONCE):
        some = np.arange(at, min(n, at + AT_ONCE))  # rows come in hashed order
        proposed, _ = beam_search(long[some], padded, links, entries, width)
        edges[some] = pruned(some, np.hstack([proposed, edges[some]]), long, alpha, degree)
        links[some] = np.where(edges[some] < 0, n, edges[some])
        source, target = np.repeat(some, degree), edges[some].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(nodes), count.max(initial=1)), -1)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        by_count = np.argsort(count, kind="stable")  # few back edges: few candidates
        for part in range(0, len(nodes), AT_ONCE):
            which = by_count[part : part + AT_ONCE]
            edges[nodes[which]] = made = pruned(nodes[which], np.hstack([edges[nodes[which]], back[which, : count[which].max()]]), long, alpha, degree)
            links[nodes[which]] = np.where(made < 0, n, made)
    return edges, entries


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, vector: one row an id, of usable vectors."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    usable = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    return rows.where(usable).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of a matrix's rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal values of `by`, in parts: a run goes on while its key repeats."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
        heads = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for a, b in zip(heads, [*heads[1:], len(keys)]):
            yield keys[a], pa.Table.from_batches([batch.slice(a, b - a)])


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of graphs, from rows sorted by shard and dimension."""
    for (shard, dim), parts in groupby(grouped(batches, ["shard", "dim"]), lambda g: g[0]):
        rows = pa.concat_tables([part for _, part in parts])
        order = np.argsort(np.array([i[0] for i in rows["ids"].to_pylist()]), kind="stable")
        rows = rows.take(pa.array(np.random.default_rng(1).permutation(order)))
        vectors = matrix(rows["vector"])
        edges, entries = built(vectors)
        entry = np.zeros(len(rows), bool)
        entry[entries] = True
        made = {"shard": rows["shard"], "dim": rows["dim"], "vector": lists(vectors, pa.float64()), "ids": rows["ids"].cast(pa.list_(pa.int64())), "node": pa.array(np.arange(len(rows)), pa.int32()), "edges": lists(edges, pa.int32()), "entry": pa.array(entry)}
        yield from pa.table(made).to_batches(max_chunksize=8192)


def index(vectors: DataFrame, k: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """shard, dim, vector, ids (the k + 1 smallest of the vector), node, edges, entry: a row for each node; and the number of shards."""
    ship(vectors.sparkSession)
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.withColumn("dim", F.size("vector")))
    n, widest = nodes.agg(F.count("*"), F.max("dim")).first()
    shards = max(1, -(-n * 8 * (widest or 0) // shard_bytes))
    dealt = nodes.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), "dim", "vector", "ids")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "dim")
    return cut(dealt.mapInArrow(build, "shard int, dim int, vector array<double>, ids array<long>, node int, edges array<int>, entry boolean")), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int, width: int = SEARCH_BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, vector) the k best of all shards, without its own id."""
    blocks = -(-queries.count() // block) or 1
    width = max(k + 1, width)
    # a task's rows are a shard's graph, and behind it the queries of a block
    all_shards, all_blocks = (F.sequence(F.lit(0), F.lit(m - 1)) for m in (shards, blocks))
    asked = queries.select(F.explode(all_shards).alias("shard"), F.size("vector").alias("dim"), "vector", F.array("vec_id").alias("ids"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("array<int>").alias("edges"), F.lit(None).cast("boolean").alias("entry"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    rows = graphs.withColumn("block", F.explode(all_blocks)).unionByName(asked).withColumn("task", F.col("shard") * blocks + F.col("block"))
    rows = rows.repartitionById(shards * blocks, "task").sortWithinPartitions("task", "dim", F.col("node").asc_nulls_last()).select("task", "dim", "vector", "ids", "node", "edges", "entry")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, graph = [], None, None
        for key, part in grouped(batches, ["task", "dim"]):
            if key != of:
                held, of, graph = [], key, None
            split = len(part) - part["node"].null_count
            if split:
                held.append(part.slice(0, split))
            if split < len(part) and held:
                if graph is None:
                    graph = Graph(pa.concat_tables(held))
                    held = [None]
                yield from graph.best(part.slice(split), k, width)

    best = rows.mapInArrow(walk, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # of k rows a shard
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Graph:
    """A shard's graph in memory."""

    def __init__(self, rows: pa.Table) -> None:
        edges = rows["edges"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).astype(np.int64)
        (self.vectors, self.links), self.entries = with_none(matrix(rows["vector"]), edges), np.flatnonzero(rows["entry"].to_numpy())
        ids = rows["ids"].combine_chunks()
        self.flat, self.sizes = ids.flatten().to_numpy(), np.asarray(pc.list_value_length(ids)).astype(np.int64)
        self.before = np.cumsum(self.sizes) - self.sizes

    def best(self, some: pa.Table, k: int, width: int) -> Iterator[pa.RecordBatch]:
        """The k best of this shard for each query."""
        asking, own = matrix(some["vector"]), some["ids"].combine_chunks().flatten().to_numpy()
        for at in range(0, len(own), AT_ONCE):
            found, score = beam_search(asking[at : at + AT_ONCE], self.vectors, self.links, self.entries, width)
            of, nth = np.nonzero(found >= 0)
            node = found[of, nth]
            n = self.sizes[node]
            who, s = np.repeat(own[at : at + AT_ONCE][of], n), np.repeat(score[of, nth], n)
            vec = self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.before[node], n)]
            other = who != vec
            who, vec, s = who[other], vec[other], s[other]
            order = np.lexsort((vec, -s, who))
            who, vec, s = who[order], vec[order], s[order]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            top = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) < k
            yield pa.RecordBatch.from_arrays([pa.array(c[top], t) for c, t in ((who, pa.int64()), (vec, pa.int64()), (s, pa.float64()))], ["query_id", "vec_id", "score"])


def nearest(table: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows."""
    vectors = cut(vectors_of(table, key, vector))
    graphs, shards = index(vectors, k)
    return search(graphs, shards, vectors.where(F.col("vec_id") % every == 0), k)
