"""Whitening of embeddings by principal components, from exact cross-products of bit planes.

A vector's entries c become whole numbers x = floor(256 c). The distinct x vectors are the fit list. A task
takes them in blocks: each dimension, shifted by its least value in the block, is sliced into bit planes, a
plane packed across rows into 64-bit words. The cross-product of two dimensions is the sum over their planes
a, b of 2^(a+b) times the bits that both planes have set, counted by AND and popcount; the shifts are put back
in whole numbers. Blocks' and tasks' sums are exact (32-bit limbs, added by Spark), the scatter is centred
as whole numbers, n C - S S', and only then divided and given to eigh. What passes the driver are the d
sums and d (d + 1) / 2 products of a vector of d dimensions, however many rows there are.

Cases: vectors null or with null, NaN or infinite entries are dropped; so are those whose length is not the
most common one (of equally common, the longer). Repeated vectors count once in the fit list, and get rows
each. x is held to the range of a long. A component without spread (eigenvalue zero to double precision: all
vectors equal along it) has a null whitened value; explained is null where no dimension has spread, and
identity_error is null if no component has. Of d < 4 dimensions there are d components. No rows give
no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odlake.session import ship

from .common import cut

SCALE, COMPONENTS = 256.0, 4
#: Words of bit planes that are combined together, at most, and rows of a block, at least.
WORDS, LEAST = 1 << 17, 64
LIMB = 32


@dataclass
class Model:
    n: int
    sums: list[int]
    axes: np.ndarray  # d x components, of unit length
    values: list[float]
    explained: list[float | None]

    @property
    def spread(self) -> list[int]:
        return [k for k, e in enumerate(self.values) if e > 0]


def valid(rows: DataFrame, vector: str) -> DataFrame:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.where(F.coalesce(F.forall(vector, finite), F.lit(False)))


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """x of each vector, a row each."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        x = np.floor(c * SCALE)
    top = x >= 2.0**63
    out = np.maximum(np.where(top, 0.0, x), -(2.0**63)).astype(np.int64)
    out[top] = np.iinfo(np.int64).max
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 1, 2, 4 or 8 bytes a number; equal rows give equal bytes."""
    out = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.full(len(x), 8)
    for size in (4, 2, 1):
        width[(low >= np.iinfo(f"i{size}").min) & (high <= np.iinfo(f"i{size}").max)] = size
    for size in (1, 2, 4, 8):
        at = np.flatnonzero(width == size)
        raw = x[at].astype(f"<i{size}").tobytes()
        step = size * x.shape[1]
        for k, row in enumerate(at.tolist()):
            out[row] = raw[k * step : (k + 1) * step]
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    x, sizes = np.empty((len(rows), dims), np.int64), np.array([len(r) for r in rows]) // dims
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x[at] = np.frombuffer(b"".join([rows[k] for k in at.tolist()]), f"<i{size}").reshape(-1, dims)
    return x


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of y (rows x dims, unsigned), a row of words each, the bit of each, and where each dimension's planes begin."""
    bits = [max(1, int(top).bit_length()) for top in y.max(axis=0)]
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.uint64)
    padded[: len(y)] = y
    made = np.zeros((sum(bits), len(padded) // 64), np.uint64)
    starts = np.cumsum([0, *bits[:-1]])
    for b in range(max(bits)):
        of = [d for d, n in enumerate(bits) if n > b]
        plane = np.packbits(((padded[:, of] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        made[starts[of] + b] = np.ascontiguousarray(plane.T).view(np.uint64)
    return made, np.concatenate([np.arange(n) for n in bits]), starts


def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (d) and cross-products (d x d) of a block's rows, exactly: arrays of Python's whole numbers."""
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, in which the difference fits
    words, bit, starts = planes(y)
    counts = np.zeros((len(words), len(words)), np.int64)
    for k in range(len(words)):
        counts[k, k:] = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
    counts = np.maximum(counts, counts.T)
    small = 2 * int(bit.max() + 1) + len(x).bit_length() < 63
    weight = np.array([1 << int(b) for b in bit], np.int64 if small else object)
    weighted = counts.astype(weight.dtype) * weight[:, None] * weight[None, :]
    cross = np.add.reduceat(np.add.reduceat(weighted, starts, axis=0), starts, axis=1).astype(object)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(weight.dtype) * weight
    sums, n, low = np.add.reduceat(ones, starts).astype(object), len(x), low.astype(object)
    cross = cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, cross


def limbs(i: np.ndarray, j: np.ndarray, values: list[int]) -> list[tuple[int, int, int, int]]:
    """(i, j, k, v): values as sums of v 2^(32 k), the last limb signed."""
    out = []
    for a, b, v in zip(i.tolist(), j.tolist(), values):
        k = 0
        while not -(1 << LIMB) <= v < 1 << LIMB:
            out.append((a, b, k, v & ((1 << LIMB) - 1)))
            v, k = v >> LIMB, k + 1
        out.append((a, b, k, v))
    return out


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and cross-products of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total_s, total_c, waiting = 0, np.zeros(dims, object), np.zeros((dims, dims), object), []
        block = max(LEAST, WORDS // (10 * dims) * 64)

        def add(rows: list[bytes]) -> None:
            nonlocal n, total_s, total_c
            s, c = products(unpacked(rows, dims))
            n, total_s, total_c = n + len(rows), total_s + s, total_c + c

        for batch in batches:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= block:
                add(waiting[:block])
                del waiting[:block]
        if waiting:
            add(waiting)
        if n:
            i, j = np.triu_indices(dims)
            alone, nothing = np.arange(dims), np.full(dims, -1)
            made = limbs(i, j, total_c[i, j].tolist()) + limbs(alone, nothing, total_s.tolist()) + [(-1, -1, 0, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "v"])

    ship(fit.sparkSession)
    parts = fit.mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()  # of d dimensions, not of rows
    n, sums, cross = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for i, j, k, v in parts:
        if i < 0:
            n = v
        elif j < 0:
            sums[i] += v << (LIMB * k)
        else:
            cross[i][j] += v << (LIMB * k)
            if i != j:
                cross[j][i] += v << (LIMB * k)
    return n, sums, cross


def fitted(n: int, sums: list[int], cross: list[list[int]], components: int) -> Model:
    s = np.array(sums, object)
    centred = n * np.array(cross, object) - np.outer(s, s)
    v = np.array([[int(c) / (n * n) for c in row] for row in centred])
    values, axes = np.linalg.eigh(v)
    top = range(len(sums) - 1, max(-1, len(sums) - 1 - components), -1)
    axes = axes[:, list(top)]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    trace = int(centred.trace()) / (n * n)
    least = trace * len(sums) * np.finfo(float).eps
    kept = [float(values[k]) if values[k] > least else 0.0 for k in top]
    return Model(n, sums, axes, kept, [e / trace if trace else None for e in kept])


class Projection:
    def __init__(self, model: Model) -> None:
        self.model, self.sums = model, np.array(model.sums, object)
        self.most, self.spread = max(map(abs, model.sums)), model.spread
        self.axes = model.axes[:, self.spread] / np.sqrt([model.values[k] for k in self.spread])

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly; of longs, where also the sum of its squares is one."""
        high = self.model.n * max(abs(int(x.min())), abs(int(x.max()))) + self.most
        if high * high * x.shape[1] < 1 << 63:
            return x * self.model.n - self.sums.astype(np.int64)
        return x.astype(object) * self.model.n - self.sums

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        """The components that have spread, a column each."""
        centred = moved / self.model.n
        return centred.astype(np.float64) @ self.axes


def identity_error(fit: DataFrame, model: Model, dims: int) -> float | None:
    """The largest absolute entry of the fit list's whitened covariance less the identity."""
    if not (spread := model.spread):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projection(model)
        for batch in batches:
            if batch.num_rows:
                w = project.whitened(project.moved(unpacked(batch.column(0).to_pylist(), dims)))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(len(spread))], names=[f"w{k}" for k in range(len(spread))])

    rows = fit.mapInArrow(run, ", ".join(f"w{k} double" for k in range(len(spread))))
    pairs = [(a, b) for a in range(len(spread)) for b in range(a, len(spread))]
    found = rows.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[k] - (a == b)) for k, (a, b) in enumerate(pairs))


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error for each row and component."""
    spark = rows.sparkSession
    ship(spark)
    rows = valid(rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("vector")), "vector")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("vector").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", vec_id)
    dims = lengths["d"]
    rows = rows.where(F.size("vector") == dims)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole(batch.column(0), dims)), pa.binary())], names=["x"])

    fit = cut(rows.select("vector").mapInArrow(pack, "x binary").distinct())
    model = fitted(*scatter(fit, dims), components)
    error = identity_error(fit, model, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, many = Projection(model), len(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            moved = project.moved(whole(batch.column(1), dims))
            squares, w = (moved * moved).sum(axis=1), project.whitened(moved)
            deviation = pc.cast(pa.array(squares), pa.decimal128(38, 0)) if squares.dtype == np.int64 else pa.array([Decimal(v) if v < 10**38 else None for v in squares.tolist()], pa.decimal128(38, 0))
            for k in range(many):
                n = batch.num_rows
                values = pa.array(w[:, model.spread.index(k)]) if k in model.spread else pa.nulls(n, pa.float64())
                same = lambda v, t: pa.array([v] * n, t)
                yield pa.RecordBatch.from_arrays([batch.column(0), same(k + 1, pa.int32()), same(model.n, pa.int64()), deviation, values, same(model.explained[k], pa.float64()), same(error, pa.float64())], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", vec_id)
