"""What the operators share: reading a table, and mapping whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odlake.session import ship


#: Bytes of text that a task works on at a time.
PART = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8"), F.lit(b""))


def parts_of(batch: pa.RecordBatch, text: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Hands freed memory back to the system, which a worker would keep while it waits and through its next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task's batches, with memory that is given back as it is freed, and all of it at the task's end."""

    @functools.wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # which gives freed batches back
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean


def frugal_groups(made: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """As frugal, for the function of a group."""

    def lean(rows: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return made(rows)
        finally:
            give_back()

    return lean


def frugal_pairs(made: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As frugal, for the function of two cogrouped groups."""

    def lean(a: pa.Table, b: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return made(a, b)
        finally:
            give_back()

    return lean


def map_texts(df: DataFrame, text: str, keep: Sequence[str], schema: str, make: Callable[[], Callable[[list], list]], as_bytes: bool = False) -> DataFrame:
    """`keep`'s columns and those of `schema`, which make() gives from a batch's whole texts.

    make runs once a task and returns the function of one batch: list of texts (null: empty) in,
    one Python list for each column of `schema` out. If that function has an attribute `done`, it is
    called when the task ends, to drop what a worker need not hold. Spark caps a batch at 64 MB, of
    which PART bytes of text are worked on at a time, so memory is bounded by these and by the longest
    single text. A text that is also kept is sent once.
    """
    ship(df.sparkSession)
    shared = text in keep and not as_bytes
    inner = df.select(*keep) if shared else df.select(*keep, (utf8(text) if as_bytes else F.col(text)).alias("__text"))
    kept, at = df.select(*keep).schema, list(keep).index(text) if shared else len(keep)
    out = df.sparkSession.createDataFrame([], schema).schema
    names = [*keep, *(f.name for f in out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in out]
        work, empty = make(), b"" if as_bytes else ""
        try:
            for batch in batches:
                for part in parts_of(batch, at):
                    made = work([t or empty for t in part.column(at).to_pylist()])
                    arrays = [*part.columns[: len(keep)], *(pa.array(x, t) for x, t in zip(made, types, strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
        finally:
            getattr(work, "done", lambda: None)()

    whole = kept
    for f in out:
        whole = whole.add(f)
    return inner.mapInArrow(frugal(run), whole)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only in local mode, as in tests, one of its own where none is named."""
    if (named := spark.conf.get("spark.checkpoint.dir", None)) is None and (named := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df from a file copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def without(docs: DataFrame, ids: DataFrame, most: int = 200_000, key: str = "doc_id") -> DataFrame:
    """docs but those of `ids` (of the column `key`, distinct); null keys stay. Only up to `most` ids are broadcast, more are shuffled."""
    ids = cut(ids)
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), key, "left_anti")


def buckets(spark: SparkSession, rows: int, each: int) -> int:
    """How many buckets of about `each` rows to deal `rows` rows to, and at least some for every partition."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // each + 1)
