"""Packages of a store: checksummed copies with a manifest, and an index of versions.

A file's hash is that of its bytes, or, of a file of several ranges, that of its ranges' hashes, a line each. Ranges are
hashed by tasks of their own, which read a piece at a time, so a file may be of any size.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odlake.operators.catalog import totals
from odlake.operators.load import Store, new_run_id

VERSION = 1
MANIFEST = "schema_version int, portal string, snapshot_id string, created_at timestamp_ntz, sha256 string, size_bytes long, dataset_count long, total_row_count long"
#: Fixed value: file names without path parts.
SAFE_NAME = r"^(?!\.{1,2}$)[^/\\]+$"
#: Bytes of a range, and of a piece that is read at a time.
RANGE, PIECE = 128 << 20, 4 << 20
#: Stores that Arrow opens on executors, by scheme; in others Spark reads files whole.
ARROW = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}


def file_hashes(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """name (below the folder), size_bytes, sha256 of each Parquet file, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    name = F.substring_index("path", f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1).alias("name")
    listed = files.select("path", name, F.col("length").alias("size_bytes"))  # names and sizes only: no content is read
    first = listed.first()
    if first is None or first["path"].partition(":")[0] not in ARROW:
        return files.select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    ranges = listed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(size).cast("long"))).alias("at"))
    tasks = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism))
    hashed = ranges.select("path", "name", "size_bytes", "at").repartition(tasks).mapInArrow(lambda batches: _hashed(batches, size), "name string, size_bytes long, at long, hash string")
    lines = F.array_sort(F.collect_list(F.struct("at", "hash")))["hash"]  # a row a range of one file
    one = F.when(F.count("*") == 1, F.max("hash")).otherwise(F.sha2(F.array_join(lines, "\n"), 256))
    return hashed.groupBy("name", "size_bytes").agg(one.alias("sha256"))


def _hashed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        made = []
        for path, at in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            scheme, _, rest = path.partition(":")
            system, place = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{ARROW[scheme]}:{rest}")
            digest, left = hashlib.sha256(), size
            with system.open_input_file(place) as f:
                f.seek(at)
                while left and (piece := f.read(min(PIECE, left))):
                    digest.update(piece)
                    left -= len(piece)
            made.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.string())], names=["name", "size_bytes", "at", "hash"])


def total_hash(files: DataFrame) -> DataFrame:
    """sha256 of the sorted list of the files' hashes, and their size."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "name")))  # a line a file
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def pack(store: Store, portal: str, folder: str, tables: Sequence[str]) -> str:
    """Copies the live versions as zstd Parquet, then writes the files' hashes and, last, the manifest. The snapshot's id."""
    spark, snapshot = store.spark, new_run_id()
    if (catalog := store.read("catalog")) is None:
        raise ValueError(f"{store.root} is no store: it has no catalog")
    target = f"{folder}/snapshot_id={snapshot}"
    for name in ("catalog", *tables):
        if (df := store.read(name)) is not None:
            df.write.option("compression", "zstd").parquet(f"{target}/data/{name}")
    files = file_hashes(spark, f"{target}/data")
    files.write.parquet(f"{target}/files")
    counts, total = totals(catalog, store.runs()).first(), total_hash(files).first()
    row = (VERSION, portal, snapshot, dt.datetime.now(dt.UTC).replace(tzinfo=None), total["sha256"], total["size_bytes"], counts["dataset_count"], counts["total_row_count"])
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{target}/manifest")
    return snapshot


def faults(spark: SparkSession, target: str) -> DataFrame:
    """name, fault of each file that is missing, extra, unsafely named, or of another size or hash than the package's list."""
    listed, there = spark.read.parquet(f"{target}/files").alias("l"), file_hashes(spark, f"{target}/data").alias("t")
    fault = F.when(F.col("t.name").isNull(), "missing").when(F.col("l.name").isNull(), "not listed").when(F.col("l.size_bytes") != F.col("t.size_bytes"), "size").when(F.col("l.sha256") != F.col("t.sha256"), "hash")
    unsafe = F.exists(F.split(F.col("l.name"), "/"), lambda part: ~part.rlike(SAFE_NAME))
    return listed.join(there, F.col("l.name") == F.col("t.name"), "full").select(F.coalesce("l.name", "t.name").alias("name"), F.when(unsafe, "unsafe name").otherwise(fault).alias("fault")).where("fault is not null")


def restore(spark: SparkSession, target: str, root: str, force: bool = False, verify: bool = True) -> None:
    """Checks a package, and copies its tables below root; an existing one is replaced only by force."""
    manifest = spark.read.parquet(f"{target}/manifest").first()
    if manifest["schema_version"] != VERSION:
        raise ValueError(f"unsupported schema_version {manifest['schema_version']}")
    if verify:
        if bad := faults(spark, target).orderBy("name").first():
            raise ValueError(f"{bad['name']}: {bad['fault']}")
        if total_hash(spark.read.parquet(f"{target}/files")).first()["sha256"] != manifest["sha256"]:
            raise ValueError("the list of files is not the manifest's")
    names = spark.read.parquet(f"{target}/files").select(F.substring_index("name", "/", 1).alias("t")).distinct()
    for (name,) in names.collect():  # a row a table
        spark.read.parquet(f"{target}/data/{name}").write.mode("overwrite" if force else "errorifexists").parquet(f"{root}/{name}")


def add_to_index(index: DataFrame, entries: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` snapshots of each portal, each once."""
    return retained(index.unionByName(entries), "portal", "snapshot_id", keep)


def retained(rows: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.dropDuplicates([by, order]).withColumn("__n", newest).where(F.col("__n") <= keep).drop("__n")


def latest(index: DataFrame, by: str = "portal", order: str = "snapshot_id") -> DataFrame:
    rest = [c for c in index.columns if c != by]
    return index.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("last")).select(by, "last.*")


def resolve(index: DataFrame, portal: str, snapshot_id: str | None = None) -> DataFrame:
    """The pinned or the latest snapshot of a portal."""
    own = index.where(F.col("portal") == portal)
    found = latest(own) if snapshot_id is None else own.where(F.col("snapshot_id") == snapshot_id)
    if found.isEmpty():
        raise ValueError(f"no snapshot {snapshot_id or ''} of {portal}")
    return found


def rules() -> dict[str, Column]:
    """What is wrong with an index entry, by rule."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return {
        "schema_version": F.coalesce(F.col("schema_version") != VERSION, F.lit(True)),
        "portal": blank("portal"),
        "snapshot_id": blank("snapshot_id"),
        "url": blank("url"),
        "sha256": blank("sha256"),
        "size_bytes": F.coalesce(F.col("size_bytes") <= 0, F.lit(True)),
        "created_at": F.col("created_at").isNull(),
    }


def violations(index: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """A row for each rule that an entry breaks."""
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in (checks or rules()).items())))
    return index.select("*", F.explode(broken).alias("rule"))
