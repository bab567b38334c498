"""List, describe and search datasets over portals; run-log reductions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odlake.functions.text import contains_folded, table_name
from odlake.plans.schema import RECORD_ID


def latest_ok(runs: DataFrame, by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """The last successful run of each dataset; ties go to the greater run_id. A null in it stays null."""
    rest = [c for c in runs.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct("started_at", "run_id"))
    return runs.where("status = 'ok'").groupBy(*by).agg(last.alias("last")).select(*by, "last.*")


def portals(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all portals' tables, with the portal's alias first."""
    return reduce(lambda a, b: a.unionByName(b), (df.select(F.lit(name).alias("portal"), "*") for name, df in sorted(tables.items())))


def list_datasets(catalog: DataFrame, runs: DataFrame, portal: str | None = None, category: str | None = None) -> DataFrame:
    """portal, dataset_id, name, category, table_name, last_rows_written, updated_at of each dataset; by category substring, case folded."""
    kept = _scoped(catalog, portal).where(contains_folded(F.col("category"), category or ""))
    last = latest_ok(_scoped(runs, portal), ("portal", "dataset_id")).select("portal", F.col("dataset_id").alias("id"), "table_name", "rows_written")
    joined = kept.join(last, ["portal", "id"], "left")
    table = F.coalesce("table_name", table_name(F.col("id")))
    return joined.select("portal", F.col("id").alias("dataset_id"), "name", "category", table.alias("table_name"), F.col("rows_written").alias("last_rows_written"), "updated_at").orderBy("portal", "dataset_id")


def _scoped(table: DataFrame, portal: str | None) -> DataFrame:
    return table if portal is None else table.where(F.col("portal") == portal)


def found_by(needle: str) -> Column:
    """Substring of name or description, or a whole tag; case folded, the needle as it is."""
    if not needle.strip():
        raise ValueError("query must not be blank")
    tag = F.coalesce(F.exists("tags", lambda t: F.lower(t) == needle.lower()), F.lit(False))
    return contains_folded(F.col("name"), needle) | contains_folded(F.col("description"), needle) | tag


def search_datasets(catalog: DataFrame, runs: DataFrame, needle: str, portal: str | None = None) -> DataFrame:
    return list_datasets(catalog.where(found_by(needle)), runs, portal)


def ambiguous(catalog: DataFrame) -> DataFrame:
    """Ids in several portals, with the portals' names sorted."""
    return catalog.groupBy("id").agg(F.sort_array(F.collect_set("portal")).alias("portals")).where(F.size("portals") > 1)  # of the attached portals


def describe_dataset(catalog: DataFrame, runs: DataFrame, state: DataFrame, columns: DataFrame, dataset_id: str, portal: str | None = None) -> DataFrame:
    """One row: catalog entry, last successful run, state and columns (portal, table_name, pos, name, type; without the record key)."""
    if portal is not None and catalog.where(F.col("portal") == portal).isEmpty():
        raise ValueError(f"portal {portal!r} not attached")
    entry = _scoped(catalog, portal).where(F.col("id") == dataset_id)
    homes = sorted(r[0] for r in entry.select("portal").distinct().collect())  # of the attached portals
    if not homes:
        raise ValueError(f"dataset {dataset_id!r} not found")
    if len(homes) > 1:
        raise ValueError(f"dataset {dataset_id!r} is in portals {', '.join(homes)}; name one")
    return details(entry, runs, state, columns)


def details(entries: DataFrame, runs: DataFrame, state: DataFrame, columns: DataFrame) -> DataFrame:
    last = latest_ok(runs, ("portal", "dataset_id")).select("portal", F.col("dataset_id").alias("id"), "table_name", F.col("rows_written").alias("last_rows_written"), F.col("finished_at").alias("last_synced_at"))
    kept = state.select("portal", F.col("dataset_id").alias("id"), "hwm_updated_at", "last_full_replace_at")
    shown = columns.where(F.col("name") != RECORD_ID).groupBy("portal", "table_name").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))).alias("columns"))  # of one table
    joined = entries.join(last, ["portal", "id"], "left").join(kept, ["portal", "id"], "left")
    joined = joined.withColumn("table_name", F.coalesce("table_name", table_name(F.col("id"))))
    return joined.join(shown, ["portal", "table_name"], "left")


def totals(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """dataset_count, total_row_count: rows written by the last successful runs, 0 for none."""
    rows = latest_ok(runs).agg(F.coalesce(F.sum("rows_written"), F.lit(0)).alias("total_row_count"))
    return catalog.agg(F.count("*").alias("dataset_count")).join(rows, F.lit(True))


def tally(runs: DataFrame) -> DataFrame:
    """planned, ok, failed, aborted of each run."""
    return runs.groupBy("run_id").agg(F.count("*").alias("planned"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "failed", "aborted")))


def incomplete(runs: DataFrame) -> DataFrame:
    return runs.where("finished_at is null")


def key_faults(df: DataFrame, *key: str) -> DataFrame:
    """The keys that are null or repeated, with their rows."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(null | (F.col("n") > 1))
