"""From a portal to the store: planned settings become load targets, whose rows above the mark are asked for at the source.

The user's condition is in the portal's own filter language and goes to the portal with the mark, so rows
that a load does not need are not sent. Settings and a dataset's columns are small and read on the driver.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from odlake.operators.load import Store, Target, action_of
from odlake.plans.schema import SYSTEM_UPDATED
from odlake.session import ship
from odlake.sources.portal import Fetch, after, all_of, fetched, metadata_url, moment, parsed, quoted, sources


def columns_of(fetch: Fetch, portal: str, dataset: str, wait: float = 1.0) -> list[tuple[str, str]]:
    """A dataset's (field name, source type), in its own order."""
    columns = json.loads(fetched(fetch, metadata_url(portal, dataset), wait=wait)).get("columns") or []
    return [(c.get("fieldName") or "", c.get("dataTypeName") or "") for c in columns]


def newer_than(mark: dt.datetime | None, column: str, where: str = "", inclusive: bool = False, record: str | None = None) -> str:
    """The filter of a load in the portal's language: above the mark (and, at it, above a record's id), and the user's condition."""
    newer = mark and (f"{column} >= {quoted(moment(mark))}" if inclusive else after(column, moment(mark), record))
    return all_of(newer, where)


def rows_of(spark: SparkSession, portal: str, settings: Mapping, options: Mapping[str, str]) -> Callable[..., DataFrame]:
    """rows(mark) of a dataset, by many tasks; rows(mark, id, n): its next n rows in the order of both. A limit takes rows in the mark's order, so that none left behind is below the mark."""
    column, limit, full = settings["hwm_column"] or SYSTEM_UPDATED, settings["limit"], settings["mode"] == "full_replace"
    asked = {"portal": portal, "dataset": settings["dataset_id"], "systemFields": "true", "pageSize": str(settings["batch_size"])}

    def rows(mark: dt.datetime | None, record: str | None = None, most: int = 0) -> DataFrame:
        n = most or limit
        given = {"order": f"{column},:id" if n and (most or not full) else settings["order_by"], "where": newer_than(mark, column, settings["where"], record=record), "limit": str(n or "")}
        return parsed(spark.read.format("portal_rows").options(**{k: v for k, v in (asked | given | dict(options)).items() if v}).load())

    return rows


def targets(spark: SparkSession, plan: DataFrame, portal: str, fetch: Fetch, options: Mapping[str, str] | None = None) -> list[Target]:
    """A target for each row of `plan` (effective settings, with config_hash or without), in the order of ids."""
    ship(spark)
    for source in sources(fetch):
        spark.dataSource.register(source)
    options, made = options or {}, []
    for row in plan.orderBy("dataset_id").collect():  # one row a selected dataset
        s = row.asDict()
        columns = columns_of(fetch, portal, s["dataset_id"], float(options.get("wait", 1.0)))
        rows, every = rows_of(spark, portal, s, options), s["checkpoint_every_n_pages"] or 0
        group = lambda mark, record, rows=rows, n=every * s["batch_size"]: rows(mark, record, n)
        made.append(
            Target(
                s["dataset_id"],
                s["table"],
                columns,
                rows,
                mode=s["mode"],
                hwm_column=s["hwm_column"] or SYSTEM_UPDATED,
                skip=s["skip_columns"] or (),
                config_hash=s.get("config_hash") or "",
                limit=s["limit"] if s["mode"] != "full_replace" else 0,
                checkpoint_every_n_pages=0 if s["limit"] else every,
                group=group,
            )
        )
    return made


def dry_run(plan: DataFrame, store: Store) -> DataFrame:
    """dataset_id, table, action (full_replace, bootstrap or delta), mark: what a run would do; nothing is fetched or written."""
    made = []
    for row in plan.select("dataset_id", "table", "mode").orderBy("dataset_id").collect():  # one row a selected dataset
        state = store.notes["dataset_state"].get(row["dataset_id"])
        action = action_of(row["mode"], state, store.manifest(row["table"]))
        made.append((*row[:2], action, state["hwm_updated_at"] if action == "delta" else None))
    return store.spark.createDataFrame(made, "dataset_id string, table string, action string, mark timestamp_ntz")


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """Rows as JSON lines; with an order files follow it, as they do without one for rows that come in order (a catalog's, by read_in_order)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)
