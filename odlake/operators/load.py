"""Incremental loads into versioned Parquet tables: full replace, or a keyed merge above a high-water mark.

A store is a folder. A keyed table is kept in buckets by a hash of its key: <root>/<table>/v=<version>/__bucket=<k>
holds what a version wrote of bucket k, and a version's manifest names, for every bucket, the version whose
folder is its content. A load rewrites the buckets that its rows fall in and carries the others over by
reference. A version is written and checked before its manifest and the note that makes it live; state is
noted last; a failed run leaves the live version and the mark as they were. Counts, marks and faults of keys are
observed on the write itself. Superseded versions are removed after a retention time.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from odlake.functions.coerce import lenient_timestamp
from odlake.operators.catalog import tally
from odlake.operators.notes import Notes
from odlake.plans import schema
from odlake.plans.schema import RECORD_ID
from odlake.sources.folder import Folder

RUNS = "run_id string, dataset_id string, table_name string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, rows_written long, error string, duration_ms long, config_hash string"
STATE = "dataset_id string, hwm_updated_at timestamp_ntz, last_full_replace_at timestamp_ntz, last_run_id string, hwm_column string, hwm_id string"
LIVE = "table_name string, version string, published_at timestamp_ntz"
HWM, BUCKET, NEW = "__hwm", "__bucket", "__new"
#: How long a superseded version is kept.
RETENTION = dt.timedelta(days=7)


class SchemaDrift(Exception):
    pass


def new_run_id() -> str:
    """Ids sort by time."""
    return f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def last_write(rows: DataFrame, key: str | Sequence[str], *order: str) -> DataFrame:
    """One row a key: the last by `order`."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged(target: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """target's rows whose key is not in delta, and delta's. delta has each key once."""
    return target.join(delta.select(key), key, "left_anti").select(*target.columns).unionByName(delta.select(*target.columns))


def above(mark: dt.datetime | None, hwm: str, where: str | None = None, inclusive: bool = False) -> Column:
    """The delta's rows: newer than the mark (all, without one), and the user's own condition."""
    newer = F.lit(True) if mark is None else (F.col(hwm) >= F.lit(mark) if inclusive else F.col(hwm) > F.lit(mark))
    return newer & F.expr(f"({where})") if where else newer


def advanced(rows: DataFrame, hwm: str, previous: dt.datetime | None) -> DataFrame:
    """hwm: the greatest of the previous mark and the rows', nulls aside."""
    return rows.agg(F.greatest(F.lit(previous).cast("timestamp_ntz"), F.max(hwm)).alias("hwm"))


def page_marks(rows: DataFrame, hwm: str, page: Column, every: int, chunk: int = 10_000) -> DataFrame:
    """page, hwm: the running mark at every n-th page of rows that come ordered by hwm. Pages run in chunks, each led by the marks of the chunks before it."""
    pages = rows.groupBy(page.alias("page")).agg(F.max(hwm).alias("hwm")).withColumn("__chunk", F.floor(F.col("page") / chunk))
    upto = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    led = pages.groupBy("__chunk").agg(F.max("hwm").alias("__top")).select("__chunk", F.max("__top").over(upto).alias("__before"))
    running = F.max("hwm").over(Window.partitionBy("__chunk").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    marked = pages.withColumn("hwm", running).join(led, "__chunk")
    return marked.select("page", F.greatest("hwm", "__before").alias("hwm")).where(F.col("page") % every == 0)


@dataclass
class Target:
    """A dataset to load: rows(mark) gives landed rows (VARIANT v) above a mark; columns are its source columns.

    With checkpoint_every_n_pages, a delta is loaded in groups of so many pages: group(mark, id) gives the next
    rows above both, in their order, and the store's mark follows each group.
    """

    dataset_id: str
    table: str
    columns: Sequence[tuple[str, str]]
    rows: Callable[[dt.datetime | None], DataFrame]
    mode: str = ""
    hwm_column: str = schema.SYSTEM_UPDATED
    skip: Sequence[str] = ()
    where: str | None = None
    config_hash: str = ""
    inclusive: bool = False
    limit: int = 0
    checkpoint_every_n_pages: int = 0
    group: Callable[[dt.datetime | None, str | None], DataFrame] | None = None


@dataclass
class Written:
    """What a write has seen: its rows, their greatest mark, and the (mark, id) of the last one fetched."""

    rows: int
    mark: dt.datetime | None = None
    last: tuple[dt.datetime | None, str] | None = None


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """One writer a table at a time; any number of readers. `buckets` (default: spark.sql.shuffle.partitions) holds for tables that it creates; their manifests keep it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, retention: dt.timedelta | None = RETENTION) -> None:
        self.spark, self.root, self.retention = spark, root.rstrip("/"), retention
        self.buckets, self.folder = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), Folder(spark, root)
        kinds = {"sync_runs": (RUNS, ("run_id", "dataset_id")), "dataset_state": (STATE, ("dataset_id",)), "live": (LIVE, ("table_name",))}
        self.notes = {name: Notes(spark, self.folder, f"_meta/{name}", kind, key) for name, (kind, key) in kinds.items()}

    def runs(self) -> DataFrame:
        return self.notes["sync_runs"].table()

    def state(self) -> DataFrame:
        return self.notes["dataset_state"].table()

    def live(self, table: str) -> str | None:
        note = self.notes["live"].get(table)
        return note and note["version"]

    def manifest(self, table: str, version: str | None = None) -> dict | None:
        """Of a version, or of the live one: key, buckets (0: none), parts (versions: of each bucket, or all) and schema."""
        if (version := version or self.live(table)) is None or not self.folder.exists(name := f"{table}/_manifests/{version}.json"):
            return None
        return json.loads(self.folder.read(name))

    def read(self, table: str) -> DataFrame | None:
        return None if (made := self.manifest(table)) is None else self._rows(made)

    def read_in_order(self, table: str = "catalog", key: str = "id") -> DataFrame | None:
        """A table that was written in ranges of `key`, its files one after the other: no sort. Refused for other tables."""
        if (made := self.manifest(table)) is None:
            return None
        if made["sorted"] != key:
            raise ValueError(f"{table} is not kept in the order of {key}")
        (version,), read = made["parts"], self.spark.read.schema(StructType.fromJson(made["schema"]))
        files = [f for f in self.folder.names(f"{table}/v={version}") if f.startswith("part-")]  # numbered in the order of ranges
        df = None
        for f in files:
            one = read.parquet(f"{self.root}/{table}/v={version}/{f}")
            df = one if df is None else df.union(one)
        return self._rows(made) if df is None else df

    def _rows(self, made: dict, only: Sequence[int] | None = None) -> DataFrame:
        kept, kind = f"{self.root}/{made['table']}/v=", StructType.fromJson(made["schema"])
        chosen = range(made["buckets"]) if only is None else only
        folders = [f"{kept}{v}/{BUCKET}={k}" for k in chosen if (v := made["parts"][k])] if made["buckets"] else [f"{kept}{v}" for v in made["parts"]]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def _go_live(self, table: str, version: str, kind: StructType, parts: Sequence[str | None], key: str | None = None, order: str | None = None, mark: dt.datetime | None = None) -> dict:
        made = {"table": table, "version": version, "key": key, "buckets": len(parts) if key else 0, "parts": list(parts), "sorted": order, "mark": mark and mark.isoformat(), "published_at": _now().isoformat(), "schema": kind.jsonValue()}
        self.folder.remove(name := f"{table}/_manifests/{version}.json")  # of a run that ended before it went live
        self.folder.write(name, json.dumps(made))
        self.notes["live"].add(table, version, _now())
        if self.retention is not None:
            self.clean(table, self.retention)
        return made

    def _write(self, table: str, df: DataFrame, version: str) -> Written:
        """A version's folder of a table without a key."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.root}/{table}/v={version}")  # not live yet: what a crashed run may have left
        return Written(seen.get["rows"])

    def _write_buckets(self, path: str, rows: DataFrame, key: str, buckets: int, last: Callable[[DataFrame], DataFrame] | None = None) -> Written:
        """rows in a folder for each bucket, dealt once. last: takes one row a key; without it, repeated keys are a fault, as null ones are."""
        dealt = rows.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET)  # the windows below need no other
        if last:
            dealt = last(dealt).withColumn("__n", F.lit(1))
        else:
            dealt = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(BUCKET, key).orderBy(key)))
        bad, seen = F.col(key).isNull() | (F.col("__n") > 1), Observation()
        mark = F.max(HWM if HWM in dealt.columns else F.lit(None).cast("timestamp_ntz"))
        dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), mark.alias("mark"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col(key).cast("string"))).alias("fault"))
        dealt.drop("__n").write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        got = seen.get
        if got["bad"]:
            self.folder.remove(path)
            raise ValueError(f"{path.split('/')[0]}: key {key} is null or repeated: {got['fault']!r}")
        return Written(got["rows"], got["mark"])

    def _buckets_in(self, path: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names(path) if n.startswith(f"{BUCKET}="))

    def create(self, table: str, df: DataFrame, version: str, key: str) -> Written:
        """A keyed table's version of df alone, live if its key is unique and never null."""
        path = f"{table}/v={version}"
        made, there = self._write_buckets(path, df, key, self.buckets), set(self._buckets_in(path))
        self._go_live(table, version, df.schema, [version if k in there else None for k in range(self.buckets)], key, mark=made.mark)
        return made

    def publish(self, table: str, df: DataFrame, version: str, key: str | None = None) -> DataFrame:
        """Writes a version of df alone, checks its key, and makes it live."""
        if key:
            self.create(table, df, version, key)
        else:
            self._write(table, df, version)
            self._go_live(table, version, df.schema, [version])
        return self.read(table)

    def merge(self, table: str, rows: DataFrame, version: str) -> Written:
        """The rows (with __hwm, page and pos) merged by record_id: of rows of one key, the greatest mark wins, of equal marks the later one.

        The rows are landed by bucket first, in one pass; then only their buckets are read, merged and written. Where
        there is nothing to merge with, what has landed is the version.
        """
        live = self.manifest(table)
        path = f"{table}/{'delta' if live else 'v'}={version}"
        buckets, fetched = live["buckets"] if live else self.buckets, Observation()
        rows = rows.observe(fetched, F.max_by(F.struct(HWM, RECORD_ID), F.struct("page", "pos")).alias("last"))
        made = self._write_buckets(path, rows, RECORD_ID, buckets, lambda dealt: last_write(dealt, (BUCKET, RECORD_ID), HWM, "page", "pos").drop("page", "pos"))
        made.last = tuple(last) if (last := fetched.get.get("last")) else None  # no rows may leave nothing observed
        if not made.rows:
            self.folder.remove(path)
            return made
        touched, kind = self._buckets_in(path), rows.drop("page", "pos").schema
        if live:
            delta = self.spark.read.schema(StructType([*kind.fields]).add(BUCKET, "integer")).parquet(f"{self.root}/{path}").withColumn(NEW, F.lit(1))
            old = self._rows(live, touched).withColumn(BUCKET, bucket_of(RECORD_ID, buckets)).withColumn(NEW, F.lit(0))
            both = old.unionByName(delta).repartition(BUCKET)
            last_write(both, (BUCKET, RECORD_ID), HWM, NEW).drop(NEW).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{table}/v={version}")
        parts = list(live["parts"]) if live else [None] * buckets
        for k in touched:
            parts[k] = version
        self._go_live(table, version, kind, parts, RECORD_ID, mark=made.mark)
        if live:
            self.folder.remove(path)
        return made

    def clean(self, table: str, keep: dt.timedelta = RETENTION) -> list[str]:
        """Removes what no version needs that is live or was until less than `keep` ago; the names removed."""
        limit, gone = _now() - keep, []
        names = [n for n in self.folder.names(f"{table}/_manifests") if n.endswith(".json")]
        all_made = sorted((json.loads(self.folder.read(f"{table}/_manifests/{n}")) for n in names), key=lambda m: m["published_at"])
        ended = [m["published_at"] for m in all_made[1:]] + [None]
        live, kept = self.live(table), []
        for made, end in zip(all_made, ended):
            if made["version"] == live or end is None or dt.datetime.fromisoformat(end) > limit:
                kept.append(made)
            else:
                self.folder.remove(f"{table}/_manifests/{made['version']}.json")
        whole = {v for m in kept if not m["buckets"] for v in m["parts"]}
        needed = {(v, k) for m in kept if m["buckets"] for k, v in enumerate(m["parts"]) if v}
        known = {m["version"] for m in all_made} | {v for v, _ in needed} | whole

        def drop(path: str) -> None:
            self.folder.remove(path)
            gone.append(path)

        for name in self.folder.names(table):
            path, version = f"{table}/{name}", name.partition("=")[2]
            if not name.startswith(("v=", "delta=")) or version in whole and name.startswith("v="):
                continue
            of_buckets = {k for v, k in needed if v == version} if name.startswith("v=") else set()
            if of_buckets:
                for k in set(self._buckets_in(path)) - of_buckets:
                    drop(f"{path}/{BUCKET}={k}")
            elif version in known or self.folder.changed(path) < limit.replace(tzinfo=dt.UTC).timestamp():  # else it may be of a load that runs
                drop(path)
        return gone

    def replace_catalog(self, entries: DataFrame, version: str) -> int:
        """The whole catalog, stamped and kept in ranges of id; no entries keep the old one. The number of entries."""
        landed = f"catalog/delta={version}"  # ranges are found in a pass of their own, which must not ask the portal again
        entries.write.mode("overwrite").parquet(f"{self.root}/{landed}")
        entries = self.spark.read.schema(entries.schema).parquet(f"{self.root}/{landed}")
        ranged = entries.withColumn("fetched_at", F.lit(_now())).repartitionByRange("id").sortWithinPartitions("id")
        if made := self._write("catalog", ranged, version).rows:
            self._go_live("catalog", version, ranged.schema, [version], order="id")
        else:
            self.folder.remove(f"catalog/v={version}")
        self.folder.remove(landed)
        return made

    def add(self, table: str, df: DataFrame, version: str, replace: bool = True) -> DataFrame:
        """A new version of df alone, or of df after the live rows, which stay where they are. For tables without a key."""
        live = None if replace else self.manifest(table)
        if live and live["buckets"]:
            raise ValueError(f"{table} has a key: rows are merged into it")
        if live and not _same(StructType.fromJson(live["schema"]), df.schema):
            raise SchemaDrift(f"{table}: rows of other columns cannot be appended")
        self._write(table, df, version)
        self._go_live(table, version, df.schema, [*(live["parts"] if live else ()), version])
        return self.read(table)

    def run(self, targets: Sequence[Target], on_error: str = "continue", concurrency: int = 4) -> DataFrame:
        """Loads the targets, some at a time; the run's log is returned. After a failure, abort records those not begun as aborted."""
        if on_error not in ("continue", "abort") or concurrency < 1:
            raise ValueError("on_error is continue or abort, concurrency at least 1")
        run_id, failed = new_run_id(), threading.Event()

        def load(t: Target) -> None:
            began = _now()

            def event(end: dt.datetime | None, status: str, rows: int | None = None, error: str | None = None) -> None:
                took = None if end is None else int((end - began) / dt.timedelta(milliseconds=1))
                self.notes["sync_runs"].add(run_id, t.dataset_id, t.table, began, end, status, rows, error, took, t.config_hash)

            if failed.is_set() and on_error == "abort":
                return event(began, "aborted")
            event(None, "running")
            try:
                event(_now(), "ok", self.sync(t, run_id))
            except Exception as error:  # one dataset's failure is a result
                failed.set()
                event(_now(), "failed", None, said(error))

        with ThreadPoolExecutor(1 if on_error == "abort" else concurrency) as pool:
            list(pool.map(load, targets))
        return self.runs().where(F.col("run_id") == run_id)

    def tally(self) -> DataFrame:
        return tally(self.runs())

    def sync(self, t: Target, run_id: str) -> int:
        """Full replace, bootstrap or delta; the rows written."""
        if t.mode not in ("", "incremental", "full_replace"):
            raise ValueError(f"unknown mode {t.mode!r}")
        columns = [c for c in t.columns if c[0] and not c[0].startswith(":@") and c[0] not in t.skip]
        state, old = self.notes["dataset_state"].get(t.dataset_id), self.manifest(t.table)
        version = f"{run_id}-{uuid.uuid4().hex[:6]}"
        action = action_of(t.mode, state, old)
        if action == "full_replace":
            rows = schema.typed(self._filtered(t.rows(None), t), columns, keyed=False)
            made = self._write(t.table, rows, version)
            self._go_live(t.table, version, rows.schema, [version])
            return made.rows
        if action == "bootstrap":
            made = self.create(t.table, self._typed(t, t.rows(None), columns, t.hwm_column), version, RECORD_ID)
            self.mark(t.dataset_id, made.mark, _now(), run_id, t.hwm_column)
            return made.rows
        hwm, mark, after = state["hwm_column"], state["hwm_updated_at"], state["hwm_id"]
        typed = lambda rows, newer=None: self._typed(t, rows, columns, hwm, keep=("page", "pos"), newer=newer)
        wanted, live = typed(t.rows(mark).limit(0)).drop(HWM, "page", "pos"), self.spark.createDataFrame([], StructType.fromJson(old["schema"])).drop(HWM)
        if {(f.name, f.dataType) for f in wanted.schema} != {(f.name, f.dataType) for f in live.schema}:
            if drift := schema.drift_message(schema.diff(schema.live_columns(wanted), schema.live_columns(live))).first():
                raise SchemaDrift(f"{t.table}: {drift[0]}")
        if not (t.checkpoint_every_n_pages and t.group):
            made = self.merge(t.table, typed(t.rows(mark), above(mark, HWM, None, t.inclusive)), version)
            self.mark(t.dataset_id, max(filter(None, (mark, made.mark)), default=None), state["last_full_replace_at"], run_id, hwm)
            return made.rows
        n, k, top = 0, 0, mark
        while True:  # a group of pages each, merged and marked; a load that ends early goes on behind its last group
            made = self.merge(t.table, typed(t.group(mark, after)), f"{version}-{k:06d}")
            n, k, top = n + made.rows, k + 1, max(filter(None, (top, made.mark)), default=None)
            going = made.last is not None and made.last != (mark, after)
            if going:
                mark, after = made.last
            self.mark(t.dataset_id, top, state["last_full_replace_at"], run_id, hwm, after if going else None)
            if not going:
                return n

    def _filtered(self, rows: DataFrame, t: Target) -> DataFrame:
        return rows.where(F.expr(t.where)) if t.where else rows

    def _typed(self, t: Target, rows: DataFrame, columns: Sequence[tuple[str, str]], hwm: str, keep: Sequence[str] = (), newer: Column | None = None) -> DataFrame:
        """The typed columns, and the mark's own column, parsed leniently; of rows that are `newer` only, if that is given."""
        text = F.try_variant_get("v", f"$['{hwm}']", "string")
        marked = self._filtered(rows, t).withColumn(HWM, lenient_timestamp(text))
        if t.limit:  # in the mark's order, so that no row left behind is below the mark
            marked = marked.orderBy(HWM, F.try_variant_get("v", f"$['{schema.SYSTEM_ID}']", "string")).limit(t.limit)
        if newer is not None:
            marked = schema.settled(marked).where(newer)
        return schema.typed(marked, columns, keyed=True, keep=(*keep, HWM))

    def mark(self, dataset_id: str, mark, replaced, run_id: str, hwm: str, after: str | None = None) -> None:
        """Notes a dataset's state; `after` is the id of the last row at the mark, while a load is under way."""
        self.notes["dataset_state"].add(dataset_id, mark, replaced, run_id, hwm, after)


def action_of(mode: str, state: Mapping | None, manifest: Mapping | None) -> str:
    """What a load does: full_replace by its mode, else a bootstrap, where there is no state or no keyed table of records, else a delta."""
    if mode == "full_replace":
        return mode
    return "delta" if state and manifest and manifest["key"] == RECORD_ID else "bootstrap"


def refresh_catalogs(stores: Mapping[str, Store], entries: Callable[[str], DataFrame]) -> DataFrame:
    """portal, datasets, error: each portal's catalog replaced by entries(portal); one portal's failure is its row's error."""
    made = []
    for name, store in sorted(stores.items()):
        try:
            written = store.replace_catalog(entries(name), new_run_id())
            kept = None if written else store.read("catalog")  # no entries: the old catalog
            made.append((name, written if kept is None else kept.count(), None))
        except Exception as error:
            made.append((name, None, said(error)))
    return next(iter(stores.values())).spark.createDataFrame(made, "portal string, datasets long, error string")


def attach(stores: Mapping[str, Store], tables: Mapping[str, Sequence[str]]) -> None:
    """A schema for each store, by alias: <alias>.<table> and <alias>_meta.catalog, views over the live versions' folders."""
    for alias, store in sorted(stores.items()):
        if not re.fullmatch("[a-z][a-z0-9_]*", alias):
            raise ValueError(f"alias {alias!r} is no name")
        if store.live("catalog") is None:
            raise ValueError(f"{store.root} is no store: it has no catalog")
        for space, names in ((alias, tables.get(alias, ())), (f"{alias}_meta", ("catalog",))):
            store.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {space}")
            store.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {space}_parts")
            for name in names:
                if (made := store.manifest(name)) is None:
                    raise ValueError(f"{alias} has no table {name}")
                _attach(store, space, name, made)


def _attach(store: Store, space: str, name: str, made: dict) -> None:
    """A view of the table's own columns over an external table, each of whose partitions is a live folder."""
    fields, part = StructType.fromJson(made["schema"]), f"{space}_parts.`{name}`"
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    inside = (lambda k: f"/{BUCKET}={k}") if made["buckets"] else lambda k: ""
    places = [f"PARTITION ({BUCKET} = {k}) LOCATION '{store.root}/{name}/v={v}{inside(k)}'" for k, v in enumerate(made["parts"]) if v]
    store.spark.sql(f"DROP TABLE IF EXISTS {part}")
    store.spark.sql(f"CREATE TABLE {part} ({columns}{BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) LOCATION '{store.root}/{name}'")
    if places:
        store.spark.sql(f"ALTER TABLE {part} ADD {' '.join(places)}")
    store.spark.sql(f"CREATE OR REPLACE VIEW {space}.`{name}` AS SELECT {', '.join(f'`{f.name}`' for f in fields)} FROM {part}")


def said(error: Exception) -> str:
    """An error in a line; of one from a Python worker, what its trace ends with."""
    lines = [line.strip() for line in str(error).split("\n") if line.strip()] or [type(error).__name__]
    if lines[0].endswith("Traceback (most recent call last):"):
        ends = [line for line in lines[1:] if re.match(r"[\w.]+(Error|Exception|Exit)\b", line)]
        return f"{lines[0].removesuffix('Traceback (most recent call last):')}{ends[-1] if ends else lines[-1]}"[:2000]
    return lines[0][:2000]


def _same(a: StructType, b: StructType) -> bool:
    return [(f.name, f.dataType) for f in a] == [(f.name, f.dataType) for f in b]


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)
