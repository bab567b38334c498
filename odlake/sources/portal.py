"""Portals as Spark sources: catalog and row pages over any fetch(url), a stream of newer rows, and landed page files.

A dataset is read in ranges of record ids, a task each: the driver asks for every n-th id, always from the last one
on, and a task asks for pages above the last id it has, so no address has a deep offset. The stream reads in ranges
of {mark, id}; the driver sees their ends only, and a range that is asked for again has the same rows. Read with a
schema of its own columns and the option pushFilters, a dataset's simple comparisons become the portal's filter; Spark
hands them on if spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import time
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegralType, StringType, StructType, TimestampNTZType

from odlake.functions.coerce import lenient_timestamp

Fetch = Callable[[str], tuple[int, str]]
#: Rows of a page, tries after the first, and the first wait in seconds (doubled each time).
PAGE, RETRIES, WAIT = 5000, 5, 1.0
#: Pages of a task, and what a row is without a schema of its own.
PAGES, RAW = 10, "value string, page int, pos int"


def fetched(fetch: Fetch, url: str, retries: int = RETRIES, wait: float = WAIT) -> str:
    """The body; 429, 5xx and failures of the transport are tried again, other statuses end it at once."""
    for k in range(retries + 1):
        try:
            status, body = fetch(url)
        except OSError as error:  # timeouts, resets, and what urllib makes of them
            last: Exception = error
        else:
            if status < 400:
                return body
            last = RuntimeError(f"{url}: status {status}")
            if status != 429 and status < 500:
                break
        if k < retries:
            time.sleep(wait * 2**k)
    raise RuntimeError(f"{url}: {last}") from last


def quoted(value: str) -> str:
    """A text literal of the portal's filter language."""
    return "'" + value.replace("'", "''") + "'"


def rows_url(options: dict, offset: int, size: int) -> str:
    """A page's address; without an order of its own, by record id, as pages of no order may repeat and miss rows."""
    asked = {"$order": options.get("order") or ":id", "$where": options.get("where"), "$select": options.get("select") or (":*,*" if options.get("systemFields", "").lower() == "true" else None)}
    query = urlencode({k: v for k, v in asked.items() if v} | {"$limit": size, "$offset": offset})
    return f"https://{options['portal']}/resource/{options['dataset']}.json?{query}"


def metadata_url(portal: str, dataset: str) -> str:
    return f"https://{portal}/api/views/{dataset}.json"


def all_of(*conditions: str | None) -> str:
    return " AND ".join(f"({c})" for c in conditions if c)


def literal(value: object) -> str | None:
    """A value in the portal's filter language; None if it has none."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dt.datetime):
        return quoted(moment(value))
    if isinstance(value, int) or isinstance(value, float) and math.isfinite(value):
        return repr(value)
    return quoted(value) if isinstance(value, str) else None


def moment(at: dt.datetime) -> str:
    return at.isoformat(timespec="microseconds" if at.microsecond % 1000 else "milliseconds")


def after(column: str, mark: str, record: str | None) -> str:
    """Above a mark, or at it with a greater id."""
    newer = f"{column} > {quoted(mark)}"
    return newer if record is None else f"{newer} OR ({column} = {quoted(mark)} AND :id > {quoted(record)})"


COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter, schema: StructType) -> str | None:
    """A filter in the portal's language, where it means the same there; None elsewhere (texts, for one, sort otherwise)."""
    if len(f.attribute if hasattr(f, "attribute") else ()) != 1 or f.attribute[0] not in schema.names:
        return None
    name, kind = f.attribute[0], schema[f.attribute[0]].dataType
    name = name if re.fullmatch(":?[a-z_][a-z0-9_]*", name) else f"`{name}`"
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL"
    if "`" in name[1:-1] or not isinstance(kind, StringType | BooleanType | IntegralType | DoubleType | TimestampNTZType):
        return None
    if isinstance(f, In):
        made = [literal(v) for v in f.value]
        return f"{name} IN ({', '.join(made)})" if made and all(made) else None
    ordered = isinstance(kind, IntegralType | DoubleType | TimestampNTZType)
    if type(f) not in COMPARED or not (ordered or isinstance(f, EqualTo)) or (made := literal(f.value)) is None:
        return None
    return f"{name} {COMPARED[type(f)]} {made}"


def cell(value: object, kind: object) -> object:
    """A JSON value as one of a column's type; numbers and booleans may come as texts."""
    if value is None or value == "" and not isinstance(kind, StringType):
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else {"true": True, "false": False}[value]
    if isinstance(kind, DateType):
        return dt.date.fromisoformat(value[:10])
    if isinstance(kind, TimestampNTZType):
        return dt.datetime.fromisoformat(value)
    return {True: float, False: int}[isinstance(kind, DoubleType | FloatType)](value)


class Pages(InputPartition):
    def __init__(self, first: int, last: int | None) -> None:
        self.first, self.last = first, last  # pages; last excluded, none: up to a short page


class Ids(InputPartition):
    def __init__(self, above: str | None, upto: str | None, page: int) -> None:
        self.above, self.upto, self.page = above, upto, page  # record ids: above one, up to another; none: no end


class RowsReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch, schema: StructType) -> None:
        self.options, self.fetch, self.where = dict(options), fetch, options.get("where")
        self.schema = None if schema.names == [c.split()[0] for c in RAW.split(", ")] else schema
        self.size, self.wait = int(options.get("pageSize", PAGE)), float(options.get("wait", WAIT))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.each = int(options.get("pagesPerTask", PAGES))
        if self.schema is not None:
            self.options["systemFields"] = "true"

    def asked(self, offset: int, size: int, *where: str | None, **options: str) -> list[dict]:
        given = self.options | {"where": all_of(self.where, *where)} | options
        return json.loads(fetched(self.fetch, rows_url(given, offset, size), wait=self.wait))

    def by_id(self) -> bool:
        """Whether rows carry their ids and need no other order."""
        return self.options.get("systemFields", "").lower() == "true" and self.options.get("order", ":id") == ":id" and not (self.options.get("select") or self.limit or self.options.get("rows"))

    def partitions(self) -> list[InputPartition]:
        """Ranges of ids; without ids, page ranges where the option `rows` tells how many rows there are, else one range, read up to a short page."""
        if self.by_id():
            made, step = [Ids(None, None, 0)], self.size * self.each
            while row := self.asked(step - 1, 1, made[-1].above and f":id > {quoted(made[-1].above)}", select=":id"):
                made[-1].upto = row[0][":id"]
                made.append(Ids(made[-1].upto, None, len(made) * self.each))
            return made
        if not self.options.get("rows"):
            return [Pages(0, None)]
        n = min(int(self.options["rows"]), self.limit or int(self.options["rows"]))
        pages = -(-n // self.size)
        return [Pages(a, min(pages, a + self.each)) for a in range(0, pages, self.each)] or [Pages(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page, rows in self.of_ids(partition) if isinstance(partition, Ids) else self.of_pages(partition):
            for pos, row in enumerate(rows):
                yield (json.dumps(row), page, pos) if self.schema is None else tuple(cell(row.get(f.name), f.dataType) for f in self.schema)

    def of_ids(self, ids: Ids) -> Iterator[tuple[int, list[dict]]]:
        at, page = ids.above, ids.page
        while True:
            rows = self.asked(0, self.size, at and f":id > {quoted(at)}", ids.upto and f":id <= {quoted(ids.upto)}")
            yield page, rows
            if len(rows) < self.size:
                return
            at, page = rows[-1][":id"], page + 1

    def of_pages(self, pages: Pages) -> Iterator[tuple[int, list[dict]]]:
        page = pages.first
        while pages.last is None or page < pages.last:
            size = self.size if self.limit is None else min(self.size, self.limit - page * self.size)
            if size <= 0:
                return
            rows = self.asked(page * self.size, size)
            yield page, rows
            if len(rows) < size:
                return
            page += 1


class PagesReader(RowsReader):
    """A reader of raw rows that hands each page over as one Arrow batch: as single rows they would cost more on their way to Spark than to ask for and to write as JSON."""

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for page, rows in self.of_ids(partition) if isinstance(partition, Ids) else self.of_pages(partition):
            columns = [pa.array(map(json.dumps, rows), pa.string()), pa.array([page] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["value", "page", "pos"])


class FilteringReader(RowsReader):
    """A reader of a schema of its own that takes simple comparisons from Spark, which then does not evaluate them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (made := None if self.limit else condition(f, self.schema)) is None:
                yield f
            else:
                self.where = all_of(self.where, made)


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch) -> None:
        self.options, self.fetch = options, fetch
        self.size, self.wait = int(options.get("pageSize", 1000)), float(options.get("wait", WAIT))
        self.each = int(options.get("pagesPerTask", PAGES))

    def page(self, offset: int) -> dict:
        portal = self.options["portal"]
        query = urlencode({"domains": portal, "search_context": portal, "offset": offset, "limit": self.size})
        return json.loads(fetched(self.fetch, f"https://{portal}/api/catalog/v1?{query}", wait=self.wait))

    def partitions(self) -> list[Pages]:
        pages = -(-int(self.page(0).get("resultSetSize", 0)) // self.size)
        return [Pages(k, min(pages, k + self.each)) for k in range(0, pages, self.each)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last or 0):
            for pos, entry in enumerate(self.page(page * self.size).get("results", [])):
                yield json.dumps(entry), page, pos


class Newer(InputPartition):
    def __init__(self, start: dict, end: dict, page: int) -> None:
        self.start, self.end, self.page = start, end, page


class NewerRows(DataSourceStreamReader):
    """Rows above an offset {hwm, id} up to the portal's last, in ranges of pagesPerTask pages."""

    def __init__(self, options: dict, fetch: Fetch) -> None:
        self.options, self.fetch = options, fetch
        self.column, self.size = options.get("hwmColumn", ":updated_at"), int(options.get("pageSize", PAGE))
        self.step = self.size * int(options.get("pagesPerTask", PAGES))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"hwm": self.options.get("startingHwm", ""), "id": ""}

    def asked(self, start: dict | None, end: dict | None, offset: int, size: int, down: bool = False, **options: str) -> list[dict]:
        c = self.column
        above = start and start["hwm"] and after(c, start["hwm"], start["id"])
        upto = end and f"{c} < {quoted(end['hwm'])} OR ({c} = {quoted(end['hwm'])} AND :id <= {quoted(end['id'])})"
        order = f"{c} DESC,:id DESC" if down else f"{c},:id"
        given = self.options | {"order": order, "where": all_of(self.options.get("where"), f"{c} IS NOT NULL", above, upto), "systemFields": "true"} | options
        return json.loads(fetched(self.fetch, rows_url(given, offset, size), wait=float(self.options.get("wait", WAIT))))

    def place(self, *asked, **options) -> dict | None:
        """The {hwm, id} of one row."""
        rows = self.asked(*asked, select=f":id,{self.column}", **options)
        return {"hwm": rows[0][self.column], "id": rows[0][":id"]} if rows else None

    def latestOffset(self) -> dict:
        self.last = self.place(self.last, None, 0, 1, down=True) or self.last
        return self.last or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Newer]:
        made, self.last = [Newer(start, end, 0)], end
        while bound := self.place(made[-1].start, end, self.step - 1, 1):
            if bound == end:
                break
            made[-1].end = bound
            made.append(Newer(bound, end, len(made) * (self.step // self.size)))
        return made

    def read(self, partition: Newer) -> Iterator[tuple]:
        at, page = partition.start, partition.page
        while True:
            rows = self.asked(at, partition.end, 0, self.size)
            for pos, row in enumerate(rows):
                yield json.dumps(row), page, pos
            if len(rows) < self.size:
                return
            at, page = {"hwm": rows[-1][self.column], "id": rows[-1][":id"]}, page + 1


def sources(fetch: Fetch) -> list[type[DataSource]]:
    """The formats portal_rows and portal_catalog over a fetch function, for spark.dataSource.register."""

    class PortalRows(DataSource):
        @classmethod
        def name(cls) -> str:
            return "portal_rows"

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            made = RowsReader(options := _plain(self.options), fetch, schema)
            if made.schema is None:
                return PagesReader(options, fetch, schema)
            return FilteringReader(options, fetch, schema) if options.get("pushFilters", "").lower() == "true" else made

        def streamReader(self, schema) -> DataSourceStreamReader:
            return NewerRows(_plain(self.options), fetch)

    class PortalCatalog(DataSource):
        @classmethod
        def name(cls) -> str:
            return "portal_catalog"

        def schema(self) -> str:
            return RAW

        def reader(self, schema) -> DataSourceReader:
            return CatalogReader(_plain(self.options), fetch)

    return [PortalRows, PortalCatalog]


def _plain(options) -> dict:
    """Options by their own names; Spark hands them in lower case."""
    named = ("portal", "dataset", "order", "where", "select", "systemFields", "limit", "pageSize", "rows", "pagesPerTask", "wait", "hwmColumn", "startingHwm", "pushFilters")
    return {n: v for n in named if (v := options.get(n, options.get(n.lower()))) is not None}


def parsed(pages: DataFrame, value: str = "value") -> DataFrame:
    """The rows' JSON as VARIANT v."""
    return pages.withColumn("v", F.parse_json(value)).drop(value)


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page (file), pos, v: the rows of page files that each hold a JSON array."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.parse_json("value").alias("array"))
    return files.select("page", F.posexplode(F.variant_get("array", "$", "array<variant>")).alias("pos", "v"))


def catalog_entries(entries: DataFrame, v: str = "v") -> DataFrame:
    """id, name, description, category, tags, row_count, updated_at, raw of VARIANT catalog results."""
    at = lambda path, kind: F.try_variant_get(F.col(v), path, kind)
    return entries.select(
        at("$.resource.id", "string").alias("id"),
        at("$.resource.name", "string").alias("name"),
        F.nullif(at("$.resource.description", "string"), F.lit("")).alias("description"),
        F.nullif(at("$.classification.domain_category", "string"), F.lit("")).alias("category"),
        F.coalesce(at("$.classification.domain_tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.lit(None).cast("long").alias("row_count"),
        lenient_timestamp(at("$.resource.rowsUpdatedAt", "string")).alias("updated_at"),
        F.to_json(v).alias("raw"),
    )


def metadata_columns(body: DataFrame, v: str = "v") -> DataFrame:
    """pos, field_name, data_type_name of a dataset's metadata."""
    columns = body.select(F.posexplode(F.variant_get(F.col(v), "$.columns", "array<variant>")).alias("pos", "c"))
    text: Callable[[str], Column] = lambda p: F.variant_get("c", p, "string")
    return columns.select("pos", text("$.fieldName").alias("field_name"), text("$.dataTypeName").alias("data_type_name"))
