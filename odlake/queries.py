"""The registered queries over the given tables, each with its SQL twin.

Portals, catalogs, run logs and landed rows are roles that the given tables play: part, documents and
customer are catalogs, orders is a run log (customer: dataset, status F: ok), events are landed rows.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odlake.functions import coerce
from odlake.functions.text import config_hash, matches, shortened, table_name
from odlake.operators import catalog, load, portal_load, select, snapshot
from odlake.operators import query as user_query
from odlake.plans import schema
from odlake.session import ship
from odlake.sources import replay
from odlake.sources.folder import Folder
from odlake.sources.portal import catalog_entries, landed_pages, parsed, sources
from odlake.streaming import hwm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores: a table of few files or row groups is read by as few tasks, and what is made of its rows costs far more than they do."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="odlake-")
    return f"{named}/{name}-{uuid.uuid4().hex}"


EVENT_COLUMNS = [("event_id", "number"), ("ts", "calendar_date"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "json")]


def event_texts(spark: SparkSession, sf_dir: str, record_id: Column | None = None, kept: Column | None = None) -> DataFrame:
    """event_id, value: events, or those `kept`, as JSON texts, with the system fields."""
    e = table(spark, sf_dir, "events")
    e = spread(e if kept is None else e.where(kept))
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    row = F.struct((F.col("event_id").cast("string") if record_id is None else record_id).alias(":id"), ts.alias(":updated_at"), "event_id", ts.alias("ts"), "user_id", "event_type", F.col("value").cast("string").alias("value"), F.parse_json("props").alias("props"))
    return e.select("event_id", F.to_json(row).alias("value"))


def event_rows(spark: SparkSession, sf_dir: str, record_id: Column | None = None, kept: Column | None = None) -> DataFrame:
    """event_id, v: event_texts as untyped rows."""
    return event_texts(spark, sf_dir, record_id, kept).select("event_id", F.parse_json("value").alias("v"))


def land(spark: SparkSession, sf_dir: str, folder: str, page: int = 5000) -> None:
    """events as page files, each a JSON array of `page` rows at most: pages grow in number with the table, not in size."""
    rows = event_texts(spark, sf_dir).withColumn("page", F.expr(f"event_id div {page}"))
    arrays = rows.groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))  # a page of rows
    arrays.select("value").write.option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


@registered("""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY event_type""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped rows, strictly typed, the last row of each user, counted by type."""
    typed = schema.typed(event_rows(spark, sf_dir), EVENT_COLUMNS)
    last = load.last_write(typed, "user_id", "ts", "event_id")
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@registered("""
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def typed_rows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = schema.typed(event_rows(spark, sf_dir), EVENT_COLUMNS)
    k = coerce.to_bigint(F.try_variant_get(F.parse_json("props"), "$.k", "variant")).strict("column=k")
    return typed.select(F.col("event_id").cast("long").alias("event_id"), "ts", F.col("user_id").cast("long").alias("user_id"), "event_type", "value", k.alias("k"))


@registered("""
SELECT c_custkey, round(c_acctbal / 100, 6) AS place_lon, CAST(c_nationkey AS DOUBLE) AS place_lat,
       '{"coordinates":[' || (c_nationkey::VARCHAR) || '],"type":"' || c_mktsegment || '"}' AS raw FROM customer""")
def point_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(F.col("c_acctbal") / 100, 6), F.col("c_nationkey").cast("double")).alias("coordinates"))
    other = F.struct(F.col("c_mktsegment").alias("type"), F.array("c_nationkey").alias("coordinates"))
    rows = c.select("c_custkey", F.parse_json(F.to_json(F.struct(point.alias("place"), other.alias("shape")))).alias("v"))
    return schema.typed(rows, [("place", "point"), ("shape", "location")], keep=("c_custkey",)).select("c_custkey", "place_lon", "place_lat", F.col("shape_raw").alias("raw"))


WORDS_SQL = "SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [p_size::VARCHAR, '1e400', '0x10', ' 7', '.5e1', ''])) AS w FROM part"


@registered(f"""
SELECT w, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad, max(CASE WHEN good THEN try_cast(nullif(w, '') AS DOUBLE) END) AS value FROM (
  SELECT w, w = '' OR (regexp_full_match(w, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND w <> '1e400') AS good FROM ({WORDS_SQL})) GROUP BY w""")
def strict_number_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.split("p_name", " "), F.array(F.col("p_size").cast("string"), *map(F.lit, ("1e400", "0x10", " 7", ".5e1", ""))))
    rows = spread(table(spark, sf_dir, "part")).select(F.explode(words).alias("w")).select("w", F.parse_json(F.to_json(F.struct("w"))).alias("v"))
    made, good = schema.marked(rows, [("w", "number")], keep=(F.col("w").alias("word"),)), F.size("bad_columns") == 0
    return made.groupBy(F.col("word").alias("w")).agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"), F.max(F.when(good, F.col("w"))).alias("value"))


BOOLS = ("t", "FALSE", "1", "False", "true", "y")


@registered(f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS flag, o_orderkey % 6 = 5 AS bad FROM orders""")
def bool_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array(*map(F.lit, BOOLS))[(F.col("o_orderkey") % 6).cast("int")]
    made = coerce.to_boolean(F.parse_json(F.concat(F.lit('"'), text, F.lit('"'))))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.value.alias("flag"), made.bad.alias("bad"))


@registered("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN o_orderdate - INTERVAL 2 HOUR WHEN 5 THEN NULL ELSE o_orderdate END AS ts, o_orderkey % 6 = 5 AS bad
FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)""")
def timestamp_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    layouts = [F.concat(day, F.lit(x)) for x in ("T00:00:00.000", "T00:00:00", "T00:00:00Z", "T00:00:00+02:00", "", " 00:00")]
    text = F.array(*layouts)[(F.col("o_orderkey") % 6).cast("int")]
    made = coerce.to_timestamp(F.parse_json(F.concat(F.lit('"'), text, F.lit('"'))))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.value.alias("ts"), made.bad.alias("bad"))


@registered("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def columns_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    described = spark.createDataFrame([(c, "text", k) for k, c in enumerate([*orders.columns, ":@computed_region", ""])], "field_name string, data_type_name string, pos int")
    kept = schema.usable(described, ("o_orderstatus", "o_orderpriority")).orderBy("pos").collect()  # a table's columns
    return orders.select(*(r["field_name"] for r in kept))


@registered("""
SELECT column0 AS source_type, column1 AS kind, (SELECT count(*) FROM part WHERE p_size % 10 = i) AS parts FROM (VALUES
 ('number','double',0),('money','double',1),('date','timestamp_ntz',2),('checkbox','boolean',3),('polygon','json',4),('point','point',5),('url','string',6)) v(column0, column1, i)""")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a described schema, by the number of parts of each."""
    names = ["number", "money", "date", "checkbox", "polygon", "point", "url"]
    named = F.try_element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 10 + 1).cast("int"))
    counts = table(spark, sf_dir, "part").groupBy(named.alias("source_type")).agg(F.count("*").alias("parts"))
    return counts.where("source_type is not null").select("source_type", schema.kind_column(F.col("source_type")).alias("kind"), "parts")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog: brand is the category, the type's words are the tags."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("tags"), "p_size")


INCLUDE, EXCLUDE = [{"category": "Brand#[1-3]*"}, {"tag": "*EE?"}, {"id": "7"}], [{"name": "*a"}, {"category": "Brand#?2"}]
INCLUDED_SQL = "((regexp_full_match(p_brand, 'Brand#[1-3][^/]*') OR len(list_filter(string_split(p_type, ' '), lambda t: regexp_full_match(t, '[^/]*EE[^/]'))) > 0 OR p_partkey = 7) AND NOT (regexp_full_match(p_name, '[^/]*a') OR regexp_full_match(p_brand, 'Brand#[^/]2')))"


@registered(f"SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS category FROM part WHERE {INCLUDED_SQL}")
def select_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.resolve(part_catalog(spark, sf_dir), INCLUDE, EXCLUDE).select("id", "name", "category")


@registered(f"SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE {INCLUDED_SQL} AND p_partkey IN (SELECT min(p_partkey) FROM part WHERE {INCLUDED_SQL} UNION ALL SELECT max(p_partkey) FROM part WHERE {INCLUDED_SQL})")
def select_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_catalog(spark, sf_dir)
    ends = select.resolve(parts, INCLUDE, EXCLUDE).agg(F.min(F.col("id").cast("long")), F.max(F.col("id").cast("long"))).first()
    return select.resolve(parts, INCLUDE, EXCLUDE, [str(x) for x in ends if x is not None]).select("id")


@registered("SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'a%' OR p_name LIKE 'b%') AND (p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%')")
def catalog_filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = part_catalog(spark, sf_dir).where(select.catalog_filter(names=["a*", "b*"], categories=["Brand#1*", "Brand#2*"]))
    return kept.select(F.col("id").cast("long").alias("p_partkey"), F.col("name").alias("p_name"))


def part_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_catalog(spark, sf_dir)
    overrides = parts.where("p_size > 40").select("id", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("t_"), "id")).otherwise("").alias("table"), F.when(F.col("p_size") % 5 == 0, "score > 1").alias("where"), (F.col("p_size") % 3 * 100).cast("int").alias("batch_size"), F.when(F.col("p_size") > 45, "full_replace").alias("mode"))
    return select.effective(parts, overrides)


PLAN_SQL = """
SELECT CAST(p.p_partkey AS VARCHAR) AS dataset_id, coalesce(nullif(o.t, ''), replace(CAST(p.p_partkey AS VARCHAR), '-', '_')) AS "table", coalesce(o.w, '') AS "where", ':id' AS order_by,
       CAST(coalesce(nullif(o.b, 0), 5000) AS INTEGER) AS batch_size, coalesce(o.m, '') AS mode
FROM part p LEFT JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 't_' || p_partkey ELSE '' END AS t, CASE WHEN p_size % 5 = 0 THEN 'score > 1' END AS w, p_size % 3 * 100 AS b, CASE WHEN p_size > 45 THEN 'full_replace' END AS m
  FROM part WHERE p_size > 40) o USING (p_partkey)"""


@registered(PLAN_SQL)
def effective_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_plan(spark, sf_dir).select("dataset_id", "table", "where", "order_by", "batch_size", "mode")


@registered(f"SELECT dataset_id, CASE WHEN dataset_id IN ('1', '2', '3') THEN 'full_replace' ELSE mode END AS mode FROM ({PLAN_SQL})")
def full_refresh_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.full_refresh(part_plan(spark, sf_dir), ["1", "2", "3"]).select("dataset_id", "mode")


@registered("""SELECT p_partkey, 'sha256:' || sha256('{"table":"' || p_partkey || '","mode":"' || p_brand || '","limit":' || p_size || '}') AS config_hash FROM part""")
def config_hash_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", config_hash(F.col("p_partkey").cast("string").alias("table"), F.col("p_brand").alias("mode"), F.col("p_size").alias("limit")).alias("config_hash"))


def customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.lit("shop").alias("portal"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.lit(None).cast("string").alias("description"), F.array(F.lower("c_mktsegment")).alias("tags"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("aborted")
    return o.select(F.lit("shop").alias("portal"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run_id"), F.col("o_custkey").cast("string").alias("dataset_id"), F.concat(F.lit("t_"), F.col("o_orderpriority")).alias("table_name"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"), status.alias("status"), F.floor("o_totalprice").cast("long").alias("rows_written"))


LAST_SQL = "SELECT o_custkey, 't_' || o_orderpriority AS table_name, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1"


@registered(f"""
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS name, c_mktsegment AS category, coalesce(l.table_name, CAST(c_custkey AS VARCHAR)) AS table_name, l.n AS last_rows_written
FROM customer LEFT JOIN ({LAST_SQL}) l ON c_custkey = o_custkey""")
def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_datasets(customer_catalog(spark, sf_dir), order_runs(spark, sf_dir)).select("dataset_id", "name", "category", "table_name", "last_rows_written")


@registered(f"""
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, coalesce(l.table_name, CAST(c_custkey AS VARCHAR)) AS table_name
FROM customer LEFT JOIN ({LAST_SQL}) l ON c_custkey = o_custkey WHERE contains(lower(c_mktsegment), 'build')""")
def list_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_datasets(customer_catalog(spark, sf_dir), order_runs(spark, sf_dir), "shop", "BUILD").select("dataset_id", "table_name")


@registered("SELECT doc_id FROM documents WHERE contains(lower(text), 'token') OR contains(lower(source), 'token') OR lower(lang) = 'token' OR lower(source) = 'token'")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    entries = d.select("doc_id", F.col("source").alias("name"), F.col("text").alias("description"), F.array("lang", "source").alias("tags"))
    return entries.where(catalog.found_by("Token")).select("doc_id")


@registered(f"""
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, l.n AS last_rows_written FROM customer LEFT JOIN ({LAST_SQL}) l ON c_custkey = o_custkey WHERE lower(c_mktsegment) = 'machinery' OR contains(lower(c_name), 'machinery')""")
def search_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_datasets(customer_catalog(spark, sf_dir), order_runs(spark, sf_dir), "Machinery").select("dataset_id", "last_rows_written")


@registered(f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(l.table_name, CAST(c_custkey AS VARCHAR)) AS table_name, l.n AS last_rows_written, l.o_orderdate AS last_synced_at, s.m AS hwm_updated_at,
       CASE WHEN l.table_name IS NOT NULL THEN 'o_orderkey bigint,o_custkey bigint,o_orderstatus string,o_totalprice double,o_orderdate timestamp_ntz,o_orderpriority string' END AS columns
FROM customer LEFT JOIN ({LAST_SQL}) l ON c_custkey = l.o_custkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) s ON c_custkey = s.o_custkey""")
def describe_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the run log hold orders, with a record key that is not shown."""
    runs = order_runs(spark, sf_dir)
    state = runs.groupBy("portal", "dataset_id").agg(F.max("started_at").alias("hwm_updated_at"), F.lit(None).cast("timestamp_ntz").alias("last_full_replace_at"))
    fields = [("record_id", "string"), *((f.name, f.dataType.simpleString()) for f in table(spark, sf_dir, "orders").schema)]
    each = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(name).alias("name"), F.lit(kind).alias("type")) for k, (name, kind) in enumerate(fields)))
    columns = runs.select("portal", "table_name").distinct().select("*", F.inline(each))
    shown = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ",").alias("columns")
    return catalog.details(customer_catalog(spark, sf_dir), runs, state, columns).select("id", "table_name", "last_rows_written", "last_synced_at", "hwm_updated_at", shown)


@registered("SELECT CAST(s_suppkey AS VARCHAR) AS id, 'buyers,sellers' AS portals FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)")
def ambiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = catalog.portals({"sellers": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id")), "buyers": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))})
    return catalog.ambiguous(both).select("id", F.array_join("portals", ",").alias("portals"))


@registered(f"SELECT (SELECT count(*) FROM customer) AS dataset_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_row_count FROM ({LAST_SQL})")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(customer_catalog(spark, sf_dir), order_runs(spark, sf_dir))


@registered("""
SELECT CAST(o_custkey AS VARCHAR) AS run_id, count(*) AS planned, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS aborted FROM orders GROUP BY 1""")
def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tally(order_runs(spark, sf_dir).withColumn("run_id", F.col("dataset_id")))


@registered("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def incomplete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = order_runs(spark, sf_dir).withColumn("finished_at", F.when(F.col("status") != "aborted", F.col("finished_at")))
    return catalog.incomplete(started).agg(F.count("*").alias("n"))


@registered("SELECT l_orderkey, l_linenumber, l_partkey, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS duration_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def run_duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", F.timestamp_diff("MILLISECOND", F.col("o_orderdate"), F.col("l_shipdate")).alias("duration_ms"))


@registered("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.key_faults(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@registered("SELECT event_type, max(ts) AS hwm FROM events GROUP BY 1")
def hwm_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    marked = table(spark, sf_dir, "events").withColumn("mark", coerce.lenient_timestamp(text))
    return marked.groupBy("event_type").agg(F.max("mark").alias("hwm"))


MARK = dt.datetime(1998, 1, 1)


@registered("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND (o_orderstatus <> 'P' OR o_totalprice > 1000)")
def delta_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(load.above(MARK, "o_orderdate", "o_orderstatus <> 'P' OR o_totalprice > 1000")).select("o_orderkey", "o_orderdate")


@registered("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def delta_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.last_write(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@registered("SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    newer = F.col("o_orderdate") >= F.lit(MARK)
    delta = orders.where(newer | (F.col("o_orderkey") % 10 == 0)).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return load.merged(orders.where(~newer), delta, "o_orderkey").drop("o_orderdate")


def landed_target(spark: SparkSession, sf_dir: str, upto: int | None) -> load.Target:
    def rows(mark) -> DataFrame:
        """As a portal does, the source itself leaves out what is not above the mark, before it makes JSON."""
        asked = (F.lit(True) if upto is None else F.col("event_id") < upto) & (F.lit(True) if mark is None else F.col("ts") > F.lit(mark))
        return event_rows(spark, sf_dir, kept=asked).select(F.lit(0).alias("page"), F.col("event_id").alias("pos"), "v")

    return load.Target("events-1", "events_1", EVENT_COLUMNS, rows)


EVENTS_SQL = "SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(event_id AS DOUBLE) AS event_id, ts, event_type, value FROM events"


@registered(EVENTS_SQL)
def bootstrap_then_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half as a bootstrap, then the rest above the mark: the table is the source."""
    store = load.Store(spark, scratch(spark, "store"))
    middle = table(spark, sf_dir, "events").agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for upto in (middle, None):
        log = store.run([landed_target(spark, sf_dir, upto)])
        if failed := log.where("status <> 'ok'").first():
            raise RuntimeError(failed["error"])
    return store.read("events_1").select("record_id", "event_id", "ts", "event_type", "value")


def recorded_load(spark: SparkSession, sf_dir: str, datasets: int, runs: int) -> tuple[load.Store, list[DataFrame]]:
    """events as a recorded portal's datasets, the first loaded above its mark and the second in full: the store, and the log of each run."""
    root, wide = scratch(spark, "recorded"), F.lpad(F.col("event_id").cast("string"), 12, "0")  # ids in the order of their texts
    rows = event_rows(spark, sf_dir, wide).select("v")
    fetch = replay.player(replay.record(rows, f"{root}/rows"), EVENT_COLUMNS)
    overrides = spark.createDataFrame([("even-0001", 2000, None), ("even-0002", 2000, "full_replace")][:datasets], "id string, batch_size int, mode string")
    entries = overrides.select("id")
    plan, store = select.hashed(select.effective(entries, overrides)), load.Store(spark, f"{root}/store")
    return store, [store.run(portal_load.targets(spark, plan, "recorded", fetch, {"pagesPerTask": "2"})) for _ in range(runs)]


@registered("SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS record_id, CAST(event_id AS DOUBLE) AS event_id, ts, event_type, value FROM events")
def portal_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = recorded_load(spark, sf_dir, 1, 1)
    return store.read("even_0001").select("record_id", "event_id", "ts", "event_type", "value")


@registered("""
SELECT run, dataset_id, table_name, 'ok' AS status, CASE WHEN loaded THEN (SELECT count(*) FROM events) ELSE 0 END AS rows_written, (SELECT count(*) FROM events) AS table_rows
FROM (VALUES (1, 'even-0001', 'even_0001', true), (1, 'even-0002', 'even_0002', true), (2, 'even-0001', 'even_0001', false), (2, 'even-0002', 'even_0002', true)) v(run, dataset_id, table_name, loaded)""")
def portal_load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap and a delta without news beside two full replacements: what each run logs, and the tables' rows."""
    store, logs = recorded_load(spark, sf_dir, 2, 2)
    both = logs[0].withColumn("run", F.lit(1)).unionByName(logs[1].withColumn("run", F.lit(2)))
    tables = {t: store.read(t).count() for t in ("even_0001", "even_0002")}
    counts = spark.createDataFrame(list(tables.items()), "table_name string, table_rows long")
    return both.select("run", "dataset_id", "table_name", "status", "rows_written").join(counts, "table_name")


@registered(EVENTS_SQL)
def stream_hwm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed page files, merged by several micro-batches in whatever order they come; then a second stream with a checkpoint of its own over all of them, which changes nothing."""
    folder = scratch(spark, "stream")
    land(spark, sf_dir, f"{folder}/pages", 500)
    store, n = load.Store(spark, f"{folder}/store"), len([f for f in Folder(spark, f"{folder}/pages").names() if f.startswith("part-")])
    for check, batches in (("first", 4), ("second", 1)):
        pages = hwm.landed_stream(spark, f"{folder}/pages", -(-n // batches))
        hwm.start(pages, store, "events-1", "events_1", EVENT_COLUMNS, f"{folder}/{check}").awaitTermination()
    return store.read("events_1").select("record_id", "event_id", "ts", "event_type", "value")


@registered("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def landed_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pages")
    land(spark, sf_dir, folder)
    return schema.typed(landed_pages(spark, folder), EVENT_COLUMNS).groupBy("event_type").agg(F.count("*").alias("n"))


@registered("""
SELECT coalesce(w.c, l.c) AS "column", CASE WHEN l.c IS NULL THEN 'added' WHEN w.c IS NULL THEN 'removed' ELSE 'retyped' END AS change
FROM (VALUES ('k', 'DOUBLE'), ('note', 'VARCHAR')) w(c, t)
FULL JOIN (SELECT key AS c, max(t) AS t FROM (SELECT unnest(json_keys(props)) AS key, 'BIGINT' AS t FROM events) GROUP BY 1) l ON w.c = l.c WHERE w.t IS DISTINCT FROM l.t""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that all events' props have, and their types, against a declared schema."""
    props = table(spark, sf_dir, "events").select(F.parse_json("props").alias("v"))
    fields = props.select(F.explode(F.variant_get("v", "$", "map<string,variant>")).alias("column", "x"))
    live = fields.groupBy("column").agg(F.max(F.schema_of_variant("x")).alias("type"))
    wanted = spark.createDataFrame([("k", "DOUBLE"), ("note", "STRING")], "column string, type string")
    return schema.diff(wanted, live).select("column", "change")


@registered("""
SELECT page, hwm FROM (SELECT page, max(max(ts)) OVER (ORDER BY page) AS hwm FROM (SELECT event_id // 500 AS page, ts FROM events) GROUP BY page) WHERE page % 2 = 0""")
def checkpoint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.page_marks(table(spark, sf_dir, "events"), "ts", F.floor(F.col("event_id") / 500).cast("long"), 2)


@registered("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def index_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.retained(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@registered("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@registered("""
SELECT o_orderkey, 'size_bytes' AS rule FROM orders WHERE o_totalprice < 5000 UNION ALL
SELECT o_orderkey, 'url' FROM orders WHERE o_orderstatus = 'P' UNION ALL
SELECT o_orderkey, 'created_at' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL
SELECT o_orderkey, 'schema_version' FROM orders WHERE o_orderkey % 11 < 2 UNION ALL
SELECT o_orderkey, 'portal' FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL
SELECT o_orderkey, 'snapshot_id' FROM orders WHERE o_orderkey % 13 = 0 UNION ALL
SELECT o_orderkey, 'sha256' FROM orders WHERE o_orderkey % 17 = 0""")
def index_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index that break each of the rules."""
    key, version = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 11 == 0, snapshot.VERSION + 1).when(F.col("o_orderkey") % 11 != 1, snapshot.VERSION)
    index = table(spark, sf_dir, "orders").select(
        key,
        version.alias("schema_version"),
        F.when(~F.col("o_orderpriority").startswith("1"), "shop").alias("portal"),
        F.when(key % 13 == 0, "").otherwise(key.cast("string")).alias("snapshot_id"),
        F.when(F.col("o_orderstatus") != "P", "https://host/x").alias("url"),
        F.when(key % 17 != 0, "ab").alias("sha256"),
        F.when(F.col("o_totalprice") < 5000, 0).otherwise(1).alias("size_bytes"),
        F.when(key % 7 != 0, F.col("o_orderdate")).alias("created_at"),
    )
    return snapshot.violations(index).select("o_orderkey", "rule")


@registered("SELECT 0 AS faults, count(*) AS table_rows FROM customer")
def snapshot_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of customer is packed, verified, restored and counted."""
    folder = scratch(spark, "snapshot")
    store = load.Store(spark, f"{folder}/store")
    store.replace_catalog(customer_catalog(spark, sf_dir).drop("portal"), load.new_run_id())
    store.publish("customer", table(spark, sf_dir, "customer"), load.new_run_id(), "c_custkey")
    target = f"{folder}/packages/snapshot_id={snapshot.pack(store, 'shop', f'{folder}/packages', ['customer'])}"
    snapshot.restore(spark, target, f"{folder}/restored")
    faults = snapshot.faults(spark, target).agg(F.count("*").cast("int").alias("faults"))
    return faults.join(spark.read.parquet(f"{folder}/restored/customer").agg(F.count("*").alias("table_rows")), F.lit(True))


TAMPERED = (("customer", "size"), ("supplier", "missing"), ("nation", "hash"), ("region", "not listed"))


@registered(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{fault}' AS fault, count(*) AS table_rows FROM {t}" for t, fault in TAMPERED))
def snapshot_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of four tables, of each of which one file is changed, replaced, removed or added: the faults that are found."""
    root = scratch(spark, "tampered")
    store, names = load.Store(spark, f"{root}/store"), [t for t, _ in TAMPERED]
    store.replace_catalog(customer_catalog(spark, sf_dir).drop("portal"), load.new_run_id())
    rows = {t: store.publish(t, table(spark, sf_dir, t), load.new_run_id()).count() for t in names}
    target = f"{root}/packages/snapshot_id={snapshot.pack(store, 'shop', f'{root}/packages', names)}"
    listed = {r["name"].split("/")[0]: r for r in spark.read.parquet(f"{target}/files").groupBy(F.substring_index("name", "/", 1)).agg(F.min_by(F.struct("name", "size_bytes"), "name").alias("f")).select("f.*").collect()}  # a row a table
    data = Folder(spark, f"{target}/data")
    for t, fault in TAMPERED:
        name = "region/extra.parquet" if fault == "not listed" else listed[t]["name"]
        data.remove(name)
        if fault != "missing":
            data.write(name, "x" * (listed[t]["size_bytes"] + (fault == "size")))
    counts = spark.createDataFrame(list(rows.items()), "table_name string, table_rows long")
    return snapshot.faults(spark, target).select(F.substring_index("name", "/", 1).alias("table_name"), "fault").join(counts, "table_name")


@registered("""
SELECT a.c_custkey AS a_custkey, a.c_name AS a_name, b.c_custkey AS b_custkey, b.c_acctbal AS b_acctbal FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey ORDER BY a.c_custkey LIMIT 1000""")
def attached_user_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores, attached, and joined by user SQL under its caps, with columns of one name: what a portal's tool returns."""
    root, customers = scratch(spark, "attached"), table(spark, sf_dir, "customer")
    stores = {name: load.Store(spark, f"{root}/{name}") for name in ("east", "west")}
    for name, store in stores.items():
        store.replace_catalog(customer_catalog(spark, sf_dir).drop("portal"), load.new_run_id())
        store.publish("customer", customers.select("c_custkey", "c_name" if name == "east" else "c_acctbal"), load.new_run_id(), "c_custkey")
    load.attach(stores, {name: ["customer"] for name in stores})
    found = user_query.run(spark, "SELECT * FROM east.customer a JOIN west.customer b ON a.c_custkey = b.c_custkey ORDER BY a.c_custkey")
    if found.columns != ["c_custkey", "c_name", "c_custkey", "c_acctbal"]:
        raise RuntimeError(f"columns {found.columns}")
    return spark.createDataFrame(found.rows, "a_custkey long, a_name string, b_custkey long, b_acctbal double")


@registered("SELECT c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def cross_portal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "SELECT c_name, s_name FROM {buyers} JOIN {sellers} ON c_custkey = s_suppkey")


@registered("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def cross_portal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir, "SELECT c_custkey AS id, c_name AS name FROM {buyers} UNION ALL SELECT s_suppkey, s_name FROM {sellers}")


def attached(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """User SQL over the tables of two portals."""
    return spark.sql(sql, buyers=table(spark, sf_dir, "customer"), sellers=table(spark, sf_dir, "supplier"))


@registered("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 1000")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id")
    return user_query.capped(ordered, 1000, 1 << 30).where(F.col("__n") <= 1000).drop("__n", "__over")


@registered("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, sum(strlen('[' || doc_id || ',"' || source || '"]') + 1) OVER (ORDER BY doc_id) + strlen('{"columns":[],"rows":[],"row_count":0,"truncated":false}') + 18 AS b FROM documents ORDER BY doc_id LIMIT 1001) WHERE k = 1 OR b <= 8192""")
def byte_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id")
    return user_query.capped(ordered, 1000, 8192).where(~F.col("__over")).select("doc_id")


PARTS_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS category, array_to_string(string_split(p_type, ' '), '|') AS tags, TIMESTAMP '2024-01-15 10:00:00' AS updated_at FROM part"


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a portal's catalog results."""
    resource = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.lit("2024-01-15T10:00:00.000Z").alias("rowsUpdatedAt"))
    classified = F.struct(F.col("p_brand").alias("domain_category"), F.split("p_type", " ").alias("domain_tags"))
    return spread(table(spark, sf_dir, "part")).select(F.parse_json(F.to_json(F.struct(resource.alias("resource"), classified.alias("classification")))).alias("v"))


@registered(PARTS_SQL)
def catalog_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_entries(part_entries(spark, sf_dir)).select("id", "name", "category", F.array_join("tags", "|").alias("tags"), "updated_at")


@registered(PARTS_SQL)
def portal_catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded portal's catalog, read page by page, stored in the order of ids and read back without a sort."""
    root = scratch(spark, "catalog")
    fetch = replay.player(replay.record(part_entries(spark, sf_dir), f"{root}/entries", "$.resource.id"), [])
    ship(spark)
    for source in sources(fetch):
        spark.dataSource.register(source)
    pages = spark.read.format("portal_catalog").option("portal", "recorded").option("pageSize", 500).load()
    store = load.Store(spark, f"{root}/store")
    store.replace_catalog(catalog_entries(parsed(pages)), load.new_run_id())
    return store.read_in_order().select("id", "name", "category", F.array_join("tags", "|").alias("tags"), "updated_at")


@registered("SELECT t AS tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part) WHERE regexp_full_match(t, '[A-M][^/]*') GROUP BY 1")
def tags_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = part_catalog(spark, sf_dir).select(F.explode("tags").alias("tag"))
    return tags.where(matches(F.col("tag"), "[A-M]*")).groupBy("tag").agg(F.count("*").alias("n"))


@registered("SELECT p_partkey, replace(p_brand || '-' || p_size, '-', '_') AS table_name, CASE WHEN length(p_name) > 12 THEN p_name[1:11] || '…' ELSE p_name END AS shown, upper(p_type) AS kind FROM part")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", table_name(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("table_name"), shortened(F.col("p_name"), 12).alias("shown"), F.upper("p_type").alias("kind"))


@registered("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') ")
def delta_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at the mark again, which a keyed merge makes safe."""
    orders = table(spark, sf_dir, "orders")
    mark = load.advanced(orders.where(F.col("o_orderdate") < F.lit(MARK)), "o_orderdate", None).first()[0]
    return orders.where(load.above(mark, "o_orderdate", inclusive=True)).select("o_orderkey", "o_custkey", "o_orderdate")


@registered("SELECT page, count(*) AS n FROM (SELECT (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 5 AS page FROM orders) GROUP BY page")
def source_order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each dataset in the source's stable order, by page of five."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor((F.row_number().over(w) - 1) / 5).cast("long").alias("page")).groupBy("page").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
