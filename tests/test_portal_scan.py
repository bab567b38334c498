"""portal_rows against a portal that filters by itself: pushed filters, and the stream in ranges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull
from pyspark.sql.types import StructType

from odlake.operators import load
from odlake.sources import portal as portals
from odlake.sources import replay
from odlake.streaming import hwm

ROWS = [(f"r{k:02d}", 1 + k // 4, f"n{k % 3}", str(k)) for k in range(22)]


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def reader(spark, fetch, **options):
    for source in portals.sources(fetch):
        spark.dataSource.register(source)
    return spark.read.format("portal_rows").options(portal="p.example", dataset="d", wait="0", **options)


def test_simple_comparisons_reach_the_portal(spark, portal, pushing):
    fetch, put, folder, asked = portal
    put(ROWS)
    rows = reader(spark, fetch, pageSize=4, pagesPerTask=2, pushFilters="true").schema("name string, score double, `:updated_at` timestamp_ntz")
    df = rows.load().where((F.col("score") > 6) & (F.col("name") == "n1") & (F.col(":updated_at") <= F.lit(dt.datetime(2024, 1, 5))))
    assert sorted(r["score"] for r in df.collect()) == [float(k) for k in range(7, 20) if k % 3 == 1]
    where = [a["$where"] for a in asked() if "*" in a.get("$select", "")]
    assert where and all("score > 6.0" in w and "name = 'n1'" in w and ":updated_at <= '2024-01-05T00:00:00.000'" in w for w in where)
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_comparisons_stay_with_spark(spark, portal, pushing):
    fetch, put, folder, asked = portal
    put(ROWS)
    rows = reader(spark, fetch, pushFilters="true").schema("name string, score double").load()
    df = rows.where((F.col("name") > "n0") & (F.col("score") % 2 == 0) & ((F.col("score") > 17) | (F.col("name") == "n2")))
    assert sorted(r["score"] for r in df.collect()) == [k for k in range(22) if k % 2 == 0 and k % 3 and (k > 17 or k % 3 == 2)]
    assert all(" > " not in a.get("$where", "") for a in asked())
    limited = reader(spark, fetch, limit=5, order=":id", pushFilters="true").schema("score double").load().where("score >= 3")
    assert sorted(r["score"] for r in limited.collect()) == [3.0, 4.0]  # of the first five rows


def test_without_pushing_a_schema_of_its_own_is_read_all_the_same(spark, portal):
    fetch, put, folder, asked = portal
    put(ROWS)
    rows = reader(spark, fetch).schema("name string, score double").load().where("score >= 20")
    assert sorted(map(tuple, rows.collect())) == [("n2", 20.0), ("n0", 21.0)][::-1] and not any("score" in a.get("$where", "") for a in asked())


def test_conditions():
    schema = StructType.fromDDL("name string, n bigint, x double, `Odd name` double, ok boolean, d decimal(9,2)")
    made = lambda f: portals.condition(f, schema)
    assert made(EqualTo(("name",), "it's")) == "name = 'it''s'" and made(GreaterThan(("name",), "a")) is None
    assert made(GreaterThan(("Odd name",), 1.5)) == "`Odd name` > 1.5" and made(GreaterThan(("x",), float("nan"))) is None
    assert made(In(("n",), (1, 2))) == "n IN (1, 2)" and made(In(("n",), (1, None))) is None and made(EqualTo(("ok",), True)) == "ok = true"
    assert made(IsNotNull(("d",))) == "d IS NOT NULL" and made(EqualTo(("d",), 1)) is None and made(EqualTo(("n", "m"), 1)) is None and made(EqualTo(("zz",), 1)) is None


def test_cells():
    kinds = {f.name: f.dataType for f in StructType.fromDDL("s string, n bigint, x double, b boolean, t timestamp_ntz, d date")}
    assert portals.cell({"a": 1}, kinds["s"]) == '{"a": 1}' and portals.cell("", kinds["s"]) == "" and portals.cell("", kinds["n"]) is None
    assert portals.cell("7", kinds["n"]) == 7 and portals.cell("1.5", kinds["x"]) == 1.5 and portals.cell("true", kinds["b"]) is True
    assert portals.cell("2024-01-02T03:04:05.000", kinds["t"]) == dt.datetime(2024, 1, 2, 3, 4, 5) and portals.cell("2024-01-02T00:00:00", kinds["d"]) == dt.date(2024, 1, 2)


def test_ranges_of_the_stream(portal):
    """Replay of a range gives its rows again, also when newer rows have come; ties fall on both sides of a range's end once."""
    fetch, put, folder, asked = portal
    put(ROWS)
    made = portals.NewerRows({"portal": "p.example", "dataset": "d", "pageSize": "3", "pagesPerTask": "2", "wait": "0"}, fetch)
    start = made.initialOffset()
    end = made.latestOffset()
    assert end == {"hwm": "2024-01-06T00:00:00.000", "id": "r21"}
    parts = made.partitions(start, end)
    read = lambda: [[json.loads(v)[":id"] for v, _, _ in made.read(p)] for p in parts]
    first = read()
    assert [len(r) for r in first] == [6, 6, 6, 4] and sum(first, []) == [r[0] for r in ROWS]
    put(ROWS + [("r00a", 6, "late", "1"), ("r22", 6, "new", "1"), ("r23", 9, "new", "2")])
    assert read()[:3] == first[:3] and set(read()[3]) == {*first[3], "r00a"}  # an id below the end, at its mark
    later = made.latestOffset()
    assert later["id"] == "r23" and [[json.loads(v)[":id"] for v, _, _ in made.read(p)] for p in made.partitions(end, later)] == [["r22", "r23"]]
    put([])
    assert made.latestOffset() == later and portals.NewerRows(made.options, fetch).latestOffset() == {"hwm": "", "id": ""}


def test_the_stream_through_spark(spark, portal):
    fetch, put, folder, asked = portal
    put(ROWS)
    for source in portals.sources(fetch):
        spark.dataSource.register(source)
    store = load.Store(spark, str(folder / "store"), buckets=3)

    def go(check="check"):
        pages = spark.readStream.format("portal_rows").options(portal="p.example", dataset="d", pageSize="3", pagesPerTask="1", wait="0").load()
        query = hwm.start(portals.parsed(pages), store, "aaaa-0001", "aaaa_0001", [("name", "text"), ("score", "number")], str(folder / check), once=False)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    go()
    table = lambda: {r["record_id"]: r["score"] for r in store.read("aaaa_0001").collect()}
    assert table() == {i: float(s) for i, _, _, s in ROWS}
    put([r for r in ROWS if r[0] != "r03"] + [("r03", 8, "changed", "33"), ("r99", 8, "new", "99")])
    go()
    assert table() == {i: float(s) for i, _, _, s in ROWS} | {"r03": 33.0, "r99": 99.0}
    go("another")  # a second query, from the beginning
    assert table() == {i: float(s) for i, _, _, s in ROWS} | {"r03": 33.0, "r99": 99.0}
    pages = [a for a in asked() if a.get("$limit") == "3"]
    drivers = {a["pid"] for a in asked() if "DESC" in a.get("$order", "")}
    assert pages and not drivers & {a["pid"] for a in pages}  # rows are read where tasks run


def test_a_recorded_portal(spark, tmp_path):
    rows = [{":id": f"r{k:03d}", ":updated_at": f"2024-01-{1 + k % 9:02d}T00:00:00.000", "n": k} for k in range(100)]
    v = portals.parsed(spark.createDataFrame([(json.dumps(r), 0, 0) for r in rows], "value string, page int, pos int").repartition(4))
    recorded = replay.record(v, str(tmp_path / "rows"), files=5)
    fetch = replay.player(recorded, [("n", "number")])
    assert len(recorded) == 5 and sum(n for _, _, n in recorded) == 100

    def ids(where="", order=":id", offset=0, size=7):
        status, body = fetch(portals.rows_url({"portal": "p", "dataset": "d", "order": order, "where": where, "systemFields": "true"}, offset, size))
        return [r[":id"] for r in json.loads(body)] if status == 200 else status

    every = [r[":id"] for r in rows]
    assert ids(offset=60, size=50) == every[60:] and ids(offset=17) == every[17:24] and ids(offset=100) == []
    assert ids("(:id > 'r038')") == every[39:46] and ids("(:id > 'r038') AND (:id <= 'r041')", offset=1) == every[40:42] and ids(":id > 'zz'") == []
    assert ids("(:updated_at > '2024-01-08T00:00:00.000') AND (:id > 'r050')", size=3) == ["r053", "r062", "r071"]
    assert ids("score > 1") == 400 and ids(order=":updated_at,:id") == 400 and ids("(:id > 'a' OR n = 1)") == 400
    assert json.loads(fetch(portals.metadata_url("p", "d"))[1]) == {"columns": [{"fieldName": "n", "dataTypeName": "number"}]}


def test_a_recorded_portal_opens_only_the_files_of_a_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "ROWS", 10)
    rows = [{":id": f"r{k:03d}", ":updated_at": f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}.000", "n": "a\u2028b\tc\n"} for k in range(200)]
    v = portals.parsed(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").repartition(4))
    recorded, seen = replay.record(v, str(tmp_path / "rows"), files=3), []
    fetch = replay.player(recorded, [("n", "text")])
    assert len(recorded) >= 20 and max(n for _, _, n in recorded) <= 10 and [r[0] for r in recorded] == sorted(r[0] for r in recorded)
    real = replay.opened
    monkeypatch.setattr(replay, "opened", lambda path: seen.append(path) or real(path))

    def asked(where="", offset=0, size=10):
        replay.lines.cache_clear()
        seen.clear()
        return json.loads(fetch(portals.rows_url({"portal": "p", "dataset": "d", "where": where, "systemFields": "true"}, offset, size))[1])

    assert asked("(:id > 'r049') AND (:id <= 'r150')") == rows[50:60] and len(seen) <= 3
    assert asked("(:id > 'r004')", offset=140, size=1) == rows[145:146] and len(seen) <= 2  # whole files are passed over by their rows
    assert asked(offset=195) == rows[195:] and len(seen) <= 2
    assert asked("(:updated_at > '2024-01-01T00:03:19.000')") == [] and not seen  # nothing newer: no file
    assert asked("(:updated_at > '2024-01-01T00:03:14.000')") == rows[195:] and len(seen) <= 2
