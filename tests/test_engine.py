from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odlake.functions import coerce
from odlake.functions.text import glob_to_regex, matches
from odlake.operators import catalog, load, query, select, snapshot
from odlake.plans import schema
from odlake.sources import portal
from odlake.streaming import hwm


def values(spark, made, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string").select("k", F.parse_json("j").alias("v"))
    c = made(F.col("v"))
    return [(r[0], r[1]) for r in rows.select(c.value, c.bad, "k").orderBy("k").collect()]


BAD, NULL = (None, True), (None, False)


def test_numbers(spark):
    cases = {'"1.5"': (1.5, False), "2": (2.0, False), '""': NULL, "null": NULL, '" 1"': BAD, '"1e400"': BAD, '"0x10"': BAD, '"1d"': BAD, '"inf"': (float("inf"), False), "true": BAD, '{"a":1}': BAD, '".5"': (0.5, False), '"+7."': (7.0, False)}
    assert values(spark, coerce.to_double, cases) == list(cases.values())


def test_integers(spark):
    cases = {'"12"': (12, False), "2.9": (2, False), '"2.9"': BAD, '""': NULL, '"99999999999999999999"': BAD, '"-3"': (-3, False)}
    assert values(spark, coerce.to_bigint, cases) == list(cases.values())


def test_booleans(spark):
    cases = {"true": (True, False), '"T"': (True, False), '"f"': (False, False), '"tRuE"': BAD, '"y"': BAD, "1": BAD, '""': NULL, "null": NULL}
    assert values(spark, coerce.to_boolean, cases) == list(cases.values())


def test_timestamps(spark):
    day = dt.datetime(2024, 1, 15)
    cases = {'"2024-01-15T00:00:00.000"': (day, False), '"2024-01-15"': (day, False), '"2024-01-15T02:00:00+02:00"': (day, False), '"2024-01-15T00:00:00Z"': (day, False), '"2024"': BAD, '"2024-13-01"': BAD, '""': NULL, "5": BAD, '"2024-01-15 00:00:00"': BAD}
    assert values(spark, coerce.to_timestamp, cases) == list(cases.values())


def test_text_and_json(spark):
    cases = {'"a"': "a", '""': "", "1": "1", "true": "true", '{"b":1,"a":[2]}': '{"a":[2],"b":1}', "null": None}
    assert [v for v, _ in values(spark, coerce.to_text, cases)] == list(cases.values())


def test_points(spark):
    rows = spark.createDataFrame([('{"p":{"type":"Point","coordinates":[1.5,2]}}',), ('{"p":{"human_address":"x"}}',), ("{}",)], "value string")
    out = schema.typed(portal.parsed(rows), [("p", "point")]).collect()
    assert [(r[0], r[1]) for r in out] == [(1.5, 2.0), (None, None), (None, None)] and out[1][2] is not None


def test_strict_fails_and_permissive_splits(spark):
    rows = portal.parsed(spark.createDataFrame([('{"s":"1"}', 0, 0), ('{"s":"x"}', 0, 1)], "value string, page int, pos int"))
    with pytest.raises(Exception, match="pos=1 column=s"):
        schema.typed(rows, [("s", "number")]).collect()
    good, bad = schema.split(rows, [("s", "number")], keep=("pos",))
    assert [r["pos"] for r in good.collect()] == [0] and bad.first()["bad_columns"] == ["s"]


@pytest.mark.parametrize(("glob", "text", "hit"), [("Crimes*", "Crimes 2020", True), ("crimes*", "Crimes", False), ("*", "a/b", False), ("a?c", "abc", True), ("[^a]b", "ab", False), ("[a-c]b", "bb", True), ("\\*", "*", True), ("[", "[", False), ("a.c", "abc", False), ("*.csv", "x.csv\n", False)])
def test_globs(spark, glob, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), glob)).first()[0] is hit, glob_to_regex(glob)


CATALOG = [("aaaa-0001", "Crimes 2020", "Public Safety", ["crime", "311"]), ("aaaa-0002", "Crimes 2021", "Public Safety", ["crime"]), ("bbbb-0003", "Park Events", "Parks", ["events"]), ("cccc-0004", "Building Permits", "Buildings", ["permits"]), ("dddd-0005", "311 Archive 2015", "Public Safety", ["311", "archive"])]


@pytest.fixture
def entries(spark):
    return spark.createDataFrame(CATALOG, "id string, name string, category string, tags array<string>")


def test_selectors(entries):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(select.resolve(entries, [{"category": "Public*"}], [{"name": "*Archive*"}])) == ["aaaa-0001", "aaaa-0002"]
    assert ids(select.resolve(entries, [{"tag": "311"}, {"id": "cccc-0004"}])) == ["aaaa-0001", "cccc-0004", "dddd-0005"]
    assert ids(select.resolve(entries, [{"name": "*"}], only=["bbbb-0003"])) == ["bbbb-0003"]
    with pytest.raises(ValueError, match="zzzz"):
        select.resolve(entries, [{"name": "*"}], only=["zzzz"])
    with pytest.raises(ValueError, match="exactly one"):
        select.resolve(entries, [{"name": "*", "id": "x"}])


def test_effective_and_refresh(spark, entries):
    overrides = spark.createDataFrame([("aaaa-0001", "crimes", "", 0, ["x"])], "id string, table string, where string, batch_size int, skip_columns array<string>")
    plan = select.effective(entries, overrides)
    rows = {r["dataset_id"]: r for r in plan.collect()}
    assert rows["aaaa-0001"]["table"] == "crimes" and rows["aaaa-0001"]["batch_size"] == 5000 and rows["aaaa-0001"]["skip_columns"] == ["x"]
    assert rows["aaaa-0002"]["table"] == "aaaa_0002" and rows["aaaa-0002"]["order_by"] == ":id"
    assert select.full_refresh(plan, ["aaaa-0002"]).where("mode = 'full_replace'").count() == 1
    assert select.hashed(plan).select("config_hash").distinct().count() == 5
    with pytest.raises(ValueError):
        select.full_refresh(plan, ["nope"])


def row(k: int, minute: int, score) -> dict:
    return {":id": f"r{k}", ":updated_at": f"2024-01-01T00:{minute:02d}:00.000", "score": score}


def target(spark, rows, columns=(("score", "number"),), **settings):
    def read(mark):
        kept = [r for r in rows if mark is None or r[":updated_at"] >= mark.isoformat()]
        df = spark.createDataFrame([(json.dumps(r), 0, k) for k, r in enumerate(kept)], "value string, page int, pos int")
        return portal.parsed(df)

    return load.Target("aaaa-0001", "aaaa_0001", list(columns), read, **settings)


def table_of(store):
    return {r["record_id"]: r["score"] for r in store.read("aaaa_0001").collect()}


def test_delta(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    store.run([target(spark, [row(k, k, k) for k in range(3)])])
    log = store.run([target(spark, [row(1, 5, 0), row(1, 6, 999), row(4, 4, 4)])]).first()
    assert (log["status"], log["rows_written"]) == ("ok", 2)
    assert table_of(store) == {"r0": 0, "r1": 999, "r2": 2, "r4": 4}
    assert store.state().first()["hwm_updated_at"] == dt.datetime(2024, 1, 1, 0, 6)
    drift = store.run([target(spark, [row(5, 9, 1)], columns=[("other", "number")])]).first()
    assert drift["status"] == "failed" and "removed score" in drift["error"]
    assert len(table_of(store)) == 4
    again = store.run([target(spark, [row(9, 9, 1)], mode="full_replace")]).first()
    assert again["status"] == "ok" and store.read("aaaa_0001").count() == 1


def test_failures_leave_table_and_mark(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    store.run([target(spark, [row(0, 0, 0)])])
    before = store.state().first()["hwm_updated_at"]
    log = store.run([target(spark, [row(1, 1, 1), row(2, 2, "bad")]), replace(target(spark, []), dataset_id="other")], on_error="abort")
    assert sorted(r["status"] for r in log.collect()) == ["aborted", "failed"]
    assert table_of(store) == {"r0": 0} and store.state().first()["hwm_updated_at"] == before
    other = load.Store(spark, str(tmp_path / "other"))
    assert other.run([target(spark, [row(0, 0, 0), row(0, 1, 1)])]).first()["status"] == "failed"
    assert other.read("aaaa_0001") is None


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=3, max_size=8), st.integers(1, 3))
def test_any_split_gives_the_full_load(spark, tmp_path_factory, ids, cuts):
    rows = [row(i, minute, minute) for minute, i in enumerate(ids)]
    expected = {r[":id"]: r["score"] for r in rows}
    store = load.Store(spark, str(tmp_path_factory.mktemp("store")))
    first = list({r[":id"]: r for r in rows[:1]}.values())
    store.run([target(spark, first)])
    for upto in sorted({len(rows) * (k + 1) // cuts for k in range(cuts)} | {len(rows)}):
        store.run([target(spark, rows[:upto])])
    assert table_of(store) == expected


def test_stream(spark, tmp_path):
    pages, store = tmp_path / "pages", load.Store(spark, str(tmp_path / "store"))
    pages.mkdir()

    def go():
        stream = hwm.landed_stream(spark, str(pages), 1)
        hwm.start(stream, store, "aaaa-0001", "aaaa_0001", [("score", "number")], str(tmp_path / "check")).awaitTermination()

    (pages / "1.json").write_text(json.dumps([row(0, 0, 0), row(1, 1, 1)]))
    go()
    (pages / "2.json").write_text(json.dumps([row(1, 2, 5), row(2, 3, 2)]))
    go()
    go()
    assert table_of(store) == {"r0": 0, "r1": 5, "r2": 2}


def fake(rows, failing=()):
    calls = []

    def fetch(url):
        from urllib.parse import parse_qs, urlparse

        asked = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        offset, size = int(asked["$offset"]), int(asked["$limit"])
        calls.append(offset)
        if offset in failing:
            return failing[offset], ""
        return 200, json.dumps(rows[offset : offset + size])

    return fetch


def test_portal_rows(spark):
    rows = [row(k, k, k) for k in range(5)]
    for source in portal.sources(fake(rows)):
        spark.dataSource.register(source)
    read = spark.read.format("portal_rows").option("portal", "x").option("dataset", "d")
    assert read.option("pageSize", 2).load().count() == 5
    assert read.option("pageSize", 2).option("rows", 5).option("pagesPerTask", 1).load().count() == 5
    assert read.option("pageSize", 2).option("limit", 3).load().count() == 3


def test_retries_end():
    with pytest.raises(RuntimeError, match="503"):
        portal.fetched(lambda u: (503, ""), "u", wait=0)
    with pytest.raises(RuntimeError, match="404"):
        portal.fetched(lambda u: (404, ""), "u", wait=0)
    statuses = iter([(429, ""), (500, ""), (200, "ok")])
    assert portal.fetched(lambda u: next(statuses), "u", wait=0) == "ok"


def runs(spark, *rows):
    return spark.createDataFrame([("p", r, d, d.replace("-", "_"), dt.datetime(2024, 1, day), None, s, n) for r, d, day, s, n in rows], "portal string, run_id string, dataset_id string, table_name string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, rows_written long")


def test_catalog(spark, entries):
    log = runs(spark, ("1", "aaaa-0001", 1, "ok", 3), ("2", "aaaa-0001", 2, "ok", None), ("3", "aaaa-0002", 1, "ok", 5), ("4", "aaaa-0002", 2, "failed", 999))
    full = entries.withColumn("portal", F.lit("p")).withColumn("description", F.lit(None).cast("string")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    listed = {r["dataset_id"]: r["last_rows_written"] for r in catalog.list_datasets(full, log).collect()}
    assert listed == {"aaaa-0001": None, "aaaa-0002": 5, "bbbb-0003": None, "cccc-0004": None, "dddd-0005": None}
    assert catalog.totals(full, log).first().asDict() == {"dataset_count": 5, "total_row_count": 5}
    assert [r["dataset_id"] for r in catalog.search_datasets(full, log, "CRIME").collect()] == ["aaaa-0001", "aaaa-0002"]
    assert catalog.search_datasets(full, log, "arch").count() == 1 and catalog.search_datasets(full, log, "31").count() == 1
    with pytest.raises(ValueError, match="blank"):
        catalog.search_datasets(full, log, "  ")
    state = spark.createDataFrame([], "portal string, dataset_id string, hwm_updated_at timestamp_ntz, last_full_replace_at timestamp_ntz")
    columns = spark.createDataFrame([("p", "aaaa_0002", 0, "record_id", "string"), ("p", "aaaa_0002", 1, "score", "double")], "portal string, table_name string, pos int, name string, type string")
    assert [c["name"] for c in catalog.describe_dataset(full, log, state, columns, "aaaa-0002").first()["columns"]] == ["score"]
    with pytest.raises(ValueError, match="not found"):
        catalog.describe_dataset(full, log, state, columns, "zzzz")
    with pytest.raises(ValueError, match="not attached"):
        catalog.describe_dataset(full, log, state, columns, "aaaa-0002", "q")
    with pytest.raises(ValueError, match="p, q"):
        catalog.describe_dataset(full.union(full.withColumn("portal", F.lit("q")).select(full.columns)), log, state, columns, "aaaa-0002")


def test_query_caps(spark):
    assert query.run(spark, "SELECT id FROM range(2)").rows == [(0,), (1,)]
    many = query.run(spark, "SELECT id FROM range(2000)")
    assert len(many.rows) == 1000 and many.truncated and "1000 rows" in many.note
    wide = query.run(spark, "SELECT repeat('x', 30000) AS s FROM range(50) t")
    assert 0 < len(wide.rows) < 50 and wide.truncated and "bytes" in wide.note


@pytest.mark.parametrize("sql", ["CREATE TABLE t (a INT)", "DROP TABLE t", "SET a=b", "INSERT INTO t VALUES (1)"])
def test_read_only(spark, sql):
    with pytest.raises(PermissionError, match="read-only"):
        query.run(spark, sql)


@pytest.mark.parametrize("sql", ["VALUES (1), (2)", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "SELECT a FROM t WHERE a IN (SELECT b FROM u) UNION ALL SELECT 1 ORDER BY 1 LIMIT 3"])
def test_reads_are_allowed(spark, sql):
    assert query.is_read_only(spark, sql)


REFLECTING = ["SELECT java_method('java.lang.System', 'setProperty', 'zz', '1')", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT `try_reflect` ('java.util.UUID', 'randomUUID')", "SELECT reflect/* */('java.util.UUID', 'randomUUID')", "SELECT IDENTIFIER('ref' || 'lect')('java.util.UUID', 'randomUUID')", "FROM range(1) INSERT INTO t SELECT *", "SELECT 1) AS x; DROP TABLE t"]


@pytest.mark.parametrize("sql", REFLECTING[:-1])
def test_nothing_else_runs(spark, sql):
    with pytest.raises(PermissionError, match="read-only"):
        query.run(spark, sql)


def test_paths_and_several_statements_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)not_found|cannot be found"):
        query.run(spark, f"SELECT * FROM parquet.`{tmp_path}/t`")
    with pytest.raises(Exception, match="(?i)syntax|read-only"):
        query.run(spark, REFLECTING[-1])
    assert spark.sql(f"SELECT * FROM parquet.`{tmp_path}/t`").count() == 3  # only user queries are kept off


def test_other_reads(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert query.run(spark, "SELECT /*+ BROADCAST(a) */ a.id FROM three a JOIN three b ON a.id = b.id").rows == [(0,), (1,), (2,)]
    assert query.run(spark, "FROM three |> WHERE id > 1").rows == [(2,)]
    assert query.run(spark, "SELECT 'reflect(1)' AS s").rows == [("reflect(1)",)]
    assert query.run(spark, "DESCRIBE three").rows and query.run(spark, "EXPLAIN SELECT 1").rows and query.run(spark, "SHOW TABLES").columns
    assert query.run(spark, "SELECT * FROM three WHERE id < 0").rows == []


def test_byte_cap_counts_arrays_of_values_in_bytes(spark):
    head = len('{"columns":[],"rows":[],"row_count":0,"truncated":false}') + len("s") + 3
    row = len('["ééé",null]'.encode()) + 1 + len("n") + 3 - len("n") - 3
    for most, expected in ((head + len("n") + 3 + 2 * row, 2), (head + len("n") + 3 + 2 * row - 1, 1), (1, 1)):
        got = query.run(spark, "SELECT 'ééé' AS s, CAST(NULL AS INT) AS n FROM range(5)", max_bytes=most)
        assert len(got.rows) == expected and got.truncated
    assert not query.run(spark, "SELECT 'ééé' AS s, CAST(NULL AS INT) AS n FROM range(5)", max_bytes=head + len("n") + 3 + 5 * row).truncated


def test_bad_sql_passes_the_parser_message(spark):
    with pytest.raises(Exception, match="(?i)syntax"):
        query.run(spark, "not sql")


def test_timeout(spark):
    with pytest.raises(TimeoutError, match="timeout"):
        query.run(spark, "SELECT count(*) FROM range(1000000000) a JOIN range(100000) b ON a.id % 100000 = b.id AND sqrt(a.id) + b.id < 0", timeout=0.3)


def test_snapshot_tamper(spark, tmp_path, entries):
    store = load.Store(spark, str(tmp_path / "store"))
    store.replace_catalog(entries, "1")
    store.replace_catalog(entries.limit(0), "2")
    assert store.read("catalog").count() == 5
    packages = tmp_path / "packages"
    target_ = packages / f"snapshot_id={snapshot.pack(store, 'p', str(packages), [])}"
    snapshot.restore(spark, str(target_), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/catalog")).count() == 5
    with pytest.raises(Exception, match="(?i)exists"):
        snapshot.restore(spark, str(target_), str(tmp_path / "out"))
    snapshot.restore(spark, str(target_), str(tmp_path / "out"), force=True)
    part = next((target_ / "data/catalog").glob("*.parquet"))
    data = bytearray(part.read_bytes())
    data[8] ^= 1
    part.write_bytes(data)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="hash"):
        snapshot.restore(spark, str(target_), str(tmp_path / "o2"))
    part.unlink()
    assert snapshot.faults(spark, str(target_)).first()["fault"] == "missing"


def test_index(spark):
    rows = [("p", f"s{k}", k) for k in range(4)] + [("p", "s3", 3), ("q", "s9", 9)]
    index = spark.createDataFrame(rows, "portal string, snapshot_id string, size_bytes long")
    kept = snapshot.add_to_index(index, index.limit(1), 2)
    assert sorted((r[0], r[1]) for r in kept.collect()) == [("p", "s2"), ("p", "s3"), ("q", "s9")]
    assert snapshot.resolve(index, "p").first()["snapshot_id"] == "s3"
    assert snapshot.resolve(index, "p", "s1").first()["size_bytes"] == 1
    with pytest.raises(ValueError, match="no snapshot"):
        snapshot.resolve(index, "z")


def test_catalog_entries_and_metadata(spark):
    body = {"resource": {"id": "a", "name": "n", "description": "", "rowsUpdatedAt": "junk"}, "classification": {"domain_tags": ["t"]}}
    e = portal.catalog_entries(portal.parsed(spark.createDataFrame([(json.dumps(body),)], "value string"))).first()
    assert (e["id"], e["description"], e["category"], e["tags"], e["updated_at"]) == ("a", None, None, ["t"], None)
    meta = {"columns": [{"fieldName": "a", "dataTypeName": "number"}, {"fieldName": ":@x", "dataTypeName": "number"}]}
    columns = portal.metadata_columns(portal.parsed(spark.createDataFrame([(json.dumps(meta),)], "value string")))
    assert [r["field_name"] for r in schema.usable(columns).collect()] == ["a"]


def test_limit_goes_by_the_mark(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    rows = [row(k, 9 - k, k) for k in range(5)]
    store.run([target(spark, rows, limit=2)])
    assert set(table_of(store)) == {"r4", "r3"}
    store.run([target(spark, rows, limit=2)])
    store.run([target(spark, rows)])
    assert set(table_of(store)) == {f"r{k}" for k in range(5)}


def test_attach_and_query_over_portals(spark, tmp_path, entries):
    stores = {name: load.Store(spark, str(tmp_path / name)) for name in ("north", "south")}
    done = load.refresh_catalogs(stores, lambda name: entries if name == "north" else entries.where(F.raise_error(F.lit("down")).isNull()))
    assert [(r["portal"], r["datasets"], r["error"] is None) for r in done.orderBy("portal").collect()] == [("north", 5, True), ("south", None, False)]
    with pytest.raises(ValueError, match="no catalog"):
        load.attach(stores, {})
    stores["south"].replace_catalog(entries, "1")
    for k, store in enumerate(stores.values()):
        store.publish("items", spark.createDataFrame([("a",), (f"b{k}",)], "id string"), "1")
    load.attach(stores, {"north": ["items"], "south": ["items"]})
    assert query.run(spark, "SELECT n.id FROM north.items n JOIN south.items s ON n.id = s.id").rows == [("a",)]
    assert query.run(spark, "SELECT count(*) FROM north_meta.catalog").rows == [(5,)]


def test_several_datasets_at_a_time(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    some = [replace(target(spark, [row(0, 0, k if k != 2 else "bad")]), dataset_id=f"d{k}", table=f"t{k}") for k in range(5)]
    log = {r["dataset_id"]: r["status"] for r in store.run(some).collect()}
    assert log == {f"d{k}": "failed" if k == 2 else "ok" for k in range(5)}
    assert store.tally().first().asDict() | {"run_id": ""} == {"run_id": "", "planned": 5, "ok": 4, "failed": 1, "aborted": 0}


def test_fetch_tries_again_after_failures_of_the_transport():
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError("timed out")
        return (503, "") if len(calls) < 6 else (200, "[]")

    assert portal.fetched(flaky, "u", wait=0) == "[]" and len(calls) == 6
    with pytest.raises(RuntimeError, match="reset"):
        portal.fetched(lambda url: (_ for _ in ()).throw(ConnectionResetError("reset")), "u", retries=2, wait=0)
    assert "%24order=%3Aid" in portal.rows_url({"portal": "p", "dataset": "d"}, 0, 10) and portal.quoted("o'x") == "'o''x'"


def test_catalog_pages(spark):
    entries = [{"resource": {"id": f"aaaa-000{k}", "name": f"n{k}"}, "classification": {"domain_tags": ["t"]}} for k in range(5)]

    def fetch(url):
        asked = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        at, size = int(asked["offset"]), int(asked["limit"])
        return 200, json.dumps({"resultSetSize": 5, "results": entries[at : at + size]})

    for source in portal.sources(fetch):
        spark.dataSource.register(source)
    pages = spark.read.format("portal_catalog").option("portal", "p").option("pageSize", 2).load()
    assert [r["id"] for r in portal.catalog_entries(portal.parsed(pages)).orderBy("id").collect()] == [f"aaaa-000{k}" for k in range(5)]
    assert pages.select("page").distinct().count() == 3
