"""Buckets, manifests, notes, cleaning and groups of pages of a store."""

import datetime as dt
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from odlake.operators import load, snapshot
from odlake.operators.notes import Notes
from odlake.plans import schema
from odlake.sources import portal
from odlake.sources.folder import Folder
from odlake.streaming import hwm

from .test_engine import row, table_of, target

DAY = dt.timedelta(days=1)


def folders(root, table="aaaa_0001"):
    """version -> its bucket folders."""
    return {v: sorted(b for b in os.listdir(root / table / v) if b.startswith("__bucket=")) for v in os.listdir(root / table) if v.startswith("v=")}


def test_a_row_rewrites_its_bucket_only(spark, tmp_path):
    store = load.Store(spark, str(tmp_path), buckets=8)
    store.run([target(spark, [row(k, k % 50, k) for k in range(40)])])
    (first,), before = folders(tmp_path), store.manifest("aaaa_0001")
    assert len(folders(tmp_path)[first]) == 8 == before["buckets"]
    assert store.run([target(spark, [row(7, 55, 700)])]).first()["rows_written"] == 1
    after, new = store.manifest("aaaa_0001"), [v for v in folders(tmp_path) if v != first]
    assert len(new) == 1 and len(folders(tmp_path)[new[0]]) == 1
    changed = [k for k in range(8) if before["parts"][k] != after["parts"][k]]
    assert folders(tmp_path)[new[0]] == [f"__bucket={changed[0]}"] and len(changed) == 1
    assert table_of(store) == {f"r{k}": (700 if k == 7 else k) for k in range(40)}
    assert not [n for n in os.listdir(tmp_path / "aaaa_0001") if n.startswith("delta=")]


def test_a_store_keeps_the_buckets_that_a_table_began_with(spark, tmp_path):
    load.Store(spark, str(tmp_path), buckets=3).run([target(spark, [row(k, k, k) for k in range(9)])])
    other = load.Store(spark, str(tmp_path), buckets=11)
    other.run([target(spark, [row(4, 40, 44), row(20, 41, 20)])])
    assert other.manifest("aaaa_0001")["buckets"] == 3
    assert table_of(other) == {f"r{k}": k for k in range(9)} | {"r4": 44, "r20": 20}


def test_loads_without_rows(spark, tmp_path):
    store = load.Store(spark, str(tmp_path), buckets=4)
    assert store.run([target(spark, [])]).first()["rows_written"] == 0
    assert table_of(store) == {} and store.state().first()["hwm_updated_at"] is None
    assert store.run([target(spark, [row(1, 1, 1)])]).first()["rows_written"] == 1
    assert store.run([target(spark, [])]).first()["rows_written"] == 0
    assert table_of(store) == {"r1": 1} and store.state().first()["hwm_updated_at"] == dt.datetime(2024, 1, 1, 0, 1)


def test_keys_are_checked_where_they_are_written(spark, tmp_path):
    store = load.Store(spark, str(tmp_path), buckets=4)
    items = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    with pytest.raises(ValueError, match="repeated: 'b'"):
        store.publish("items", items, "1", "id")
    with pytest.raises(ValueError, match="null"):
        store.publish("items", items.select(F.nullif("id", F.lit("a")).alias("id"), "n").limit(1), "1", "id")
    assert store.read("items") is None and store.folder.names("items") == []
    store.publish("items", items.limit(2), "2", "id")
    failed = store.run([target(spark, [row(1, 1, 1)])]).first()["status"], store.run([target(spark, [{":updated_at": "2024-01-01T00:09:00.000", "score": 1}])]).first()
    assert failed[0] == "ok" and failed[1]["status"] == "failed" and "null" in failed[1]["error"]
    assert table_of(store) == {"r1": 1}


def test_superseded_versions_go_after_their_time(spark, tmp_path):
    store = load.Store(spark, str(tmp_path), buckets=4, retention=None)
    store.run([target(spark, [row(k, k, k) for k in range(12)])])
    for k in range(3):
        store.run([target(spark, [row(k, 30 + k, 100 + k)])])
    expected = table_of(store)
    (tmp_path / "aaaa_0001/v=crashed").mkdir()
    (tmp_path / "aaaa_0001/delta=crashed").mkdir()
    assert len(folders(tmp_path)) == 5 and store.clean("aaaa_0001", DAY) == []
    assert len(store.clean("aaaa_0001", -DAY)) > 2
    kept = folders(tmp_path)
    assert sum(map(len, kept.values())) == 4 and len(os.listdir(tmp_path / "aaaa_0001/_manifests")) in (1, 2)
    assert table_of(store) == expected and not os.path.exists(tmp_path / "aaaa_0001/delta=crashed")
    eager = load.Store(spark, str(tmp_path), retention=dt.timedelta(0))
    eager.run([target(spark, [row(k, 50, k) for k in range(12)])])
    assert sum(map(len, folders(tmp_path).values())) == 4 and table_of(eager) == {f"r{k}": k for k in range(12)}


def test_add_appends_by_reference(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    one, two = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2,), (3,)], "n int")
    store.add("t", one, "1")
    assert sorted(r[0] for r in store.add("t", two, "2", replace=False).collect()) == [1, 2, 3]
    assert store.manifest("t")["parts"] == ["1", "2"]
    with pytest.raises(load.SchemaDrift):
        store.add("t", one.withColumn("m", F.lit(1)), "3", replace=False)
    assert [r[0] for r in store.add("t", one, "4").collect()] == [1]
    store.publish("k", one, "1", "n")
    with pytest.raises(ValueError, match="key"):
        store.add("k", two, "2", replace=False)


def test_the_catalog_is_read_in_the_order_of_ids(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    assert store.read_in_order() is None
    ids = [f"{(k * 7919) % 10007:05d}" for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert store.replace_catalog(spark.createDataFrame([(i, "n") for i in ids], "id string, name string").repartition(3), "1") == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in store.folder.names("catalog/v=1") if f.startswith("part-")]
    read = store.read_in_order()
    assert len(files) > 2 and [r["id"] for r in read.collect()] == sorted(ids) and "Sort" not in read._jdf.queryExecution().toString()
    store.add("t", spark.range(3), "1")
    with pytest.raises(ValueError, match="order"):
        store.read_in_order("t")


def test_attached_views_read_the_live_buckets(spark, tmp_path):
    store = load.Store(spark, str(tmp_path / "s"), buckets=4)
    store.replace_catalog(spark.createDataFrame([("a",)], "id string"), "1")
    store.run([target(spark, [row(k, k, k) for k in range(12)])])
    for k in range(2):
        store.run([target(spark, [row(k, 30 + k, 100 + k)])])
        load.attach({"west": store}, {"west": ["aaaa_0001"]})
        assert {r["record_id"]: r["score"] for r in spark.sql("SELECT record_id, score FROM west.aaaa_0001").collect()} == table_of(store)


def test_notes_are_folded(spark, tmp_path):
    kind = "k string, n int, at timestamp_ntz"
    notes = lambda: Notes(spark, Folder(spark, str(tmp_path)), "log", kind, ("k",), every=4)
    mine, other, at = notes(), notes(), dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    for n in range(30):
        (mine if n % 3 else other).add(f"k{n % 5}", n, at if n % 2 else None)
    expected = {f"k{n % 5}": (f"k{n % 5}", n, at if n % 2 else None) for n in range(30)}
    for reader in (mine, other, notes()):
        assert {r[0]: r for r in reader.rows()} == expected and reader.get("k4") == {"k": "k4", "n": 29, "at": at}
    assert notes().get("none") is None and notes().table().count() == 5
    assert len([f for f in os.listdir(tmp_path / "log") if not f.startswith(".")]) < 12
    threads = [threading.Thread(target=lambda k=k: [notes().add(f"t{k}", n, None) for n in range(5)]) for k in range(4)]
    [t.start() for t in threads] and [t.join() for t in threads]
    assert {r[0]: r[1] for r in notes().rows() if r[0][0] == "t"} == {f"t{k}": 4 for k in range(4)}


def test_state_and_log_cost_no_jobs(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    store.run([target(spark, [row(1, 1, 1)])])
    spark.sparkContext.setJobGroup("notes", "notes")
    store.notes["dataset_state"].get("aaaa-0001"), store.manifest("aaaa_0001"), store.mark("x", None, None, "r", "h")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("notes") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def paged(spark, rows, size, calls, broken=None):
    """A target whose deltas come in groups of two pages, and fail at a page."""
    rows = sorted(rows, key=lambda r: (r[":updated_at"], r[":id"]))

    def above(mark, after):
        key = mark and (mark.isoformat(timespec="milliseconds"), after or "~")
        return [r for r in rows if key is None or (r[":updated_at"], r[":id"]) > key]

    def frame(some):
        made = [(json.dumps(r), k // size, k % size) for k, r in enumerate(some)]
        return portal.parsed(spark.createDataFrame(made, "value string, page int, pos int"))

    def group(mark, after):
        some = above(mark, after)[: 2 * size]
        for k in range(0, len(some), size):
            if broken is not None and len(calls) >= broken:
                raise RuntimeError("page is gone")
            calls.append([r[":id"] for r in some[k : k + size]])
        return frame(some)

    return load.Target("aaaa-0001", "aaaa_0001", [("score", "number")], lambda mark: frame(above(mark, None)), checkpoint_every_n_pages=2, group=group)


def test_a_load_goes_on_behind_its_last_group(spark, tmp_path):
    store, calls = load.Store(spark, str(tmp_path), buckets=3), []
    rows = [row(0, 0, 0)] + [row(k, 1 + k // 5, k) for k in range(1, 13)]  # five rows to a mark: groups of four end within one
    store.run([target(spark, rows[:1])])
    failed = store.run([paged(spark, rows, 2, calls, broken=5)]).first()
    assert failed["status"] == "failed" and len(calls) == 5
    assert store.state().first()["hwm_updated_at"] == dt.datetime(2024, 1, 1, 0, 2) and len(table_of(store)) == 9
    calls.clear()
    left = {f"r{k}" for k in range(13)} - set(table_of(store))
    done = store.run([paged(spark, rows, 2, calls)]).first()
    assert (done["status"], done["rows_written"]) == ("ok", 4)
    assert len(calls) == 2 and set(sum(calls, [])) == left  # the pages that were left, none twice
    assert table_of(store) == {f"r{k}": k for k in range(13)}
    assert store.state().first()["hwm_id"] is None


def stream(store, folder, pages, check, late="merge", per_batch=1):
    made = hwm.landed_stream(store.spark, str(pages), per_batch)
    hwm.start(made, store, "aaaa-0001", "aaaa_0001", [("score", "number")], str(folder / check), late=late).awaitTermination()


def land(pages, name, rows):
    pages.mkdir(exist_ok=True)
    (pages / name).write_text(json.dumps(rows))


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    store, pages = load.Store(spark, str(tmp_path / "store"), buckets=3), tmp_path / "pages"
    land(pages, "1.json", [row(0, 0, 0), row(1, 1, 1)])
    stream(store, tmp_path, pages, "check-1")
    land(pages, "2.json", [row(1, 5, 5), row(2, 6, 6)])
    stream(store, tmp_path, pages, "check-2")
    assert table_of(store) == {"r0": 0, "r1": 5, "r2": 6}


@pytest.mark.parametrize("late, kept", [("merge", {"r1": 1, "r2": 2, "r3": 3, "r4": 4, "r0": 0}), ("inclusive", {"r1": 1, "r2": 2, "r3": 3, "r4": 4}), ("drop", {"r1": 1, "r2": 2, "r4": 4})])
def test_ties_between_batches(spark, tmp_path, late, kept):
    store, pages = load.Store(spark, str(tmp_path / "store"), buckets=3), tmp_path / "pages"
    for k, page in enumerate([[row(1, 1, 1), row(2, 2, 2)], [row(3, 2, 3)], [row(4, 3, 4)], [row(0, 0, 0), row(4, 2, -1)]]):
        land(pages, f"{k}.json", page)
        stream(store, tmp_path, pages, "check", late)
    assert table_of(store) == kept
    assert store.state().first()["hwm_updated_at"] == dt.datetime(2024, 1, 1, 0, 3)


def test_a_batch_that_was_published_is_not_merged_again(spark, tmp_path):
    store = load.Store(spark, str(tmp_path), buckets=3)
    apply = hwm.apply_batch(store, "aaaa-0001", "aaaa_0001", [("score", "number")], schema.SYSTEM_UPDATED, "q")
    batch = lambda *rows: portal.parsed(spark.createDataFrame([(json.dumps(r), 0, k) for k, r in enumerate(rows)], "value string, page int, pos int"))
    apply(batch(row(0, 0, 0), row(1, 1, 1)), 0)
    mark, store.mark = store.mark, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError, match="crash"):
        apply(batch(row(1, 3, 3)), 1)
    store.mark, live = mark, store.live("aaaa_0001")
    for _ in range(2):
        apply(batch(row(1, 3, 3)), 1)
        assert store.live("aaaa_0001") == live and table_of(store) == {"r0": 0, "r1": 3}
        assert store.state().first()["hwm_updated_at"] == dt.datetime(2024, 1, 1, 0, 3)
    with pytest.raises(ValueError, match="late"):
        hwm.apply_batch(store, "a", "a", [], "h", "q", "never")


def test_running_marks_of_many_chunks(spark):
    rows = spark.range(200).select((F.col("id") % 67).alias("page"), F.timestamp_seconds(F.col("id") * 7919 % 1000).cast("timestamp_ntz").alias("at"))
    one = load.page_marks(rows, "at", F.col("page"), 3).collect()
    assert sorted(one) == sorted(load.page_marks(rows, "at", F.col("page"), 3, chunk=5).collect()) and len(one) == 23
    top = {}
    for r in rows.collect():
        top[r["page"]] = max(top.get(r["page"], r["at"]), r["at"])
    assert {r["page"]: r["hwm"] for r in one} == {p: max(top[q] for q in range(p + 1)) for p in range(0, 67, 3)}


def test_large_files_are_hashed_by_ranges(spark, tmp_path):
    """A sparse file above the two GB that a row can hold, and small ones that tell each byte."""
    import hashlib

    (tmp_path / "d").mkdir()
    size = (2 << 30) + 12_345
    with open(tmp_path / "d/big.parquet", "wb") as f:
        f.truncate(size)
    (tmp_path / "d/small.parquet").write_bytes(b"abc" * 40)
    found = {r["name"]: (r["size_bytes"], r["sha256"]) for r in snapshot.file_hashes(spark, str(tmp_path / "d")).collect()}
    whole, rest = hashlib.sha256(bytes(snapshot.RANGE)).hexdigest(), hashlib.sha256(bytes(size % snapshot.RANGE)).hexdigest()
    lines = [whole] * (size // snapshot.RANGE) + [rest]
    assert found == {"big.parquet": (size, hashlib.sha256("\n".join(lines).encode()).hexdigest()), "small.parquet": (120, hashlib.sha256(b"abc" * 40).hexdigest())}
    ranged = lambda: {r["name"]: r["sha256"] for r in snapshot.file_hashes(spark, str(tmp_path / "e"), 7).collect()}
    (tmp_path / "e").mkdir()
    seen = set()
    for k in range(0, 50, 3):
        (tmp_path / "e/x.parquet").write_bytes(bytes(j == k for j in range(50)))
        seen.add(ranged()["x.parquet"])
    assert len(seen) == 17


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_rows_are_parsed_once_where_they_are_split(spark):
    v = spark.createDataFrame([('{"n": 1}',), ('{"n": "x"}',), ('{"n": "2"}',)], "value string").select(F.parse_json("value").alias("v"))
    good, bad = schema.split(v, [("n", "number")])
    assert parses(good) == parses(bad) == 1
    assert sorted(r["n"] for r in good.collect()) == [1.0, 2.0] and [r["bad_columns"] for r in bad.collect()] == [["n"]]
    assert sorted((r["n"] or 0, r["bad_columns"]) for r in schema.marked(v, [("n", "number")]).collect()) == [(0, ["n"]), (1.0, []), (2.0, [])]


def test_rows_above_the_mark_are_parsed_once(spark, tmp_path):
    rows = [json.dumps({":id": str(k), ":updated_at": f"2024-01-{k:02d}T00:00:00.000", "n": k}) for k in range(1, 5)]
    v = spark.createDataFrame([(r,) for r in rows], "value string").select(F.parse_json("value").alias("v"))
    target = load.Target("d", "t", [("n", "number")], lambda mark: v)
    typed = load.Store(spark, str(tmp_path / "store"))._typed(target, v, target.columns, target.hwm_column, newer=load.above(dt.datetime(2024, 1, 2), load.HWM))
    assert parses(typed) == 1 and sorted(r["n"] for r in typed.collect()) == [3.0, 4.0]


def test_a_catalog_is_asked_for_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def entry(k):
        asked.add(1)
        return (f"id{k:03d}", f"name {k}")

    entries = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 4).map(entry), "id string, name string")
    store = load.Store(spark, str(tmp_path / "store"))
    assert store.replace_catalog(entries, load.new_run_id()) == 100 and asked.value == 100
    assert [r["id"] for r in store.read_in_order().collect()] == [f"id{k:03d}" for k in range(100)]
    assert not [n for n in store.folder.names("catalog") if n.startswith("delta=")]
    reader = portal.CatalogReader({"portal": "p", "pageSize": "10"}, lambda url: (200, '{"resultSetSize": 1001, "results": []}'))
    assert [(p.first, p.last) for p in reader.partitions()] == [(k, min(k + 10, 101)) for k in range(0, 101, 10)]
