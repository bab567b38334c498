"""A fake portal, from its metadata and pages to the store: bootstrap, failure at a page, resume, delta, dry run."""

from odlake.operators import load, portal_load, select

def plan(spark, **settings):
    given = {"id": "aaaa-0001", "batch_size": 2} | settings
    overrides = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'string' if k == 'id' else select.SETTINGS[k]}" for k in given))
    return select.hashed(select.effective(spark.createDataFrame([("aaaa-0001",)], "id string"), overrides))


def test_bootstrap_failure_resume_delta(spark, portal):
    fetch, put, folder, asked = portal
    store, settings = load.Store(spark, str(folder / "store")), plan(spark, where="score > 0")
    run = lambda: store.run(portal_load.targets(spark, settings, "p.example", fetch, {"wait": "0"})).first()
    table = lambda: sorted((r["record_id"], r["name"], r["score"]) for r in store.read("aaaa_0001").collect())
    put([("r1", 1, "a", "1"), ("r2", 2, "b", "2"), ("r3", 3, "c", "3"), ("r4", 3, "d", "-1")])
    assert portal_load.dry_run(settings, store).first().asDict() == {"dataset_id": "aaaa-0001", "table": "aaaa_0001", "action": "bootstrap", "mark": None}
    (folder / "broken").write_text("c")
    assert run()["status"] == "failed" and store.read("aaaa_0001") is None
    (folder / "broken").unlink()
    log = run()
    assert (log["status"], log["rows_written"], log["error"]) == ("ok", 3, None) and log["config_hash"]
    assert table() == [("r1", "a", 1.0), ("r2", "b", 2.0), ("r3", "c", 3.0)]
    put([("r1", 1, "unseen", "9"), ("r2", 5, "B", "2"), ("r3", 3, "c", "3"), ("r5", 6, "e", "5"), ("r6", 7, "f", "6")])
    (folder / "broken").write_text("f")
    assert run()["status"] == "failed" and len(table()) == 3
    (folder / "broken").unlink()
    planned = portal_load.dry_run(settings, store).first()
    assert planned["action"] == "delta" and planned["mark"].day == 3
    assert run()["rows_written"] == 3
    assert table() == [("r1", "a", 1.0), ("r2", "B", 2.0), ("r3", "c", 3.0), ("r5", "e", 5.0), ("r6", "f", 6.0)]
    portal_load.write_json(store.read("aaaa_0001"), str(folder / "out"), "record_id")
    assert [r["record_id"] for r in spark.read.json(str(folder / "out")).orderBy("record_id").collect()] == ["r1", "r2", "r3", "r5", "r6"]


def test_a_limit_takes_the_oldest_rows_first(spark, portal):
    fetch, put, folder, asked = portal
    store, settings = load.Store(spark, str(folder / "store")), plan(spark, limit=2, skip_columns=["score"])
    put([("r1", 4, "a", "1"), ("r2", 2, "b", "2"), ("r3", 3, "c", "3")])
    for n in (2, 1):
        assert store.run(portal_load.targets(spark, settings, "p.example", fetch, {"wait": "0"})).first()["rows_written"] == n
    assert sorted(r["name"] for r in store.read("aaaa_0001").collect()) == ["a", "b", "c"]
    assert "score" not in store.read("aaaa_0001").columns


def test_a_dry_run_says_what_a_run_does(spark, portal):
    fetch, put, folder, asked = portal
    store, settings = load.Store(spark, str(folder / "store")), plan(spark)
    put([("r1", 1, "a", "1")])
    told = lambda: (lambda r: (r["action"], r["mark"] and r["mark"].day))(portal_load.dry_run(settings, store).first())
    assert told() == ("bootstrap", None)
    store.mark("aaaa-0001", load.dt.datetime(2024, 1, 5), None, "r", ":updated_at")  # a state, but no table
    assert told() == ("bootstrap", None)
    store.publish("aaaa_0001", spark.range(3), "1")  # a table, but without records' ids
    assert told() == ("bootstrap", None)
    store.run(portal_load.targets(spark, settings, "p.example", fetch, {"wait": "0"}))
    assert told() == ("delta", 1)
    assert portal_load.dry_run(plan(spark, mode="full_replace"), store).first()["action"] == "full_replace"


def test_a_load_goes_on_at_its_last_checkpoint(spark, portal):
    """Ties at every end of a group; a failure at a page; the pages behind the last mark are asked for, and no others."""
    fetch, put, folder, asked = portal
    store, settings = load.Store(spark, str(folder / "store")), plan(spark, checkpoint_every_n_pages=2)
    run = lambda: store.run(portal_load.targets(spark, settings, "p.example", fetch, {"wait": "0"})).first()
    put([("r00", 1, "n0", "0")])
    assert run()["rows_written"] == 1
    put([(f"r{k:02d}", 1 + (k + 4) // 5, f"n{k}", str(k)) for k in range(13)])
    (folder / "broken").write_text("n9")  # on the fifth page
    assert run()["status"] == "failed"
    table = lambda: sorted(r["record_id"] for r in store.read("aaaa_0001").collect())
    assert table() == [f"r{k:02d}" for k in range(9)]
    state = store.notes["dataset_state"].get("aaaa-0001")
    assert (state["hwm_updated_at"].day, state["hwm_id"]) == (3, "r08")
    (folder / "broken").unlink()
    pages = lambda: len([a for a in asked() if a.get("$limit") == "2"])
    before = pages()
    assert run()["rows_written"] == 4 and table() == [f"r{k:02d}" for k in range(13)]
    assert pages() - before == 3  # two pages of the four rows left, and one that shows that there are no more
    state = store.notes["dataset_state"].get("aaaa-0001")
    assert (state["hwm_updated_at"].day, state["hwm_id"]) == (4, None)
    assert run()["rows_written"] == 0


def test_a_dataset_is_read_by_many_tasks(spark, portal):
    """1,000 pages: ranges of ids, a task each, no deep offset."""
    fetch, put, folder, asked = portal
    store, settings = load.Store(spark, str(folder / "store"), buckets=2), plan(spark, batch_size=3)
    put([(f"r{(k * 7919) % 10007:05d}", 1 + k % 28, f"n{k}", str(k)) for k in range(3000)])
    targets = portal_load.targets(spark, settings, "p.example", fetch, {"wait": "0", "pagesPerTask": "250"})
    pages = targets[0].rows(None)
    assert pages.rdd.getNumPartitions() == 5
    assert store.run(targets).first()["rows_written"] == 3000
    assert store.read("aaaa_0001").select("record_id").distinct().count() == 3000
    reads = [a for a in asked() if a.get("$limit") == "3"]
    assert len(reads) >= 1000 and {a["$offset"] for a in reads} == {"0"}
    assert max(int(a["$offset"]) for a in asked() if "$offset" in a) < 750


def test_the_filter_doubles_apostrophes_and_keeps_the_users_condition():
    assert portal_load.newer_than(None, ":updated_at") == ""
    assert portal_load.newer_than(None, ":updated_at", "a = 'it''s'") == "(a = 'it''s')"
    mark = load.dt.datetime(2024, 1, 2)
    assert portal_load.newer_than(mark, "t", "a OR b", True) == "(t >= '2024-01-02T00:00:00.000') AND (a OR b)"
