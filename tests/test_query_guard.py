"""User SQL: what is refused and what is let through, whatever its text looks like; results of any columns."""

import threading

import pytest

from odlake.operators import query

CALL = "reflect('java.lang.System','setProperty','zz','{}')"
REFUSED = [
    r"SELECT r'\', " + CALL + " AS x, ''",
    "SELECT /* /* */ ' */ " + CALL + " AS x -- '",
    "SELECT system.builtin." + CALL,
    "SELECT (SELECT " + CALL + ")",
    "WITH a AS (SELECT " + CALL + " AS x) SELECT 1",
    "SELECT * FROM VALUES (" + CALL + ") AS t(x)",
    "SELECT * FROM range(length(" + CALL + "))",
    "SELECT id FROM range(3) ORDER BY " + CALL,
    "SELECT transform(array(1), x -> try_reflect('java.lang.System','setProperty','zz','{}'))",
    "SELECT sum(id) OVER (PARTITION BY " + CALL + ") FROM range(2)",
    "SELECT id FROM range(2) WHERE EXISTS (SELECT 1 FROM range(1) WHERE java_method('java.lang.System','setProperty','zz','{}') IS NULL)",
    "EXPLAIN EXTENDED SELECT " + CALL,
    "FROM range(2) |> SELECT " + CALL,
    "SELECT `REFLECT`('java.lang.System','setProperty','zz','{}')",
    "SELECT TRANSFORM(id) USING 'cat' AS (x STRING) FROM range(2)",
    "SELECT IDENTIFIER('re' || 'flect')('java.lang.System','setProperty','zz','{}')",
    "BEGIN SELECT 1; END",
    "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a",
    "CACHE TABLE t AS SELECT 1",
    "EXPLAIN DROP TABLE t",
    "SET x = 1",
]


@pytest.mark.parametrize("k", range(len(REFUSED)))
def test_refused(spark, k):
    sql = REFUSED[k].replace("{}", str(k))
    with pytest.raises(PermissionError, match="read-only"):
        query.run(spark, sql)
    assert spark._jvm.java.lang.System.getProperty("zz") is None


def test_a_view_that_calls_code_is_refused(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW calling AS SELECT " + CALL.format("v") + " AS x")
    with pytest.raises(PermissionError, match="read-only"):
        query.run(spark, "SELECT * FROM calling")
    assert spark._jvm.java.lang.System.getProperty("zz") is None
    spark.catalog.dropTempView("calling")


LET_THROUGH = ["SELECT 'reflect(1)' AS s", "SELECT 1 AS reflect", "SELECT reflect FROM VALUES (1) AS t(reflect)", "SELECT /* reflect('a') */ 1", "SELECT r'\\reflect(' AS s", "SHOW SCHEMAS", "SHOW FUNCTIONS LIKE 'abs'", "EXPLAIN SELECT 1", "DESCRIBE FUNCTION abs"]


@pytest.mark.parametrize("sql", LET_THROUGH)
def test_let_through(spark, sql):
    assert query.run(spark, sql).rows


def test_columns_of_one_name_and_of_any_name(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW north AS SELECT id, id * 2 AS n FROM range(3)")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW south AS SELECT id, id * 3 AS n FROM range(1, 3)")
    got = query.run(spark, "SELECT * FROM north a JOIN south b ON a.id = b.id ORDER BY a.id")
    assert got.columns == ["id", "n", "id", "n"] and got.rows == [(1, 2, 1, 3), (2, 4, 2, 6)]
    got = query.run(spark, "SELECT 1 AS a, 2 AS a, 3 AS `b``c`, 4 AS `d.e`, 5 AS __n")
    assert got.columns == ["a", "a", "b`c", "d.e", "__n"] and got.rows == [(1, 2, 3, 4, 5)]
    assert query.run(spark, "SELECT * FROM range(2000) a JOIN range(2000) b ON a.id = b.id").truncated
    for view in ("north", "south"):
        spark.catalog.dropTempView(view)


def test_no_setting_of_the_caller_changes(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t"))
    seen, done = [], threading.Event()

    def watch():
        while not done.is_set():
            seen.append(spark.conf.get("spark.sql.runSQLOnFiles"))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        for _ in range(3):
            with pytest.raises(Exception, match="(?i)not_found|cannot be found"):
                query.run(spark, f"SELECT * FROM parquet.`{tmp_path}/t`")
            assert query.run(spark, "SELECT count(*) FROM range(5)").rows == [(5,)]
    finally:
        done.set()
        watcher.join()
    assert set(seen) == {"true"}


def test_two_queries_at_a_time(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t"))
    refused = []

    def ask():
        for _ in range(4):
            try:
                query.run(spark, f"SELECT * FROM parquet.`{tmp_path}/t`")
            except Exception:
                refused.append(1)
            query.run(spark, "SELECT 1")

    threads = [threading.Thread(target=ask) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(refused) == 12
