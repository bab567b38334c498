from __future__ import annotations

import json

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.local.dir", str(folder / "local"))
        .config("spark.checkpoint.dir", str(folder / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def portal(tmp_path):
    """fetch, put(rows), folder, asked(): a portal of one dataset that answers filters by SQLite. Files in its folder make pages from an offset of rows on (`broken`) fail; asked gives the queries so far."""
    folder = str(tmp_path)

    def fetch(url):
        import json
        import os
        import sqlite3
        from urllib.parse import parse_qs, urlparse

        asked = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
        with open(f"{folder}/asked.{os.getpid()}", "a") as f:
            f.write(json.dumps(asked | {"pid": os.getpid()}) + "\n")
        if "/api/views/" in url:
            return 200, json.dumps({"columns": [{"fieldName": "name", "dataTypeName": "text"}, {"fieldName": "score", "dataTypeName": "number"}, {"fieldName": ":@computed", "dataTypeName": "number"}]})
        with open(f"{folder}/rows.json") as f:
            rows = json.load(f)
        plain = lambda text: text.replace(":id", "_id").replace(":updated_at", "_at")
        table = sqlite3.connect(":memory:")
        table.execute("CREATE TABLE t (k, _id TEXT, _at TEXT, name TEXT, score REAL)")
        table.executemany("INSERT INTO t VALUES (?,?,?,?,?)", [(k, r[":id"], r[":updated_at"], r["name"], r["score"]) for k, r in enumerate(rows)])
        where, order = plain(asked.get("$where", "1")), plain(asked["$order"])
        found = [rows[k] for (k,) in table.execute(f"SELECT k FROM t WHERE {where} ORDER BY {order} LIMIT {asked['$limit']} OFFSET {asked['$offset']}")]
        if os.path.exists(f"{folder}/broken") and any(r["name"] == open(f"{folder}/broken").read() for r in found) and "$select" in asked and "*" in asked["$select"]:
            return 404, "gone"
        return 200, json.dumps(found)

    def put(rows):
        (tmp_path / "rows.json").write_text(json.dumps([{":id": i, ":updated_at": f"2024-01-{d:02d}T00:00:00.000", "name": n, "score": s} for i, d, n, s in rows]))

    def asked():
        return [json.loads(line) for f in sorted(tmp_path.glob("asked.*")) for line in f.read_text().splitlines()]

    return fetch, put, tmp_path, asked
