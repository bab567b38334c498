"""Pages on their way to the store: as whole batches from the portal, and landed without a detour."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from odlake import queries
from odlake.operators.load import Store
from odlake.sources.portal import RAW, RowsReader, sources
from odlake.streaming import hwm


def test_a_page_of_rows_is_one_batch(spark):
    def fetch(url: str) -> tuple[int, str]:
        low = int(url.partition("%3E+%27")[2][:2] or 10)
        return 200, json.dumps([{":id": str(k), "n": "é"} for k in range(low + 1, min(low + 3, 16))] if "%24select=%3Aid" not in url else [])

    options, kind = {"portal": "p", "dataset": "d", "systemFields": "true", "pageSize": "2"}, StructType.fromDDL(RAW)
    reader, plain = sources(fetch)[0](options).reader(kind), RowsReader(options, fetch, kind)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert all(isinstance(b, pa.RecordBatch) for b in batches) and [b.num_rows for b in batches] == [2, 2, 1]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == list(plain.read(part))


def test_landed_pages_are_made_of_texts_as_they_are(spark, tmp_path):
    events = "/root/testdata/sf0.001"
    texts, rows = queries.event_texts(spark, events), queries.event_rows(spark, events)
    assert sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in texts.collect()) == sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in rows.select(F.to_json("v")).collect())
    queries.land(spark, events, str(tmp_path / "pages"), 100)
    landed = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "pages"), wholetext=True).collect()]
    assert len(landed) == 10 and all(len(p) == 100 for p in landed) and {r[":id"] for p in landed for r in p} == {str(k) for k in range(1000)}


def test_a_first_batch_is_written_once(spark, tmp_path, monkeypatch):
    store, removed = Store(spark, str(tmp_path / "store"), 3), []
    monkeypatch.setattr(store.folder, "remove", lambda path, remove=store.folder.remove: (removed.append(path), remove(path))[1])
    merge = hwm.apply_batch(store, "d", "t", [("n", "number")], ":updated_at", "s")
    page = lambda n, at, *ids: spark.createDataFrame([(json.dumps({":id": k, ":updated_at": f"2024-01-0{at}T00:00:00.000", "n": n}), i) for i, k in enumerate(ids)], "j string, pos int").select(F.lit("p").alias("page"), "pos", F.parse_json("j").alias("v"))
    table = lambda: sorted((r["record_id"], r["n"]) for r in store.read("t").collect())
    merge(page(1, 1, "a", "b", "a"), 0)
    assert table() == [("a", 1.0), ("b", 1.0)] and not any("delta=" in path for path in removed)
    merge(page(2, 2, "b", "c"), 1)
    assert table() == [("a", 1.0), ("b", 2.0), ("c", 2.0)] and any("delta=" in path for path in removed)
    assert not [n for n in store.folder.names("t") if n.startswith("delta=")]
