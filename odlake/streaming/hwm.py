"""The incremental loop as a stream: pages in, a keyed merge and a mark out, once per micro-batch.

At-least-once delivery and an idempotent merge by key give each row its effect exactly once; a batch that was
published before a crash is recognised by its version, which names the streaming query (by the id in its
checkpoint) and the batch. Of rows of one key the greatest mark wins, so rows may come in any order and none is
lost: neither one that ties with the mark of an earlier batch, nor a late one. Late rows can be dropped instead.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from odlake.functions.coerce import lenient_timestamp
from odlake.operators.load import HWM, Store, above
from odlake.plans import schema
from odlake.sources.folder import Folder

#: What becomes of rows that are not above the mark: merged all the same; only those at it; or none.
LATE = ("merge", "inclusive", "drop")


def landed_stream(spark: SparkSession, folder: str, pages_per_batch: int = 10) -> DataFrame:
    """page, pos, v of page files as they land."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", pages_per_batch).load(folder)
    array = F.variant_get(F.parse_json("value"), "$", "array<variant>")
    return files.select(F.col("_metadata.file_name").alias("page"), F.posexplode(array).alias("pos", "v"))


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the streaming query of a checkpoint folder."""
    return json.loads(Folder(spark, checkpoint).read("metadata").strip().split("\n")[-1])["id"]


def apply_batch(store: Store, dataset_id: str, table: str, columns: Sequence[tuple[str, str]], hwm_column: str, source: str | Callable[[], str], late: str = "merge") -> Callable[[DataFrame, int], None]:
    """The function of a micro-batch: typed rows are merged into a new version, then the mark is stored. source: an id of where batches come from."""
    if late not in LATE:
        raise ValueError(f"late is one of {', '.join(LATE)}")

    def apply(batch: DataFrame, batch_id: int) -> None:
        version = f"{source if isinstance(source, str) else source()}-{batch_id:012d}"
        state = store.notes["dataset_state"].get(dataset_id) or {}
        mark = state.get("hwm_updated_at")
        if published := store.manifest(table, version):  # before a crash, with its mark noted or not
            seen = published["mark"] and dt.datetime.fromisoformat(published["mark"])
        else:
            text = F.try_variant_get("v", f"$['{hwm_column}']", "string")
            rows = schema.typed(batch.withColumn(HWM, lenient_timestamp(text)), columns, keyed=True, keep=("page", "pos", HWM))
            made = store.merge(table, rows if late == "merge" else rows.where(above(mark, HWM, None, late == "inclusive")), version)
            seen = made.mark
            if not made.rows:
                return
        if state.get("last_run_id") != version:
            store.mark(dataset_id, max(filter(None, (mark, seen)), default=None), state.get("last_full_replace_at"), version, hwm_column)

    return apply


def start(pages: DataFrame, store: Store, dataset_id: str, table: str, columns: Sequence[tuple[str, str]], checkpoint: str, hwm_column: str = schema.SYSTEM_UPDATED, once: bool = True, late: str = "merge") -> StreamingQuery:
    """Runs until what has landed is merged (once), or on."""
    source = lambda: query_id(pages.sparkSession, checkpoint)
    writer = pages.writeStream.foreachBatch(apply_batch(store, dataset_id, table, columns, hwm_column, source, late)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
