"""A store's small notes: numbered JSON files, the latest of each key kept, folded into one file now and then.

A note costs a file of some hundred bytes and no Spark job. A reader lists the folder and reads what it has
not seen: the last fold, if it is newer, and the notes behind it. Every `every` notes the state so far is
written as a fold; notes before the fold before it are removed. Numbers are claimed by file name, so a writer
that finds its number taken goes on to the next.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, TimestampNTZType

from odlake.sources.folder import Folder

EVERY = 32


class Notes:
    def __init__(self, spark: SparkSession, folder: Folder, name: str, schema: str, key: Sequence[str], every: int = EVERY) -> None:
        self.spark, self.folder, self.name, self.every = spark, folder, name, every
        self.schema = StructType.fromDDL(schema)
        self.key = [self.schema.names.index(k) for k in key]
        self.times = [k for k, f in enumerate(self.schema) if isinstance(f.dataType, TimestampNTZType)]
        self.at, self.last, self.lock = 0, {}, threading.RLock()

    def _put(self, values: list) -> None:
        for k in self.times:
            values[k] = values[k] and dt.datetime.fromisoformat(values[k])
        key = tuple(values[k] for k in self.key)
        self.last.pop(key, None)  # the latest comes last
        self.last[key] = tuple(values)

    def rows(self) -> list[tuple]:
        """The last note of each key, in the order of writing."""
        with self.lock:
            numbers = {n: int(n.split(".")[0]) for n in self.folder.names(self.name) if n.endswith((".json", ".fold"))}
            fold = max((n for n in numbers if n.endswith(".fold")), default=None)
            if fold and numbers[fold] > self.at:
                self.last = {}
                for values in json.loads(self.folder.read(f"{self.name}/{fold}")):
                    self._put(values)
                self.at = numbers[fold]
            for n in sorted(n for n in numbers if n.endswith(".json") and numbers[n] > self.at):
                self._put(json.loads(self.folder.read(f"{self.name}/{n}")))
                self.at = numbers[n]
            return list(self.last.values())

    def add(self, *values) -> None:
        with self.lock:
            self.rows()
            while not self.folder.write(f"{self.name}/{self.at + 1:012d}.json", self._json(values)):
                self.rows()
            self.rows()
            if self.at % self.every == 0:
                self._fold()

    def _fold(self) -> None:
        self.folder.write(f"{self.name}/{self.at:012d}.fold", self._json(list(self.last.values())))
        for n in self.folder.names(self.name):
            if int(n.split(".")[0]) < self.at - self.every or n.endswith(".json") and int(n.split(".")[0]) <= self.at - self.every:
                self.folder.remove(f"{self.name}/{n}")

    @staticmethod
    def _json(values) -> str:
        return json.dumps(values, default=lambda v: v.isoformat(), ensure_ascii=False)

    def get(self, *key) -> dict | None:
        found = [r for r in self.rows() if tuple(r[k] for k in self.key) == key]
        return dict(zip(self.schema.names, found[0])) if found else None

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows(), self.schema)
