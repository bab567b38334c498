"""A recorded portal: its answers from landed files, so that a load can be run again without the network.

Rows are landed in ranges of their ids, `ROWS` at most in a file, a line each: a JSON array of its id and mark, a tab,
and the row's JSON. A fetch function made over them answers the addresses of portal_rows, portal_catalog and a
dataset's metadata. Of filters it knows those on ids and on one more field above a value; other filters get status 400.
Of each file the driver keeps the first id, the greatest mark and the rows, so a page opens only the files that its
rows are in, however many there are, and parses only rows that a filter on another field must see.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections.abc import Callable, Sequence
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABOVE = re.compile(r"(:?\w+) (>|<=) '((?:[^']|'')*)'")
#: Rows of a file at most, and the field whose greatest value is kept of each file.
ROWS, MARK = 5000, ":updated_at"


def opened(path: str):
    """A file on the executors' side, as bytes."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    return (lambda found: found[0].open_input_file(found[1]))(fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1)))


@functools.lru_cache(maxsize=2)
def lines(path: str) -> list[str]:
    """A file's lines; pages that follow each other are mostly in one file, so the last two are held."""
    with opened(path) as f:
        return f.read().decode().removesuffix("\n").split("\n")


def id_of(line: str) -> str:
    return json.loads(line.partition("\t")[0])[0]


class Recorded(list):
    """(first id, path, rows) of each file, and their greatest marks."""

    def __init__(self, files: Sequence[tuple[str, str, int]], tops: Sequence[str | None]) -> None:
        super().__init__(files)
        self.tops = list(tops)


def record(rows: DataFrame, folder: str, record_id: str = ":id", files: int | None = None) -> Recorded:
    """Lands VARIANT rows v in the order of their ids, in `files` ranges or as many as shuffles have."""
    at = lambda name: F.try_variant_get("v", f"$['{name}']" if not name.startswith("$") else name, "string")
    kept = rows.select(at(record_id).alias("id"), "v")
    ranged = kept.repartitionByRange(files, "id") if files else kept.repartitionByRange("id")  # which goes over the rows twice: texts are made behind it
    line = F.concat(F.to_json(F.array("id", at(MARK))), F.lit("\t"), F.to_json("v")).alias("value")
    ranged.sortWithinPartitions("id").select(line).write.option("maxRecordsPerFile", ROWS).text(folder)
    head = F.from_json(F.substring_index("value", "\t", 1), "array<string>").alias("head")
    read = rows.sparkSession.read.text(folder).select(head, F.col("_metadata.file_path").alias("path"))
    each = read.groupBy("path").agg(F.min(F.col("head")[0]).alias("first"), F.count("*").alias("n"), F.max(F.col("head")[1]).alias("top"))
    found = each.orderBy("first", "path").collect()  # a row a file
    return Recorded([(r["first"], r["path"], r["n"]) for r in found], [r["top"] for r in found])


def player(recorded: Recorded, columns: Sequence[tuple[str, str]]) -> Callable[[str], tuple[int, str]]:
    """fetch(url) over recorded rows, which are all datasets' rows, and the catalog's entries."""
    firsts, counts, tops = [r[0] for r in recorded], [r[2] for r in recorded], recorded.tops
    folder = recorded[0][1].rpartition("/")[0] if recorded else ""
    names = [r[1].rpartition("/")[2] for r in recorded]  # all in one folder

    def page(low: str | None, high: str | None, offset: int, size: int, above: Sequence[tuple[str, str, str]] = ()) -> str:
        found: list[str] = []
        begin = 0 if low is None else max(0, bisect.bisect_left(firsts, low) - 1)
        for k in range(begin, len(names) if high is None else bisect.bisect_right(firsts, high)):
            if any(name == MARK and sign == ">" and (tops[k] is None or tops[k] <= v) for name, sign, v in above):
                continue
            whole = (low is None or firsts[k] > low) and (high is None or k + 1 < len(firsts) and firsts[k + 1] <= high)
            if whole and not above and offset >= counts[k]:
                offset -= counts[k]
                continue
            rows = lines(f"{folder}/{names[k]}")
            first = 0 if low is None else bisect.bisect_right(rows, low, key=id_of)
            last = len(rows) if high is None else bisect.bisect_right(rows, high, key=id_of)
            if above:
                kept = lambda r: all((r[name] > v) if sign == ">" else (r[name] <= v) for name, sign, v in above)
                rows = [line for line in rows[first:last] if kept(json.loads(line.partition("\t")[2]))]
                first, last = 0, len(rows)
            found += [line.partition("\t")[2] for line in rows[min(first + offset, last) : min(first + offset + size - len(found), last)]]
            offset = max(0, offset - (last - first))
            if len(found) == size:
                break
        return f"[{','.join(found)}]"

    def fetch(url: str) -> tuple[int, str]:
        parts = urlparse(url)
        asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if parts.path.startswith("/api/views/"):
            return 200, json.dumps({"columns": [{"fieldName": name, "dataTypeName": kind} for name, kind in columns]})
        if parts.path.startswith("/api/catalog/"):
            return 200, f'{{"resultSetSize": {sum(counts)}, "results": {page(None, None, int(asked["offset"]), int(asked["limit"]))}}}'
        where, size, offset = asked.get("$where", ""), int(asked["$limit"]), int(asked["$offset"])
        if asked["$order"] != ":id" or ABOVE.sub("", where).replace("AND", "").strip("() "):
            return 400, "not recorded"
        limits = [(name, sign, value.replace("''", "'")) for name, sign, value in ABOVE.findall(where)]
        low = max((v for name, sign, v in limits if name == ":id" and sign == ">"), default=None)
        high = min((v for name, sign, v in limits if name == ":id" and sign == "<="), default=None)
        return 200, page(low, high, offset, size, [c for c in limits if c[0] != ":id"])

    return fetch
