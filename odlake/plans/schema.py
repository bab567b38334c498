"""Table schemas, resolved at run time from a dataset's column metadata."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odlake.functions import coerce

RECORD_ID, SYSTEM_ID, SYSTEM_UPDATED = "record_id", ":id", ":updated_at"
#: Source type names by what they become; all others are text.
TYPES = {
    "double": ("number", "percent", "money"),
    "timestamp_ntz": ("calendar_date", "date"),
    "boolean": ("checkbox",),
    "json": ("json", "polygon", "multipolygon", "line", "multiline", "multipoint"),
    "point": ("point", "location"),
}
_KIND = {name: kind for kind, names in TYPES.items() for name in names}
_COERCE = {"double": coerce.to_double, "timestamp_ntz": coerce.to_timestamp, "boolean": coerce.to_boolean, "json": coerce.to_json_text, "string": coerce.to_text}


def kind_of(source_type: str) -> str:
    return _KIND.get(source_type, "string")


def kind_column(source_type: Column) -> Column:
    """kind_of as an expression, for metadata in a table."""
    kinds = F.create_map(*(F.lit(x) for pair in _KIND.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, source_type), F.lit("string"))


def usable(columns: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """columns (field_name, data_type_name, pos) without computed, unnamed and skipped ones."""
    name = F.col("field_name")
    kept = columns.where(name.isNotNull() & (name != "") & ~name.startswith(":@"))
    return kept.where(~name.isin(list(skip))) if skip else kept


def build(rows: DataFrame, columns: Iterable[tuple[str, str]], row: str = "v", keyed: bool = False) -> tuple[DataFrame, dict[str, coerce.Coerced]]:
    """rows with each field at hand, and target column -> typed value of the VARIANT column `row`; points become longitude, latitude and raw JSON."""
    columns, made = list(columns), {}
    rows, fields = coerce.staged(rows, {name: coerce.field(F.col(row), name) for name in [*([SYSTEM_ID] if keyed else []), *(name for name, _ in columns)]})
    if keyed:
        made[RECORD_ID] = coerce.to_text(fields[SYSTEM_ID])
    for name, source_type in columns:
        value, kind = fields[name], kind_of(source_type)
        if kind == "point":
            made |= {f"{name}_lon": coerce.coordinate(value, 0), f"{name}_lat": coerce.coordinate(value, 1), f"{name}_raw": coerce.to_json_text(value)}
        else:
            made[name] = _COERCE[kind](value)
    return rows, made


def typed(rows: DataFrame, columns: Iterable[tuple[str, str]], row: str = "v", keyed: bool = False, keep: Sequence[str] = (), at: Sequence[str] = ("page", "pos")) -> DataFrame:
    """Strict: any value that cannot be coerced fails the job, naming its place and column."""
    where = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in at if c in rows.columns]
    rows, made = build(rows, columns, row, keyed)
    return rows.select(*keep, *(c.strict(*where, f"column={name}").alias(name) for name, c in made.items()))


def settled(rows: DataFrame) -> DataFrame:
    """rows, counted as they pass: conditions on their columns stay behind this place. Spark would move them before it, and there make each column anew at each mention."""
    return rows.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def marked(rows: DataFrame, columns: Iterable[tuple[str, str]], row: str = "v", keyed: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Permissive, in one pass: every row's typed values, null where they are bad, and bad_columns, the names of those."""
    rows, made = build(rows, columns, row, keyed)
    return rows.select(*keep, *(c.value.alias(name) for name, c in made.items()), _bad_columns(made))


def _bad_columns(made: dict[str, coerce.Coerced]) -> Column:
    return F.array_compact(F.array(*(F.when(c.bad, name) for name, c in made.items()))).alias("bad_columns")


def split(rows: DataFrame, columns: Iterable[tuple[str, str]], row: str = "v", keyed: bool = False, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Permissive: typed good rows, and the rows with a bad value with the names of their bad columns."""
    given = rows.columns
    rows, made = build(rows, columns, row, keyed)
    marked = settled(rows.withColumn("bad_columns", _bad_columns(made)))
    good = marked.where(F.size("bad_columns") == 0).select(*keep, *(c.value.alias(name) for name, c in made.items()))
    return good, marked.where(F.size("bad_columns") > 0).select(*given, "bad_columns")


def _normal(type_name: Column) -> Column:
    upper = F.upper(type_name)
    return F.when(upper == "STRING", "VARCHAR").otherwise(upper)


def diff(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """column, change (added, removed, retyped), wanted, live: of two (column, type) tables; the record key is no user column."""
    sides = [d.select("column", _normal(F.col("type")).alias(side)).where(F.col("column") != RECORD_ID) for d, side in ((wanted, "wanted"), (live, "live"))]
    change = F.when(F.col("live").isNull(), "added").when(F.col("wanted").isNull(), "removed").when(F.col("live") != F.col("wanted"), "retyped")
    return sides[0].join(sides[1], "column", "full").withColumn("change", change).where("change is not null").select("column", "change", "wanted", "live")


def drift_message(changes: DataFrame) -> DataFrame:
    """message: one row that lists all changes, or none."""
    one = F.concat_ws(" ", "change", "column", F.when(F.col("change") == "retyped", F.concat_ws("", F.lit("("), "live", F.lit(" -> "), "wanted", F.lit(")"))))
    return changes.agg(F.array_join(F.array_sort(F.collect_list(one)), ", ").alias("message")).where("message <> ''")  # of a table's columns


def live_columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string")
