"""Strict typing of untyped JSON values, as Column expressions.

Each function takes a VARIANT value and gives its typed value and whether it cannot be had. Missing
fields, JSON null and (but for text) the empty string are null. Strict mode fails the job with the
page, row and column; permissive mode lets bad rows be split off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal numbers, other accepted number words, and the texts that are booleans.
NUMBER, NUMBER_WORD = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$", r"(?i)^([+-]?(inf|infinity)|nan)$"
INTEGER = r"^[+-]?[0-9]+$"
TRUE, FALSE = ["1", "t", "T", "TRUE", "true", "True"], ["0", "f", "F", "FALSE", "false", "False"]
#: Wall-clock times, instants, and days.
WALL, INSTANT, DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@dataclass(frozen=True)
class Coerced:
    value: Column
    bad: Column
    #: The value where it is not bad, without its tests: what is left to evaluate once they have passed.
    passed: Column | None = None

    def strict(self, *where: Column | str) -> Column:
        message = F.concat_ws(" ", F.lit("cannot coerce:"), *(F.lit(w) if isinstance(w, str) else w for w in where))
        return F.when(self.bad, F.raise_error(message)).otherwise(self.value if self.passed is None else self.passed)


def field(row: Column, name: str) -> Column:
    """A field of a VARIANT object, as VARIANT; null if it is missing."""
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(row, f"$[{quote}{name}{quote}]", "variant")


@dataclass(frozen=True)
class Field:
    """A VARIANT value whose text and kind are at hand as columns, so that they are made once however often they are asked for."""

    value: Column
    text: Column
    kind: Column


def staged(rows: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, dict[str, Field]]:
    """rows with the columns of a Field for each named value, made in steps that each refer to the step before."""
    numbered = [(f"__{k}", name) for k, name in enumerate(values)]
    rows = rows.withColumns({f"{at}_v": values[name] for at, name in numbered})
    rows = rows.withColumns({f"{at}_{part}": made for at, _ in numbered for part, made in (("t", F.try_variant_get(f"{at}_v", "$", "string")), ("s", F.schema_of_variant(f"{at}_v")))})
    rows = rows.withColumns({f"{at}_k": _kind(F.col(f"{at}_v"), F.col(f"{at}_s")) for at, _ in numbered})
    return rows, {name: Field(*(F.col(f"{at}_{part}") for part in "vtk")) for at, name in numbered}


def _parts(v: Column | Field) -> tuple[Column, Column]:
    """The value's text, and its kind: one of text, number, bool, other; null for none."""
    if isinstance(v, Field):
        return v.text, v.kind
    return F.try_variant_get(v, "$", "string"), _kind(v, F.schema_of_variant(v))


def _json(v: Column | Field) -> Column:
    return F.to_json(v.value if isinstance(v, Field) else v)


def _kind(v: Column, kind: Column) -> Column:
    named = F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "bool").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|TINYINT|SMALLINT|INT)"), "number").when(kind == "VOID", None).otherwise("other")
    return F.when(v.isNotNull(), named)


def _given(text: Column, kind: Column) -> Column:
    return kind.isNotNull() & ~((kind == "text") & (text == ""))


def _made(value: Column, text: Column, kind: Column, ok: Column) -> Coerced:
    given = _given(text, kind)
    return Coerced(F.when(given & ok, value), F.coalesce(given & ~F.coalesce(ok, F.lit(False)), F.lit(False)), F.when(given, value))


def to_double(v: Column | Field) -> Coerced:
    text, kind = _parts(v)
    value = text.try_cast("double")
    finite = F.abs(value) < float("inf")
    ok = ((kind == "number") | (kind == "text") & text.rlike(NUMBER)) & finite | (kind == "text") & text.rlike(NUMBER_WORD)
    return _made(value, text, kind, ok)


def to_bigint(v: Column | Field) -> Coerced:
    text, kind = _parts(v)
    whole, cut = text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")
    ok = (kind == "number") & cut.isNotNull() | (kind == "text") & text.rlike(INTEGER) & whole.isNotNull()
    return _made(F.coalesce(whole, cut), text, kind, ok)


def to_boolean(v: Column | Field) -> Coerced:
    text, kind = _parts(v)
    return _made(text.isin(TRUE), text, kind, (kind == "bool") | (kind == "text") & text.isin(TRUE + FALSE))


def to_timestamp(v: Column | Field) -> Coerced:
    """Wall-clock times as they are; instants in UTC (the session's zone must be UTC)."""
    text, kind = _parts(v)
    value = F.when(text.rlike(INSTANT), text.try_cast("timestamp").cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))
    ok = (kind == "text") & (text.rlike(WALL) | text.rlike(INSTANT) | text.rlike(DAY)) & value.isNotNull()
    return _made(value, text, kind, ok)


def to_text(v: Column | Field) -> Coerced:
    """Texts as they are, also empty; objects and arrays as canonical JSON."""
    text, kind = _parts(v)
    return Coerced(F.when(kind == "other", _json(v)).when(kind.isNotNull(), text), F.lit(False))


def to_json_text(v: Column | Field) -> Coerced:
    _, kind = _parts(v)
    return Coerced(F.when(kind.isNotNull(), _json(v)), F.lit(False))


def coordinate(v: Column | Field, at: int) -> Coerced:
    """A coordinate of a GeoJSON point; null in other shapes, bad if it is there but no number."""
    return to_double(F.try_variant_get(v.value if isinstance(v, Field) else v, f"$.coordinates[{at}]", "variant"))


def lenient_timestamp(text: Column, days: bool = False) -> Column:
    """For catalog times and high-water marks: null where strict typing would fail."""
    instant = F.when(text.rlike(INSTANT), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.coalesce(instant, F.when(text.rlike(WALL) | (text.rlike(DAY) & F.lit(days)), text.try_cast("timestamp_ntz")))
