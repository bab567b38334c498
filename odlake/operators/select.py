"""Which datasets a run takes, and with which settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odlake.functions.text import config_hash, matches, table_name

KINDS = ("id", "name", "category", "tag")
MODES = ("", "incremental", "full_replace")
SETTINGS = {"table": "string", "where": "string", "order_by": "string", "batch_size": "int", "limit": "int", "skip_columns": "array<string>", "mode": "string", "hwm_column": "string", "checkpoint_every_n_pages": "int"}


def checked(selectors: Sequence[Mapping[str, str]]) -> Sequence[Mapping[str, str]]:
    for k, s in enumerate(selectors):
        if sum(bool(s.get(kind)) for kind in KINDS) != 1:
            raise ValueError(f"selector {k}: exactly one of {', '.join(KINDS)} must be set")
    return selectors


def selected_by(selector: Mapping[str, str]) -> Column:
    """Whether a catalog row (id, name, category, tags) matches one selector."""
    if selector.get("id"):
        return F.coalesce(F.col("id") == selector["id"], F.lit(False))
    if selector.get("tag"):
        return F.coalesce(F.exists("tags", lambda t: matches(t, selector["tag"])), F.lit(False))
    kind = "name" if selector.get("name") else "category"
    return matches(F.col(kind), selector[kind])


def any_of(selectors: Sequence[Mapping[str, str]]) -> Column:
    return reduce(or_, map(selected_by, checked(selectors)), F.lit(False))


def resolve(catalog: DataFrame, include: Sequence[Mapping[str, str]], exclude: Sequence[Mapping[str, str]] = (), only: Sequence[str] = ()) -> DataFrame:
    """Catalog rows that an include selector takes and no exclude selector drops; `only` narrows them and must be among them."""
    kept = catalog.where(any_of(include) & ~any_of(exclude)).dropDuplicates(["id"])
    if not only:
        return kept
    wanted = catalog.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(only)], "id string")
    if unknown := [r[0] for r in wanted.join(kept, "id", "left_anti").orderBy("id").collect()]:
        raise ValueError(f"not among the selected datasets: {', '.join(unknown)}")
    return kept.join(F.broadcast(wanted), "id", "left_semi")


def catalog_filter(ids: Sequence[str] = (), names: Sequence[str] = (), categories: Sequence[str] = (), tags: Sequence[str] = ()) -> Column:
    """OR within a kind, AND across kinds; a kind without values takes all."""
    given = ((k, v) for k, v in zip(KINDS, (ids, names, categories, tags)) if v)
    return reduce(and_, (any_of([{kind: x} for x in values]) for kind, values in given), F.lit(True))


def effective(targets: DataFrame, overrides: DataFrame, batch_size: int = 5000, order_by: str = ":id") -> DataFrame:
    """dataset_id and every setting: an override that is not empty wins over the defaults. overrides: id and settings, one row an id."""
    o = targets.select("id").join(overrides.select("id", *(c for c in SETTINGS if c in overrides.columns)), "id", "left")
    for c, kind in SETTINGS.items():
        if c not in o.columns:
            o = o.withColumn(c, F.lit(None).cast(kind))

    def given(c: str, default: Column) -> Column:
        empty = F.size(c) <= 0 if "array" in SETTINGS[c] else F.col(c) == ("" if SETTINGS[c] == "string" else 0)
        return F.when(F.col(c).isNull() | empty, default).otherwise(F.col(c)).cast(SETTINGS[c])

    defaults = {"table": table_name(F.col("id")), "order_by": F.lit(order_by), "batch_size": F.lit(batch_size), "skip_columns": F.array().cast("array<string>")}
    made = {c: given(c, defaults.get(c, F.lit("" if kind == "string" else 0))) for c, kind in SETTINGS.items()}
    valid = F.assert_true(made["mode"].isin(*MODES), "unknown mode")
    made["mode"] = F.when(valid.isNull(), made["mode"])
    return o.select(F.col("id").alias("dataset_id"), *(v.alias(c) for c, v in made.items()))


def hashed(plan: DataFrame) -> DataFrame:
    return plan.withColumn("config_hash", config_hash(*SETTINGS))


def full_refresh(plan: DataFrame, ids: Sequence[str] = (), everything: bool = False) -> DataFrame:
    """Settings with mode full_replace for the given ids, which must be planned, or for all."""
    if ids and everything:
        raise ValueError("full refresh takes ids or all, not both")
    if ids:
        wanted = plan.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "dataset_id string")
        if unknown := [r[0] for r in wanted.join(plan, "dataset_id", "left_anti").orderBy("dataset_id").collect()]:
            raise ValueError(f"full refresh of datasets that are not selected: {', '.join(unknown)}")
    forced = F.lit(everything) if everything or not ids else F.col("dataset_id").isin(list(ids))
    return plan.withColumn("mode", F.when(forced, "full_replace").otherwise(F.col("mode")))
