"""Globs, names and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """An anchored regex: * and ? do not cross a slash, classes may be negated by ^, a backslash escapes. A malformed glob matches nothing."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if k == len(glob):
                return "(?!)"
            out.append(re.escape(glob[k]))
            k += 1
        elif c == "[":
            if (m := re.compile(r"\^?(?:(?:\\.|[^\\\]\-])(?:-(?:\\.|[^\\\]\-]))?)+\]", re.DOTALL).match(glob, k)) is None:
                return "(?!)"
            inner = m[0][:-1]
            negated, inner = inner.startswith("^"), inner.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"(?<!\\)([\[&~^])", r"\\\1", inner) + "]")
            k = m.end()
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def matches(value: Column, glob: str) -> Column:
    return F.coalesce(value.rlike(glob_to_regex(glob)), F.lit(False))


def table_name(dataset_id: Column) -> Column:
    return F.replace(dataset_id, F.lit("-"), F.lit("_"))


def contains_folded(value: Column, needle: str) -> Column:
    return F.lower(F.coalesce(value, F.lit(""))).contains(needle.lower())


def config_hash(*fields: Column) -> Column:
    """sha256: and the digest of the canonical JSON of the fields."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def shortened(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("…"))).otherwise(value)
