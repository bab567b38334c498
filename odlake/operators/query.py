"""Read-only SQL over all attached portals, with row, byte and time caps.

A query runs in a session of its own, a copy of the caller's, in which paths cannot stand for tables; no setting
of the caller's session changes. What a text is, Spark's parser says: the guard walks the parsed plan, which
knows what is a literal or a comment, and the analysed plan, in which views have become what they stand for.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS, MAX_BYTES, TIMEOUT = 1000, 1 << 20, 30.0
#: Functions that call code of the JVM by its name.
REFUSED = ("reflect", "try_reflect", "java_method")
#: Of the parts of a plan, by the beginnings of their names: those that call such code, run a program, or make a name out of text.
REFUSED_PARTS = ("CallMethodViaReflection", "TryReflect", "ScriptTransformation", "ScriptInputOutputSchema", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "CompoundBody")
#: Parts that hold no others and are many.
LEAVES = ("AttributeReference", "Literal", "LogicalRelation", "UnresolvedAttribute", "UnresolvedRelation")
#: Statements that are no queries and only tell of tables and plans.
TELLS = ("Describe", "Show", "Explain")
#: JSON around columns and rows, whose bytes count, too.
ENVELOPE = len('{"columns":[],"rows":[],"row_count":0,"truncated":false}')


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    note: str = ""


def session_of(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings, views and tables, that changes nothing in the caller's."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    return own


def _parts(spark: SparkSession, plan) -> Iterator[tuple[str, object]]:
    """Class name and object of every plan and expression in a plan, whatever holds it."""
    of = spark._jvm.java.lang.Class.forName
    tree, many, kind = of("org.apache.spark.sql.catalyst.trees.TreeNode"), of("scala.collection.Iterable"), of("org.apache.spark.sql.types.DataType")
    waiting, seen = [plan], 0
    while waiting:
        x = waiting.pop()
        if not hasattr(x, "_get_object_id"):
            continue  # a text or a number
        if tree.isInstance(x):
            yield (name := x.getClass().getSimpleName()), x
            if name in LEAVES:
                continue
            parts = x.productIterator()
        elif kind.isInstance(x):
            continue
        elif many.isInstance(x):
            parts = x.iterator()
        elif x.getClass().getName().startswith(("scala.Tuple", "scala.Some")):
            parts = x.productIterator()
        else:
            continue  # what holds neither plans nor expressions
        while parts.hasNext():
            waiting.append(parts.next())
        if (seen := seen + 1) > 20_000:
            raise PermissionError("the query is too large to be looked through")


def refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a text is more than one statement that only reads; None if it is one. Text that does not parse raises Spark's own error."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    for name, node in _parts(spark, plan):
        if name.startswith(REFUSED_PARTS):
            return name
        if name == "UnresolvedFunction" and (called := node.nameParts().last().lower()) in REFUSED:
            return called
        if (command.isInstance(node) or statement.isInstance(node)) and not name.startswith(TELLS):
            return name
    return None


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether the text is one statement that only reads tables; text that does not parse raises Spark's own error."""
    return refusal(spark, sql) is None


def _analysed(spark: SparkSession, sql: str) -> DataFrame:
    df = spark.sql(sql)
    for name, _ in _parts(spark, df._jdf.queryExecution().analyzed()):
        if name.startswith(REFUSED_PARTS):
            raise PermissionError(f"read-only: only queries may run, not {name}")
    return df


def capped(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df's first rows with __n (from 1) and __over: whether the running size as JSON arrays of values, in bytes, passes max_bytes.

    One row past either cap is kept, if there is one, so that it is known that rows are missing; the
    window is over max_rows + 1 rows at most. The first row is never over.
    """
    given = df.columns  # of which several may be equal
    df = df.toDF(*(f"__{k}" for k in range(len(given))))
    first = df.limit(max_rows + 1).withColumn("__n", F.monotonically_increasing_id())
    sizes = [F.octet_length(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})) - len('{"v":}') for c in df.columns]
    row, head = sum(sizes, F.lit(len(given) + 2)), ENVELOPE + sum(len(c.encode()) + 3 for c in given)  # brackets, commas, and the comma behind
    w = Window.orderBy("__n")
    sized = first.withColumn("__size", row).withColumn("__bytes", F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)) + head)
    numbered = sized.withColumn("__n", F.row_number().over(w)).withColumn("__over", (F.col("__bytes") > max_bytes) & (F.col("__n") > 1))
    kept = numbered.where(~F.col("__over") | (F.col("__bytes") - F.col("__size") <= max_bytes) | (F.col("__n") == 2)).drop("__size", "__bytes")
    return kept.toDF(*given, "__n", "__over")


def run(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, timeout: float = TIMEOUT) -> Result:
    group, late, ended = f"query-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        late.set()
        while not ended.is_set():  # jobs that begin only after the limit, too: planning may take longer than it
            spark.sparkContext.cancelJobGroup(group)
            ended.wait(0.2)

    spark.sparkContext.setJobGroup(group, sql[:200], interruptOnCancel=True)
    timer = threading.Timer(timeout, stop)
    timer.start()
    try:
        own = session_of(spark)
        if (why := refusal(own, sql)) is not None:
            raise PermissionError(f"read-only: only queries may run, not {why}")
        df = _analysed(own, sql)
        rows = capped(df, max_rows, max_bytes).collect()  # at most max_rows + 1
        if late.is_set():
            raise RuntimeError("done after the limit")
        kept = [r for r in rows[:max_rows] if not r[-1]]
        result = Result(df.columns, [tuple(r)[:-2] for r in kept], len(kept) < len(rows))
        if result.truncated:
            cap = f"{max_rows} rows" if len(kept) == max_rows else f"{max_bytes} bytes"
            result.note = f"more than {cap}: only the first {len(kept)} rows are given"
        return result
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"timeout: not done within {timeout:g} s") from error
        raise
    finally:
        ended.set()
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
