"""What happened in a run, as arrays of event structs derived from the columns of its nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of events beside the run's key and the place in its sequence.
EVENT = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("type", "node_id", "error", "result", "idempotency_key", "results", "warning", "payload")],
        *[T.StructField(n, T.LongType()) for n in ("attempt", "max_retries", "current", "total")],
        *[T.StructField(n, T.DoubleType()) for n in ("delay", "elapsed_seconds", "timeout_seconds")],
        *[T.StructField(n, T.BooleanType()) for n in ("cached", "is_validation", "is_timeout")],
        T.StructField("completed", T.ArrayType(T.StringType())),
    ]
)
EVENTS = T.ArrayType(EVENT)
#: How the fault of an input begins that can't be made its type.
INVALID = "invalid "


def event(kind: str, node: str | None = None, **fields: Column) -> Column:
    given = {"type": F.lit(kind), "node_id": F.lit(node), **fields}
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def none() -> Column:
    return F.array().cast(EVENTS)


def some(where: Column, many: Column) -> Column:
    return F.when(where, many).otherwise(none())


def retries(node: str, most: int, delay: float, tries: Column, errors: Column) -> Column:
    """node_retry for each attempt but the first."""
    again = lambda k: event("node_retry", node, attempt=k, max_retries=F.lit(most), delay=F.lit(delay) * F.pow(F.lit(2.0), k - 1), error=F.get(errors, k - 1))
    return some(tries > 1, F.transform(F.sequence(F.lit(1), F.greatest(tries - 1, F.lit(1))), again))


def progress(node: str, current: Column, total: Column) -> Column:
    """node_progress from 1 to current."""
    current = F.coalesce(current.cast("long"), F.lit(0).cast("long"))
    return some(current > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(current, F.lit(1).cast("long"))), lambda k: event("node_progress", node, current=k, total=total)))


def bare(fault: Column) -> Column:
    """A fault without the ids of the nodes that it came through."""
    return F.regexp_replace(fault, r"^(?:[^\s:]+: )(?=invalid |TimeoutError)", "")


def wrong(fault: Column) -> dict[str, Column]:
    """Fields of an event that tells a fault."""
    plain = bare(fault)
    return {"error": fault, "is_validation": F.startswith(plain, F.lit(INVALID)), "is_timeout": F.startswith(plain, F.lit("TimeoutError"))}
