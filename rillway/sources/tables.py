"""Tables in and out of a flow: readers by widget, inline tables, files as base64, catalogs, and event frames."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.predicates import predicate
from rillway.model import Flow, FlowError
from rillway.plans.compile import status
from rillway.plans.run import Result, run
from rillway.registry import Registry


def read_table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """A table source: {format, path, schema, options} or {table}."""
    if "table" in config:
        return spark.table(config["table"])
    reader = spark.read.format(config.get("format", "parquet")).options(**config.get("options", {}))
    if config.get("schema"):
        reader = reader.schema(config["schema"])
    return reader.load(config["path"])


def inline_table(spark: SparkSession, value: dict[str, Any]) -> DataFrame:
    """{columns, rows} as a DataFrame of text columns; short rows are filled with nulls."""
    columns = list(value["columns"])
    rows = [tuple(None if i >= len(r) or r[i] is None else str(r[i]) for i in range(len(columns))) for r in value.get("rows", ())]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def filter_rows(df: DataFrame, conditions: list[dict[str, Any]]) -> DataFrame:
    """Rows for which every {column, operator, value} holds; operators are the predicate catalog."""
    if missing := [c["column"] for c in conditions if c["column"] not in df.columns]:
        raise FlowError(f"no column {missing[0]}")
    tests = [predicate(c["operator"], F.col(f"`{c['column']}`"), F.lit(str(c.get("value", "")))) for c in conditions]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def files(spark: SparkSession, paths: str) -> DataFrame:
    """filename and content (base64) of files, as a file upload gives them."""
    read = spark.read.format("binaryFile").load(paths)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.base64("content").alias("content"))


def for_triggers(spark: SparkSession, flow: Flow) -> dict[str, DataFrame]:
    """A reader for each trigger that names a path: streams for events, tables otherwise."""
    out = {}
    for t in flow.triggers:
        if "path" not in t.config:
            continue
        if t.kind == "event":
            out[t.id] = spark.readStream.format(t.config.get("format", "parquet")).schema(t.config["schema"]).load(t.config["path"])
        else:
            out[t.id] = read_table(spark, t.config)
    return out


def catalog(flow: Flow, spark: SparkSession) -> DataFrame:
    """kind, id, subkind, config: a flow's dependencies and triggers."""
    rows = [("dependency", d.id, d.kind, str(d.config)) for d in flow.dependencies] + [("trigger", t.id, t.kind, str(t.config)) for t in flow.triggers]
    return spark.createDataFrame(rows, "kind string, id string, subkind string, config string")


def entities(lookups: dict[str, DataFrame], kind: str) -> DataFrame:
    """The table that serves an entity dropdown."""
    if kind not in lookups:
        raise FlowError(f"no lookup for {kind!r}")
    return lookups[kind]


def sse_frames(events: DataFrame) -> DataFrame:
    """Event rows as server-sent event frames: one `frame` text each."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("frame"))


def nodes_json(registry: Registry, spark: SparkSession) -> DataFrame:
    """The palette, one JSON document per operator."""
    import json

    return spark.createDataFrame([(json.dumps(d, default=str),) for d in registry.palette()], "node string")


def execute(payload: dict[str, Any], df: DataFrame, registry: Registry, **options) -> Result:
    """Run a request's flow over df; cached results it carries stand in for their nodes."""
    from rillway.sources.files import from_payload

    flow, cache = from_payload(payload)
    held: dict[str, dict[str, str]] = {}
    for node, handles in cache.items():
        for handle, value in handles.items():
            name = f"_cache_{node}_{handle}"
            df = df.withColumn(name, F.lit(value))
            held.setdefault(node, {})[handle] = name
    return run(flow, df, registry, cache=held, **options)


def check(payload: dict[str, Any], registry: Registry, strict: bool = False) -> dict:
    """{status, errors, warnings} of a request's flow."""
    from rillway.sources.files import from_payload

    return status(from_payload(payload)[0], registry, strict)
