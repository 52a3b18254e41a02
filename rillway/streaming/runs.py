"""Flows over streams: stateless flows run unchanged on a streaming table; waiting runs and timers keep state by run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillway.model import Flow, FlowError
from rillway.plans.run import OutputRef, Result, match_signals, run
from rillway.registry import Registry


def run_stream(flow: Flow, stream: DataFrame, registry: Registry | None = None, **options) -> Result:
    """The flow's columns on a streaming table. Flows that pause need wait_for_signals instead."""
    result = run(flow, stream, registry, **options)
    if result.waits:
        raise FlowError("a flow that pauses can't run on a stream as a whole")
    return result


def once_per_key(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows of a stream, each idempotency key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, width: str, late: str, by: list[str], **aggregates) -> DataFrame:
    """Aggregates by key and time window of a stream with late data up to `late`."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])


def emit(result: Result, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Send a streaming result's events to a sink, batch by batch."""
    return result.events(key).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def wait_for_signals(waiting: DataFrame, signals: DataFrame, key: str = "run_id", keep_seconds: float = 86_400.0) -> DataFrame:
    """key, response, timed_out, from two streams: waiting runs (key, seconds) and signals (key, response).

    A run is answered by the first signal after or before it, or times out `seconds` after it was seen (0: never).
    State is one small record per run, dropped once it is answered; a signal that no run asks for within keep_seconds is
    dropped.
    """
    asks = waiting.select(key, F.lit("wait").alias("kind"), F.col("seconds").cast("double").alias("seconds"), F.lit(None).cast("string").alias("response"))
    told = signals.select(key, F.lit("signal").alias("kind"), F.lit(0.0).alias("seconds"), F.col("response").cast("string").alias("response"))
    kind = waiting.schema[key].dataType.simpleString()
    return asks.unionByName(told).groupBy(key).applyInPandasWithState(_settle(key, keep_seconds), f"{key} {kind}, response string, timed_out boolean", "waits boolean, response string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _settle(key: str, keep_seconds: float):
    def settle(name: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            waits, _ = state.get
            state.remove()
            if not waits:
                return
            yield pd.DataFrame({key: [name[0]], "response": [None], "timed_out": [True]})
            return
        waits, response = state.get if state.exists else (False, None)
        seconds = 0.0
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.kind == "wait":
                    waits, seconds = True, row.seconds or 0.0
                elif response is None:
                    response = row.response
        if waits and response is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [name[0]], "response": [response], "timed_out": [False]})
            return
        state.update((waits, response))
        if not waits:
            state.setTimeoutDuration(int(keep_seconds * 1000))
        elif seconds > 0:
            state.setTimeoutDuration(int(seconds * 1000))

    return settle


def resume_on_stream(first: Result, node_id: str, signals: DataFrame, key: str, outputs: list[OutputRef], folder: str, *, correlation: str | None = None, time: str = "time", since: str | None = None, answer: Callable[[Column], Column] = lambda p: p, keep_seconds: float = 86_400.0) -> DataStreamWriter:
    """A stream that goes on with the runs that wait at a node as their signals come; start() it, with any trigger.

    signals: a stream of signal_name, payload (a struct) and `time`. A waiting run is answered by the earliest signal of its
    name whose correlation holds (see match_signals): answer(payload) becomes the node's result and the rest of the flow is
    carried out. With `since`, a column of the run with the time that it began to wait, a run whose timeout_seconds end before
    the latest time seen is given up; a later signal doesn't answer it. Signals that nobody waits for are kept for
    keep_seconds of the signals' time.

    Everything lies in tables by batch in `folder`: `out` (key, outputs, timed_out), `open` (the runs that wait still),
    `signals` (those kept) and the stream's checkpoint. A batch reads the tables of the one before and overwrites its own, so
    one that is repeated after a loss gives the same rows, once. A folder that has been begun is gone on with.
    """
    spark = signals.sparkSession
    path = lambda name, n: f"{folder}/{name}/batch={n}"
    waiting = first.waiting(node_id)
    schema = waiting.schema
    if not _begun(spark, folder):
        waiting.write.mode("overwrite").parquet(path("open", -1))
    told = signals.select("signal_name", "payload", F.col(time).cast("timestamp").alias("time"))

    def settle(batch: DataFrame, n: int) -> None:
        held = batch if n == 0 else spark.read.schema(told.schema).parquet(path("signals", n - 1)).unionByName(batch)
        _write(held.withColumn("sid", F.monotonically_increasing_id()), path("told", n))
        now = spark.read.parquet(path("told", n))
        seen = now.agg(F.max(F.unix_micros("time"))).first()[0]
        latest = F.lit(None).cast("timestamp") if seen is None else F.timestamp_micros(F.lit(seen))
        runs = spark.read.schema(schema).parquet(path("open", n - 1))
        limit = F.col("wait.timeout_seconds").cast("double") if "timeout_seconds" in schema["wait"].dataType.names else F.lit(None).cast("double")
        end = F.timestamp_seconds(F.unix_micros(F.col(since).cast("timestamp")) / 1e6 + limit) if since else F.lit(None).cast("timestamp")
        runs = runs.withColumn("_end", F.when(limit > 0, end)).withColumn("_rid", F.monotonically_increasing_id())
        _write(runs, path("runs", n))
        runs = spark.read.parquet(path("runs", n))
        met = match_signals(runs, now, "_rid", correlation, carry=("time", "sid"))
        met = met.join(runs.select("_rid", "_end"), "_rid").filter(F.col("_end").isNull() | (F.col("time") <= F.col("_end")))
        _write(met.select("_rid", "sid", "time", answer(F.col("response")).alias("response")), path("met", n))
        met = spark.read.parquet(path("met", n))
        answers = met.groupBy("_rid").agg(F.min_by("response", F.struct("time", "sid")).alias("response"))
        done = first.resume(node_id, answers, "_rid", checkpoint=runs).project(outputs, keep=(key,)).withColumn("timed_out", F.lit(False))
        left = runs.join(answers.select("_rid"), "_rid", "left_anti")
        late = F.coalesce(F.col("_end") < latest, F.lit(False))
        given_up = left.filter(late).select(key, *[F.lit(None).cast(done.schema[o.name].dataType).alias(o.name) for o in outputs], F.lit(True).alias("timed_out"))
        _write(done.unionByName(given_up), path("out", n))
        _write(left.filter(~late).select(*schema.names), path("open", n))
        fresh = now.filter(F.unix_micros("time") > F.unix_micros(latest) - keep_seconds * 1e6)
        _write(fresh.join(met.select("sid").distinct(), "sid", "left_anti").select(*told.columns), path("signals", n))

    return told.writeStream.foreachBatch(settle).option("checkpointLocation", f"{folder}/checkpoint")


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """What resume_on_stream has put out so far."""
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _begun(spark: SparkSession, folder: str) -> bool:
    try:
        return spark.read.parquet(f"{folder}/open/batch=-1") is not None
    except AnalysisException:
        return False
