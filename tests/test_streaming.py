from pyspark.sql import functions as F

from rillway.model import Edge, Flow, Node
from rillway.plans.run import OutputRef, run
from rillway.queries import one
from rillway.streaming.runs import answered, once_per_key, resume_on_stream, run_stream, tumbling, wait_for_signals


def drain(df, name, mode="append", tmp=None):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(60)
    query.stop()
    return df.sparkSession.table(name)


def test_stateless_flow(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    r = run_stream(one("text-uppercase", text="@text"), stream)
    assert sorted(x[0] for x in drain(r.project([OutputRef("out", "out")]), "upper").collect()) == ["A", "B"]


def test_keys_and_windows(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:00:30"), ("k2", "2024-01-01 00:01:10")]
    spark.createDataFrame(rows, "key string, at string").select("key", F.col("at").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    assert drain(once_per_key(stream, "key", "at", "1 hour"), "once").count() == 2
    counted = drain(tumbling(stream, "at", "1 minute", "0 seconds", [], n=F.count(F.lit(1))), "windows", "complete")
    assert sorted(r["n"] for r in counted.collect()) == [1, 2]


def test_signals(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, 0.0)], "run_id long, seconds double").write.parquet(str(tmp_path / "w"))
    spark.createDataFrame([(1, "yes")], "run_id long, response string").write.parquet(str(tmp_path / "s"))
    waiting = spark.readStream.schema("run_id long, seconds double").parquet(str(tmp_path / "w"))
    signals = spark.readStream.schema("run_id long, response string").parquet(str(tmp_path / "s"))
    got = drain(wait_for_signals(waiting, signals), "answers").collect()
    assert [(r["run_id"], r["response"], r["timed_out"]) for r in got] == [(1, "yes", False)]


def test_runs_go_on_as_their_signals_come(spark, tmp_path):
    """Three batches: early signals are kept, the earliest of a batch answers, late runs are given up, repeats change nothing."""
    stamp = lambda s: F.timestamp_seconds(F.col(s).cast("double"))
    rows = [(0, "go", 1, "early", 10), (0, "no", 2, "other", 11), (1, "go", 2, "b", 21), (1, "go", 2, "a", 20), (2, "go", 4, "late", 200), (2, "go", 3, "in time", 150)]
    every = spark.createDataFrame(rows, "batch int, signal_name string, user int, word string, at int")
    runs = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 100), (4, 4, 100), (5, 9, 0), (6, 2, 15)], "k int, user int, began int").withColumn("began", stamp("began"))
    flow = Flow((Node("hold", "signal-wait", {"signal_name": "go", "timeout_seconds": 60}), Node("out", "text-uppercase")), (Edge("e", "hold", "out", None, "text"),))
    first = run(flow, runs)
    (tmp_path / "in").mkdir()
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    stream = spark.readStream.schema("signal_name string, user int, word string, at int").option("maxFilesPerTrigger", 1).parquet(source)
    signals = stream.select("signal_name", F.struct("user", "word").alias("payload"), stamp("at").alias("at"))
    for n in range(3):
        every.filter(F.col("batch") == n).drop("batch").coalesce(1).write.mode("append").parquet(source)
        query = resume_on_stream(first, "hold", signals, "k", [OutputRef("out", "out")], folder, correlation="user == run.user", time="at", since="began", answer=lambda p: p["word"]).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted(((r["k"], r["out"], r["timed_out"]) for r in answered(spark, folder).collect()), key=str)
    assert got == [(1, "EARLY", False), (2, "A", False), (3, "IN TIME", False), (4, None, True), (5, None, True), (6, "A", False)]
    assert spark.read.parquet(f"{folder}/open/batch=2").count() == 0
