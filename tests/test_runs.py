"""Faults of rows, loops by row, retries, effects and events."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions import expression as E
from rillway.functions.expression import Value
from rillway.model import Edge, Flow, Node
from rillway.operators.standard import standard
from rillway.plans.control import Control
from rillway.plans.run import OutputRef, idempotent, match_signals, run
from rillway.queries import ORACLE_SQL, QUERIES, col, nested_loop, one, parity_flow, python_registry, wire, word_loop


def faults(df, source):
    """(value, fault) of an expression over all columns of df."""
    scope = {f.name: Value(F.col(f.name), f.dataType) for f in df.schema.fields}
    value, fault = E.checked(source, scope)
    return [tuple(r) for r in df.select(value.column, fault).collect()]


@pytest.mark.parametrize(
    ("source", "wanted"),
    [
        ("10 / n", [(5, None), (None, "division by zero")]),
        ("10 % n", [(0, None), (None, "modulo by zero")]),
        ("1.5 / n", [(0.75, None), (None, "division by zero")]),
        ("i + i", [(4_000_000_000, None), (4_000_000_000, None)]),
        ("big + big", [(2, None), (None, "integer overflow")]),
        ("big * 3", [(3, None), (None, "integer overflow")]),
        ("-big - 2", [(-3, None), (None, "integer overflow")]),
        ("int(t)", [(12, None), (None, "int: not a whole number")]),
        ("double(t)", [(12.0, None), (None, "double: not a number")]),
        ("m['k']", [("v", None), (None, "missing key k")]),
        ("l[n]", [(30, None), (10, None)]),
        ("l[n + 1]", [(None, "index out of range"), (20, None)]),
        ("l[-4]", [(None, "index out of range"), (None, "index out of range")]),
        ("n == 0 || 10 / n > 1", [(True, None), (True, None)]),
        ("n != 0 && 10 / n > 1", [(True, None), (False, None)]),
        ("n != 0 && 10 / n > 1 && int(t) > 0", [(True, None), (False, None)]),
        ("n == 0 ? 0 : 10 / n", [(5, None), (0, None)]),
        ("n == 0 ? 10 / n : 1", [(1, None), (None, "division by zero")]),
    ],
)
def test_faults_are_columns(spark, source, wanted):
    rows = [(2, 2_000_000_000, 1, "12", {"k": "v"}, [10, 20, 30]), (0, 2_000_000_000, 2**63 - 1, "x", {}, [10, 20, 30])]
    df = spark.createDataFrame(rows, "n long, i int, big long, t string, m map<string,string>, l array<long>")
    got = faults(df.coalesce(1), source)
    assert got == wanted


def test_guard_fault_fails_its_run_only(spark):
    goes = lambda n, when=None, priority=0: Edge(n, "which", n, None, None, when, priority)
    flow = Flow((col("x"), Node("which", "decision"), Node("a", "text", {"value": "a"}), Node("b", "text", {"value": "b"})), (wire("x", "which", "value"), goes("a", "10 / value > 3"), goes("b")))
    df = spark.createDataFrame([(1,), (0,), (9,)], "x long")
    r = run(flow, df)
    got = {x["x"]: (x["status"], x["error"]) for x in r.summary(("x",)).collect()}
    assert got == {1: ("complete", None), 9: ("complete", None), 0: ("failed", "which: guard a: division by zero")}
    assert {x["x"]: (x["a"], x["b"]) for x in r.project([OutputRef("a", "a"), OutputRef("b", "b")], ("x",)).collect()} == {1: ("a", None), 9: (None, "b"), 0: (None, None)}
    with pytest.raises(Exception, match="division by zero"):
        run(flow, df, on_fault="raise").summary(("x",)).collect()


def test_condition_fault_ends_a_loop(spark):
    nodes = (Node("go", "while-start", {"condition": "!exists(last) || 6 / (3 - iteration) > 0"}), Node("same", "math-multiply", {"b": 1}), Node("stop", "while-end"))
    r = run(Flow(nodes, (wire("go", "same", "a", "output_1"), wire("same", "stop", "item"))), spark.range(2))
    assert {x["error"] for x in r.summary(("id",)).collect()} == {"go: condition: division by zero"}


def test_faulty_keys_and_correlations(spark):
    df = spark.createDataFrame([("1", 0), ("1", 1), ("x", 2), ("y", 3)], "k string, n long")
    assert sorted(r["n"] for r in idempotent(df, "int(k)").select("n").collect())[-2:] == [2, 3]
    assert idempotent(df, "int(k)").count() == 3
    waiting = spark.createDataFrame([(1, ("go",)), (2, ("go",))], "run_id long, wait struct<signal_name:string>")
    signals = spark.createDataFrame([("go", (0, 1)), ("go", (5, 2))], "signal_name string, payload struct<d:long,id:long>")
    assert [r["run_id"] for r in match_signals(waiting, signals, "run_id", "10 / d == 2 && id == run.run_id").collect()] == [2]


def counted(tmp_path):
    registry = standard()

    @registry.node("mark", retry_delay=0.0)
    def mark(text: str) -> str:
        with open(f"{tmp_path}/calls", "a") as f:
            f.write("x")
        return text.upper()

    return registry, lambda: len(open(f"{tmp_path}/calls").read())


def test_loops_of_repeated_and_null_keys(spark, tmp_path):
    registry, calls = counted(tmp_path)
    flow = word_loop((Node("up", "mark"),), (wire("each", "up", "text", "output_1"),), ("up", None))
    df = spark.createDataFrame([("k", "a b"), ("k", "c"), (None, "d e"), (None, "")], "key string, p_name string").coalesce(1)
    r = run(flow, df, registry, key="key")
    assert sorted(x["out"] for x in r.project([OutputRef("out", "out")]).collect()) == ["", "A B", "C", "D E"]
    before = calls()
    assert r.summary().count() == 4 and calls() == before <= 6


def test_what_a_loop_collects_is_never_broadcast(spark):
    """A small table may have any number of items; and a table of one file isn't left to one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(64, numPartitions=1).select("id", F.lit("ab cde").alias("p_name"))
        r = run(nested_loop("shout"), rows, python_registry())
        plan = r._runs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
        assert len(r._runs.inputFiles()) > 2  # the outer and the inner loop's tables
        assert [tuple(x) for x in r.project([OutputRef("out", "out")]).groupBy("out").count().collect()] == [("A!.B! C!.D!.E!", 64)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_effects_happen_once(spark, tmp_path):
    registry, calls = counted(tmp_path)
    flow = Flow((col("t"), Node("m", "mark", compensation="undo"), Node("bad", "math-divide", {"a": 1, "b": 0}, on_error="compensate"), Node("undo", "template", {"template": "undo {input}", "input": ""})), (wire("t", "m", "text"), wire("m", "bad", "after")))
    r = run(flow, spark.createDataFrame([("a",), ("b",)], "t string"), registry)
    assert r.summary(("t",)).count() == 2 and r.compensation("t").count() == 2 and r.undo("t").count() == 2
    assert r.events("t").filter("type = 'flow_error'").count() == 2 and calls() == 2


def test_retry_classes(spark):
    registry = standard()

    class Final(Exception):
        retryable = False

    @registry.node("fails", max_retries=2, retry_delay=0.0)
    def fails(text: str) -> str:
        raise {"value": ValueError, "type": TypeError, "final": Final}[text](text)

    df = spark.createDataFrame([("value",), ("type",), ("final",)], "t string")
    events = run(one("fails", text="@t"), df, registry).events("t").filter("node_id = 'out'").orderBy("t", "seq").collect()
    told = {t: [(e["type"], e["attempt"], e["error"]) for e in events if e["t"] == t and e["type"] != "node_start"] for t in ("value", "type", "final")}
    for t, name in (("value", "ValueError"), ("type", "TypeError")):
        assert told[t] == [("node_retry", 1, f"{name}: {t}"), ("node_retry", 2, f"{name}: {t}"), ("node_error", None, f"{name}: {t}")]
    assert told["final"] == [("node_error", None, "Final: final")]
    assert {(e["max_retries"], e["delay"]) for e in events if e["type"] == "node_retry"} == {(2, 0.0)}


def test_validation_names_all_fields(spark):
    df = spark.createDataFrame([("x", "y"), ("1", "2"), ("x", "2")], "a string, b string")
    r = run(one("math-add", a="@a", b="@b"), df)
    wrong = {(e["a"], e["error"], e["is_validation"]) for e in r.events("a").filter("type = 'node_error'").collect()}
    assert all(v for _, _, v in wrong) and {len(e.split("; ")) for _, e, _ in wrong} == {1, 2}
    assert r.runs.filter(r.column("out").isNotNull()).count() == 1


def test_event_log_against_its_sql(spark, tmp_path):
    """The log shows is_validation for the nodes' errors alone; the events themselves keep it for flow_error, too."""
    df = spark.createDataFrame([(-3,), (-2,), (0,), (1,), (2,), (2,), (None,)], "o_orderkey long")
    df.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["event_log"](spark, str(tmp_path))
    orders = df.toArrow()  # noqa: F841
    wanted = duckdb.sql(ORACLE_SQL["event_log"])
    assert found.columns == wanted.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted.fetchall()))
    told = run(parity_flow(), df).events("o_orderkey").filter("type = 'flow_error'").collect()
    assert [e["is_validation"] for e in told] == [False] * 4


def test_fields_of_events(spark):
    df = spark.createDataFrame([(1, "a b c", "kept"), (2, "d", None)], "id long, p_name string, held string")
    r = run(word_loop((Node("up", "text-uppercase"),), (wire("each", "up", "text", "output_1"),), ("up", None)), df)
    events = r.events("id").orderBy("id", "seq").collect()
    assert [(e["current"], e["total"]) for e in events if e["type"] == "node_progress"] == [(1, 3), (2, 3), (3, 3), (1, 1)]
    assert '"out":"A B C"' in next(e["results"] for e in events if e["type"] == "flow_complete")
    cached = run(one("text-uppercase", text="@p_name"), df, cache={"out": {"result": "held"}}).events("id").filter("node_id = 'out' and type = 'node_complete'")
    assert {e["id"]: e["cached"] for e in cached.collect()} == {1: True, 2: False}


def test_item_cap_is_a_parameter_and_warns(spark):
    nodes = (col("l"), Node("each", "for-each-start", {"max_items": 2}), Node("up", "text-uppercase"), Node("all", "for-each-end"))
    r = run(Flow(nodes, (wire("l", "each", "items"), wire("each", "up", "text", "output_1"), wire("up", "all", "items"))), spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "id long, l array<string>"))
    assert {x["id"]: x["all"] for x in r.project([OutputRef("all", "all")], ("id",)).collect()} == {1: ["A", "B"], 2: ["D"]}
    assert [(e["id"], e["error"]) for e in r.events("id").filter("type = 'runtime_warning'").collect()] == [(1, "the first 2 of 3 items are taken")]


def test_events_of_stopped_batches(spark):
    r = run(one("text-uppercase", text="@t"), spark.createDataFrame([("a",), ("b",)], "t string"))
    control = Control(spark)
    outcome = control.run(lambda: spark.range(10**13).selectExpr("max(id % 7)").collect(), timeout=1.0)
    told = r.stopped_events("t", outcome).collect()
    assert {(e["type"], e["timeout_seconds"]) for e in told} == {("flow_timeout", 1.0)} and len(told) == 2 and told[0]["elapsed_seconds"] >= 1
    done = Control(spark).run(lambda: 1)
    assert r.stopped_events("t", done).count() == 0


def test_compounds_of_ones_own(spark):
    """A compound that runs its body once for the largest item of a list."""
    from rillway.functions.expression import Value
    from rillway.plans.lower import Handle, Placed
    from rillway.registry import Input, Operator, Output

    def largest(lowering, region, env, df):
        start = lowering.compiled.flow.by_id[region.start]
        live, none = lowering.live(start, env), F.lit(None).cast("string")
        items = lowering.inputs(start, env)[0]["items"]
        item = Placed({"result": Handle(Value(F.array_max(items.column), items.kind.elementType), live)}, live, none)
        value = lowering._slots(region, lowering._body(region, {**env, region.start: item}))[0].value
        return df, item, Placed({"result": Handle(value, live)}, live, none)

    registry = standard()
    registry.add(Operator("largest-start", inputs=(Input("items", "list[float]"),), outputs=(Output("result", "float"),), region="largest", ends="largest-end", compound=largest))
    registry.add(Operator("largest-end", inputs=(Input("item", "any"),), region="largest-end"))
    nodes = (col("l"), Node("go", "largest-start"), Node("twice", "math-multiply", {"b": 2}), Node("stop", "largest-end"), Node("out", "math-add", {"b": 1}))
    edges = (wire("l", "go", "items"), wire("go", "twice", "a"), wire("twice", "stop", "item"), wire("stop", "out", "a"))
    r = run(Flow(nodes, edges), spark.createDataFrame([([1.0, 5.0, 2.0],), ([3.0],)], "l array<double>"), registry)
    assert sorted(x["out"] for x in r.project([OutputRef("out", "out")]).collect()) == [7.0, 11.0]


def test_patterns_in_columns(spark):
    df = spark.createDataFrame([("a1 b2", r"([a-z])(\d)"), ("a1 b2", r"[(a-z]\d"), ("x", r"(?P<w>y)")], "t string, p string").coalesce(1)
    r = run(one("regex", text="@t", pattern="@p"), df)
    assert [tuple(x) for x in r.runs.select(r.column("out", "output_1"), r.column("out", "output_2"), r.column("out", "output_3")).collect()] == [("a1", ["a", "1"], True), ("a1", [], True), ("", [], False)]
    every = run(one("regex-extract", text="@t", pattern="@p"), df)
    assert [x["out"] for x in every.project([OutputRef("out", "out")]).collect()] == [["a", "b"], ["a1", "b2"], []]


def test_correlations_join_by_their_equalities(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, None, "c")], "k int, user int, tag string")
    signals = spark.createDataFrame([("go", (10, 5.0, "a")), ("go", (20, 1.0, "x")), ("go", (None, 9.0, "c")), ("no", (10, 5.0, "a")), ("go", (10, None, "a"))], "signal_name string, payload struct<user_id: long, value: double, tag: string>")
    waiting = run(Flow((Node("hold", "signal-wait", {"signal_name": "go"}),)), rows).waiting("hold")
    met = lambda c: sorted(((r["k"] is None, r["k"], r["response"]["value"]) for r in match_signals(waiting, signals, "k", c).collect()), key=str)
    plan = lambda c: match_signals(waiting, signals, "k", c)._jdf.queryExecution().optimizedPlan().toString()
    both = "user_id == run.user && value > 2 && run.tag == tag"
    assert met(both) == [(False, 1, 5.0), (True, None, 9.0)]
    joined = next(line for line in plan(both).splitlines() if line.lstrip(" +-:").startswith("Join"))
    assert joined.count("<=>") == 2
    assert met("1 / (value - 5) > 0 && signal.user_id == run.user") == [(True, None, 9.0)]  # where it fails nothing matches
    assert len(met(None)) == 3 * 4 and len(met("value > 2 || tag == run.tag")) == 7
    assert met("missing == run.user") == [] and met("user_id == run.tag") == []


def test_a_slow_attempt_is_ended(spark, tmp_path):
    """At its limit an attempt's process ends: it does nothing more beside the next; other calls of its worker go on."""
    registry, place = standard(), str(tmp_path)

    @registry.node("slow", timeout=0.5, max_retries=1, retry_delay=0.0)
    def slow(text: str, store=None) -> str:
        store.set("seen", text)
        if text == "stuck":
            time.sleep(2)
            open(f"{place}/done", "a").close()
        if text == "bad":
            raise ValueError("bad text")
        return text.upper()

    flow = Flow((col("t"), Node("s", "slow")), (wire("t", "s", "text"),))
    df = spark.createDataFrame([("a",), ("stuck",), ("bad",), ("b",)], "t string").coalesce(1)
    r = run(flow, df, registry)
    got = {x["t"]: (x["out"], x["fault"], x["seen"]) for x in r.runs.select("t", r.column("s").alias("out"), r.lowering.env["s"].fault.alias("fault"), F.col("store")["seen"].alias("seen")).collect()}
    assert (got["a"], got["b"]) == (("A", None, "a"), ("B", None, "b"))
    assert got["stuck"][:2] == (None, "TimeoutError: took over 0.5 s") and got["bad"][:2] == (None, "ValueError: bad text")
    time.sleep(2)
    assert not (tmp_path / "done").exists()


def test_slow_attempts_are_dealt_over_tasks_and_wait_side_by_side(spark):
    registry = standard()

    @registry.node("stuck", timeout=0.5)
    def stuck(key: int) -> int:
        if key % 2 == 0:
            time.sleep(60)
        return key

    flow = Flow((col("id"), Node("s", "stuck")), (wire("id", "s", "key"),))
    began = time.time()
    r = run(flow, spark.range(160, numPartitions=1), registry)
    got = {x["id"]: (x["out"], x["fault"]) for x in r.runs.select("id", r.column("s").alias("out"), r.lowering.env["s"].fault.alias("fault")).collect()}
    assert time.time() - began < 30  # one after another the 80 limits alone take 40 s
    assert got == {k: (k, None) if k % 2 else (None, "TimeoutError: took over 0.5 s") for k in range(160)}
    assert len(r.runs.inputFiles()) > 1


def test_attempts_that_work_have_the_task_to_themselves():
    from rillway.plans.python import runner, side_by_side

    def act(how: str) -> str:
        began = time.process_time()
        while how == "work" and time.process_time() - began < 0.15:
            pass
        time.sleep({"nap": 0.3, "stuck": 60}.get(how, 0))
        if how == "bad":
            raise ValueError("bad text")
        return how.upper()

    def told(*hows):
        held = []
        steps = runner(act, ["how"], set(), {"result": T.StringType()}, 1, 0.01, 1.0, held)
        try:
            return [(x["result"], x["fault_"], x["attempts_"]) for x in side_by_side(steps(True, None, how) for how in hows)], len(held)
        finally:
            for a in held:
                a.end()

    assert told(*["work"] * 6) == ([("WORK", None, 1)] * 6, 1)
    made, processes = told(*["nap", "stuck", "bad", "a"] * 3)
    assert made == [("NAP", None, 1), (None, "TimeoutError: took over 1 s", 2), (None, "ValueError: bad text", 2), ("A", None, 1)] * 3 and processes > 2


def test_deadlines_of_runs(spark):
    registry = standard()

    @registry.node("nap", max_retries=3, retry_delay=0.01)
    def nap(seconds: float) -> float:
        time.sleep(seconds)
        return seconds

    flow = Flow((col("x"), Node("first", "nap"), Node("then", "nap")), (wire("x", "first", "seconds"), wire("first", "then", "seconds")))
    now = time.time()
    df = spark.createDataFrame([(1, 0.0, now + 3600), (2, 600.0, now + 12), (3, 0.0, now - 1), (4, 0.0, None)], "k int, x double, at double").withColumn("until", F.timestamp_seconds("at"))
    r = run(flow, df, registry, deadline="until")
    last = {e["k"]: e for e in r.events("k").filter("type LIKE 'flow%'").collect()}
    assert {k: e["type"] for k, e in last.items()} == {1: "flow_complete", 2: "flow_timeout", 3: "flow_timeout", 4: "flow_complete"}
    assert last[2]["completed"] == ["x"] and last[2]["error"] == "first: TimeoutError: the run's time is over"
    assert time.time() - now < 120
