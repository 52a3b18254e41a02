"""Flows over small tables: checks, branches, loops, errors, pauses, sub-flows, files."""

import json

import pytest
from pyspark.sql import functions as F

from rillway import queries
from rillway.model import CompilationError, Dependency, Edge, Flow, FlowError, Node, Trigger, layers
from rillway.operators.standard import standard
from rillway.plans.compile import compile_flow, status
from rillway.plans.lower import SKIPPED, connection_labels
from rillway.plans.run import OutputRef, match_signals, run
from rillway.queries import col, count_flow, greeting, one, wire, word_loop
from rillway.registry import Actor, Category, Operator, Output, Registry, operator_of, seconds
from rillway.sources import files, tables
from rillway.types import compatible, name_of, spark_type, type_name
from rillway.widgets import WIDGETS, widget


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a bb c", 5.0), (2, "", 0.0), (3, None, None)], "id int, words string, x double")


def show(result, *refs):
    return [tuple(r) for r in result.project([OutputRef(f"o{i}", *ref.split(".")) for i, ref in enumerate(refs)], ("id",)).orderBy("id").collect()]


# -- checks


@pytest.mark.parametrize(("flow", "said"), [
    (Flow((Node("a", "nope"),)), "unknown operator"),
    (Flow((Node("a", "text"), Node("a", "text"))), "used twice"),
    (Flow((Node("a", "text"),), (Edge("e", "a", "b"),)), "no node b"),
    (Flow((Node("a", "text-trim"), Node("b", "text-trim")), (wire("a", "b", "text"), wire("b", "a", "text"))), "cycle"),
    (Flow((Node("a", "text", on_error="shrug"),)), "error policy"),
    (Flow((Node("a", "text", compensation="z"),)), "compensation"),
    (Flow((Node("a", "text-trim", consumes={"text": ("z", "result")}),)), "consumes from unknown"),
    (Flow((Node("a", "text"), Node("b", "text-trim")), (Edge("e", "a", "b", None, "text", "true"),)), "no decision"),
    (Flow((Node("a", "decision", {"value": 1}),)), "else edge"),
    (Flow((Node("a", "decision", {"value": 1}), Node("b", "text"), Node("c", "text")), (Edge("g", "a", "b", when="1 +"), Edge("e", "a", "c"))), "edge g"),
    (Flow((Node("a", "for-each-start"),)), "matching"),
])
def test_problems(flow, said):
    with pytest.raises(CompilationError, match=said):
        compile_flow(flow, standard())
    assert status(flow, standard())["status"] == "error"


def test_uses_need_a_declaration():
    registry = standard()
    registry.add(Operator("pay", uses=("bank",), expr=lambda i: None))
    with pytest.raises(CompilationError, match="bank"):
        compile_flow(Flow((Node("a", "pay"),), dependencies=(Dependency("db", "sql"),)), registry)


def test_type_warnings_become_errors_when_strict():
    flow = Flow((Node("a", "make-list", {"text": "1"}), Node("b", "math-abs")), (wire("a", "b", "value"),))
    assert compile_flow(flow, standard()).warnings
    with pytest.raises(CompilationError):
        compile_flow(flow, standard(), strict=True)


@pytest.mark.parametrize(("a", "b", "ok"), [("int", "float", True), ("int", "str", True), ("str", "int", False), ("str", "list[str]", True), ("list[int]", "int", True), ("dict[str, int]", "dict", True), ("any", "int", True), ("str | int", "int", True), ("list[float | int]", "bool", True), ("str", "date", False)])
def test_compatible(a, b, ok):
    assert compatible(a, b) is ok


def test_type_names():
    assert [type_name(t) for t in (str, list[int], dict[str, float], int | None, str | int, tuple[int, str])] == ["str", "list[int]", "dict[str, float]", "int", "str | int", "tuple[int, str]"]
    assert spark_type("list[int]").simpleString() == "array<bigint>" and name_of(spark_type("dict[str, float]")) == "dict[str, float]"


def test_order_follows_declaration():
    nodes = [Node(i, "text") for i in "cab"]
    assert [[n.id for n in layer] for layer in layers(nodes, [Edge("e", "a", "c")])] == [["a", "b"], ["c"]]


# -- running


def test_null_and_empty(rows):
    r = run(one("text-uppercase", text="@words"), rows)
    assert show(r, "out") == [(1, "A BB C"), (2, ""), (3, None)]


def test_precedence(rows):
    flow = Flow((col("words"), Node("which", "decision", consumes={"value": ("words", "result")}), Node("edge", "text-uppercase"), Node("other", "text"), Node("out", "text-trim", {"text": "stated"})),
                (Edge("g", "which", "edge", None, "text", "size(value) > 0", 1), Edge("e", "which", "other"), wire("edge", "out", "text"), Edge("c", "other", "out")))
    assert show(run(flow, rows.filter("id < 3")), "out") == [(1, "A BB C"), (2, "stated")]


def test_loop_edges(rows):
    loop = word_loop((Node("up", "text-uppercase"),), (wire("each", "up", "text", "output_1"),), ("up", None))
    named = rows.withColumn("p_name", F.col("words"))
    assert show(run(loop, named), "out")[:2] == [(1, "A BB C"), (2, "")]


def test_empty_table(rows):
    assert show(run(queries.count_flow("iteration < 2"), rows.filter("false")), "stop") == []


def test_runaway_and_failed_runs(rows):
    got = run(count_flow("true", most=3), rows).summary(("id",)).collect()
    assert {r["status"] for r in got} == {"failed"} and "ran away" in got[0]["error"]


def test_loop_cap(spark):
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1005)), lambda x: x.cast("string")), " ").alias("p_name"))
    loop = word_loop((Node("up", "text-uppercase"),), (wire("each", "up", "text", "output_1"),), ("up", None))
    r = run(loop, df)
    assert r.runs.select(F.size(r.column("all"))).first()[0] == 1000


def test_nested_loops(rows):
    nodes = (col("words"), Node("cut", "text-split", {"separator": " "}), Node("a", "for-each-start"), Node("letters", "regex-extract", {"pattern": "."}), Node("b", "for-each-start"), Node("up", "text-uppercase"), Node("b2", "for-each-end"), Node("glue", "text-join", {"separator": "."}), Node("a2", "for-each-end"), Node("out", "text-join", {"separator": " "}))
    edges = (wire("words", "cut", "text"), wire("cut", "a", "items"), wire("a", "letters", "text", "output_1"), wire("letters", "b", "items"), wire("b", "up", "text", "output_1"), wire("up", "b2", "items"), wire("b2", "glue", "parts"), wire("glue", "a2", "items"), wire("a2", "out", "parts"))
    assert show(run(Flow(nodes, edges), rows.filter("id = 1")), "out") == [(1, "A B.B C")]


def test_truncation_is_told(rows):
    nodes = (Node("a", "make-list", {"text": "1,2,3"}), Node("b", "make-list", {"text": "x,y"}), Node("each", "for-each-start"), Node("pair", "text-concat"), Node("all", "for-each-end"))
    edges = (wire("a", "each", "items"), wire("b", "each", "items"), wire("each", "pair", "a", "output_1"), wire("each", "pair", "b", "output_3"), wire("pair", "all", "items"))
    r = run(Flow(nodes, edges), rows.limit(1))
    row = r.runs.select(r.column("all"), r.column("each", "truncated")).first()
    assert row[0] == ["1x", "2y"] and "unequal" in row[1]


def python_registry():
    registry = standard()

    @registry.node("flaky", max_retries=2, retry_delay=0.0)
    def flaky(text: str) -> str:
        import os

        mark = f"/tmp/rillway-flaky-{os.getppid()}-{text}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("once")
        os.remove(mark)
        return text + "!"

    @registry.node("slow", timeout=0.1)
    def slow(text: str) -> str:
        import time

        time.sleep(1)
        return text

    @registry.node("halves")
    def halves(text: str) -> tuple[str, str]:
        return (text, SKIPPED) if text else (SKIPPED, text)

    @registry.node("charge", idempotency_key="'ch-' + amount")
    def charge(amount: int, idempotency_key: str = "") -> str:
        return f"{idempotency_key}={amount}"

    return registry


def test_python_operators(rows):
    two = rows.filter("id < 3")
    assert show(run(one("flaky", text="@words"), rows.filter("id = 1"), python_registry()), "out") == [(1, "a bb c!")]
    got = run(one("slow", text="@words"), two, python_registry()).summary(("id",)).collect()
    assert all("took over" in r["error"] for r in got)
    r = run(one("halves", text="@words"), two, python_registry())
    assert [tuple(x) for x in r.runs.select(r.live("out", "output_1"), r.live("out", "output_2")).collect()] == [(True, False), (False, True)]
    r = run(one("charge", amount="@id"), two, python_registry())
    assert show(r, "out") == [(1, "ch-1=1"), (2, "ch-2=2")]


def test_python_loop_bodies(rows):
    registry = standard()

    @registry.node("next")
    def following(n: int) -> int:
        return n * 10

    nodes = (Node("go", "while-start", {"condition": "iteration < 3"}), Node("body", "next"), Node("stop", "while-end"))
    r = run(Flow(nodes, (wire("go", "body", "n", "output_1"), wire("body", "stop", "item"))), rows.limit(1), registry)
    assert r.runs.select(r.column("go", "output_1"), r.column("stop")).first()[:] == (3, 30)


def test_class_operator(rows):
    class Twice:
        base_id = "twice"

        def execute(self, inputs):
            return inputs["text"] * 2

    registry = standard()
    registry.register_class(Twice, outputs=(Output("result", "str"),))
    assert show(run(one("twice", text="@words"), rows.filter("id = 1"), registry), "out") == [(1, "a bb ca bb c")]


def test_raise_mode(rows):
    with pytest.raises(Exception, match="division by zero"):
        run(one("math-divide", a=1.0, b="@x"), rows, on_fault="raise").runs.collect()


def test_recursive_sub_flows_are_refused(rows):
    again = Flow((Node("call", "subprocess-call", {"flow_id": "again"}),), id="again")
    with pytest.raises(CompilationError, match="deep"):
        run(again, rows, flows={("again", 1): again})
    assert show(run(Flow((Node("c", "subprocess-call", {"flow_id": "greeting", "inputs": {"value": "you"}}),)), rows.limit(1), flows={("greeting", 1): greeting()}), "c")[0][1]["hi"] == "hello you"


def test_checkpoint_survives_a_table(rows, tmp_path):
    flow = Flow((col("words"), Node("ask", "human-input", {"prompt": "?"}), Node("out", "text-concat", {"separator": ":"})), (Edge("c", "words", "ask"), wire("words", "out", "a"), wire("ask", "out", "b")))
    first = run(flow, rows)
    assert first.runs.count() == 0
    path = str(tmp_path / "waiting")
    first.waiting("ask").write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    assert held.select("wait.prompt").distinct().collect()[0][0] == "?"
    responses = rows.sparkSession.createDataFrame([(1, "yes")], "id int, response string")
    assert show(first.resume("ask", responses, "id", held), "out") == [(1, "a bb c:yes")]


def test_signals_that_cannot_match(rows):
    waiting = run(Flow((Node("hold", "signal-wait", {"signal_name": "paid"}),)), rows).waiting("hold")
    signals = rows.select(F.lit("paid").alias("signal_name"), F.struct("id").alias("payload"))
    assert match_signals(waiting, signals, "id", "absent == 1").count() == 0
    assert match_signals(waiting, signals, "id", "id == run.id").count() == 3


# -- registry, files, metadata


def test_registry():
    registry = Registry((Operator("x", 1), Operator("x", 2)))
    assert registry.get("x").version == 2 and registry.is_deprecated("x@1") and "y" not in registry
    with pytest.raises(FlowError):
        registry.add(Operator("x", 1))
    other = Registry((Operator("x", 1), Operator("y", 1)))
    with pytest.raises(FlowError):
        registry.merge(other)
    registry.merge(other, on_conflict="skip")
    assert "y" in registry and len(registry.all_current()) == 2
    with pytest.raises(FlowError, match="x@1, y@1"):
        registry.merge(other, on_conflict="error-summary")
    assert Registry((Operator("x", 1),)).overlay(Registry((Operator("x", 1, name="mine"),))).get("x").name == "mine"
    tools = Category("tools")
    tools.node("inc")(lambda n: n + 1)
    registry.include(tools)
    assert registry.get("inc").category == "tools"


@pytest.mark.parametrize(("written", "found"), [("PT1H30M", 5400), ("P1DT0.5S", 86400.5), ("250ms", 0.25), ("2h", 7200), (3, 3.0), (None, None)])
def test_durations(written, found):
    assert seconds(written) == found


@pytest.mark.parametrize("written", ["PT0S", "soon", 0, -1])
def test_bad_durations(written):
    with pytest.raises(ValueError):
        seconds(written)


def test_palette(spark):
    palette = {d["id"]: d for d in standard().palette()}
    assert palette["text-contains@1"]["inputs"][2]["default"] is True
    assert palette["decision@1"]["is_decision"] and palette["signal-wait@1"]["is_signal"]
    assert standard().table(spark).filter("base_id = 'math-add'").count() == 1
    assert Actor.coerce({"kind": "human", "role": "clerk"}).to_dict() == {"kind": "human", "role": "clerk"}
    made = operator_of(lambda a, b=1: a, "f")
    assert [i.name for i in made.inputs] == ["a", "b"]


def test_widgets():
    assert len(WIDGETS) == 25
    assert widget("Range", min_val=1).schema()["range_min"] == 1
    with pytest.raises(ValueError):
        widget("Text", wheels=4)


def test_labels():
    assert connection_labels([("A", "out"), ("B", "out"), ("C", "x")]) == ["A (out)", "B (out)", "x"]
    assert connection_labels([("A", "out"), ("A", "out")]) == ["A (out)", "A (out)_2"]


def test_round_trips(tmp_path):
    flow = Flow((Node("a", "text", {"value": "x"}, node_label="A"), Node("b", "decision", consumes={"value": ("a", "result")}, on_error="continue"), Node("c", "text"), Node("d", "text")), (Edge("g", "b", "c", None, None, "true", 3), Edge("e", "b", "d")), "f", 2, "name", None, (Dependency("db", "sql", {"x": 1}),), (Trigger("t", "manual", {}, "$.x"),), "compensate")
    assert files.flow_from_dict(json.loads(json.dumps(files.flow_to_dict(flow)))) == flow
    assert files.flow_from_yaml(files.flow_to_yaml(flow)) == flow
    for name in ("f.json", "f.yaml"):
        files.dump(flow, tmp_path / name)
        assert files.load(tmp_path / name) == flow
    canvas = files.to_canvas(flow, {"a": {"x": 9, "y": 9}})
    assert canvas["nodes"][0]["position"] == {"x": 9, "y": 9} and canvas["nodes"][1]["position"] == {"x": 260, "y": 0}
    back = files.from_canvas({**canvas, "viewport": 1})
    assert (back.nodes, back.edges) == (flow.nodes, flow.edges)
    with pytest.raises(FlowError):
        files.load(tmp_path / "f.txt") if (tmp_path / "f.txt").write_text("") is not None else None


def test_tables(spark, tmp_path):
    df = tables.inline_table(spark, {"columns": ["a", "b"], "rows": [[1, "x"], [2]]})
    assert [tuple(r) for r in df.collect()] == [("1", "x"), ("2", None)]
    assert tables.filter_rows(df, [{"column": "a", "operator": "gt", "value": 1}]).count() == 1
    with pytest.raises(FlowError):
        tables.filter_rows(df, [{"column": "z", "operator": "gt", "value": 1}])
    (tmp_path / "x.txt").write_text("hi")
    assert tables.files(spark, str(tmp_path / "x.txt")).first()[:] == ("x.txt", "aGk=")
    payload = {"nodes": [{"id": "n", "type": "text-uppercase", "data": {"text": "a"}}], "cache": {"n": {"result": "held"}}}
    r = tables.execute(payload, spark.range(1), standard())
    assert r.runs.select(r.column("n")).first()[0] == "held"
    assert tables.check(payload, standard())["status"] == "ok"


def test_a_long_chain(spark):
    nodes = [Node("n0", "text", {"value": "x"})] + [Node(f"n{i}", "text-reverse") for i in range(1, 60)]
    r = run(Flow(tuple(nodes), tuple(wire(f"n{i}", f"n{i + 1}", "text") for i in range(59))), spark.range(1))
    assert r.runs.select(r.column("n59")).first()[0] == "x"


def test_native_flow_is_one_stage(rows):
    plan = run(queries.price_flow(), rows.select(F.col("x").alias("o_totalprice"), F.col("words").alias("o_orderpriority")))
    text = plan.project([OutputRef("out", "out")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_store_is_threaded(rows):
    registry = standard()

    @registry.node("keep")
    def keep(text: str, store) -> str:
        store.set("n", int(store.get("n", "0")) + 1)
        store.set("last", text)
        return text

    flow = Flow((col("words"), Node("a", "keep"), Node("b", "keep")), (wire("words", "a", "text"), wire("a", "b", "text")))
    r = run(flow, rows.filter("id = 1"), registry, store={"seed": "x"})
    r.runs.select(r.column("b")).collect()
    assert r.runs.select("store").first()["store"] == {"seed": "x", "n": "2", "last": "a bb c"}


def test_deadline(spark):
    from rillway.plans.control import Control

    def _sleep(batches):
        import time

        for b in batches:
            time.sleep(4)
            yield b

    slow = lambda: spark.range(0, 4, 1, 4).mapInPandas(_sleep, "id long").collect()
    assert Control(spark).run(slow, timeout=1.0).status == "timeout"
    assert Control(spark).run(lambda: 7).value == 7
    with pytest.raises(ZeroDivisionError):
        Control(spark).run(lambda: 1 / 0)


# -- faults inside loops ----------------------------------------------------------------------------------------------


def divide_loop(policy=None, start=None):
    nodes = (Node("xs", "column", {"name": "xs"}), Node("each", "for-each-start", on_error=start), Node("inv", "math-divide", {"a": 1.0}, on_error=policy), Node("all", "for-each-end"))
    return Flow(nodes, (Edge("a", "xs", "each", None, "items"), Edge("b", "each", "inv", "output_1", "b"), Edge("c", "inv", "all", None, "items")))


@pytest.mark.parametrize(("policy", "start", "status", "error", "out"), [
    (None, None, "failed", "inv: division by zero", None),
    ("continue", None, "complete", None, [1.0, None, 0.5]),
    (None, "continue", "complete", None, None),
])
def test_a_failing_item_fails_its_run(spark, policy, start, status, error, out):
    df = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [4.0]), (3, [])], "k int, xs array<double>")
    r = run(divide_loop(policy, start), df)
    got = {x["k"]: x for x in r.summary(("k",)).collect()}
    values = {x["k"]: x["out"] for x in r.runs.select("k", r.column("all").alias("out")).collect()}
    assert (got[1]["status"], got[1]["error"], values[1]) == (status, error, out)
    assert (got[2]["status"], values[2], got[3]["status"], values[3]) == ("complete", [0.25], "complete", [])
    assert ("all" in got[1]["completed"]) == (policy == "continue") and "all" in got[2]["completed"]


def test_events_of_a_failing_loop(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "k int, xs array<double>")
    events = run(divide_loop(), df, trace=True).events("k").orderBy("seq").collect()
    told = [(e["type"], e["node_id"]) for e in events]
    assert told[-7:] == [("node_start", "inv"), ("node_complete", "inv"), ("node_progress", "all"), ("node_start", "inv"), ("node_error", "inv"), ("node_error", "all"), ("flow_error", None)]
    assert [(e["current"], e["total"]) for e in events if e["type"] == "node_progress"] == [(1, 3)]
    assert events[-1]["error"] == "inv: division by zero" and events[-1]["is_validation"] is False


def test_python_bodies_fault_and_nest(spark):
    registry = standard()

    @registry.node("half")
    def half(x: float) -> float:
        if x == 3:
            raise ValueError("odd")
        return x / 2

    nodes = (Node("xss", "column", {"name": "xss"}), Node("outer", "for-each-start"), Node("inner", "for-each-start"), Node("h", "half"), Node("row", "for-each-end"), Node("all", "for-each-end"))
    edges = (Edge("a", "xss", "outer", None, "items"), Edge("b", "outer", "inner", "output_1", "items"), Edge("c", "inner", "h", "output_1", "x"), Edge("d", "h", "row", None, "items"), Edge("e", "row", "all", None, "items"))
    df = spark.createDataFrame([(1, [[2.0, 4.0], [], [6.0]]), (2, [[8.0], [3.0]]), (None, []), (None, [[2.0]])], "k int, xss array<array<double>>")
    r = run(Flow(nodes, edges), df, registry, trace=True)
    rows = sorted(map(str, r.runs.select("k", r.column("all").alias("out")).collect()))
    assert rows == sorted(["Row(k=1, out=[[1.0, 2.0], [], [3.0]])", "Row(k=2, out=None)", "Row(k=None, out=[])", "Row(k=None, out=[[1.0]])"])
    got = {x["k"]: x for x in r.summary(("k",)).filter("k IS NOT NULL").collect()}
    assert (got[1]["status"], got[2]["status"], got[2]["error"]) == ("complete", "failed", "h: ValueError: odd")
    told = [(e["type"], e["node_id"]) for e in r.events("k").filter("k = 2").orderBy("seq").collect()]
    assert told.count(("node_error", "h")) == 1 and told.count(("node_progress", "row")) == 1 and told.count(("node_progress", "all")) == 1
    assert told[-1] == ("flow_error", None)


def test_while_faults_and_nested_while(spark):
    registry = standard()

    @registry.node("spend")
    def spend(left: float, last: float = None) -> float:
        if left < 0:
            raise ValueError("broke")
        return (left if last is None else last) - 1

    nodes = (Node("x", "column", {"name": "x"}), Node("go", "while-start", {"condition": "!exists(last) || last > 0"}), Node("s", "spend"), Node("stop", "while-end"))
    edges = (Edge("a", "x", "s", None, "left"), Edge("b", "go", "s", "output_2", "last"), Edge("c", "s", "stop", None, "item"))
    df = spark.createDataFrame([(1, 3.0), (2, -1.0), (3, 0.5)], "k int, x double")
    r = run(Flow(nodes, edges), df, registry, trace=True)
    got = {x["k"]: x for x in r.summary(("k",)).collect()}
    assert (got[1]["status"], got[2]["status"], got[2]["error"], got[3]["status"]) == ("complete", "failed", "s: ValueError: broke", "complete")
    assert {x["k"]: x["out"] for x in r.runs.select("k", r.column("stop").alias("out")).collect()} == {1: 0.0, 2: None, 3: -0.5}
    told = r.events("k").filter("type = 'node_progress'").groupBy("k").count().collect()
    assert {x["k"]: x["count"] for x in told} == {1: 3, 3: 1}
    nodes = (Node("x", "column", {"name": "x"}), Node("go", "while-start", {"condition": "iteration < 3"}), Node("gap", "math-subtract"), Node("inv", "math-divide", {"a": 1.0}), Node("stop", "while-end"))
    edges = (Edge("a", "x", "gap", None, "b"), Edge("b", "go", "gap", "output_1", "a"), Edge("c", "gap", "inv", None, "b"), Edge("d", "inv", "stop", None, "item"))
    r = run(Flow(nodes, edges), spark.createDataFrame([(1, 2.0), (2, 9.0)], "k int, x double"), trace=True)
    got = {x["k"]: x for x in r.summary(("k",)).collect()}
    assert (got[1]["status"], got[1]["error"], got[2]["status"]) == ("failed", "inv: division by zero", "complete")
    told = [(e["type"], e["node_id"], e["current"]) for e in r.events("k").filter("k = 1 AND node_id IN ('inv', 'stop')").orderBy("seq").collect()]
    assert told == [("node_start", "stop", None), ("node_start", "inv", None), ("node_complete", "inv", None), ("node_progress", "stop", 1), ("node_start", "inv", None), ("node_error", "inv", None), ("node_error", "stop", None)]
