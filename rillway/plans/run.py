"""Running a flow over a table of runs: results, projection, events, compensation, pausing and resuming."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions import expression
from rillway.functions.expression import Value
from rillway.model import Flow, FlowError
from rillway.operators.standard import standard
from rillway.plans import events as E
from rillway.plans.compile import Compiled, compile_flow
from rillway.plans.control import Outcome
from rillway.plans.events import EVENT
from rillway.plans.lower import LATE, STORE, Handle, Lowering, Placed, literal
from rillway.registry import Registry
from rillway.tables import cut


@dataclass(frozen=True)
class OutputRef:
    """A projected column: its name, and the node and handle it shows."""

    name: str
    node_id: str
    handle: str = "result"


class Result:
    """The runs that reached the end (`runs`), and those that wait (`waiting`), with what later steps need."""

    def __init__(self, lowering: Lowering, runs: DataFrame, rows: DataFrame | None = None):
        self.lowering, self.rows = lowering, runs if rows is None else rows
        self.compiled: Compiled = lowering.compiled
        self._runs = runs

    @property
    def runs(self) -> DataFrame:
        """The runs' rows. With Python operators they become a table when first asked for, so that however many results
        are read, effects happen once."""
        self._runs = self.lowering.settled(self._runs)
        return self._runs

    def column(self, node_id: str, handle: str = "result") -> Column:
        """A handle's value; null where it is not live."""
        h = self.lowering.env[node_id].handle(handle)
        return F.when(h.live, h.value.column)

    def live(self, node_id: str, handle: str = "result") -> Column:
        return F.coalesce(self.lowering.env[node_id].handle(handle).live, F.lit(False))

    def _own(self) -> dict[str, Placed]:
        return {i: p for i, p in self.lowering.env.items() if i in self.lowering.done or i in self.compiled.managed or p.handles}

    def project(self, outputs: list[OutputRef], keep: tuple[str, ...] = ()) -> DataFrame:
        return self.runs.select(*keep, *[self.column(o.node_id, o.handle).alias(o.name) for o in outputs])

    def summary(self, keep: tuple[str, ...] = ()) -> DataFrame:
        """keep, status (complete or failed), error (the first failed node's id, in a loop its body's, and fault),
        completed (node ids in order)."""
        env = self._own()
        error = self._error(env)
        return self.runs.select(*keep, F.when(error.isNull(), "complete").otherwise("failed").alias("status"), error.alias("error"), self.completed().alias("completed"))

    def _error(self, env: dict[str, Placed]) -> Column:
        faults = [p.told(i) for i, p in env.items() if not p.safe and self.lowering._stops(i)]
        return F.coalesce(*faults) if faults else F.lit(None).cast("string")

    def completed(self) -> Column:
        marks = [F.when(p.live & p.fault.isNull(), F.lit(i)) for i, p in self._own().items()]
        return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")

    def events(self, key: str) -> DataFrame:
        """key, seq and the fields of EVENT: what happened in each run, node by node, in one pass.

        Nodes give node_start (with their idempotency key), node_retry for each further attempt (attempt, max_retries,
        delay and the error it follows), runtime_warning (error, the code `warning`, and the lengths as payload), node_progress
        of a loop's end for each round that ended well (current, total), and node_complete (result, cached) or node_error
        (error, is_validation, is_timeout); or node_skipped. The run gives flow_complete (results) or flow_error (error,
        is_validation, completed) or, if its own deadline had passed, flow_timeout (completed). If the run was traced (run(..., trace=True)), the events of the nodes in a loop's
        rounds come before the round's progress.
        """
        env = self._own()
        parts = []
        for i, p in env.items():
            start = {"idempotency_key": p.handle("idempotency_key").value.column} if "idempotency_key" in p.handles else {}
            parts.append(self.lowering.story(i, p, self.lowering.calls(i), **start))
        error = self._error(env)
        held = {i: h for i, p in env.items() if (h := p.handles.get("result") or p.handles.get("output_1"))}
        results = {"results": F.to_json(F.struct(*[F.when(h.live, h.value.column).alias(i) for i, h in held.items()]))} if held else {}
        late = F.coalesce(F.endswith(error, F.lit(LATE)), F.lit(False))
        last = F.when(late, E.event("flow_timeout", completed=self.completed(), error=error)).when(error.isNotNull(), E.event("flow_error", completed=self.completed(), **E.wrong(error))).otherwise(E.event("flow_complete", **results))
        rows = self.runs.select(key, F.posexplode(F.concat(*parts, F.array(last))).alias("seq", "e"))
        return rows.select(key, "seq", "e.*")

    def stopped_events(self, key: str, outcome: Outcome) -> DataFrame:
        """key and the fields of EVENT: flow_timeout (elapsed_seconds, timeout_seconds) or flow_cancelled for each run of a
        batch that a deadline or a cancellation stopped; nothing if it was complete. Reads only the runs' own columns."""
        kind = {"timeout": "flow_timeout", "cancelled": "flow_cancelled"}.get(outcome.status)
        given = {"type": F.lit(kind), "elapsed_seconds": F.lit(outcome.elapsed_seconds), "timeout_seconds": F.lit(outcome.timeout_seconds if kind == "flow_timeout" else None)}
        fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields]
        return self.rows.filter(F.lit(kind is not None)).select(key, *fields)

    def pauses(self, key: str) -> DataFrame | None:
        """key, type (signal_waiting or flow_paused), node_id, wait (JSON): the runs that stopped; None if no node can."""
        out = None
        for w in self.waits:
            kind = "signal_waiting" if w.kind == "signal" else "flow_paused"
            rows = w.rows.select(key, F.lit(kind).alias("type"), F.lit(w.node_id).alias("node_id"), F.to_json(F.col(f"`{self.lowering.prefix}{w.node_id}__wait`")).alias("wait"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def undo_events(self, key: str) -> DataFrame:
        """key, step, type, node_id, compensation_node_id, result, error: compensation_start and how it ended."""
        done = self.undo(key)
        ended = F.when(F.col("error").isNull(), "compensation_complete").otherwise("compensation_failed")
        return done.withColumn("type", F.explode(F.array(F.lit("compensation_start"), ended))).select(key, "step", "type", "node_id", "compensation_node_id", "result", "error")

    def compensation(self, key: str) -> DataFrame:
        """key, step, node_id, compensation_node_id, original_inputs, original_output: what failed runs must undo.

        Completed nodes that name a compensation, last first; skipped and failed nodes have nothing to undo.
        """
        return self._to_undo(key).select(key, "step", "node_id", "compensation_node_id", "original_inputs", "original_output")

    def _to_undo(self, key: str, *more: Column) -> DataFrame:
        flow = self.compiled.flow
        env = self._own()
        broken = self._error(env).isNotNull()
        steps = []
        for n in reversed([n for layer in self.compiled.order for n in layer if n.compensation and n.id in env]):
            p = env[n.id]
            inputs, _ = self.lowering.inputs(n, self.lowering.env)
            given = F.to_json(F.struct(*[v.column.alias(k) for k, v in inputs.items() if not isinstance(v.kind, T.NullType)]))
            step = F.struct(F.lit(n.id).alias("node_id"), F.lit(n.compensation).alias("compensation_node_id"), given.alias("original_inputs"), F.to_json(F.struct(p.handle("result").value.column.alias("result"))).alias("original_output"))
            steps.append(F.when(p.live & p.fault.isNull(), step))
        none = F.array().cast("array<struct<node_id: string, compensation_node_id: string, original_inputs: string, original_output: string>>")
        held = self.runs.filter(broken).select(key, *more, (F.array_compact(F.array(*steps)) if steps else none).alias("steps"))
        rows = held.select(*[c for c in held.columns if c != "steps"], F.posexplode("steps").alias("step", "s"))
        return rows.select(*[c for c in rows.columns if c != "s"], "s.*")

    def undo(self, key: str) -> DataFrame:
        """The compensation steps carried out: each step's operator gets original_inputs, original_output and
        target_node_id besides its own data, and the run's store. A step that fails is reported and the others go on (key,
        step, node_id, compensation_node_id, result, error).

        With Python operators there is a pass for each step, and a table after it: the last completed node of all runs is
        undone before the one before it, so effects come in reverse order of completion. The passes run when undo is
        called, once. Native operators have no effects; theirs is one lazy pass.
        """
        names = sorted({n.compensation for n in self.compiled.flow.nodes if n.compensation})
        found = [self.compiled.registry.get(self.compiled.flow.by_id[n].type) for n in names]
        shown = (key, "step", "node_id", "compensation_node_id", "result", "error")
        if all(op.fn is None or op.expr is not None for op in found):
            return self._undone(self._to_undo(key), names, key).select(*shown)
        more = [F.monotonically_increasing_id().alias("_run")]
        stores = any("store" in inspect.signature(op.fn).parameters for op in found if op.fn is not None)
        if stores:
            more.append(F.col("store") if "store" in self.runs.columns else F.create_map().cast(STORE).alias("store"))
        plan = cut(self._to_undo(key, *more))
        passes, store = [], None
        for step in range(sum(1 for n in self.compiled.flow.nodes if n.compensation)):
            rows = plan.filter(F.col("step") == step)
            if rows.isEmpty():
                break
            if store is not None:
                rows = rows.drop("store").join(store, "_run")
            passes.append(cut(self._undone(rows, names, key)))
            store = passes[-1].select("_run", "store") if stores else None
        if not passes:
            return self._undone(plan, names[:1], key).select(*shown)
        return reduce(DataFrame.unionByName, [p.select(*shown) for p in passes])

    def _undone(self, plan: DataFrame, names: list[str], key: str) -> DataFrame:
        """A plan's rows with result and error of their compensation nodes."""
        parts = []
        kept = [c for c in plan.columns if c not in ("original_inputs", "original_output")]
        for name in names:
            node = self.compiled.flow.by_id[name]
            op = self.compiled.registry.get(node.type)
            given = {k: Value(F.col(c), T.StringType()) for k, c in (("original_inputs", "original_inputs"), ("original_output", "original_output"), ("target_node_id", "node_id")) if op.input(k) or op.dynamic_handles}
            flow = Flow((replace(node, on_error="continue", data={**node.data, **given}),))
            done = run(flow, plan.filter(F.col("compensation_node_id") == name), self.compiled.registry)
            value = done.lowering.env[name]
            parts.append(done.runs.select(*kept, F.to_json(F.struct(value.handle("result").value.column.alias("result"))).alias("result"), value.fault.alias("error")))
        if not parts:
            parts = [plan.select(*kept, F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"))]
        return reduce(DataFrame.unionByName, parts)

    @property
    def waits(self):
        return self.lowering.waits

    def waiting(self, node_id: str) -> DataFrame:
        """The checkpoint of the runs that wait at a node: their rows with all results so far, and `wait`."""
        found = next((w for w in self.waits if w.node_id == node_id), None)
        if found is None:
            raise FlowError(f"no run waits at {node_id}")
        return found.rows.withColumnRenamed(f"{self.lowering.prefix}{node_id}__wait", "wait")

    def resume(self, node_id: str, responses: DataFrame, key: str, checkpoint: DataFrame | None = None) -> Result:
        """Go on with the runs that have a response (key, response): it is the waiting node's result.

        checkpoint: the waiting rows if they were written and read again; else those of this result.
        """
        wait = next(w for w in self.waits if w.node_id == node_id)
        rows = checkpoint if checkpoint is not None else self.waiting(node_id)
        rows = rows.drop("wait").join(responses.select(key, F.col("response").alias("_response")), key)
        kind = dict((f.name, f.dataType) for f in rows.schema.fields)["_response"]
        lowering = replace(self.lowering, env={i: p for i, p in self.lowering.env.items() if i in wait.after}, waits=[], done=set(wait.after))
        answered = Placed({"result": Handle(Value(F.col("_response"), kind), F.lit(True))}, F.lit(True), F.lit(None).cast("string"))
        columns, lowering.env[node_id] = lowering.store_in(node_id, answered)
        old = [c for c in rows.columns if c.startswith(f"{lowering.prefix}{node_id}__")]
        rows = rows.drop(*old).select("*", *columns).drop("_response")
        return Result(lowering, lowering.rows(rows))


#: Parts over which the signals of a name are dealt where the correlation has no equality to join by.
SIGNAL_PARTS = 32


def match_signals(waiting: DataFrame, signals: DataFrame, key: str, correlation: str | None = None, payload: str = "payload", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, response and the columns `carry` of signals: each waiting run with the payloads of signals of its name whose
    correlation holds.

    signals: signal_name and a payload struct (or more columns). The correlation is an expression over the payload's
    fields (also `signal`, the payload itself); `run` is the waiting row. What it asks to be equal of the payload and of the
    run is joined by, beside the name; the rest is asked of what meets. Without such equalities the signals of a name are
    dealt over parts, to each of which its runs are sent. A correlation that fails, for a row or for the payload's shape,
    matches nothing.
    """
    names = waiting.select(key, F.col("wait.signal_name").alias("_name"), F.struct(*[F.col(f"`{c}`") for c in waiting.columns if c != "wait"]).alias("run"))
    told = signals.select(F.col("signal_name").alias("_signal"), F.col(payload).alias("_payload"), *[F.col(c).alias(f"_with_{c}") for c in carry])
    pairs, test = [], F.lit(True)
    if correlation:
        held = signals.schema[payload].dataType
        of_signal = {f.name: Value(F.col(f"_payload.`{f.name}`"), f.dataType) for f in held.fields} | {"signal": Value(F.col("_payload"), held)}
        of_run = {"run": Value(F.col("run"), names.schema["run"].dataType)}
        try:
            pairs = expression.equalities(correlation, of_run, of_signal)
            test = expression.checked_condition(correlation, {**of_signal, **of_run})[0]
        except expression.ExpressionError:
            test = F.lit(False)
    for i, (a, b) in enumerate(pairs):
        names, told = names.withColumn(f"_a{i}", a.column), told.withColumn(f"_b{i}", b.column)
    if not pairs:
        names = names.withColumn("_a0", F.explode(F.sequence(F.lit(0), F.lit(SIGNAL_PARTS - 1))))
        told = told.withColumn("_b0", F.pmod(F.xxhash64("_payload"), F.lit(SIGNAL_PARTS)).cast("int"))
    met = F.col("_name") == F.col("_signal")
    for i in range(max(1, len(pairs))):
        met = met & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    return names.join(told, met).filter(test).select(key, F.col("_payload").alias("response"), *[F.col(f"_with_{c}").alias(c) for c in carry])


def run(flow: Flow, df: DataFrame, registry: Registry | None = None, *, key: str | None = None, flows: dict[tuple[str, int], Flow] | None = None, strict: bool = False, on_fault: str = "column", cache: dict[str, dict[str, str]] | None = None, store: dict[str, Any] | None = None, context: dict[str, Any] | None = None, trace: bool = False, deadline: str | None = None) -> Result:
    """Lower a flow over df (one row, one run). Nothing is computed until a result is asked for.

    key: a column that names the run, for loops with Python operators. on_fault: `column` keeps a bad row as a row
    with an error, `raise` fails the job. cache: node id to {handle: column of df}; where the column isn't null the
    node's own result isn't used. store and context: values that guards see as store.x and context columns. trace: keep
    the events of the nodes inside loops. deadline: a column of df with the time at which the run must have ended; Python
    operators of a run whose time is over are stopped and the run ends as timed out.
    """
    compiled = compile_flow(flow, registry or standard(), strict, flows)
    for name, value in (context or {}).items():
        df = df.withColumn(name, literal(value).column)
    if store:
        df = df.withColumn("store", literal(store).column)
    lowering = Lowering(compiled, key=key, on_fault=on_fault, cache=cache or {}, trace=trace, deadline=deadline)
    return Result(lowering, lowering.rows(df), df)


def idempotent(df: DataFrame, flow_expression: str, scope_columns: dict[str, str] | None = None, name: str = "idempotency_key") -> DataFrame:
    """df with its idempotency key, one row for each key (a batch's repeated requests count once; a request whose key
    can't be evaluated has a null key and counts for itself)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    scope = {n: Value(F.col(f"`{c}`"), kinds[c]) for n, c in (scope_columns or {c: c for c in df.columns}).items()}
    held, fault = expression.checked(flow_expression, scope)
    keyed = df.withColumn(name, held.column.cast("string"))
    own = F.when(fault.isNotNull(), F.expr("uuid()"))
    return keyed.withColumn("_own", own).dropDuplicates([name, "_own"]).drop("_own")
