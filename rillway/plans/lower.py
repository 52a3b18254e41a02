"""Lowering: a compiled flow over a table of runs becomes one chain of selects.

Each node is a few flat columns: `<node>__v_<handle>` its values, `__l_<handle>` where a handle may be dead on its own,
`__live` (false where the branch was not taken), `__fault` (why it gave no value), for decisions `__taken`. Flat, so
that Catalyst folds what is constant and never copies what two readers share. Native nodes of one
layer share a select, which Catalyst folds with its neighbours; loops over lists are higher-order functions; Python
nodes run as Arrow-batched functions that get `live` and skip dead rows themselves.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions import expression
from rillway.functions.expression import Value
from rillway.functions.values import number, strip, text, truthy
from rillway.model import CompilationError, Edge, FlowError, Node, layers
from rillway.operators.standard import Maybe
from rillway.plans import events as E
from rillway.plans.compile import MAX_DEPTH, Compiled, Region, compile_flow, guards_of
from rillway.plans.python import LATE, SKIPPED, FlowStore, by_batch, by_row, packed, unpacked
from rillway.registry import NOTHING, Input, Operator
from rillway.tables import cut
from rillway.types import spark_type

#: Items that a loop takes of its list, and rounds that a while loop may make.
MAX_ITEMS, MAX_ROUNDS = 1000, 1000
#: Layers of native nodes that share a select.
LAYERS_AT_ONCE = 10
#: While loops are folded in blocks of so many rounds, or blocks.
ROUNDS_AT_ONCE = 10
#: Handles of loop starts that tell about the loop.
OWN_HANDLES = ("truncated", "warning", "lengths", "total")
FAN_IN = "\n\n"
STORE = T.MapType(T.StringType(), T.StringType())


@dataclass(frozen=True)
class Stated(Value):
    """A value that the flow itself states."""

    literal: Any = None


@dataclass(frozen=True)
class Handle:
    value: Value
    live: Column


@dataclass(frozen=True)
class Placed:
    """A node where later nodes can read it. named: its fault begins with the id of the node that failed, as a loop's does.
    safe: it can't fail. progress: how many of a loop's rounds ended well, and of how many; events: those of its rounds."""

    handles: dict[str, Handle]
    live: Column
    fault: Column
    taken: Column | None = None
    named: bool = False
    safe: bool = False
    progress: tuple[Column, Column] | None = None
    events: Column | None = None

    def told(self, node_id: str) -> Column:
        """The fault with the id of the node that failed; null if none did."""
        return self.fault if self.named else F.when(self.fault.isNotNull(), F.concat(F.lit(f"{node_id}: "), self.fault))

    def handle(self, name: str) -> Handle:
        if name not in self.handles and name == "result" and "output_1" in self.handles:
            name = "output_1"
        return self.handles.get(name) or Handle(Value(F.lit(None), T.NullType()), self.live)


Env = dict[str, Placed]


def literal(value: Any) -> Value:
    """A Python value as a typed column; mixed or nested containers become VARIANT."""
    if isinstance(value, Value):
        return value
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    if value is None:
        return Stated(F.lit(None), T.NullType())
    if type(value) in kinds:
        return Stated(F.lit(value).cast(kinds[type(value)]), kinds[type(value)], value)
    items = list(value.values()) if isinstance(value, dict) else list(value)
    inner = {type(x) for x in items}
    if inner == {int, float}:
        inner, items = {float}, [float(x) for x in items]
    if len(inner) == 1 and next(iter(inner)) in kinds:
        kind = kinds[next(iter(inner))]
        if isinstance(value, dict):
            return Stated(F.create_map(*[F.lit(x) for k, v in zip(value, items, strict=True) for x in (k, v)]).cast(T.MapType(T.StringType(), kind)), T.MapType(T.StringType(), kind), value)
        return Stated(F.array(*map(F.lit, items)).cast(T.ArrayType(kind)), T.ArrayType(kind), value)
    if not items:
        kind = T.MapType(T.StringType(), T.StringType()) if isinstance(value, dict) else T.ArrayType(T.StringType())
        return Stated((F.create_map() if isinstance(value, dict) else F.array()).cast(kind), kind, value)
    return Stated(F.parse_json(F.lit(json.dumps(value))), T.VariantType(), value)


def coerce(value: Value, name: str) -> tuple[Value, Column | None]:
    """The value as an input type, and where that fails the reason. Lists wrap and unwrap one level."""
    want = spark_type(name)
    have, c = value.kind, value.column
    if type(have) is type(want) and not isinstance(want, (T.ArrayType, T.MapType)) or isinstance(want, (T.VariantType, T.NullType)):
        return value, None
    made = lambda col, fault=None: (Stated(col, want, value.literal) if isinstance(value, Stated) else Value(col, want), fault)
    if isinstance(have, T.NullType):
        return made(F.lit(None).cast(want))
    if isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType):
            return (value, None) if isinstance(want.elementType, T.VariantType) else made(c.cast(want))
        if isinstance(have, T.VariantType):
            return made(F.try_variant_get(c, "$", want.simpleString()))
        return Value(F.array(c), T.ArrayType(have)), None
    if isinstance(have, T.ArrayType):
        return coerce(Value(F.get(c, F.lit(0)), have.elementType), name)
    if isinstance(want, T.MapType):
        return value, None
    if isinstance(have, T.VariantType):
        return made(F.try_variant_get(c, "$", want.simpleString()))
    if isinstance(want, T.StringType):
        return made(F.when(c.isNotNull(), text(c, have)))
    if isinstance(want, T.DoubleType) and isinstance(have, (T.IntegralType, T.FloatType)):
        return made(c.cast(want))
    if isinstance(have, T.StringType):
        cast = number(c) if isinstance(want, T.DoubleType) else strip(c).try_cast(want)
        if isinstance(want, T.BinaryType):
            cast = F.try_to_binary(c, F.lit("base64"))
        return made(cast, F.when(c.isNotNull() & cast.isNull(), F.concat(F.lit(f"not {name}: "), c)))
    return made(c.try_cast(want), F.when(c.isNotNull() & c.try_cast(want).isNull(), F.lit(f"not {name}")))


def _any(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _unify(values: list[Value]) -> list[Value]:
    """Values of one type: theirs, double for numbers, else text."""
    if len({v.kind.simpleString() for v in values}) == 1:
        return values
    if all(isinstance(v.kind, T.NumericType) for v in values):
        return [Value(v.column.cast("double"), T.DoubleType()) for v in values]
    return [Value(text(v.column, v.kind), T.StringType()) for v in values]


def connection_labels(hints: list[tuple[str, str]]) -> list[str]:
    """Map keys of a ConnectionList: output labels, with the node's name where they collide, numbered if they still do."""
    outs = [o for _, o in hints]
    named = [f"{n} ({o})" if outs.count(o) > 1 else o for n, o in hints]
    return [x if not named[:i].count(x) else f"{x}_{named[:i].count(x) + 1}" for i, x in enumerate(named)]


@dataclass
class Wait:
    """Runs that stopped at a node: their rows are the checkpoint."""

    node_id: str
    kind: str
    rows: DataFrame
    after: frozenset[str]


@dataclass
class Lowering:
    compiled: Compiled
    key: str | None = None
    prefix: str = "node_"
    depth: int = 0
    on_fault: str = "column"
    env: Env = field(default_factory=dict)
    waits: list[Wait] = field(default_factory=list)
    done: set[str] = field(default_factory=set)
    columns: dict[str, T.DataType] = field(default_factory=dict)
    cache: dict[str, Any] = field(default_factory=dict)
    effects: bool = False
    retry: dict[str, tuple[int, float]] = field(default_factory=dict)
    trace: bool = False
    deadline: str | None = None
    #: Whether the rows were dealt over the tasks for Python operators.
    dealt: bool = False
    #: Constants that are told by identity: a node whose liveness is `true` is always live, one whose fault is `none` is safe;
    #: they get no columns.
    true: Column = field(default_factory=lambda: F.lit(True))
    none: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    #: Liveness that lies in a column already, by identity: nodes that share it need none of their own.
    shared: dict[int, Column] = field(default_factory=dict)

    # -- reading inputs ------------------------------------------------------------------------------------------

    def _edge(self, e: Edge, env: Env) -> Handle:
        source = env[e.source]
        out = source.handle(e.out)
        return Handle(out.value, out.live & (source.taken == e.id) if source.taken is not None else out.live)

    def _wired(self, node: Node, spec: Input, edges: list[Edge], env: Env) -> Value:
        got = [self._edge(e, env) for e in edges]
        if spec.gathers:
            values = _unify([h.value for h in got])
            by_id = self.compiled.flow.by_id
            hints = []
            for e in edges:
                n = by_id[e.source]
                hints.append((n.node_label or self.compiled.operators[n.id].name or n.id, (n.output_labels or {}).get(e.out) or e.out))
            entries = [F.struct(F.lit(k).alias("key"), v.column.alias("value"), F.coalesce(h.live, F.lit(False)).alias("live")) for k, v, h in zip(connection_labels(hints), values, got, strict=True)]
            kept = F.transform(F.filter(F.array(*entries), lambda x: x["live"]), lambda x: F.struct(x["key"], x["value"]))
            return Value(F.map_from_entries(kept), T.MapType(T.StringType(), values[0].kind))
        if len(got) == 1:
            return got[0].value
        if spec.takes_list:
            values = _unify([h.value for h in got])
            entries = [F.struct(v.column.alias("value"), F.coalesce(h.live, F.lit(False)).alias("live")) for v, h in zip(values, got, strict=True)]
            return Value(F.transform(F.filter(F.array(*entries), lambda x: x["live"]), lambda x: x["value"]), T.ArrayType(values[0].kind))
        return Value(F.concat_ws(FAN_IN, *[F.when(h.live, text(h.value.column, h.value.kind)) for h in got]), T.StringType())

    def _specs(self, node: Node) -> list[Input]:
        specs = list(self.compiled.inputs[node.id])
        if self.compiled.operators[node.id].dynamic_handles:
            named = {i.name for i in specs}
            open_ = [e.target_handle for e in self.compiled.flow.incoming(node.id)] + list(node.data) + list(node.consumes or {})
            specs += [Input(n, optional=True) for n in dict.fromkeys(open_) if n and n not in named]
        return specs

    def inputs(self, node: Node, env: Env) -> tuple[dict[str, Value], list[Column]]:
        """An input comes from its live edges, else a consumed reference, else the node's data, else its default."""
        out, faults = {}, []
        for spec in self._specs(node):
            edges = [e for e in self.compiled.flow.incoming(node.id) if e.target_handle == spec.name]
            fallback = None
            if node.consumes and spec.name in node.consumes:
                producer, handle = node.consumes[spec.name]
                fallback = env[producer].handle(handle).value
            elif spec.name in node.data:
                fallback = literal(node.data[spec.name])
            elif spec.default is not NOTHING:
                fallback = literal(spec.default)
            if edges:
                value = self._wired(node, spec, edges, env)
                if fallback is not None and not spec.gathers:
                    wired, _ = coerce(value, spec.type)
                    other, fault = coerce(fallback, spec.type)
                    if wired.kind.simpleString() == other.kind.simpleString() or isinstance(other.kind, T.NullType):
                        value = Value(F.when(_any([self._edge(e, env).live for e in edges]), wired.column).otherwise(other.column), wired.kind)
            elif fallback is not None:
                value = fallback
            elif spec.optional:
                value = literal(None)
            else:
                raise CompilationError([f"{node.id} gets no value for {spec.name}"])
            value, fault = (value, None) if spec.gathers else coerce(value, spec.type)
            if fault is not None:
                faults.append(F.concat(F.lit(f"{E.INVALID}{spec.label or spec.name}: "), fault))
            out[spec.name] = value
        # All inputs that don't fit are named at once.
        return out, [F.nullif(F.concat_ws("; ", *faults), F.lit(""))] if faults else []

    def live(self, node: Node, env: Env) -> Column:
        incoming = self.compiled.flow.incoming(node.id)
        edges = [self._edge(e, env).live for e in incoming]
        if not edges or any(x is self.true for x in edges):
            return self.true
        return F.coalesce(_any(edges), F.lit(False)) if len(edges) > 1 or env[incoming[0].source].taken is not None else edges[0]

    # -- placing nodes -------------------------------------------------------------------------------------------

    def scope(self, placed: dict[str, Handle], env: Env, source: str) -> expression.Scope:
        scope = {k: h.value for k, h in placed.items()}
        if "result" not in scope and "output_1" in scope:
            scope["result"] = scope["output_1"]
        if "store" in self.columns:
            scope["store"] = Value(F.col("store"), self.columns["store"])
        if "results" in expression.identifiers(source):
            inner = {i: {h: x.value for h, x in p.handles.items()} for i, p in env.items() if p.handles}
            kinds = T.StructType([T.StructField(i, T.StructType([T.StructField(h, v.kind) for h, v in hs.items()])) for i, hs in inner.items()])
            scope["results"] = Value(F.struct(*[F.struct(*[v.column.alias(h) for h, v in hs.items()]).alias(i) for i, hs in inner.items()]), kinds)
        return scope

    def finish(self, node: Node, op: Operator, made: Any, live: Column, faults: list[Column], env: Env) -> Placed:
        """Values, liveness and error policy of a node from what its expression gave."""
        if not isinstance(made, dict):
            made = {"result": made}
        fault = F.when(live, faults[0] if len(faults) == 1 else F.coalesce(*faults)) if faults else self.none
        if live is self.true and faults:
            fault = faults[0] if len(faults) == 1 else F.coalesce(*faults)
        good = fault.isNull() if faults else self.true
        if faults and self.on_fault == "raise":
            made = {k: v if isinstance(v, Maybe) else Value(F.when(good, v.column).otherwise(F.raise_error(F.concat(F.lit(f"{node.id}: "), fault)).cast(v.kind)), v.kind) for k, v in made.items()}
            faults, fault = [], self.none
        goes_on = self.compiled.flow.policy(node) == "continue"
        alive = live if goes_on or not faults else good if live is self.true else live & good
        handles = {}
        for name, v in made.items():
            value, own = (v.value, v.live) if isinstance(v, Maybe) else (v, None)
            shown = alive & good if faults and goes_on else alive
            kept = value if shown is self.true else Value(F.when(shown, value.column), value.kind)
            handles[name] = Handle(kept, alive if own is None else alive & F.coalesce(own, F.lit(False)))
        taken = None
        if op.is_decision:
            guards = guards_of(self.compiled.flow, node.id)
            taken, why = F.lit(guards[-1].id), F.lit(None).cast("string")
            # Guards are tried in order: a guard's fault counts if none before it is true.
            for e in reversed(guards[:-1]):
                test, wrong = expression.checked_condition(e.when, self.scope({**handles, "value": handles["result"]}, env, e.when))
                taken = F.when(test, F.lit(e.id)).otherwise(taken)
                why = F.when(wrong.isNotNull(), F.concat(F.lit(f"guard {e.id}: "), wrong)).when(~test, why)
            if self.on_fault == "raise":
                why = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit(f"{node.id}: "), why)).cast("string"))
            taken = F.when(why.isNull(), taken)
            fault = F.coalesce(fault, F.when(alive, why))
            if not goes_on:
                alive = alive & why.isNull()
                handles = {k: Handle(h.value, h.live & why.isNull()) for k, h in handles.items()}
        return Placed(handles, alive, fault, taken, safe=not faults and taken is None)

    def native(self, node: Node, env: Env) -> Placed:
        op = self.compiled.operators[node.id]
        live = self.live(node, env)
        if op.base_id == "column":
            name = node.data["name"]
            if name not in self.columns:
                raise CompilationError([f"{node.id}: the table has no column {name}"])
            return self.finish(node, op, Value(F.col(f"`{name}`"), self.columns[name]), live, [], env)
        inputs, faults = self.inputs(node, env)
        if op.faults is not None:
            fault = op.faults(inputs)
            faults = [*faults, fault]
        return self.finish(node, op, op.expr(inputs), live, faults, env)

    def store_in(self, node_id: str, placed: Placed, row: Column | None = None) -> tuple[list[Column], Placed]:
        """The node's columns, and the node read back from them: from the table, or from a struct that has them."""
        name = self.prefix + node_id
        return self.columns_of(name, placed), self.read_back(name, placed, lambda f: F.col(f"`{f}`") if row is None else row[f])

    def columns_of(self, name: str, placed: Placed) -> list[Column]:
        columns = []
        for h, x in placed.handles.items():
            void = isinstance(x.value.kind, T.NullType)
            columns.append((x.value.column.cast("string") if void else x.value.column).alias(f"{name}__v_{h}"))
            if x.live is not placed.live:
                columns.append(x.live.alias(f"{name}__l_{h}"))
        if placed.live is not self.true and id(placed.live) not in self.shared:
            columns.append(F.coalesce(placed.live, F.lit(False)).alias(f"{name}__live"))
        if placed.fault is not self.none:
            columns.append(placed.fault.alias(f"{name}__fault"))
        if placed.taken is not None:
            columns.append(placed.taken.alias(f"{name}__taken"))
        if placed.progress is not None:
            columns += [placed.progress[0].cast("long").alias(f"{name}__at"), placed.progress[1].cast("long").alias(f"{name}__of")]
        if placed.events is not None:
            columns.append(placed.events.alias(f"{name}__events"))
        return columns

    def read_back(self, name: str, placed: Placed, get: Callable[[str], Column]) -> Placed:
        at = lambda f: get(f"{name}__{f}")
        live = placed.live
        if live is not self.true and id(live) not in self.shared:
            live = at("live")
            self.shared[id(live)] = live
        handles = {}
        for h, x in placed.handles.items():
            kind = T.StringType() if isinstance(x.value.kind, T.NullType) else x.value.kind
            handles[h] = Handle(Value(at(f"v_{h}"), kind), live if x.live is placed.live else at(f"l_{h}"))
        return replace(
            placed, handles=handles, live=live, fault=self.none if placed.fault is self.none else at("fault"), taken=at("taken") if placed.taken is not None else None,
            progress=(at("at"), at("of")) if placed.progress is not None else None, events=at("events") if placed.events is not None else None,
        )

    # -- Python operators ----------------------------------------------------------------------------------------

    def dealt_out(self, df: DataFrame) -> DataFrame:
        """df dealt over the session's tasks by number, whatever its size: its rows may take long to wait for."""
        if self.dealt or df.isStreaming:
            return df
        self.dealt = True
        session = df.sparkSession
        return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))

    def python(self, df: DataFrame, node: Node, env: Env) -> DataFrame:
        op = self.compiled.operators[node.id]
        live = self.live(node, env)
        inputs, faults = self.inputs(node, env)
        key = None
        if op.idempotency_key:
            held, wrong = expression.checked(op.idempotency_key, {**inputs, "inputs": Value(F.struct(*[v.column.alias(k) for k, v in inputs.items()]), T.StructType([T.StructField(k, v.kind) for k, v in inputs.items()]))})
            key = Value(text(held.column, held.kind), T.StringType())
            faults = [*faults, F.concat(F.lit("idempotency key: "), wrong)]
            if any(i.name == "idempotency_key" for i in op.inputs):
                inputs["idempotency_key"] = key
        names = list(inputs)
        shipped = [F.to_json(F.struct(v.column.alias("x"))) if isinstance(v.kind, (T.VariantType, T.MapType, T.StructType, T.NullType)) else v.column for v in inputs.values()]
        coded = {n for n, v in inputs.items() if isinstance(v.kind, (T.VariantType, T.MapType, T.StructType, T.NullType))}
        outs = self.compiled.outputs[node.id]
        plain = {o.name: T.StringType() if isinstance(spark_type(o.type), (T.VariantType, T.NullType, T.MapType)) else spark_type(o.type) for o in outs}
        schema = T.StructType([T.StructField(n, k) for n, k in plain.items()]).add("live_", T.ArrayType(T.StringType())).add("fault_", T.StringType()).add("attempts_", T.IntegerType()).add("errors_", T.ArrayType(T.StringType()))
        retries = int(node.data.get("max_retries", op.max_retries))
        delay, limit = float(node.data.get("retry_delay", op.retry_delay)), op.timeout
        self.retry[node.id] = (retries, delay)
        stores = "store" in inspect.signature(op.fn).parameters
        if stores:
            schema = schema.add("store_", STORE)
            if "store" not in df.columns:
                df = df.withColumn("store", F.create_map().cast(STORE))
                self.columns["store"] = STORE
            names, shipped, coded = [*names, "store"], [*shipped, F.to_json(F.struct(F.col("store").alias("x")))], coded | {"store"}
        self.effects = True
        given = (op.fn, names, coded, plain, retries, delay, limit)
        if limit is None and self.deadline is None:
            call = F.udf(by_row(*given), schema, useArrow=True).asNondeterministic()
        else:
            df = self.dealt_out(df)
            pack, calls, unpack = F.udf(packed, "binary", useArrow=True), F.arrow_udf(by_batch(*given), "binary"), F.udf(unpacked, schema, useArrow=True)
            call = lambda *row: unpack.asNondeterministic()(calls.asNondeterministic()(pack(*row)))
        name = f"{self.prefix}{node.id}__call"
        bad = F.coalesce(*faults) if faults else F.lit(None).cast("string")
        until = F.lit(None).cast("double") if self.deadline is None else F.unix_micros(F.col(f"`{self.deadline}`").cast("timestamp")) / 1e6
        df = df.withColumn(name, call(live & bad.isNull(), until, *shipped))
        if stores:
            df = df.withColumn("store", F.coalesce(F.col(f"`{name}`.store_"), "store"))
        made: dict[str, Any] = {}
        for o in outs:
            c = F.col(f"`{name}`.`{o.name}`")
            value = Value(F.parse_json(c), T.VariantType()) if isinstance(spark_type(o.type), (T.VariantType, T.NullType, T.MapType)) else Value(c, plain[o.name])
            made[o.name] = Maybe(value, F.array_contains(F.col(f"`{name}`.live_"), o.name)) if len(outs) > 1 else value
        if key is not None:
            made["idempotency_key"] = key
        placed = self.finish(node, op, made, live, [bad, F.col(f"`{name}`.fault_")], env)
        columns, env[node.id] = self.store_in(node.id, placed)
        return df.select("*", *columns)

    def extension(self, df: DataFrame, node: Node, env: Env) -> DataFrame:
        """A node whose operator places itself: it may join, group or map the rows, but keeps each of them and its columns."""
        op = self.compiled.operators[node.id]
        live = self.live(node, env)
        inputs, faults = self.inputs(node, env)
        df, made = op.place(df, inputs, f"{self.prefix}{node.id}")
        columns, env[node.id] = self.store_in(node.id, self.finish(node, op, made, live, faults, env))
        return df.select("*", *columns)

    # -- loops and sub-flows -------------------------------------------------------------------------------------

    def region(self, region: Region) -> list[Node]:
        by_id = self.compiled.flow.by_id
        return [by_id[i] for i in region.body]

    def _needs_rows(self, region: Region) -> bool:
        return any(self.compiled.operators[i].fn is not None for i in region.body)

    def _limited(self, region: Region) -> bool:
        """Whether attempts of the body's Python operators have a limit."""
        return self.deadline is not None or any(self.compiled.operators[i].timeout is not None for i in region.body)

    def _body(self, region: Region, env: Env) -> Env:
        """The body's nodes in a copy of env, as plain expressions: for compounds of one's own that make one round."""
        inner = dict(env)
        self.expressions(self.region(region), inner)
        return inner

    def bound(self, nodes: list[Node], env: Env, close: Callable[[Env, Column, Column], Column]) -> Column:
        """close(env with the nodes placed, the first fault, events) as one nested expression in which each layer is bound to
        a struct, so that what several nodes read is computed once. A fault stops what follows unless its node's policy
        is `continue`."""
        units = self._units(nodes)

        def layer(k: int, env: Env, fault: Column, told: Column) -> Column:
            if k == len(units):
                return close(env, fault, told)
            placed: dict[str, Placed] = {}
            loops = []
            for node in units[k]:
                op = self.compiled.operators[node.id]
                if op.pauses or op.fn is not None or op.place is not None:
                    raise CompilationError([f"{node.id} ({op.id}) can't run inside a native loop"])
                if op.region in ("for-each", "while") and op.compound is None:
                    loops.append((node, *self._rounds_of(self.compiled.regions[node.id], env)))
                elif _holds_others(op):
                    placed |= self._place_region(node, env, None)[1]
                elif op.expr is not None or op.base_id == "column":
                    placed[node.id] = self.native(node, env)
            if not loops:
                return settle(k, env, fault, told, placed)
            held = F.struct(*[c.alias(f"r{i}") for i, (_, c, _) in enumerate(loops)])

            def ended(b: Column) -> Column:
                more = dict(placed)
                for i, (node, _, end_of) in enumerate(loops):
                    first, end = end_of(b[f"r{i}"])
                    more |= {node.id: first, self.compiled.regions[node.id].end: end}
                return settle(k, env, fault, told, more)

            return _once(held, ended)

        def settle(k: int, env: Env, fault: Column, told: Column, placed: dict[str, Placed]) -> Column:
            failing = [p.told(i) for i, p in placed.items() if not p.safe and self._stops(i)]
            single = all(p.safe and self._readers(i) < 2 for i, p in placed.items())
            if single and not self.trace:
                return layer(k + 1, {**env, **placed}, fault, told)
            columns, read = [], {}
            for i, p in placed.items():
                columns += self.columns_of(self.prefix + i, p)
                read[i] = p
            if failing:
                columns.append(F.coalesce(fault, *failing).alias("fault_"))
            if self.trace:
                mine = [E.some(fault.isNull(), self.story(i, p)) for i, p in placed.items()]
                columns.append(F.concat(told, *mine).alias("told_"))

            def rest(b: Column) -> Column:
                inner = {**env, **{i: self.read_back(self.prefix + i, p, lambda f: b[f]) for i, p in read.items()}}
                return layer(k + 1, inner, b["fault_"] if failing else fault, b["told_"] if self.trace else told)

            return _once(F.struct(*columns), rest)

        return layer(0, env, self.none, E.none() if self.trace else F.lit(None))

    def _stops(self, node_id: str) -> bool:
        """Whether a fault of the node ends the run."""
        flow = self.compiled.flow
        own = [node_id, *(r.start for r in self.compiled.regions.values() if r.end == node_id)]
        return not any(flow.policy(n) == "continue" for n in flow.nodes if n.id in own)

    def _readers(self, node_id: str) -> int:
        flow = self.compiled.flow
        return sum(e.source == node_id for e in flow.edges) + sum(p == node_id for n in flow.nodes for p, _ in (n.consumes or {}).values())

    def story(self, node_id: str, p: Placed, between: tuple[Column, ...] = (), **start: Column) -> Column:
        """The events of a node: node_start, what lies between, node_complete or node_error; or node_skipped."""
        parts = list(between)
        if "truncated" in p.handles:
            told = p.handles["truncated"].value.column
            parts.append(E.some(told.isNotNull(), F.array(E.event("runtime_warning", node_id, error=told, warning=p.handles["warning"].value.column, payload=p.handles["lengths"].value.column))))
        if p.events is not None:
            parts.append(F.coalesce(p.events, E.none()))
        elif p.progress is not None:
            parts.append(E.progress(node_id, *p.progress))
        extra = {}
        if node_id in self.cache:
            extra["cached"] = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in self.cache[node_id].values()])
        shown = {h: x for h, x in p.handles.items() if h not in OWN_HANDLES}
        if shown:
            extra["result"] = F.to_json(F.struct(*[F.when(x.live, x.value.column).alias(h) for h, x in shown.items()]))
        ended = F.when(p.fault.isNotNull(), E.event("node_error", node_id, **E.wrong(p.fault))).otherwise(E.event("node_complete", node_id, **extra))
        happened = F.concat(F.array(E.event("node_start", node_id, **start)), *parts, F.array(ended))
        return F.when(p.live | p.fault.isNotNull(), happened).otherwise(F.array(E.event("node_skipped", node_id)))

    def calls(self, node_id: str) -> tuple[Column, ...]:
        """The events of a Python node's further attempts, read from the column of its calls."""
        if node_id not in self.retry:
            return ()
        call, (most, delay) = f"{self.prefix}{node_id}__call", self.retry[node_id]
        return (E.retries(node_id, most, delay, F.coalesce(F.col(f"`{call}`.attempts_"), F.lit(1)), F.col(f"`{call}`.errors_")),)

    def _slots(self, region: Region, env: Env) -> list[Handle]:
        """One collected slot for each distinct source handle wired to the end, in edge order."""
        edges = {(e.source, e.out): e for e in self.compiled.flow.incoming(region.end)}
        return [self._edge(e, env) for e in edges.values()]

    def _items(self, region: Region, env: Env) -> list[Value]:
        node = self.compiled.flow.by_id[region.start]
        edges = [e for e in self.compiled.flow.incoming(node.id) if e.target_handle]
        values = [self._edge(e, env).value for e in edges]
        if not values and node.consumes:
            values = [env[p].handle(h).value for p, h in node.consumes.values()]
        if not values:
            values = [literal(node.data.get("items"))]
        return [_as_items(v) for v in values]

    def _rounds_of(self, region: Region, env: Env) -> tuple[Column, Callable[[Column], tuple[Placed, Placed]]]:
        """A native loop's rounds as one expression, and what makes its start and end from them."""
        return (self._each if region.kind == "for-each" else self._while)(region, env)

    def native_loop(self, region: Region, env: Env, df: DataFrame) -> tuple[DataFrame, Placed, Placed]:
        made, end_of = self._rounds_of(region, env)
        name = f"{self.prefix}{region.end}__rounds"
        live = self.live(self.compiled.flow.by_id[region.start], env)
        df = df.select("*", F.when(live, made).alias(name))
        return df, *end_of(F.col(f"`{name}`"))

    def for_each(self, region: Region, env: Env, df: DataFrame | None) -> tuple[DataFrame | None, Placed, Placed]:
        if not self._needs_rows(region):
            return self.native_loop(region, env, df)
        if df is None or df.isStreaming:
            raise CompilationError([f"{region.start}: a loop with Python operators can't lie inside a native loop or on a stream"])
        zipped, placed_start, end_of = self._list(region, env)
        df, rounds = self._exploded(region, df, zipped, env, placed_start, end_of.kinds)
        return df, *end_of(rounds)

    def _out(self, region: Region, kinds: list[T.DataType]) -> Callable[[Env, Column, Column], Column]:
        """A for-each round's result: values and liveness of its slots, its fault, and its events if they are traced."""

        def out(env: Env, fault: Column, told: Column) -> Column:
            got = self._slots(region, env)
            kinds[:] = [h.value.kind for h in got]
            fields = [c for i, h in enumerate(got) for c in (h.value.column.alias(f"v{i}"), F.coalesce(h.live, F.lit(False)).alias(f"l{i}"))]
            return F.struct(*fields, fault.alias("fault"), *([told.alias("events")] if self.trace else []))

        return out

    def _each(self, region: Region, env: Env) -> tuple[Column, Callable]:
        zipped, placed_start, end_of = self._list(region, env)
        step = lambda item, index: self.bound(self.region(region), {**env, region.start: placed_start(item, index)}, self._out(region, end_of.kinds))
        return F.transform(zipped, step), end_of

    def _list(self, region: Region, env: Env) -> tuple[Column, Callable, Callable]:
        """What a for-each loop goes over, zipped; the start as a round's nodes see it; and its end from its rounds.

        The rounds up to the first that failed count; then the loop has failed, with the fault of the node in its body,
        unless the start's policy is `continue`."""
        start = self.compiled.flow.by_id[region.start]
        live = self.live(start, env)
        items = self._items(region, env)
        most = int(start.data.get("max_items", MAX_ITEMS))
        sizes = [F.size(v.column) for v in items]
        shortest = F.least(*sizes) if len(items) > 1 else sizes[0]
        short = F.least(shortest, F.lit(most))
        zipped = F.arrays_zip(*[F.slice(v.column, F.lit(1), F.greatest(short, F.lit(0))).alias(f"x{i}") for i, v in enumerate(items)])
        longest = F.greatest(*sizes) if len(items) > 1 else sizes[0]
        uneven, over = (longest != shortest) if len(items) > 1 else F.lit(False), shortest > most
        truncated = F.when(live, F.when(uneven, F.lit("lists of unequal length: the shortest counts")).when(over, F.concat(F.lit(f"the first {most} of "), shortest.cast("string"), F.lit(" items are taken"))))
        warning = F.when(live, F.when(uneven, "zip_length_mismatch").when(over, "items_truncated"))
        lengths = F.when(uneven | over, F.to_json(F.struct(F.array(*sizes).alias("lengths"), F.greatest(short, F.lit(0)).alias("taken"))))

        def placed_start(item: Column, index: Column) -> Placed:
            handles = {"output_1": Handle(Value(item["x0"], items[0].kind.elementType), self.true), "output_2": Handle(Value((index + 1).cast("long"), T.LongType()), self.true)}
            handles |= {f"output_{i + 2}": Handle(Value(item[f"x{i}"], v.kind.elementType), self.true) for i, v in enumerate(items) if i}
            return Placed(handles, self.true, self.none, safe=True)

        kinds: list[T.DataType] = []
        goes_on = not self._stops(region.start)

        def end_of(rounds: Column) -> tuple[Placed, Placed]:
            failed = F.get(F.filter(rounds, lambda r: r["fault"].isNotNull()), F.lit(0))["fault"]
            fault = F.when(live, failed)
            if self.on_fault == "raise":
                fault = F.when(fault.isNotNull(), F.raise_error(fault).cast("string"))
            good = fault.isNull()
            alive = live if goes_on else live & good
            lists = {}
            for i, kind in enumerate(kinds):
                kept = F.coalesce(_slot(rounds, i), F.array().cast(T.ArrayType(kind)))
                lists[f"output_{i + 1}"] = Handle(Value(F.when(live & good, kept), T.ArrayType(kind)), alive)
            total = F.greatest(short, F.lit(0))
            at = F.when(good, total).otherwise(F.array_position(F.transform(rounds, lambda r: r["fault"].isNotNull()), True) - 1)
            story = None
            if self.trace:
                step = lambda r, k: F.concat(r["events"], E.some(r["fault"].isNull(), F.array(E.event("node_progress", region.end, current=k + 1, total=total))))
                story = F.flatten(F.transform(F.slice(rounds, F.lit(1), F.greatest(F.least(at + 1, F.size(rounds)), F.lit(0)).cast("int")), step))
            end = Placed({"result": lists["output_1"], **lists}, alive, fault, named=True, progress=(F.when(live, at), F.when(live, total)), events=story)
            shown = {"truncated": (truncated, T.StringType()), "warning": (warning, T.StringType()), "lengths": (lengths, T.StringType()), "total": (F.when(live, total).cast("long"), T.LongType())}
            first = Placed({"result": Handle(items[0], alive), **{h: Handle(Value(c, k), live) for h, (c, k) in shown.items()}}, alive, fault, named=True)
            return first, end

        end_of.kinds = kinds
        return zipped, placed_start, end_of

    def _exploded(self, region, df, zipped, env, placed_start, kinds):
        """The loop over exploded rows, for bodies with Python operators: one row per item, collected by a number that
        each row gets in a table of its own, so that rows of equal or null keys stay apart and what lies before the loop
        takes effect once. Loops nest: each has columns of its own. A table's size tells nothing about its items, so the
        collected ones are joined by merging, never broadcast; and rows are dealt out before the outermost loop, as a table
        of few files has few tasks."""
        own = f"{self.prefix}{region.start}__"
        row, place, item = f"{own}row", f"{own}pos", f"{own}item"
        before = self.dealt
        if self._limited(region):
            df = self.dealt_out(df)
        elif not self.dealt:
            df = df.hint("repartition")
        held = cut(df.withColumn(row, F.monotonically_increasing_id()))
        rows = held.select("*", F.posexplode(zipped).alias(place, item))
        self.dealt = True
        inner, rows = self._inside(region, rows, {**env, region.start: placed_start(F.col(f"`{item}`"), F.col(f"`{place}`"))})
        out = self._ended(inner, region, self._out(region, kinds))
        taken = rows.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"`{place}`").alias("at"), out.alias("s")))), lambda x: x["s"]).alias(f"{self.prefix}{region.end}__rounds"))
        self.dealt = before
        return held.join(taken.hint("merge"), row, "left").drop(row), F.col(f"`{self.prefix}{region.end}__rounds`")

    def _inside(self, region: Region, rows: DataFrame, env: Env) -> tuple[Lowering, DataFrame]:
        """The body's nodes placed as columns of rows."""
        inner = replace(self, env=dict(env), prefix=f"{self.prefix}{region.start}__", waits=[], done=set(), retry={})
        rows = inner.rows(rows, self.region(region))
        self.effects = True
        return inner, rows

    def _ended(self, inner: Lowering, region: Region, close: Callable) -> Column:
        """close() over a body that lies in columns: its first fault and its events."""
        mine = {i: p for i, p in inner.env.items() if i in inner.done}
        faults = [p.told(i) for i, p in mine.items() if self._stops(i)]
        told = F.lit(None)
        if self.trace:
            # What lies behind a node that failed didn't happen; a loop's end is told with its start.
            parts, before = [E.none()], {}
            starts = {r.end: r.start for r in self.compiled.regions.values()}
            for i, p in mine.items():
                ahead = [f for n, f in before.items() if n != starts.get(i)]
                story = inner.story(i, p, inner.calls(i))
                parts.append(E.some(F.coalesce(*ahead).isNull(), story) if ahead else story)
                if self._stops(i):
                    before[i] = p.fault
            told = F.concat(*parts)
        return close(inner.env, F.coalesce(*faults) if faults else F.lit(None).cast("string"), told)

    def loop(self, region: Region, env: Env, df: DataFrame | None) -> tuple[DataFrame | None, Placed, Placed]:
        """A while loop: a fold over its rounds (native body), else rounds over the runs that still go on."""
        if not self._needs_rows(region):
            return self.native_loop(region, env, df)
        if df is None or df.isStreaming:
            raise CompilationError([f"{region.start}: a loop with Python operators can't lie inside a native loop or on a stream"])
        df, state, kind = self._rounds(region, df, env)
        return df, *self._while_end(region, env, kind)(state)

    def _while_terms(self, region: Region, env: Env) -> tuple[Node, int, Callable]:
        start = self.compiled.flow.by_id[region.start]
        condition = start.data.get("condition")
        if not condition:
            raise CompilationError([f"{region.start} has no condition"])

        def goes_on(iteration: Column, last: Value) -> tuple[Column, Column]:
            scope = {"iteration": Value(iteration, T.LongType()), "last": last, "result": last}
            if "store" in self.columns:
                scope["store"] = Value(F.col("store"), self.columns["store"])
            test, wrong = expression.checked_condition(condition, scope)
            return wrong.isNull() & (~test if start.data.get("negate", False) else test), wrong

        return start, int(start.data.get("max_iterations", MAX_ROUNDS)), goes_on

    def _round_start(self, iteration: Column, last: Value) -> Placed:
        return Placed({"output_1": Handle(Value(iteration, T.LongType()), self.true), "output_2": Handle(last, self.true)}, self.true, self.none, safe=True)

    def _while(self, region: Region, env: Env) -> tuple[Column, Callable]:
        """Rounds are folded in blocks of blocks: a run that ended passes a whole block in one step."""
        start, most, goes_on = self._while_terms(region, env)
        text_, none = F.lit(None).cast("string"), T.NullType()
        kinds: list[T.DataType] = []

        def round_(n: Column, last: Value, told: Column | None, kind: T.DataType | None) -> Column:
            def close(inner: Env, fault: Column, events: Column) -> Column:
                value = self._slots(region, inner)[0].value
                kinds[:] = [value.kind]
                good = fault.isNull()
                fields = {"n": F.when(good, n + 1).otherwise(n), "last": value.column.cast(kind or value.kind), "done": ~good, "why": text_, "fault": fault}
                if self.trace:
                    at = E.some(good, F.array(E.event("node_progress", region.end, current=n + 1, total=F.lit(most))))
                    fields["events"] = F.concat(told, events, at) if told is not None else events
                return F.struct(*[c.alias(f) for f, c in fields.items()])

            return self.bound(self.region(region), {**env, region.start: self._round_start(n + 1, last)}, close)

        round_(F.lit(0).cast("long"), Value(F.lit(None), none), None, None)
        kind = T.StringType() if isinstance(kinds[0], T.NullType) else kinds[0]
        fields = {"n": F.lit(0).cast("long"), "last": F.lit(None).cast(kind), "done": F.lit(False), "why": text_, "fault": text_} | ({"events": E.none()} if self.trace else {})
        begin = F.struct(*[c.alias(f) for f, c in fields.items()])

        def step(s: Column, _: Column) -> Column:
            test, wrong = goes_on(s["n"], Value(s["last"], kind))
            over = F.struct(*[{"done": F.lit(True), "why": wrong}.get(f, s[f]).alias(f) for f in fields])
            fresh = round_(s["n"], Value(s["last"], kind), s["events"] if self.trace else None, kind)
            return F.when(s["done"] | (s["n"] >= most), s).when(test, fresh).otherwise(over)

        def fold(state: Column, rounds: int) -> Column:
            if rounds <= ROUNDS_AT_ONCE:
                return F.aggregate(F.sequence(F.lit(1), F.lit(max(rounds, 1))), state, step)
            block = -(-rounds // ROUNDS_AT_ONCE)
            return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS_AT_ONCE)), state, lambda s, _: F.when(s["done"] | (s["n"] >= most), s).otherwise(fold(s, block)))

        return fold(begin, most), self._while_end(region, env, kind)

    def _while_end(self, region: Region, env: Env, kind: T.DataType) -> Callable[[Column], tuple[Placed, Placed]]:
        start, most, _ = self._while_terms(region, env)
        live = self.live(start, env)

        def end_of(state: Column) -> tuple[Placed, Placed]:
            # All rounds used up without the condition's refusal: a runaway, as the condition isn't tested again.
            own = F.when(~state["done"] & (state["n"] >= most), F.lit(f"loop ran away: {most} rounds")).when(state["why"].isNotNull(), F.concat(F.lit("condition: "), state["why"]))
            fault = F.when(live, F.coalesce(state["fault"], F.when(own.isNotNull(), F.concat(F.lit(f"{region.start}: "), own))))
            value, n = Value(state["last"], kind), Value(state["n"], T.LongType())
            policy = start if not self._stops(region.start) else self.compiled.flow.by_id[region.end]
            end = self.finish(policy, self.compiled.operators[region.end], value, live, [fault], env)
            first = self.finish(start, self.compiled.operators[region.start], {"output_1": n, "output_2": value, "result": n}, live, [fault], env)
            story = F.when(live, state["events"]) if self.trace else None
            return replace(first, named=True), replace(end, named=True, progress=(F.when(live, state["n"]), F.when(live, F.lit(most))), events=story)

        return end_of

    def _told_kind(self, region: Region) -> T.DataType | None:
        """The type of a while loop's value where its operator states it."""
        for e in self.compiled.flow.incoming(region.end):
            op = self.compiled.operators[e.source]
            out = next((o for o in self.compiled.outputs[e.source] if o.name == e.out), None)
            if op.fn is not None and out is not None and not isinstance(spark_type(out.type), (T.VariantType, T.NullType, T.MapType)):
                return spark_type(out.type)
        return None

    def _rounds(self, region, df, env):
        """Rounds of a body with Python operators: the runs still going are one table per round."""
        start, most, goes_on = self._while_terms(region, env)
        live = self.live(start, env)
        own = f"{self.prefix}{region.start}__"
        n_, last_, go_, why_, fault_, told_ = (f"{own}{x}" for x in ("n", "last", "go", "why", "bad", "told"))
        at = lambda name: F.col(f"`{name}`")
        names, kind, rest = df.columns, self._told_kind(region), []
        if self._limited(region):
            df = self.dealt_out(df)
        now = df.select("*", F.lit(0).cast("long").alias(n_), F.lit(None).cast(kind or "string").alias(last_), F.lit(None).cast("string").alias(fault_), *([E.none().alias(told_)] if self.trace else []))
        kept = [n_, last_, fault_, *([told_] if self.trace else [])]
        for n in range(most + 1):
            last = Value(at(last_), kind or T.NullType())
            test, wrong = goes_on(at(n_), last) if n < most else (F.lit(False), F.lit(None).cast("string"))
            judged = cut(now.select("*", F.coalesce(test & live & at(fault_).isNull(), F.lit(False)).alias(go_), F.when(live, wrong).alias(why_)))
            rest.append(judged.filter(~at(go_)).select(*[at(c) for c in names], *[at(c) for c in kept], (at(fault_).isNotNull() | F.lit(n < most)).alias(go_), at(why_)))
            now = judged.filter(at(go_)).drop(go_, why_)
            if now.isEmpty():
                break
            before = Value(at(last_), kind or T.StringType())
            inner, rows = self._inside(region, now, {**env, region.start: self._round_start(at(n_) + 1, before)})

            def close(body: Env, fault: Column, events: Column) -> Column:
                value = self._slots(region, body)[0].value
                fields = [value.column.alias("last"), fault.alias("fault")]
                if self.trace:
                    fields.append(F.concat(at(told_), events, E.some(fault.isNull(), F.array(E.event("node_progress", region.end, current=at(n_) + 1, total=F.lit(most))))).alias("told"))
                return F.struct(*fields)

            kind = self._slots(region, inner.env)[0].value.kind
            done = rows.select(*[at(c) for c in names], at(n_), self._ended(inner, region, close).alias(go_))
            now = done.select(*[at(c) for c in names], F.when(at(go_)["fault"].isNull(), at(n_) + 1).otherwise(at(n_)).alias(n_), at(go_)["last"].alias(last_), at(go_)["fault"].alias(fault_), *([at(go_)["told"].alias(told_)] if self.trace else []))
        kind = kind or T.StringType()
        whole = reduce(DataFrame.unionByName, [r.withColumn(last_, at(last_).cast(kind)) for r in rest])
        fields = {"n": n_, "last": last_, "done": go_, "why": why_, "fault": fault_} | ({"events": told_} if self.trace else {})
        state = F.struct(*[at(c).alias(f) for f, c in fields.items()]).alias(f"{self.prefix}{region.end}__rounds")
        return whole.select(*[at(c) for c in names], state), F.col(f"`{self.prefix}{region.end}__rounds`"), kind

    def subprocess(self, node: Node, env: Env, df: DataFrame | None) -> tuple[DataFrame | None, Placed]:
        """A sub-flow in place: its nodes are lowered with the call's inputs bound to data of the same name."""
        if self.depth + 1 > MAX_DEPTH:
            raise CompilationError([f"{node.id}: sub-flows nest over {MAX_DEPTH} deep"])
        name = (node.data.get("flow_id"), int(node.data.get("flow_version", 1)))
        if name not in self.compiled.flows:
            raise CompilationError([f"{node.id}: no sub-flow {name[0]}@{name[1]}"])
        own = {k: v for k, v in self.inputs(node, env)[0].items() if k not in ("flow_id", "flow_version", "inputs")}
        bound: dict[str, Any] = {}
        for k, v in (node.data.get("inputs") or {}).items():
            if isinstance(v, str) and v.startswith("$"):
                try:
                    v = expression.column(v, own) if v.startswith("$.") else expression.column(v[1:], own)
                except expression.ExpressionError:
                    pass  # what isn't an expression over the inputs is meant literally
            bound[k] = v
        bound |= {k: v for k, v in own.items() if k not in bound}
        flow = self.compiled.flows[name]
        flow = replace(flow, nodes=tuple(replace(n, data={k: bound.get(k, v) for k, v in n.data.items()}) for n in flow.nodes))
        inner = replace(self, compiled=compile_flow(flow, self.compiled.registry, flows=self.compiled.flows), env={}, waits=[], done=set(), depth=self.depth + 1, prefix=f"{self.prefix}{node.id}__")
        live = self.live(node, env)
        if df is not None:
            df = inner.rows(df)
        else:
            inner.expressions(list(flow.nodes), inner.env)
        if inner.waits:
            raise CompilationError([f"{node.id}: a sub-flow can't pause"])
        parts = {i: p.handle("result") for i, p in inner.env.items() if p.handles}
        kind = T.StructType([T.StructField(i, h.value.kind) for i, h in parts.items()])
        value = Value(F.struct(*[F.when(h.live, h.value.column).alias(i) for i, h in parts.items()]), kind)
        faults = [p.told(i) for i, p in inner.env.items() if inner._stops(i) and not p.safe]
        return df, self.finish(node, self.compiled.operators[node.id], value, live, faults, env)

    # -- whole flows ---------------------------------------------------------------------------------------------

    def _units(self, nodes: list[Node]) -> list[list[Node]]:
        """Nodes by layer, a loop counting as one node that needs all that its body reads."""
        inside = {n.id for n in nodes}
        home = {}
        for r in self.compiled.regions.values():
            if r.start in inside:
                for i in (*r.body, r.end):
                    home.setdefault(i, []).append(r.start)
        # Of nested loops, a member belongs to the outermost here.
        unit = {i: next((s for s in starts if s not in home), starts[0]) for i, starts in home.items()}
        undone = {n.compensation for n in self.compiled.flow.nodes if n.compensation}
        keep = [n for n in nodes if n.id not in unit and n.id not in undone]
        edges = [Edge(e.id, unit.get(e.source, e.source), unit.get(e.target, e.target)) for e in self.compiled.flow.edges if e.source in inside and e.target in inside]
        reads = [Edge(f"{n.id}.{h}", unit.get(p, p), unit.get(n.id, n.id)) for n in nodes for h, (p, _) in (n.consumes or {}).items() if p in inside]
        bare = [replace(n, consumes=None) for n in keep]
        real = {n.id: n for n in keep}
        wired = [e for e in (*edges, *reads) if e.source != e.target and e.source in real and e.target in real]
        return [[real[n.id] for n in layer] for layer in layers(bare, wired)]

    def _place_region(self, node: Node, env: Env, df: DataFrame | None) -> tuple[DataFrame | None, dict[str, Placed]]:
        kind = self.compiled.operators[node.id].region
        if kind == "subprocess":
            df, placed = self.subprocess(node, env, df)
            return df, {node.id: placed}
        region = self.compiled.regions[node.id]
        own = self.compiled.operators[node.id].compound
        if own is not None:
            df, first, end = own(self, region, env, df)
        else:
            df, first, end = (self.for_each if kind == "for-each" else self.loop)(region, env, df)
        return df, {region.start: first, region.end: end}

    def expressions(self, nodes: list[Node], env: Env) -> None:
        """Place nodes as nested expressions: inside loops."""
        for layer in self._units(nodes):
            for node in layer:
                op = self.compiled.operators[node.id]
                if op.pauses or op.fn is not None or op.place is not None:
                    raise CompilationError([f"{node.id} ({op.id}) can't run inside a native loop"])
                if op.region in ("for-each", "while") and op.compound is None:
                    made, end_of = self._rounds_of(self.compiled.regions[node.id], env)
                    first, end = end_of(made)
                    env.update({node.id: first, self.compiled.regions[node.id].end: end})
                elif _holds_others(op):
                    env.update(self._place_region(node, env, None)[1])
                elif op.expr is not None or op.base_id == "column":
                    env[node.id] = self.native(node, env)

    def rows(self, df: DataFrame, nodes: list[Node] | None = None) -> DataFrame:
        """Place nodes as columns of df; runs that pause leave df for `waits`.

        Layers of native nodes wait for each other in one select, where a column may name one before it; so a deep flow
        takes a select for every LAYERS_AT_ONCE layers."""
        if not self.columns:
            self.columns = {f.name: f.dataType for f in df.schema.fields}
        pending: list[list[Column]] = []

        def flushed(df: DataFrame) -> DataFrame:
            columns = [c for layer in pending for c in layer]
            pending.clear()
            return df.select("*", *columns) if columns else df

        for layer in self._units(list(nodes if nodes is not None else self.compiled.flow.nodes)):
            todo = [n for n in layer if n.id not in self.done]
            native, regions, python, pausing = [], [], [], []
            for n in todo:
                op = self.compiled.operators[n.id]
                (pausing if op.pauses else regions if _holds_others(op) else python if op.place is not None or op.fn is not None and op.expr is None else native).append(n)
            placed: dict[str, Placed] = {}
            for n in native:
                placed[n.id] = self.cached(n, self.native(n, self.env))
            if regions or len(pending) >= LAYERS_AT_ONCE:
                df = flushed(df)
            for n in regions:
                df, more = self._place_region(n, self.env, df)
                placed |= more
            if placed:
                columns = []
                for i, p in placed.items():
                    more, self.env[i] = self.store_in(i, p)
                    columns += more
                pending.append(columns)
            self.done |= set(placed)
            if python or pausing or any(i.shown.kind == "HumanReview" for n in todo for i in self.compiled.inputs[n.id]):
                df = flushed(df)
            for n in python:
                df = (self.python if self.compiled.operators[n.id].place is None else self.extension)(df, n, self.env)
                self.done.add(n.id)
            for n in todo:
                df = self._review(df, n)
            for n in pausing:
                df = self._pause(df, n)
        return flushed(df)

    def settled(self, df: DataFrame) -> DataFrame:
        """df before it is read more than once: a table, if Python operators had effects on the way to it."""
        if not self.effects or df.isStreaming:
            return df
        self.effects = False
        return cut(df)

    def cached(self, node: Node, placed: Placed) -> Placed:
        """A node whose result the caller states in columns (handle to column name) isn't computed."""
        if node.id not in self.cache:
            return placed
        given = self.cache[node.id]
        handles = {h: Handle(Value(F.coalesce(F.col(f"`{c}`"), placed.handle(h).value.column), placed.handle(h).value.kind), placed.live) for h, c in given.items()}
        return replace(placed, handles={**placed.handles, **handles})

    def _pause(self, df: DataFrame, node: Node) -> DataFrame:
        df = self.settled(df)
        live = self.live(node, self.env)
        inputs, _ = self.inputs(node, self.env)
        op = self.compiled.operators[node.id]
        shown = {"human": ("prompt",), "signal": ("signal_name", "correlation", "timeout_seconds", "kind", "seconds")}[op.pauses]
        fields = [F.struct(*[inputs[k].column.alias(k) for k in shown if k in inputs]).alias(f"{self.prefix}{node.id}__wait")]
        waiting = df.filter(live).select("*", *fields)
        self.done.add(node.id)
        self.waits.append(Wait(node.id, op.pauses, waiting, frozenset(self.done)))
        gone = Placed({"result": Handle(Value(F.lit(None).cast("string"), T.StringType()), F.lit(False))}, F.lit(False), F.lit(None).cast("string"))
        columns, self.env[node.id] = self.store_in(node.id, gone)
        return df.filter(~live).select("*", *columns)

    def _review(self, df: DataFrame, node: Node) -> DataFrame:
        """Runs whose HumanReview input is true pause after the node's value is known."""
        flag = next((i for i in self.compiled.inputs[node.id] if i.shown.kind == "HumanReview"), None)
        if flag is None or node.id not in self.env:
            return df
        value = self.inputs(node, self.env)[0].get(flag.name)
        asks = F.coalesce(truthy(value.column, value.kind) & self.env[node.id].live, F.lit(False))
        df = self.settled(df)
        prompt = dict(flag.shown.options).get("prompt") or ""
        waiting = df.filter(asks).select("*", F.struct(F.lit(prompt).alias("prompt")).alias(f"{self.prefix}{node.id}__wait"))
        self.waits.append(Wait(node.id, "review", waiting, frozenset(self.done)))
        return df.filter(~asks)


def _holds_others(op: Operator) -> bool:
    """Whether an operator is the start of a loop or the call of a sub-flow."""
    return op.region in ("for-each", "while", "subprocess") or op.compound is not None


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _slot(mapped: Column, i: int) -> Column:
    """The live values of one slot of a loop's rounds."""
    return F.transform(F.filter(mapped, lambda x: x[f"l{i}"]), lambda x: x[f"v{i}"])


def _as_items(value: Value) -> Value:
    """A loop's list: a list as it is, the lines of a text, the values of a map, else the value alone."""
    if isinstance(value.kind, T.ArrayType):
        return value
    if isinstance(value.kind, T.StringType):
        return Value(F.filter(F.transform(F.split(value.column, "\n"), strip), lambda x: x != ""), T.ArrayType(T.StringType()))
    if isinstance(value.kind, T.MapType):
        return Value(F.map_values(value.column), T.ArrayType(value.kind.valueType))
    if isinstance(value.kind, T.VariantType):
        return Value(F.try_variant_get(value.column, "$", "array<variant>"), T.ArrayType(T.VariantType()))
    if isinstance(value.kind, T.NullType):
        return Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
    return Value(F.array(value.column), T.ArrayType(value.kind))


__all__ = ["LATE", "SKIPPED", "FlowStore", "FlowError", "Lowering", "Wait", "connection_labels", "literal"]
