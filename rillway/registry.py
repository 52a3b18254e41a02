"""Versioned operators: what a node type takes, gives, and how it becomes a column.

An operator is native (`expr`: inputs as Values to handles as Columns, preferred) or a Python function (`fn`, run in
an Arrow-batched Python worker with retries inside the task). Registries hold versions, merge, and can be overlaid.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
import re
import typing
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rillway.model import FlowError
from rillway.types import type_name
from rillway.widgets import Widget, default_widget

NOTHING = object()


@dataclass(frozen=True)
class Input:
    name: str
    type: str = "any"
    default: Any = NOTHING
    label: str | None = None
    description: str = ""
    optional: bool = False
    widget: Widget | None = None

    @property
    def shown(self) -> Widget:
        return self.widget or default_widget(self.type)

    @property
    def gathers(self) -> bool:
        return self.shown.kind == "ConnectionList"

    @property
    def takes_list(self) -> bool:
        return self.type.startswith("list")

    def to_dict(self) -> dict[str, Any]:
        own = {"name": self.name, "type": self.type, "label": self.label or self.name, "description": self.description, "default": None if self.default is NOTHING else self.default, "optional": self.optional}
        return self.shown.schema() | own


@dataclass(frozen=True)
class Output:
    name: str
    type: str = "any"
    label: str | None = None
    description: str = ""
    optional: bool = False
    download: bool = False
    filename: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "type": self.type, "label": self.label or self.name, "description": self.description, "optional": self.optional, "download": self.download, "filename": self.filename}


#: Who may perform an operator.
ACTOR_KINDS = ("system", "human", "agent", "external_service")


@dataclass(frozen=True)
class Actor:
    kind: str = "system"
    role: str | None = None

    def __post_init__(self):
        if self.kind not in ACTOR_KINDS:
            raise ValueError(f"no actor kind {self.kind!r}")

    @classmethod
    def coerce(cls, value: Any) -> Actor | None:
        return value if value is None or isinstance(value, cls) else cls(**value) if isinstance(value, dict) else cls(value)

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind} | ({"role": self.role} if self.role else {})


def seconds(value: Any) -> float | None:
    """Seconds of a positive number, an ISO 8601 duration up to days, or a short form such as 30s or 250ms."""
    if value is None:
        return None
    if isinstance(value, str):
        written = value.strip()
        iso = re.fullmatch(r"P(?:(?P<d>\d+)D)?(?:T(?:(?P<h>\d+)H)?(?:(?P<m>\d+)M)?(?:(?P<s>\d+(?:\.\d+)?)S)?)?", written, re.I)
        short = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?", written)
        unit = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, None: 1}
        if iso:
            total = sum(float(iso[k] or 0) * unit[k] for k in "dhms")
            if not total:
                raise ValueError(f"duration of zero: {value!r}")
            return total
        if not short:
            raise ValueError(f"not a duration: {value!r}")
        return float(short[1]) * unit[short[2]]
    if value <= 0:
        raise ValueError(f"a timeout must be positive, not {value}")
    return float(value)


@dataclass(frozen=True)
class Category:
    id: str
    label: str = ""
    description: str = ""
    members: list = field(default_factory=list, compare=False)

    def node(self, base_id: str, **options):
        """Collect a function as an operator of this category; Registry.include adds them."""

        def keep(fn):
            self.members.append((base_id, fn, options))
            return fn

        return keep


#: Categories that every registry knows.
IO, CONTROL, DECISION, HUMAN, EVENT = (Category(k, k.title()) for k in ("io", "control", "decision", "human", "event"))


@dataclass(frozen=True)
class Operator:
    base_id: str
    version: int = 1
    name: str = ""
    description: str = ""
    inputs: tuple[Input, ...] = ()
    outputs: tuple[Output, ...] = (Output("result"),)
    expr: Callable[..., Any] | None = None
    faults: Callable[..., Any] | None = None
    fn: Callable[..., Any] | None = None
    category: str = ""
    tags: tuple[str, ...] = ()
    docs: str = ""
    width: int | None = None
    max_retries: int = 0
    retry_delay: float = 1.0
    timeout: float | None = None
    actor: Actor | None = None
    idempotency_key: str | None = None
    uses: tuple[str, ...] = ()
    is_decision: bool = False
    is_signal: bool = False
    region: str | None = None
    pauses: str | None = None
    dynamic_handles: bool = False
    compute_inputs: Callable[..., Any] | None = None
    compute_outputs: Callable[..., Any] | None = None
    #: An executor of one's own: place(df, inputs, name) gives df with more columns, and the outputs' values.
    place: Callable[..., Any] | None = None
    #: A compound of one's own: region names its start, `ends` the region of its end; compound(lowering, region, env, df)
    #: gives df and what later nodes read of start and end, as Lowering.for_each does.
    ends: str | None = None
    compound: Callable[..., Any] | None = None

    @property
    def id(self) -> str:
        return f"{self.base_id}@{self.version}"

    def input(self, name: str) -> Input | None:
        return next((i for i in self.inputs if i.name == name), None)


def _outputs(hint: Any) -> tuple[Output, ...]:
    name = type_name(hint)
    if name.startswith("tuple["):
        from rillway.types import split_top

        return tuple(Output(f"output_{i}", t) for i, t in enumerate(split_top(name[6:-1], ","), 1))
    return (Output("result", name),)


def operator_of(fn: Callable[..., Any], base_id: str, **options: Any) -> Operator:
    """An operator from a typed Python function: inputs from its signature, outputs from its return type."""
    hints = typing.get_type_hints(fn)
    inputs = []
    for p in inspect.signature(fn).parameters.values():
        if p.kind in (p.VAR_KEYWORD, p.VAR_POSITIONAL) or p.name == "store":
            continue
        held = options.get("widgets", {}).get(p.name)
        inputs.append(Input(p.name, type_name(hints.get(p.name, typing.Any)), NOTHING if p.default is p.empty else p.default, widget=held, optional=p.default is None))
    options = {k: v for k, v in options.items() if k != "widgets"}
    options["timeout"] = seconds(options.get("timeout"))
    options["actor"] = Actor.coerce(options.get("actor"))
    options["tags"], options["uses"] = tuple(options.get("tags", ())), tuple(options.get("uses", ()))
    made = Operator(base_id, inputs=tuple(inputs), outputs=_outputs(hints.get("return")), fn=fn, **options)
    return replace(made, name=made.name or base_id, docs=made.docs or inspect.getdoc(fn) or "")


class Registry:
    def __init__(self, operators: tuple[Operator, ...] = ()):
        self._held: dict[str, Operator] = {}
        for o in operators:
            self.add(o)

    def add(self, operator: Operator) -> Operator:
        if operator.id in self._held:
            raise FlowError(f"{operator.id} is registered already")
        self._held[operator.id] = operator
        return operator

    def node(self, base_id: str, **options: Any):
        """Decorator: register a typed Python function."""

        def keep(fn):
            self.add(operator_of(fn, base_id, **options))
            return fn

        return keep

    def register_class(self, kind: type, version: int = 1, **options: Any) -> Operator:
        """A class with execute(inputs: dict); made once per Python worker and batch, open to any input."""

        def call(**inputs):
            return kind().execute(inputs)

        base = getattr(kind, "base_id", kind.__name__.lower())
        return self.add(Operator(base, version, name=getattr(kind, "name", base), fn=call, dynamic_handles=True, **options))

    def include(self, category: Category) -> None:
        for base_id, fn, options in category.members:
            self.node(base_id, category=category.id, **options)(fn)

    def discover(self, package: str) -> int:
        """Import all modules of a package and add what they register: their `operators` lists and categories."""
        root, n = importlib.import_module(package), 0
        for found in pkgutil.walk_packages(root.__path__, f"{package}."):
            module = importlib.import_module(found.name)
            for o in getattr(module, "operators", ()):
                self.add(o)
                n += 1
            for c in (x for x in vars(module).values() if isinstance(x, Category) and x.members):
                self.include(c)
                n += len(c.members)
        return n

    def merge(self, other: Registry, on_conflict: str = "raise") -> None:
        """Add another registry's operators: conflicts raise, are skipped, or (error-summary) raise all together."""
        clashes = [o.id for o in other if o.id in self._held]
        if clashes and on_conflict == "raise":
            raise FlowError(f"{clashes[0]} is registered already")
        for o in other:
            if o.id not in self._held:
                self._held[o.id] = o
        if clashes and on_conflict == "error-summary":
            raise FlowError(f"registered already: {', '.join(clashes)}")

    def get(self, type_id: str) -> Operator | None:
        base, _, version = type_id.partition("@")
        return self._held.get(type_id) if version else self.get_latest(base)

    def get_latest(self, base_id: str) -> Operator | None:
        return max((o for o in self if o.base_id == base_id), key=lambda o: o.version, default=None)

    def is_deprecated(self, type_id: str) -> bool:
        held = self.get(type_id)
        return held is not None and held.version < self.get_latest(held.base_id).version

    def all(self) -> list[Operator]:
        return list(self)

    def all_current(self) -> list[Operator]:
        return [o for o in self if not self.is_deprecated(o.id)]

    def __iter__(self) -> Iterator[Operator]:
        return iter(list(self._held.values()))

    def __contains__(self, type_id: str) -> bool:
        return self.get(type_id) is not None

    def overlay(self, *sources: Registry) -> Registry:
        """A view in which the sources' definitions come first."""
        out = Registry()
        for registry in (*sources, self):
            out.merge(registry, on_conflict="skip")
        return out

    def palette(self) -> list[dict[str, Any]]:
        return [self.describe(o) for o in self]

    def describe(self, o: Operator) -> dict[str, Any]:
        latest = self.get_latest(o.base_id) or o
        out = {"id": o.id, "base_id": o.base_id, "version": o.version, "name": o.name, "description": o.description, "tags": list(o.tags), "category": o.category, "inputs": [i.to_dict() for i in o.inputs], "outputs": [x.to_dict() for x in o.outputs], "width": o.width, "deprecated": latest.version > o.version, "latest_version": latest.version, "docs": o.docs}
        extras = {"actor": o.actor and o.actor.to_dict(), "timeout_seconds": o.timeout, "idempotency_key": o.idempotency_key, "uses": list(o.uses), "is_decision": o.is_decision, "is_signal": o.is_signal, "has_dynamic_outputs": o.compute_outputs is not None, "has_dynamic_inputs": o.compute_inputs is not None}
        return out | {k: v for k, v in extras.items() if v}

    def table(self, spark: SparkSession) -> DataFrame:
        """The catalog as a DataFrame, one row per operator and version."""
        rows = [(o.id, o.base_id, o.version, o.name, o.category, [i.name for i in o.inputs], [x.name for x in o.outputs], self.is_deprecated(o.id)) for o in self]
        return spark.createDataFrame(rows, "id string, base_id string, version int, name string, category string, inputs array<string>, outputs array<string>, deprecated boolean")
