"""The declared flow: nodes, edges, dependencies and triggers, and their order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any


class FlowError(Exception):
    """Base of everything this package raises on purpose."""


class CompilationError(FlowError):
    """The flow can't be lowered; `problems` lists every reason found."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Node:
    """One operator of a flow. consumes maps an input to (producer id, handle) without an edge."""

    id: str
    type: str
    data: dict[str, Any] = field(default_factory=dict)
    produces: dict[str, str] | None = None
    consumes: dict[str, tuple[str, str]] | None = None
    compensation: str | None = None
    on_error: str | None = None
    node_label: str | None = None
    output_labels: dict[str, str] | None = None


@dataclass(frozen=True)
class Edge:
    id: str
    source: str
    target: str
    source_handle: str | None = None
    target_handle: str | None = None
    when: str | None = None
    priority: int = 0

    @property
    def out(self) -> str:
        return self.source_handle or "result"

    @property
    def into(self) -> str | None:
        return self.target_handle


@dataclass(frozen=True)
class Dependency:
    id: str
    kind: str
    config: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Trigger:
    id: str
    kind: str
    config: dict[str, Any] = field(default_factory=dict)
    input_map: str | None = None


ERROR_POLICIES = ("fail", "continue", "compensate")


@dataclass(frozen=True)
class Flow:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...] = ()
    id: str | None = None
    version: int = 1
    name: str | None = None
    description: str | None = None
    dependencies: tuple[Dependency, ...] = ()
    triggers: tuple[Trigger, ...] = ()
    on_error_default: str = "fail"

    def __post_init__(self):
        for part in ("nodes", "edges", "dependencies", "triggers"):
            object.__setattr__(self, part, tuple(getattr(self, part)))

    @property
    def by_id(self) -> dict[str, Node]:
        return {n.id: n for n in self.nodes}

    def incoming(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node_id]

    def policy(self, node: Node) -> str:
        return node.on_error or self.on_error_default


def links(nodes: Iterable[Node], edges: Iterable[Edge]) -> set[tuple[str, str]]:
    """(before, after) pairs: edges and consumed references."""
    known = {n.id for n in nodes}
    pairs = {(e.source, e.target) for e in edges}
    pairs |= {(ref[0], n.id) for n in nodes for ref in (n.consumes or {}).values()}
    return {(a, b) for a, b in pairs if a in known and b in known}


def layers(nodes: list[Node], edges: Iterable[Edge]) -> list[list[Node]]:
    """Nodes by longest path from a start, each layer in declaration order; a cycle is an error."""
    needs: dict[str, set[str]] = {n.id: set() for n in nodes}
    for a, b in links(nodes, edges):
        needs[b].add(a)
    out, done = [], set()
    rest = list(nodes)
    while rest:
        ready = [n for n in rest if needs[n.id] <= done]
        if not ready:
            raise CompilationError([f"cycle among {', '.join(sorted(n.id for n in rest))}"])
        out.append(ready)
        done |= {n.id for n in ready}
        rest = [n for n in rest if n.id not in done]
    return out
