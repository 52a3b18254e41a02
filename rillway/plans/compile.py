"""Checks of a flow before it is lowered: every problem is reported, type mismatches as warnings or, strictly, errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from rillway.functions import expression
from rillway.model import ERROR_POLICIES, CompilationError, Edge, Flow, Node, layers, links
from rillway.registry import Input, Operator, Output, Registry
from rillway.types import compatible

MAX_DEPTH = 16
_ENDS = {"for-each": "for-each-end", "while": "while-end"}


@dataclass(frozen=True)
class TypeWarning:
    target: str
    handle: str
    source_type: str
    target_type: str

    def __str__(self):
        return f"{self.source_type} into {self.target}.{self.handle} ({self.target_type})"


@dataclass(frozen=True)
class Region:
    """A loop: its kind, start, end, and the nodes between."""

    kind: str
    start: str
    end: str
    body: tuple[str, ...]


@dataclass(frozen=True)
class Compiled:
    flow: Flow
    registry: Registry
    operators: dict[str, Operator]
    inputs: dict[str, tuple[Input, ...]]
    outputs: dict[str, tuple[Output, ...]]
    order: tuple[tuple[Node, ...], ...]
    regions: dict[str, Region]
    managed: frozenset[str]
    warnings: tuple[TypeWarning, ...] = ()
    flows: dict[tuple[str, int], Flow] = field(default_factory=dict)


def regions_of(flow: Flow, operators: dict[str, Operator]) -> dict[str, Region]:
    """Loops by start. An end closes the innermost open start of its kind on the way, so loops may nest."""
    after: dict[str, set[str]] = {}
    for a, b in links(flow.nodes, flow.edges):
        after.setdefault(a, set()).add(b)
    found, problems = {}, []
    for node in flow.nodes:
        kind = operators[node.id].region
        closes = operators[node.id].ends or _ENDS.get(kind)
        if closes is None:
            continue
        ends, depth, queue = set(), {node.id: 0}, [node.id]
        while queue:
            at = queue.pop(0)
            for nxt in after.get(at, ()):
                region = operators[nxt].region
                d = depth[at] + (region == kind)
                if region == closes:
                    if d == 0:
                        ends.add(nxt)
                        continue
                    d -= 1
                if nxt not in depth:
                    depth[nxt] = d
                    queue.append(nxt)
        if len(ends) != 1:
            problems.append(f"{node.id} has {len(ends) or 'no'} matching {closes}")
            continue
        end = ends.pop()
        before: dict[str, set[str]] = {}
        for a, bs in after.items():
            for b in bs:
                before.setdefault(b, set()).add(a)
        back, queue = set(), [end]
        while queue:
            for p in before.get(queue.pop(), ()):
                if p not in back and p != node.id and p in depth:
                    back.add(p)
                    queue.append(p)
        found[node.id] = Region(kind, node.id, end, tuple(n.id for n in flow.nodes if n.id in back))
    if problems:
        raise CompilationError(problems)
    return found


def guards_of(flow: Flow, node_id: str) -> list[Edge]:
    """A decision's edges in the order in which they are tried, the else edge last."""
    return sorted((e for e in flow.edges if e.source == node_id), key=lambda e: (e.when is None, -e.priority))


def _problems(flow: Flow, registry: Registry) -> list[str]:
    out = [f"unknown operator {n.type} of {n.id}" for n in flow.nodes if registry.get(n.type) is None]
    ids = [n.id for n in flow.nodes]
    out += [f"node id {i} is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    known = set(ids)
    out += [f"edge {e.id}: no node {x}" for e in flow.edges for x in (e.source, e.target) if x not in known]
    if flow.on_error_default not in ERROR_POLICIES:
        out.append(f"no error policy {flow.on_error_default!r}")
    manifest = {d.id for d in flow.dependencies}
    for n in flow.nodes:
        if n.on_error is not None and n.on_error not in ERROR_POLICIES:
            out.append(f"{n.id}: no error policy {n.on_error!r}")
        if n.compensation is not None and n.compensation not in known:
            out.append(f"{n.id}: no compensation node {n.compensation}")
        if n.compensation == n.id:
            out.append(f"{n.id} can't compensate itself")
        for handle, (producer, _) in (n.consumes or {}).items():
            if producer not in known:
                out.append(f"{n.id}.{handle} consumes from unknown {producer}")
            elif producer == n.id:
                out.append(f"{n.id}.{handle} consumes its own result")
        held = registry.get(n.type)
        if held and manifest and (missing := set(held.uses) - manifest):
            out.append(f"{n.id} uses {', '.join(sorted(missing))}, which the flow doesn't declare")
    for n in flow.nodes:
        held = registry.get(n.type)
        going = [e for e in flow.edges if e.source == n.id]
        if held is None:
            continue
        if not held.is_decision:
            out += [f"edge {e.id} has a guard but {n.id} is no decision" for e in going if e.when is not None]
            continue
        plain, guarded = [e for e in going if e.when is None], [e for e in going if e.when is not None]
        if len(plain) != 1 or not guarded:
            out.append(f"decision {n.id} needs one else edge and a guarded edge; it has {len(plain)} and {len(guarded)}")
        for e in guarded:
            try:
                expression.parse(e.when)
            except expression.ExpressionError as why:
                out.append(f"edge {e.id}: {why}")
    return out


def compile_flow(flow: Flow, registry: Registry, strict: bool = False, flows: dict[tuple[str, int], Flow] | None = None) -> Compiled:
    problems = _problems(flow, registry)
    if problems:
        raise CompilationError(problems)
    operators = {n.id: registry.get(n.type) for n in flow.nodes}
    # Dynamic shapes: inputs from a node's own data; outputs from upstream outputs, in order.
    inputs = {n.id: tuple(operators[n.id].compute_inputs(n.data)) if operators[n.id].compute_inputs else operators[n.id].inputs for n in flow.nodes}
    order = layers(list(flow.nodes), flow.edges)
    outputs: dict[str, tuple[Output, ...]] = {}
    for node in (n for layer in order for n in layer):
        made = operators[node.id].compute_outputs
        if made is None:
            outputs[node.id] = operators[node.id].outputs
            continue
        bindings = [(e.target_handle, e.source, e.out, next((o.type for o in outputs[e.source] if o.name == e.out), "any")) for e in flow.incoming(node.id)]
        outputs[node.id] = tuple(made(node.data, bindings))
        lost = {o.name for o in operators[node.id].outputs} - {o.name for o in outputs[node.id]}
        if lost and not operators[node.id].dynamic_handles:
            problems.append(f"{node.id}: computed outputs lack {', '.join(sorted(lost))}")
    warnings = []
    wires = [(e.source, e.out, e.target, e.target_handle) for e in flow.edges]
    wires += [(p, h, n.id, name) for n in flow.nodes for name, (p, h) in (n.consumes or {}).items()]
    for source, out, target, handle in wires:
        given = next((o.type for o in outputs[source] if o.name == out), None)
        taken = next((i for i in inputs[target] if i.name == handle), None)
        if given and taken and not compatible(given, taken.type, taken.gathers):
            warnings.append(TypeWarning(target, handle, given, taken.type))
    if strict:
        problems += [str(w) for w in warnings]
    if problems:
        raise CompilationError(problems)
    regions = regions_of(flow, operators)
    inner = {i for r in regions.values() for i in (*r.body, r.end)}
    undone = {n.compensation for n in flow.nodes if n.compensation}
    return Compiled(flow, registry, operators, inputs, outputs, tuple(map(tuple, order)), regions, frozenset(inner | undone), tuple(warnings), flows or {})


def status(flow: Flow, registry: Registry, strict: bool = False) -> dict:
    """{status, errors, warnings} of a flow, for callers that only ask whether it holds."""
    try:
        return {"status": "ok", "errors": [], "warnings": [str(w) for w in compile_flow(flow, registry, strict).warnings]}
    except CompilationError as e:
        return {"status": "error", "errors": e.problems, "warnings": []}
