"""Flows in and out: dictionaries, JSON and YAML files, canvas (nodes with positions) and request payloads."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.model import Dependency, Edge, Flow, FlowError, Node, Trigger, layers


def reference(raw: Any) -> tuple[str, str]:
    """(producer, handle) from a pair or a {producer, handle} mapping."""
    if isinstance(raw, dict) and "producer" in raw:
        return raw["producer"], raw.get("handle", "result")
    if isinstance(raw, (list, tuple)) and len(raw) == 2:
        return raw[0], raw[1]
    raise FlowError(f"a consumed reference is a pair or a mapping with a producer, not {raw!r}")


_NODE_EXTRAS = ("produces", "compensation", "on_error", "node_label", "output_labels")


def node_of(raw: dict[str, Any]) -> Node:
    for needed in ("id", "type"):
        if needed not in raw:
            raise FlowError(f"a node without {needed}: {raw}")
    consumes = {k: reference(v) for k, v in (raw.get("consumes") or {}).items()} or None
    return Node(raw["id"], raw["type"], dict(raw.get("data") or {}), consumes=consumes, **{k: raw.get(k) or None for k in _NODE_EXTRAS})


def edge_of(raw: dict[str, Any]) -> Edge:
    if "id" not in raw:
        raise FlowError(f"an edge without id: {raw}")
    pick = lambda a, b: raw.get(a) or raw.get(b)
    return Edge(raw["id"], raw["source"], raw["target"], pick("source_handle", "sourceHandle"), pick("target_handle", "targetHandle"), raw.get("when"), int(raw.get("priority") or 0))


def flow_from_dict(raw: dict[str, Any]) -> Flow:
    if not isinstance(raw, dict):
        raise FlowError("a flow is a mapping")
    triggers = tuple(Trigger(t["id"], t["kind"], dict(t.get("config") or {}), t.get("input_map") or t.get("map")) for t in raw.get("triggers") or ())
    dependencies = tuple(Dependency(d["id"], d["kind"], dict(d.get("config") or {})) for d in raw.get("dependencies") or ())
    return Flow(tuple(map(node_of, raw.get("nodes") or ())), tuple(map(edge_of, raw.get("edges") or ())), raw.get("id"), int(raw.get("version", 1)), raw.get("name"), raw.get("description"), dependencies, triggers, raw.get("on_error_default", "fail"))


def flow_to_dict(flow: Flow) -> dict[str, Any]:
    """What flow_from_dict reads; defaults and empty parts are left out."""
    shown = lambda pairs: {k: v for k, v in pairs if v}
    out = shown([("id", flow.id), ("version", flow.version if flow.version != 1 else None), ("name", flow.name), ("description", flow.description), ("on_error_default", flow.on_error_default if flow.on_error_default != "fail" else None)])
    out |= shown([("dependencies", [{"id": d.id, "kind": d.kind, "config": d.config} for d in flow.dependencies]), ("triggers", [{"id": t.id, "kind": t.kind, "config": t.config} | shown([("input_map", t.input_map)]) for t in flow.triggers])])
    out["nodes"] = [{"id": n.id, "type": n.type} | shown([("data", n.data), ("consumes", {k: list(v) for k, v in (n.consumes or {}).items()}), *((k, getattr(n, k)) for k in _NODE_EXTRAS)]) for n in flow.nodes]
    out["edges"] = [{"id": e.id, "source": e.source, "target": e.target} | shown([("source_handle", e.source_handle), ("target_handle", e.target_handle), ("when", e.when), ("priority", e.priority)]) for e in flow.edges]
    return out


def flow_to_yaml(flow: Flow) -> str:
    try:
        import yaml
    except ImportError:
        return json.dumps(flow_to_dict(flow), indent=2)  # JSON is YAML
    return yaml.safe_dump(flow_to_dict(flow), sort_keys=False)


def flow_from_yaml(written: str) -> Flow:
    try:
        import yaml
    except ImportError:
        return flow_from_dict(json.loads(written))
    return flow_from_dict(yaml.safe_load(written))


def load(path: str | Path) -> Flow:
    path = Path(path)
    written = path.read_text()
    if path.suffix == ".json":
        return flow_from_dict(json.loads(written))
    if path.suffix in (".yaml", ".yml"):
        return flow_from_yaml(written)
    raise FlowError(f"flows are .json, .yaml or .yml files, not {path.suffix or path.name}")


def dump(flow: Flow, path: str | Path) -> None:
    path = Path(path)
    if path.suffix not in (".json", ".yaml", ".yml"):
        raise FlowError(f"flows are .json, .yaml or .yml files, not {path.suffix or path.name}")
    path.write_text(json.dumps(flow_to_dict(flow), indent=2) if path.suffix == ".json" else flow_to_yaml(flow))


def flow_table(spark: SparkSession, paths: str) -> DataFrame:
    """path and definition (VARIANT) of many JSON flow files, read by Spark."""
    read = spark.read.text(paths, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("definition"))


def positions(flow: Flow, x_gap: int = 260, y_gap: int = 120) -> dict[str, dict[str, int]]:
    """Canvas places: columns by longest path from a start, rows by declaration."""
    return {n.id: {"x": x * x_gap, "y": y * y_gap} for x, layer in enumerate(layers(list(flow.nodes), flow.edges)) for y, n in enumerate(layer)}


def to_canvas(flow: Flow, places: dict[str, dict[str, int]] | None = None) -> dict[str, Any]:
    """The flow as a canvas library holds it; nodes without a place get one."""
    at = positions(flow) | (places or {})
    shown = flow_to_dict(flow)
    nodes = [{"id": n["id"], "type": n["type"], "position": at[n["id"]], "data": {k: v for k, v in n.items() if k not in ("id", "type")}} for n in shown["nodes"]]
    edges = []
    for e in flow.edges:
        guard = ({"when": e.when, "priority": e.priority} if e.when else {"priority": e.priority} if e.priority else {})
        edges.append({"id": e.id, "source": e.source, "target": e.target, "sourceHandle": e.source_handle, "targetHandle": e.target_handle} | ({"data": guard} if guard else {}))
    return {"nodes": nodes, "edges": edges}


def from_canvas(raw: dict[str, Any]) -> Flow:
    """The flow of a canvas; keys that mean nothing here are ignored."""
    nodes = [node_of({**(n.get("data") or {}), "id": n["id"], "type": n["type"]}) for n in raw.get("nodes", ())]
    edges = [edge_of({**e, **(e.get("data") or {})}) for e in raw.get("edges", ())]
    return Flow(tuple(nodes), tuple(edges))


def from_payload(raw: dict[str, Any]) -> tuple[Flow, dict[str, Any]]:
    """The flow of an execution request, and the cached results that come with it (node id to handles)."""
    return flow_from_dict(raw), dict(raw.get("cache") or {})
