"""Type names of handles, their Spark types, and which may flow into which."""

from __future__ import annotations

import datetime
import inspect
import types as python_types
import typing

from pyspark.sql import types as T

#: Handle types by name.
SPARK_TYPES = {
    "str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "any": T.VariantType(), "object": T.VariantType(), "none": T.NullType(),
    "date": T.DateType(), "base64str": T.BinaryType(), "namedfile": T.StructType().add("content", "string").add("filename", "string"),
}
NUMBERS = {"int", "float", "bool"}
TAKES_ANYTHING = {"any", "object", "str"}


def type_name(hint) -> str:
    """The name of a Python annotation: unions by |, Optional[T] as T, containers with their parameters."""
    if hint is None or hint is type(None):
        return "none"
    if hint is typing.Any or hint is inspect.Parameter.empty:
        return "any"
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is typing.Literal:
        return "str"
    if origin in (typing.Union, python_types.UnionType):
        kept = [type_name(a) for a in args if a is not type(None)]
        return " | ".join(dict.fromkeys(kept))
    if origin is not None:
        inner = ", ".join("..." if a is Ellipsis else type_name(a) for a in args)
        return f"{origin.__name__}[{inner}]"
    if hint is datetime.date:
        return "date"
    return getattr(hint, "__name__", str(hint)).lower()


def split_top(name: str, mark: str) -> list[str]:
    """Parts of a type name between marks that stand outside brackets."""
    parts, depth, held = [], 0, ""
    for c in name:
        depth += (c in "[(") - (c in "])")
        if c == mark and not depth:
            parts.append(held.strip())
            held = ""
        else:
            held += c
    return [p for p in (*parts, held.strip()) if p]


def spark_type(name: str) -> T.DataType:
    alternatives = split_top(name.lower(), "|")
    if len(alternatives) > 1:
        kinds = {spark_type(a) for a in alternatives if a != "none"}
        return T.DoubleType() if kinds <= {T.LongType(), T.DoubleType()} else kinds.pop() if len(kinds) == 1 else T.VariantType()
    name = alternatives[0] if alternatives else "any"
    if name in SPARK_TYPES:
        return SPARK_TYPES[name]
    if name == "multinamedfile":
        return T.ArrayType(SPARK_TYPES["namedfile"])
    if name.endswith("]"):
        outer, inner = name[:-1].split("[", 1)
        parts = split_top(inner, ",")
        if outer == "list":
            return T.ArrayType(spark_type(parts[0]))
        if outer == "dict":
            return T.MapType(T.StringType(), spark_type(parts[1]) if len(parts) > 1 else T.VariantType())
        if outer == "tuple":
            return T.StructType([T.StructField(f"output_{i}", spark_type(p)) for i, p in enumerate(parts, 1)])
    return T.ArrayType(T.VariantType()) if name == "list" else T.MapType(T.StringType(), T.VariantType()) if name == "dict" else T.VariantType()


def name_of(kind: T.DataType) -> str:
    """The handle type of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return f"list[{name_of(kind.elementType)}]"
    if isinstance(kind, T.MapType):
        return f"dict[str, {name_of(kind.valueType)}]"
    if isinstance(kind, T.StructType):
        return "dict[str, any]"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.NumericType):
        return "float"
    return next((n for n, t in SPARK_TYPES.items() if t == kind), "any")


def compatible(source: str, target: str, connection_list: bool = False) -> bool:
    """May a value of type `source` enter an input of type `target`? Containers wrap and unwrap one level."""
    a, b = source.lower().strip(), target.lower().strip()
    many = [(x, y) for x in split_top(a, "|") for y in split_top(b, "|") if x != "none" and y != "none"]
    if len(many) > 1:
        return any(compatible(x, y, connection_list) for x, y in many)
    if many:
        (a, b), = many
    if a == b or b in TAKES_ANYTHING or a == "any" or connection_list or {a, b} <= NUMBERS:
        return True
    if a.startswith("dict") and b.startswith("dict"):
        return True
    inner = lambda n: n[5:-1] if n.startswith("list[") and n.endswith("]") else None
    return bool(inner(b) and compatible(a, inner(b))) or bool(inner(a) and compatible(inner(a), b))
