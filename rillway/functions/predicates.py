"""The catalog of 22 predicates over text operands, by id or by stored label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillway.functions.values import number, strip
from rillway.model import FlowError

#: Words that count as true, in lower case.
TRUE_WORDS = ("true", "1", "yes", "ja", "sand")


class UnknownPredicate(FlowError):
    pass


@dataclass(frozen=True)
class Predicate:
    """test gives a nullable boolean; null means that the operands can't be judged (fault says why)."""

    id: str
    label: str
    category: str
    arity: int
    test: Callable[[Column, Column], Column]


def _numbers(compare):
    return lambda a, b: compare(number(a), number(F.when(b == "", F.lit("0")).otherwise(b)))


def _json_size(a: Column) -> Column:
    return F.coalesce(F.size(F.json_object_keys(a)), F.json_array_length(a))


def _json_has(a: Column, b: Column) -> Column:
    keys = F.json_object_keys(a)
    return F.when(keys.isNotNull(), F.array_contains(keys, b)).when(F.json_array_length(a).isNotNull(), F.coalesce(F.array_contains(F.from_json(a, "array<string>"), b), F.lit(False)))


def _json_value(compare):
    def test(a: Column, b: Column) -> Column:
        at = F.locate("=", b)
        wanted = F.substring(b, at + 1, F.length(b))
        key = F.substring(b, F.lit(1), at - 1)
        held = F.from_json(a, "map<string,string>")
        found = F.coalesce(F.get(F.map_values(F.map_filter(held, lambda k, _: k == key)), F.lit(0)), F.lit(""))
        return F.when((at > 0) & F.json_object_keys(a).isNotNull(), compare(found, wanted))

    return test


#: Ids, labels, categories, operand counts.
CATALOG = (
    Predicate("equals", "er lig med", "tekst", 2, lambda a, b: a == b),
    Predicate("not_equals", "er ikke lig med", "tekst", 2, lambda a, b: a != b),
    Predicate("contains", "indeholder", "tekst", 2, lambda a, b: F.contains(a, b)),
    Predicate("not_contains", "indeholder ikke", "tekst", 2, lambda a, b: ~F.contains(a, b)),
    Predicate("is_empty", "er tom", "tekst", 1, lambda a, _: strip(a) == ""),
    Predicate("is_not_empty", "er ikke tom", "tekst", 1, lambda a, _: strip(a) != ""),
    Predicate("starts_with", "starter med", "tekst", 2, lambda a, b: F.startswith(a, b)),
    Predicate("ends_with", "slutter med", "tekst", 2, lambda a, b: F.endswith(a, b)),
    Predicate("num_equals", "er lig med (tal)", "tal", 2, _numbers(lambda x, y: x == y)),
    Predicate("num_not_equals", "er ikke lig med (tal)", "tal", 2, _numbers(lambda x, y: x != y)),
    Predicate("gt", "er større end", "tal", 2, _numbers(lambda x, y: x > y)),
    Predicate("lt", "er mindre end", "tal", 2, _numbers(lambda x, y: x < y)),
    Predicate("gte", "er større end eller lig", "tal", 2, _numbers(lambda x, y: x >= y)),
    Predicate("lte", "er mindre end eller lig", "tal", 2, _numbers(lambda x, y: x <= y)),
    Predicate("is_true", "er sand", "boolean", 1, lambda a, _: F.lower(a).isin(*TRUE_WORDS)),
    Predicate("is_false", "er falsk", "boolean", 1, lambda a, _: ~F.lower(a).isin(*TRUE_WORDS)),
    Predicate("has_key", "indeholder nøgle", "json", 2, _json_has),
    Predicate("not_has_key", "indeholder ikke nøgle", "json", 2, lambda a, b: ~_json_has(a, b)),
    Predicate("is_empty_object", "er tom objekt", "json", 1, lambda a, _: _json_size(a) == 0),
    Predicate("is_not_empty_object", "er ikke tom objekt", "json", 1, lambda a, _: _json_size(a) > 0),
    Predicate("value_equals", "værdi er lig med", "json", 2, _json_value(lambda x, y: x == y)),
    Predicate("value_contains", "værdi indeholder", "json", 2, _json_value(lambda x, y: F.contains(x, y))),
)
_BY_NAME = {name: p for p in CATALOG for name in (p.id, p.label)}


def find(id_or_label: str) -> Predicate:
    if id_or_label not in _BY_NAME:
        raise UnknownPredicate(f"unknown predicate {id_or_label!r}")
    return _BY_NAME[id_or_label]


def predicate(id_or_label: str, a: Column, b: Column | None = None, strict: bool = False) -> Column:
    """The predicate over operands as text (null is empty). Operands that can't be judged are false, or with
    strict=True an error."""
    spec = find(id_or_label)
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    found = spec.test(as_text(a), as_text(b) if spec.arity == 2 else F.lit(""))
    fault = F.raise_error(F.lit(f"{spec.id}: operands can't be judged")).cast("boolean")
    return F.coalesce(found, fault if strict else F.lit(False))
