"""One-operator flows with stated inputs, exact results."""

import json

import pytest
from pyspark.sql import functions as F

from rillway.functions.predicates import CATALOG, UnknownPredicate, predicate
from rillway.model import Flow, Node
from rillway.plans.run import run
from rillway.queries import col, wire


def out(spark, kind, handle="result", **data):
    return run(Flow((Node("out", kind, data),)), spark.range(1)).runs


def give(spark, kind, handle="result", **data):
    r = run(Flow((Node("out", kind, data),)), spark.range(1))
    row = r.runs.select(r.column("out", handle).alias("v"), r.live("out", handle).alias("live"), r.lowering.env["out"].fault.alias("fault")).first()
    return row["v"], row["live"], row["fault"]


CASES = [
    ("text-uppercase", {"text": "hi ß"}, "HI SS"), ("text-lowercase", {"text": "HI"}, "hi"), ("text-trim", {"text": " \t hi\n"}, "hi"), ("text-length", {"text": "h\U0001f600"}, 2),
    ("text-concat", {"a": "foo", "b": "bar", "separator": "-"}, "foo-bar"), ("text-replace", {"text": "ab", "needle": "", "replacement": "."}, ".a.b."), ("text-replace", {"text": "a.b", "needle": ".", "replacement": "$1"}, "a$1b"),
    ("text-contains", {"text": "Hello", "needle": "ELL", "case_sensitive": False}, True), ("text-contains", {"text": "Hello", "needle": "ELL"}, False), ("text-split", {"text": "a.b.", "separator": "."}, ["a", "b", ""]),
    ("text-join", {"parts": [1, None, True], "separator": "-"}, None), ("text-join", {"parts": ["a", "b"]}, "a, b"), ("text-reverse", {"text": "hello"}, "olleh"),
    ("math-add", {"a": 2, "b": "3"}, 5.0), ("math-subtract", {"a": 5, "b": 3}, 2.0), ("math-multiply", {"a": 4, "b": 3}, 12.0), ("math-divide", {"a": 10, "b": 4}, 2.5), ("math-modulo", {"a": -7, "b": 3}, 2.0), ("math-modulo", {"a": 7, "b": -3}, -2.0),
    ("math-round", {"value": 2.5}, 2.0), ("math-round", {"value": 3.14159, "decimals": 2}, 3.14), ("math-min", {"values": [3, 1, 2]}, 1.0), ("math-max", {"values": [3, 1, 2]}, 3.0), ("math-abs", {"value": -7}, 7.0),
    ("regex-match", {"text": "abc", "pattern": "B", "ignore_case": True}, True), ("regex-replace", {"text": "ab", "pattern": "(a)(b)", "replacement": r"\2\1$"}, "ba$"), ("regex-extract", {"text": "a1 b22", "pattern": r"\d+"}, ["1", "22"]), ("regex-extract", {"text": "name: Ada", "pattern": r"name: (?P<n>\w+)"}, ["Ada"]),
    ("logic-not", {"value": True}, False), ("template", {"template": "<{input}>", "input": "x"}, "<x>"), ("combine", {"a": "x", "b": "y"}, "x y"), ("make-list", {"text": " a\\nb |c||", "separator": "|"}, ["a\\nb", "c"]),
    ("json-stringify", {"value": "a\"b"}, '"a\\"b"'), ("json-stringify", {"value": {"b": 1, "a": 2}, "sort_keys": True}, '{"a": 2, "b": 1}'),
]


@pytest.mark.parametrize(("kind", "data", "expected"), [c for c in CASES if c[2] is not None])
def test_values(spark, kind, data, expected):
    assert give(spark, kind, **data)[0] == expected


@pytest.mark.parametrize(("kind", "data"), [("math-divide", {"a": 1, "b": 0}), ("math-modulo", {"a": 1, "b": 0}), ("math-min", {"values": []}), ("json-parse", {"text": "{"}), ("text-split", {"text": "a", "separator": ""}), ("math-add", {"a": "x", "b": 1})])
def test_faults(spark, kind, data):
    value, live, fault = give(spark, kind, **data)
    assert value is None and not live and fault


def test_json_path(spark):
    r = run(Flow((Node("p", "json-parse", {"text": '{"a": [{"b": 1}, {"b": 2}], "0": "zero"}'}), *[Node(f"g{i}", "json-get", {"path": path}, consumes={"value": ("p", "result")}) for i, path in enumerate(["a.-1.b", "a. 0 .b", "0", "none.b"])])), spark.range(1))
    row = r.runs.select(*[F.try_variant_get(r.column(f"g{i}"), "$", "string").alias(f"v{i}") for i in range(4)]).first()
    assert tuple(row) == ("2", "1", "zero", None)


def test_branches(spark):
    assert give(spark, "logic-if-empty", "output_2", text="  ") == ("  ", True, None)
    assert give(spark, "logic-if-empty", "output_1", text="  ") == (None, False, None)
    assert give(spark, "logic-if-equals", "output_1", a="A", b="a", case_sensitive=False)[0] == "A"


TRUTH = [
    ("equals", "a", "a", True), ("not_equals", "a", "a", False), ("contains", "abc", "b", True), ("not_contains", "abc", "b", False), ("is_empty", "  ", None, True), ("is_not_empty", "x", None, True), ("starts_with", "abc", "ab", True), ("ends_with", "abc", "bc", True),
    ("num_equals", "1_0", "10.0", True), ("num_not_equals", "1", "2", True), ("gt", "2", "", True), ("lt", "1", "2", True), ("gte", "2", "2", True), ("lte", "3", "2", False), ("is_true", "JA", None, True), ("is_false", "nej", None, True),
    ("has_key", '{"key": 1}', "key", True), ("has_key", '["key"]', "key", True), ("not_has_key", "{}", "key", True), ("is_empty_object", "[]", None, True), ("is_not_empty_object", '{"a": 1}', None, True), ("value_equals", '{"a": 1}', "a=1", True), ("value_equals", "{}", "a=", True), ("value_contains", '{"a": "xyz"}', "a=y", True),
    ("er større end", "3", "2", True), ("indeholder", "abc", "z", False),
]


@pytest.mark.parametrize(("name", "a", "b", "expected"), TRUTH)
def test_predicates(spark, name, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(predicate(name, F.col("a"), F.col("b"))).first()[0] is expected


def test_every_predicate_is_covered():
    assert {p.id for p in CATALOG} == {t[0] for t in TRUTH if t[0] in {p.id for p in CATALOG}}


@pytest.mark.parametrize(("name", "a", "b"), [("gt", "not-a-number", "10"), ("has_key", "not json", "key"), ("value_equals", '{"a": 1}', "no sign")])
def test_predicates_that_cannot_judge(spark, name, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(predicate(name, F.col("a"), F.col("b"))).first()[0] is False
    with pytest.raises(Exception, match="judged"):
        df.select(predicate(name, F.col("a"), F.col("b"), strict=True)).collect()


def test_unknown_predicate():
    with pytest.raises(UnknownPredicate):
        predicate("nope", F.lit("a"))


def test_json_as_python_writes_it(spark):
    values = [{"b": [1, 2.5, "é\u0001\x7f😀\"\\u000B\n"], "a": {}, "c": [], "d": None, "e": [[], {"x": [1]}], "f": True, "g": 1e20, "h": 0.00025, "i": "\\\u000b", "j": 1e-05}, [], "x", 5, None, [None, {"k": {"y": [{}], "z": 1}}]]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
    for indent in (0, 2, 3):
        flow = Flow((col("t"), Node("p", "json-parse"), Node("out", "json-stringify", {"indent": indent, "sort_keys": True})), (wire("t", "p", "text"), wire("p", "out", "value")))
        r = run(flow, df)
        assert [x["out"] for x in r.runs.select(r.column("out").alias("out")).collect()] == [json.dumps(v, indent=indent or None, sort_keys=True) for v in values]


@pytest.mark.parametrize(("path", "want"), [("b.0", "1"), ("b.-1", '"x"'), ("b.9", None), ("b.x", None), ("a.k.n", "2"), ("a. k .0", None), ("", None), ("missing.y", None), (None, None)])
def test_json_get_by_a_column(spark, path, want):
    df = spark.createDataFrame([('{"a": {"k": {"n": 2}}, "b": [1, 2, "x"]}', path)], "t string, path string")
    flow = Flow((col("t"), col("path"), Node("p", "json-parse"), Node("out", "json-get")), (wire("t", "p", "text"), wire("p", "out", "value"), wire("path", "out", "path")))
    r = run(flow, df)
    got = r.runs.select(F.to_json(r.column("out")).alias("out")).first()["out"]
    assert got == ('{"a":{"k":{"n":2}},"b":[1,2,"x"]}' if path == "" else want)
