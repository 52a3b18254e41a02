import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions import expression as E
from rillway.functions.expression import Value


@pytest.fixture(scope="module")
def row(spark):
    return spark.sql("SELECT 7 AS n, -5L AS m, 2.5D AS x, 'abc' AS s, '' AS e, array('admin', 'user') AS roles, map('a', 1) AS held, CAST(NULL AS STRING) AS nothing, named_struct('amount', 1500, 'tier', 'gold') AS invoice")


def value(row, source):
    scope = {f.name: Value(F.col(f.name), f.dataType) for f in row.schema.fields}
    return row.select(E.column(source, scope).column.alias("v")).first()["v"]


CASES = [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-5 / 2", -2), ("5 / 2.0", 2.5), ("m % 3", 1), ("7 % -3", -2), ("true && false", False), ("true || false", True), ("!true == false", True),
    ("1 < 2 == true", True), ("'a' + 1", "a1"), ("s + true", "abcTrue"), ("nothing == null", True), ("s == null", False), ("n == 7.0", True), ("'b' in s", True), ("'admin' in roles", True), ("'a' in held", True),
    ("roles[0]", "admin"), ("roles[-1]", "user"), ("held['a']", 1), ("invoice.amount > 1000 ? 'big' : 'small'", "big"), ("$.invoice.tier", "gold"), ("false ? 1 : true ? 2 : 3", 2),
    ("size(roles)", 2), ("s.size()", 3), ("has(held, 'a')", True), ("'abc'.matches('[a-z]+')", True), ("'abc1'.matches('[a-z]+')", False), ("upper(s)", "ABC"), ("s.upper()", "ABC"), ("int('42')", 42), ("int(3.9)", 3),
    ("double(n)", 7.0), ("bool('false')", True), ("bool(e)", False), ("exists(nothing)", False), ("min(3, 1, 2)", 1), ("max([3, 1, 2])", 3), ("abs(m)", 5), ("string(n)", "7"), ("'x\\ny'", "x\ny"), ("not e", True), ("n and s", True),
    ("[1, 2] + [3]", [1, 2, 3]), ("{'k': 1}['k']", 1), ("held.keys()", ["a"]), ("held.values()", [1]), ("n.keys()", []), ("startsWith(s, 'a') and endsWith(s, 'c')", True), ("contains(s, 'b')", True), ("1 == '1'", False),
]


@pytest.mark.parametrize(("source", "expected"), CASES)
def test_values(row, source, expected):
    assert value(row, source) == expected


def test_right_side_is_not_evaluated(row):
    assert value(row, "false && 1 / 0 == 1") is False


@pytest.mark.parametrize("source", ["1 +", "", "(1", "a ? b", "1 ** 2", "lambda: 1", "f'{x}'"])
def test_parse_errors(source):
    with pytest.raises(E.ExpressionParseError):
        E.parse(source)


@pytest.mark.parametrize("source", ["missing", "invoice.none", "open('x')", "s.__class__", "s.format(1)", "1 < 'a'"])
def test_refused(row, source):
    with pytest.raises(E.ExpressionError):
        value(row, source)


@pytest.mark.parametrize("source", ["1 / 0", "1 % 0", "roles[9]", "held['zz']", f"'a'.matches('{'a' * 257}')"])
def test_fail_at_run_time(row, source):
    with pytest.raises(Exception, match=r"."):
        value(row, source)


def test_identifiers():
    assert E.identifiers("a.b + c") == {"a", "c"}
    assert E.identifiers("size(x) > 0") == {"x"}


def test_truth_is_never_null(row):
    scope = {"nothing": Value(F.col("nothing"), T.StringType())}
    assert row.select(E.condition("nothing", scope).alias("v")).first()["v"] is False
