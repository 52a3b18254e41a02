"""Guard and condition expressions as Spark columns.

The text is rewritten to Python's own expression syntax, which Python parses; a walk over that tree, with Spark types
at hand, builds the Column. `$` is the whole scope. Integers divide towards zero; `%` is floored; `==` is null-safe;
&&, || and ! work on truth as Python has it. Nothing but the functions listed here can be called.

What fails for a row (a missing key, an index out of range, division by zero, integer overflow, text that is no number)
is a column too: `checked` gives the value and the row's fault, and only what is evaluated can fail.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions.values import floored_mod, text, truthy
from rillway.model import FlowError

#: The longest pattern and text that matches() accepts.
PATTERN_CHARS, TEXT_CHARS = 256, 65536


class ExpressionError(FlowError):
    pass


class ExpressionParseError(ExpressionError):
    pass


class ExpressionTypeError(ExpressionError):
    pass


@dataclass(frozen=True)
class Value:
    """A column with its Spark type."""

    column: Column
    kind: T.DataType


Scope = dict[str, Value]

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*|\$)|(?P<mark>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}]))""")
_WORDS = {"true": "True", "false": "False", "null": "None", "$": "root_", "not": "~", "and": "and", "or": "or", "in": "in", "None": "None"}
_MARKS = {"&&": " and ", "||": " or ", "!": "~"}
_RESERVED = {"root_", "lambda", "if", "else", "for", "await", "yield", "is", "True", "False"}

_KNOWN = (
    ast.Constant, ast.Name, ast.Load, ast.List, ast.Dict, ast.Attribute, ast.Subscript, ast.UnaryOp, ast.Invert, ast.USub, ast.BoolOp, ast.And, ast.Or, ast.IfExp, ast.Call,
    ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod,
)


def _tokens(source: str) -> list[str]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionParseError(f"unexpected {source[at:].strip()[:10]!r}")
        kind, found = m.lastgroup, m[m.lastgroup]
        if kind == "name":
            if found in _RESERVED and found not in ("True", "False"):
                raise ExpressionParseError(f"{found} can't be a name here")
            found = f" {_WORDS.get(found, found)} "
        elif kind == "mark":
            found = _MARKS.get(found, found)
        elif kind == "string":
            found = repr(_unescape(found[1:-1]))
        out.append(found)
        at = m.end()
    return out


def _unescape(body: str) -> str:
    known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "0": "\0"}
    return re.sub(r"\\(.)", lambda m: known.get(m[1], m[1]), body, flags=re.S)


def _group(tokens: list[str], at: int, close: str | None) -> tuple[str, int]:
    """Python text of the tokens up to the closing bracket, ternaries turned round."""
    parts: list[str] = []
    while at < len(tokens):
        t = tokens[at]
        if t == close:
            return _ternary(parts, close == "}"), at + 1
        if t in ("(", "[", "{"):
            inner, at = _group(tokens, at + 1, {"(": ")", "[": "]", "{": "}"}[t])
            parts.append(t + inner + {"(": ")", "[": "]", "{": "}"}[t])
            continue
        if t in (")", "]", "}"):
            raise ExpressionParseError(f"unexpected {t}")
        parts.append(t)
        at += 1
    if close:
        raise ExpressionParseError(f"missing {close}")
    return _ternary(parts, False), at


def _ternary(parts: list[str], is_map: bool) -> str:
    pieces: list[list[str]] = [[]]
    for p in parts:
        if p == ",":
            pieces.append([])
        else:
            pieces[-1].append(p)
    done = []
    for piece in pieces:
        if is_map and ":" in piece:
            cut = piece.index(":")
            done.append("".join(piece[:cut]) + ":" + _choice(piece[cut + 1 :]))
        else:
            done.append(_choice(piece))
    return ",".join(done)


def _choice(parts: list[str]) -> str:
    if "?" not in parts:
        return "".join(parts)
    cut, depth = parts.index("?"), 0
    for i in range(cut + 1, len(parts)):
        depth += parts[i] == "?"
        if parts[i] == ":":
            if not depth:
                return f"(({_choice(parts[cut + 1 : i])}) if ({''.join(parts[:cut])}) else ({_choice(parts[i + 1 :])}))"
            depth -= 1
    raise ExpressionParseError("? without :")


def parse(source: str) -> ast.expr:
    tokens = _tokens(source or "")
    if not tokens:
        raise ExpressionParseError("empty expression")
    try:
        tree = ast.parse(_group(tokens, 0, None)[0].strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ExpressionParseError(f"can't read {source!r}: {e}") from None
    if strange := [type(n).__name__ for n in ast.walk(tree) if not isinstance(n, _KNOWN)]:
        raise ExpressionParseError(f"{strange[0]} isn't part of the language")
    return tree


def identifiers(source: str) -> set[str]:
    """Free names of an expression."""
    return _free(parse(source)) - {"root_"}


def checked(source: str, scope: Scope) -> tuple[Value, Column]:
    """An expression's value, null for rows where it fails, and the fault of those rows, null for others."""
    builder = _Builder(scope)
    value = builder.build(parse(source))
    fault = builder.fault()
    if fault is None:
        return value, F.lit(None).cast("string")
    return Value(F.when(fault.isNull(), value.column), value.kind), fault


def checked_condition(source: str, scope: Scope) -> tuple[Column, Column]:
    """The truth of an expression, never null and false for rows where it fails, and the fault of those rows."""
    value, fault = checked(source, scope)
    return fault.isNull() & truthy(value.column, value.kind), fault


def column(source: str, scope: Scope) -> Value:
    """An expression's value; a row where it fails fails the job."""
    value, fault = checked(source, scope)
    if isinstance(value.kind, T.NullType):
        return value
    return Value(F.when(fault.isNull(), value.column).otherwise(F.raise_error(fault).cast(value.kind)), value.kind)


def condition(source: str, scope: Scope) -> Column:
    """The truth of an expression, never null; a row where it fails fails the job."""
    value = column(source, scope)
    return truthy(value.column, value.kind)


def equalities(source: str, one: Scope, other: Scope) -> list[tuple[Value, Value]]:
    """What must be equal for the expression to be true, of names of `one` alone and of names of `other` alone: the pairs of
    its top-level conjuncts that are ==, as values of one type (null == null holds)."""
    found, todo = [], [parse(source)]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
            todo += node.values
        elif isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq):
            sides = (node.left, node.comparators[0])
            names = [_free(x) for x in sides]
            for (a, b), (of_a, of_b) in ((sides, names), (sides[::-1], names[::-1])):
                if of_a and of_b and of_a <= one.keys() and of_b <= other.keys() and not of_a & other.keys() and not of_b & one.keys():
                    try:
                        pair = _Builder({}).alike(_Builder(one).build(a), _Builder(other).build(b))
                    except ExpressionError:
                        continue  # what can't be built here is left to the whole expression
                    if type(pair[0].kind) is type(pair[1].kind) and isinstance(pair[0].kind, T.AtomicType) and not _is(pair[0], T.VariantType):
                        found.append(pair)
    return found[::-1]


def _free(tree: ast.expr) -> set[str]:
    called = {id(c.func) for c in ast.walk(tree) if isinstance(c, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


_NUM = T.NumericType


def _is(value: Value, *kinds) -> bool:
    return isinstance(value.kind, kinds)


class _Builder:
    def __init__(self, scope: Scope):
        self.scope = scope
        self.faults: list[Column] = []

    def fail(self, where: Column, message: str | Column) -> None:
        self.faults.append(F.when(where, F.lit(message) if isinstance(message, str) else message))

    def fault(self) -> Column | None:
        return (F.coalesce(*self.faults) if len(self.faults) > 1 else self.faults[0]) if self.faults else None

    def apart(self, node: ast.expr) -> tuple[Value, Column | None]:
        """A part that not every row evaluates, and its own fault."""
        held, self.faults = self.faults, []
        value, fault = self.build(node), self.fault()
        self.faults = held
        return value, fault

    def build(self, node: ast.expr) -> Value:
        make = getattr(self, f"on_{type(node).__name__}", None)
        if make is None:
            raise ExpressionParseError(f"{type(node).__name__} isn't part of the language")
        return make(node)

    def on_Constant(self, node: ast.Constant) -> Value:
        v = node.value
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
        return Value(F.lit(v).cast(kinds[type(v)]) if v is not None else F.lit(None), kinds[type(v)])

    def on_Name(self, node: ast.Name) -> Value:
        if node.id == "root_":
            return Value(F.struct(*[v.column.alias(k) for k, v in self.scope.items()]), T.StructType([T.StructField(k, v.kind) for k, v in self.scope.items()]))
        if node.id not in self.scope:
            raise ExpressionError(f"undefined name {node.id!r}")
        return self.scope[node.id]

    def on_List(self, node: ast.List) -> Value:
        items = [self.build(x) for x in node.elts]
        kind = items[0].kind if items else T.NullType()
        return Value(F.array(*[x.column for x in items]), T.ArrayType(kind))

    def on_Dict(self, node: ast.Dict) -> Value:
        pairs = [(self.build(k), self.build(v)) for k, v in zip(node.keys, node.values, strict=True)]
        kinds = (pairs[0][0].kind, pairs[0][1].kind) if pairs else (T.StringType(), T.NullType())
        return Value(F.create_map(*[c.column for p in pairs for c in p]), T.MapType(*kinds))

    def on_Attribute(self, node: ast.Attribute) -> Value:
        if isinstance(node.value, ast.Name) and node.value.id == "root_":
            return self.on_Name(ast.Name(node.attr))
        return self.item(self.build(node.value), Value(F.lit(node.attr), T.StringType()), node.attr)

    def on_Subscript(self, node: ast.Subscript) -> Value:
        key = node.slice.value if isinstance(node.slice, ast.Constant) else None
        return self.item(self.build(node.value), self.build(node.slice), key)

    def item(self, of: Value, key: Value, known) -> Value:
        if _is(of, T.StructType):
            if known not in of.kind.fieldNames():
                raise ExpressionError(f"no field {known!r}")
            return Value(of.column.getField(known), of.kind[known].dataType)
        if _is(of, T.MapType):
            here = F.map_contains_key(of.column, key.column)
            self.fail(~here, F.concat(F.lit("missing key "), key.column.cast("string")))
            return Value(F.when(here, F.element_at(of.column, key.column)), of.kind.valueType)
        if _is(of, T.ArrayType):
            at, n = key.column.cast("int"), F.size(of.column)
            self.fail((at >= n) | (at < -n), "index out of range")
            return Value(F.get(of.column, F.when(at < 0, at + n).otherwise(at)), of.kind.elementType)
        if _is(of, T.VariantType) and known is not None:
            path = f"$[{known}]" if isinstance(known, int) else f"$['{known}']"
            return Value(F.try_variant_get(of.column, path, "variant"), T.VariantType())
        raise ExpressionTypeError(f"{of.kind.simpleString()} has no items")

    def on_UnaryOp(self, node: ast.UnaryOp) -> Value:
        v = self.build(node.operand)
        if isinstance(node.op, ast.Invert):
            return Value(~truthy(v.column, v.kind), T.BooleanType())
        if isinstance(node.op, ast.USub) and _is(v, T.IntegralType):
            return self.whole(F.try_subtract, Value(F.lit(0), v.kind), v)
        if isinstance(node.op, ast.USub) and _is(v, _NUM):
            return Value(-v.column, v.kind)
        raise ExpressionTypeError("- needs a number")

    def on_BoolOp(self, node: ast.BoolOp) -> Value:
        first = self.build(node.values[0])
        out = truthy(first.column, first.kind)
        for x in node.values[1:]:
            part, fault = self.apart(x)
            right = truthy(part.column, part.kind)
            is_and = isinstance(node.op, ast.And)
            if fault is not None:
                self.faults.append(F.when(out if is_and else ~out, fault))
            # when() keeps the right side unevaluated where the left decides.
            out = F.when(out, right).otherwise(F.lit(False)) if is_and else F.when(out, F.lit(True)).otherwise(right)
        return Value(out, T.BooleanType())

    def on_IfExp(self, node: ast.IfExp) -> Value:
        test = self.build(node.test)
        (a, fault_a), (b, fault_b) = self.apart(node.body), self.apart(node.orelse)
        a, b = self.alike(a, b)
        chosen = truthy(test.column, test.kind)
        if fault_a is not None or fault_b is not None:
            none = F.lit(None).cast("string")
            self.faults.append(F.when(chosen, none if fault_a is None else fault_a).otherwise(none if fault_b is None else fault_b))
        return Value(F.when(chosen, a.column).otherwise(b.column), a.kind if not _is(a, T.NullType) else b.kind)

    def whole(self, made: Callable, a: Value, b: Value) -> Value:
        """Integer arithmetic in 64 bits; what doesn't fit is a fault."""
        x, y = a.column.cast("long"), b.column.cast("long")
        out = made(x, y)
        self.fail(x.isNotNull() & y.isNotNull() & out.isNull(), "integer overflow")
        return Value(out, T.LongType())

    def alike(self, a: Value, b: Value) -> tuple[Value, Value]:
        if _is(a, _NUM) and _is(b, _NUM) and a.kind != b.kind:
            return Value(a.column.cast("double"), T.DoubleType()), Value(b.column.cast("double"), T.DoubleType())
        if _is(a, T.VariantType) and not _is(b, T.VariantType):
            return Value(F.try_variant_get(a.column, "$", b.kind.simpleString()), b.kind), b
        if _is(b, T.VariantType) and not _is(a, T.VariantType):
            return a, Value(F.try_variant_get(b.column, "$", a.kind.simpleString()), a.kind)
        return a, b

    def on_Compare(self, node: ast.Compare) -> Value:
        # Comparisons bind tighter than equality and both group to the left.
        terms, ops = [node.left, *node.comparators], node.ops
        runs: list[Value] = []
        equalities = []
        held: Value | None = self.build(terms[0])
        for op, term in zip(ops, terms[1:], strict=True):
            if isinstance(op, (ast.Eq, ast.NotEq)):
                runs.append(held)
                equalities.append(op)
                held = self.build(term)
            else:
                held = self.compare(op, held, self.build(term))
        runs.append(held)
        out = runs[0]
        for op, right in zip(equalities, runs[1:], strict=True):
            a, b = self.alike(out, right)
            comparable = type(a.kind) is type(b.kind) or (_is(a, _NUM) and _is(b, _NUM)) or _is(a, T.NullType) or _is(b, T.NullType)
            same = a.column.eqNullSafe(b.column) if comparable else F.lit(False)
            out = Value(same if isinstance(op, ast.Eq) else ~same, T.BooleanType())
        return out

    def compare(self, op: ast.cmpop, a: Value, b: Value) -> Value:
        if isinstance(op, ast.In):
            return Value(self.within(b, a), T.BooleanType())
        a, b = self.alike(a, b)
        if _is(a, T.NullType) or _is(b, T.NullType):  # known to be null: a fault of the rows that come to it
            self.fail(F.lit(True), f"can't order {a.kind.simpleString()} and {b.kind.simpleString()}")
            return Value(F.lit(None).cast("boolean"), T.BooleanType())
        if not (_is(a, _NUM) and _is(b, _NUM)) and type(a.kind) is not type(b.kind):
            raise ExpressionTypeError(f"can't order {a.kind.simpleString()} and {b.kind.simpleString()}")
        made = {ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__}.get(type(op))
        if made is None:
            raise ExpressionParseError(f"{type(op).__name__} isn't part of the language")
        return Value(made(a.column, b.column), T.BooleanType())

    def within(self, whole: Value, part: Value) -> Column:
        if _is(whole, T.ArrayType):
            return F.coalesce(F.array_contains(whole.column, part.column), F.lit(False))
        if _is(whole, T.MapType):
            return F.coalesce(F.map_contains_key(whole.column, part.column), F.lit(False))
        if _is(whole, T.StringType):
            return F.contains(whole.column, part.column)
        if _is(whole, T.StructType):
            return F.array_contains(F.array(*map(F.lit, whole.kind.fieldNames())), part.column)
        raise ExpressionTypeError(f"nothing is in {whole.kind.simpleString()}")

    def on_BinOp(self, node: ast.BinOp) -> Value:
        a, b = self.build(node.left), self.build(node.right)
        if isinstance(node.op, ast.Add) and (_is(a, T.StringType) or _is(b, T.StringType)):
            return Value(F.concat(text(a.column, a.kind), text(b.column, b.kind)), T.StringType())
        if isinstance(node.op, ast.Add) and _is(a, T.ArrayType) and _is(b, T.ArrayType):
            return Value(F.concat(a.column, b.column), a.kind)
        a, b = self.alike(a, b)
        if not (_is(a, _NUM) and _is(b, _NUM)):
            raise ExpressionTypeError(f"no arithmetic on {a.kind.simpleString()} and {b.kind.simpleString()}")
        whole = _is(a, T.IntegralType) and _is(b, T.IntegralType)
        kind = T.LongType() if whole else a.kind if a.kind == b.kind else T.DoubleType()
        if isinstance(node.op, (ast.Div, ast.Mod)):
            self.fail(b.column == 0, "division by zero" if isinstance(node.op, ast.Div) else "modulo by zero")
        if whole:
            made: dict[type, Callable] = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}
            if type(node.op) in made:
                return self.whole(made[type(node.op)], a, b)
            a, b = (Value(v.column.cast("long"), kind) for v in (a, b))
        plain: dict[type, Callable] = {
            ast.Add: lambda: a.column + b.column, ast.Sub: lambda: a.column - b.column, ast.Mult: lambda: a.column * b.column,
            ast.Div: lambda: F.when(b.column != 0, self.truncated(a.column, b.column) if whole else a.column / b.column),
            ast.Mod: lambda: F.when(b.column != 0, floored_mod(a.column, b.column)),
        }
        if type(node.op) not in plain:
            raise ExpressionParseError(f"{type(node.op).__name__} isn't part of the language")
        return Value(plain[type(node.op)](), kind)

    def truncated(self, a: Column, b: Column) -> Column:
        """Whole quotient of 64-bit integers, towards zero."""
        over = (a == F.lit(-(2**63))) & (b == -1)
        self.fail(over, "integer overflow")
        return F.when(~over, F.call_function("div", a, b).cast("long"))

    def on_Call(self, node: ast.Call) -> Value:
        if node.keywords:
            raise ExpressionParseError("arguments have no names")
        if isinstance(node.func, ast.Attribute):
            return self.method(node.func.attr, self.build(node.func.value), [self.build(x) for x in node.args])
        if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS:
            raise ExpressionError("unknown function")
        args = [self.build(x) for x in node.args]
        low, high, make = FUNCTIONS[node.func.id]
        if not low <= len(args) <= high:
            raise ExpressionTypeError(f"{node.func.id} takes {low} to {high} arguments")
        return make(self, *args)

    def method(self, name: str, of: Value, args: list[Value]) -> Value:
        if name in ("lower", "upper") and not args:
            return Value(getattr(F, name)(of.column), of.kind) if _is(of, T.StringType) else of
        if name in ("keys", "values") and not args:
            if _is(of, T.MapType):
                made, kind = (F.map_keys, of.kind.keyType) if name == "keys" else (F.map_values, of.kind.valueType)
                return Value(made(of.column), T.ArrayType(kind))
            return Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
        if name in ("contains", "startsWith", "endsWith", "matches") and len(args) == 1 or name == "size" and not args:
            return FUNCTIONS[name][2](self, of, *args)
        raise ExpressionError(f"unknown method {name}")


def _size(build: _Builder, x: Value) -> Value:
    if _is(x, T.NullType):  # known to be null: a fault of the rows that come to it
        build.fail(F.lit(True), "size needs text, a list or a map")
        return Value(F.lit(None).cast("long"), T.LongType())
    if _is(x, T.StringType):
        return Value(F.length(x.column).cast("long"), T.LongType())
    if _is(x, T.ArrayType, T.MapType):
        return Value(F.size(x.column).cast("long"), T.LongType())
    raise ExpressionTypeError("size needs text, a list or a map")


def _matches(build: _Builder, s: Value, pattern: Value) -> Value:
    fits = (F.length(pattern.column) <= PATTERN_CHARS) & (F.length(s.column) <= TEXT_CHARS)
    build.fail(~fits, "matches: pattern or text too long")
    whole = F.regexp_like(s.column, F.concat(F.lit(r"\A(?:"), pattern.column, F.lit(r")\z")))
    return Value(F.when(fits, whole), T.BooleanType())


def _to_int(build: _Builder, x: Value) -> Value:
    made = F.when(x.column.rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim(x.column).try_cast("long")) if _is(x, T.StringType) else x.column.try_cast("long")
    build.fail(x.column.isNotNull() & made.isNull(), "int: not a whole number")
    return Value(made, T.LongType())


def _to_double(build: _Builder, x: Value) -> Value:
    made = x.column.try_cast("double")
    build.fail(x.column.isNotNull() & made.isNull(), "double: not a number")
    return Value(made, T.DoubleType())


def _extreme(of_list, of_many):
    def make(build: _Builder, *args: Value) -> Value:
        if len(args) == 1 and _is(args[0], T.ArrayType):
            return Value(of_list(args[0].column), args[0].kind.elementType)
        kinds = {type(a.kind) for a in args}
        kind = args[0].kind if len(kinds) == 1 else T.DoubleType()
        columns = [a.column.cast(kind) for a in args]
        return Value(of_many(*columns) if len(columns) > 1 else columns[0], kind)

    return make


_bool = lambda c: Value(c, T.BooleanType())
_str = lambda c: Value(c, T.StringType())
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "size": (1, 1, _size),
    "has": (2, 2, lambda b, m, k: _bool(b.within(m, k))),
    "contains": (2, 2, lambda b, s, x: _bool(b.within(s, x))),
    "startsWith": (2, 2, lambda _, s, p: _bool(F.startswith(s.column, p.column))),
    "endsWith": (2, 2, lambda _, s, p: _bool(F.endswith(s.column, p.column))),
    "matches": (2, 2, _matches),
    "lower": (1, 1, lambda _, s: _str(F.lower(text(s.column, s.kind)))),
    "upper": (1, 1, lambda _, s: _str(F.upper(text(s.column, s.kind)))),
    "string": (1, 1, lambda _, x: _str(text(x.column, x.kind))),
    "int": (1, 1, _to_int),
    "double": (1, 1, _to_double),
    "bool": (1, 1, lambda _, x: _bool(truthy(x.column, x.kind))),
    "exists": (1, 1, lambda _, x: _bool(x.column.isNotNull())),
    "min": (1, 99, _extreme(F.array_min, F.least)),
    "max": (1, 99, _extreme(F.array_max, F.greatest)),
    "abs": (1, 1, lambda _, x: Value(F.abs(x.column), x.kind)),
}
