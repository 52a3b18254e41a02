"""The standard operators: text, math, JSON, regex, logic, decision, loop markers, sub-flow and signals.

Each is a native column expression; `faults` says in which rows it can't give a value (null elsewhere), so one bad
row is a row with an error and not a failed job.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.functions.expression import Value
from rillway.functions.values import floored_mod, strip, text
from rillway.registry import Actor, Input, Operator, Output, Registry
from rillway.widgets import widget

STR, NUM, INT, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


class Maybe:
    """A handle that is live only where `live` holds."""

    def __init__(self, value: Value, live: Column):
        self.value, self.live = value, live


def _in(spec: str) -> tuple[Input, ...]:
    """Inputs from 'name:type=default' words; defaults are JSON."""
    out = []
    for word in spec.split(" ; ") if spec else []:
        name, _, rest = word.partition(":")
        kind, eq, default = rest.partition("=")
        out.append(Input(name, kind, json.loads(default)) if eq else Input(name, kind))
    return tuple(out)


def _op(base: str, category: str, inputs: str, kind: str, make, faults=None, outputs=None, **more) -> Operator:
    outs = outputs or (Output("result", kind),)
    return Operator(base, name=base.replace("-", " ").title(), category=category, inputs=_in(inputs), outputs=outs, expr=make, faults=faults, **more)


def constant(value: Value):
    """The literal behind a value that the flow states itself, or None."""
    return getattr(value, "literal", None)


def _replace(i):
    text_, needle, new = i["text"].column, i["needle"].column, i["replacement"].column
    # An empty needle stands before each character and at the end.
    spread = F.concat(new, F.array_join(F.transform(F.split(text_, ""), lambda c: F.concat(c, new)), ""))
    return Value(F.when(needle == "", F.when(text_ == "", new).otherwise(spread)).otherwise(F.replace(text_, needle, new)), STR)


def _folded(i, *names):
    fold = ~i["case_sensitive"].column
    return [F.when(fold, F.lower(i[n].column)).otherwise(i[n].column) for n in names]


def _literal_pattern(separator: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(separator, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


TEXT = (
    _op("text-uppercase", "text", "text:str", "str", lambda i: Value(F.upper(i["text"].column), STR)),
    _op("text-lowercase", "text", "text:str", "str", lambda i: Value(F.lower(i["text"].column), STR)),
    _op("text-trim", "text", "text:str", "str", lambda i: Value(strip(i["text"].column), STR)),
    _op("text-length", "text", "text:str", "int", lambda i: Value(F.length(i["text"].column).cast("long"), INT)),
    _op("text-concat", "text", 'a:str ; b:str ; separator:str=""', "str", lambda i: Value(F.concat(i["a"].column, i["separator"].column, i["b"].column), STR)),
    _op("text-replace", "text", 'text:str ; needle:str ; replacement:str=""', "str", _replace),
    _op("text-contains", "text", "text:str ; needle:str ; case_sensitive:bool=true", "bool", lambda i: Value(F.contains(*_folded(i, "text", "needle")), BOOL)),
    _op("text-split", "text", 'text:str ; separator:str=","', "list[str]", lambda i: Value(F.split(i["text"].column, _literal_pattern(i["separator"].column), -1), T.ArrayType(STR)), lambda i: F.when(i["separator"].column == "", F.lit("empty separator"))),
    _op("text-join", "text", 'parts:list ; separator:str=", "', "str", lambda i: Value(F.call_function("array_join", F.transform(i["parts"].column, lambda p: text(p, i["parts"].kind.elementType)), i["separator"].column), STR)),
    _op("text-reverse", "text", "text:str", "str", lambda i: Value(F.reverse(i["text"].column), STR)),
)


def _zero(i):
    return F.when(i["b"].column == 0, F.lit("division by zero"))


def _no_values(i):
    return F.when(F.size(i["values"].column) == 0, F.lit("no values"))


def _round(i):
    places = constant(i["decimals"])
    if places is None:
        scale = F.pow(F.lit(10.0), i["decimals"].column)
        return Value(F.rint(i["value"].column * scale) / scale, NUM)
    return Value(F.bround(i["value"].column, int(places)), NUM)


MATH = (
    _op("math-add", "math", "a:float ; b:float", "float", lambda i: Value(i["a"].column + i["b"].column, NUM)),
    _op("math-subtract", "math", "a:float ; b:float", "float", lambda i: Value(i["a"].column - i["b"].column, NUM)),
    _op("math-multiply", "math", "a:float ; b:float", "float", lambda i: Value(i["a"].column * i["b"].column, NUM)),
    _op("math-divide", "math", "a:float ; b:float", "float", lambda i: Value(F.try_divide(i["a"].column, i["b"].column), NUM), _zero),
    _op("math-modulo", "math", "a:float ; b:float", "float", lambda i: Value(floored_mod(i["a"].column, i["b"].column), NUM), _zero),
    _op("math-round", "math", "value:float ; decimals:int=0", "float", _round),
    _op("math-min", "math", "values:list[float]", "float", lambda i: Value(F.array_min(i["values"].column), NUM), _no_values),
    _op("math-max", "math", "values:list[float]", "float", lambda i: Value(F.array_max(i["values"].column), NUM), _no_values),
    _op("math-abs", "math", "value:float", "float", lambda i: Value(F.abs(i["value"].column), NUM)),
)


def _variant(held: Value) -> Column:
    if isinstance(held.kind, T.VariantType):
        return held.column
    return F.to_variant_object(held.column) if isinstance(held.kind, (T.ArrayType, T.MapType, T.StructType)) else held.column.cast("variant")


def _json_get(i):
    """Value at a dotted path; a numeric segment is a key or an index, negative ones count from the end. A stated path is a
    chain of lookups, one from a column a fold over its segments."""
    held, path = i["value"], constant(i["path"])
    now = _variant(held)
    if path is None:
        segments = F.filter(F.transform(F.split(i["path"].column, r"\."), strip), lambda x: x != "")

        def step(at: Column, segment: Column) -> Column:
            listed = F.try_variant_get(at, "$", "array<variant>")
            index = segment.try_cast("int")
            item = F.get(listed, F.when(index < 0, F.size(listed) + index).otherwise(index))
            return F.when(listed.isNotNull(), item).otherwise(F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), segment))

        return Value(F.when(segments.isNotNull(), F.aggregate(segments, now, step)), T.VariantType())
    for part in (p.strip() for p in path.split(".") if path.strip()):
        by_key = F.try_variant_get(now, "$['{}']".format(part.replace("'", "\\'")), "variant")
        if re.fullmatch(r"-?\d+", part):
            listed = F.try_variant_get(now, "$", "array<variant>")
            at = int(part)
            by_key = F.coalesce(by_key, F.get(listed, F.lit(at) if at >= 0 else F.size(listed) + at))
        now = by_key
    return Value(now, T.VariantType())


#: Tokens of compact JSON: texts, empty containers, marks, and what lies between (numbers, true, false, null).
_TOKENS = r'"(?:[^"\\]|\\.)*"|\[\]|\{\}|[\[\]{}:,]|[^"\[\]{}:,]+'


def _ascii(token: Column) -> Column:
    """A JSON text with all but printable ASCII as lower-case \\u escapes of UTF-16 units."""
    units = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    escaped = lambda c: F.regexp_replace(units(c), "(.{4})", r"\\u$1")
    each = lambda c: F.when(c.startswith("\\u"), F.lower(c)).when(c.rlike(r"^[\x20-\x7E]+$"), c).otherwise(escaped(c))
    whole = F.array_join(F.transform(F.regexp_extract_all(token, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|."), F.lit(0)), each), "")
    return F.when(token.rlike(r"[^\x20-\x7E]|\\u"), whole).otherwise(token)


def _float(token: Column) -> Column:
    """A number with an exponent as Python shows it: plain from 1e-4 to 1e16, else with sign and two digits at least."""
    plain = F.regexp_replace(token.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.regexp_replace(F.regexp_replace(token, r"\.0E", "E"), "E(?=[0-9])", "e+")
    short = F.regexp_replace(F.regexp_replace(short, "E-", "e-"), r"(e[+-])(\d)$", "$10$2")
    size = F.abs(token.cast("double"))
    return F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def _stringify(i):
    """Compact JSON spaced, escaped and indented as Python writes it, token by token."""
    held, indent, ordered = i["value"], constant(i["indent"]), constant(i["sort_keys"])
    options = {"ignoreNullFields": "false"}
    if isinstance(held.kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        shown = F.to_json(_variant(held) if ordered else held.column, options)
    else:
        listed = F.to_json(F.array(held.column), options)
        shown = F.substring(listed, F.lit(2), F.length(listed) - 2)
    shown = F.coalesce(shown, F.lit("null"))
    tokens = F.regexp_extract_all(shown, F.lit(_TOKENS), F.lit(0))
    plain = lambda x: F.when(x.startswith('"'), _ascii(x)).when(x.rlike("[0-9]E"), _float(x)).otherwise(x)
    if not indent:
        spaced = lambda x: F.when(x == ",", ", ").when(x == ":", ": ").otherwise(plain(x))
        return Value(F.array_join(F.transform(tokens, spaced), ""), STR)
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit(" " * int(indent)), depth))

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.isin("[", "{"), x.isin("]", "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        here = F.when(opens | (x == ","), F.concat(x, line(depth))).when(closes, F.concat(line(depth), x)).when(x == ":", ": ").otherwise(plain(x))
        return F.struct(depth.alias("depth"), F.concat(s["out"], here).alias("out"))

    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return Value(F.aggregate(tokens, begin, step, lambda s: s["out"]), STR)


JSON = (
    _op("json-parse", "json", "text:str", "any", lambda i: Value(F.try_parse_json(i["text"].column), T.VariantType()), lambda i: F.when(F.try_parse_json(i["text"].column).isNull(), F.lit("not JSON"))),
    _op("json-stringify", "json", "value:any ; indent:int=0 ; sort_keys:bool=false", "str", _stringify),
    _op("json-get", "json", "value:any ; path:str", "any", _json_get),
)


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect: named groups, the end of text."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<")).replace(r"\Z", r"\z")


def java_replacement(replacement: str) -> str:
    out = re.sub(r"([$])", r"\\\1", replacement)
    out = re.sub(r"\\g<(\d+)>|\\(\d)", lambda m: f"${m[1] or m[2]}", out)
    return re.sub(r"\\g<(\w+)>", r"${\1}", out)


def _pattern(i) -> Column:
    stated = constant(i["pattern"])
    base = F.lit(java_pattern(stated)) if stated is not None else F.regexp_replace(i["pattern"].column, r"\(\?P<", "(?<")
    return F.when(i["ignore_case"].column, F.concat(F.lit("(?i)"), base)).otherwise(base)


def _groups(i) -> Column:
    """How many groups the pattern has; of a pattern in a column by its brackets outside of escapes and classes."""
    stated = constant(i["pattern"])
    if stated is not None:
        return F.lit(re.compile(stated).groups)
    plain = F.regexp_replace(i["pattern"].column, r"\\.|\[\^?\]?[^\]]*\]", "")
    return F.regexp_count(plain, F.lit(r"\((?!\?)|\(\?P?<(?![=!])"))


def _extract(i):
    every = lambda k: F.regexp_extract_all(i["text"].column, _pattern(i), F.lit(k))
    stated = constant(i["pattern"])
    if stated is not None:
        return Value(every(1 if re.compile(stated).groups else 0), T.ArrayType(STR))
    return Value(F.when(_groups(i) > 0, every(1)).otherwise(every(0)), T.ArrayType(STR))


REGEX = (
    _op("regex-match", "regex", "text:str ; pattern:str ; ignore_case:bool=false", "bool", lambda i: Value(F.regexp_like(i["text"].column, _pattern(i)), BOOL)),
    _op("regex-replace", "regex", 'text:str ; pattern:str ; replacement:str="" ; ignore_case:bool=false', "str", lambda i: Value(F.regexp_replace(i["text"].column, _pattern(i), F.lit(java_replacement(constant(i["replacement"]))) if constant(i["replacement"]) is not None else i["replacement"].column), STR)),
    _op("regex-extract", "regex", "text:str ; pattern:str ; ignore_case:bool=false", "list[str]", _extract),
)


def _if_empty(i):
    filled = strip(i["text"].column) != ""
    return {"output_1": Maybe(i["text"], filled), "output_2": Maybe(i["text"], ~filled)}


def _if_equals(i):
    a, b = _folded(i, "a", "b")
    return {"output_1": Maybe(i["a"], a == b), "output_2": Maybe(i["a"], a != b)}


LOGIC = (
    _op("logic-if-empty", "logic", "text:str", "str", _if_empty, outputs=(Output("output_1", "str", "Not empty"), Output("output_2", "str", "Empty"))),
    _op("logic-if-equals", "logic", "a:str ; b:str ; case_sensitive:bool=true", "str", _if_equals, outputs=(Output("output_1", "str", "Equal"), Output("output_2", "str", "Not equal"))),
    _op("logic-not", "logic", "value:bool", "bool", lambda i: Value(~i["value"].column, BOOL)),
    _op("decision", "decision", "value:any", "any", lambda i: i["value"], is_decision=True),
)

_LIST = Input("items", "dict", None, widget=widget("ConnectionList", label="Items"), optional=True)
REGIONS = (
    Operator("for-each-start", name="For Each (Start)", category="control", inputs=(_LIST, *_in('execution_mode:str="Sequential"')), outputs=(Output("output_1", "any", "Item"), Output("output_2", "int", "Index")), region="for-each", dynamic_handles=True),
    Operator("for-each-end", name="For Each (End)", category="control", inputs=(_LIST,), outputs=(Output("result", "list", "Collected"),), region="for-each-end", dynamic_handles=True),
    Operator("while-start", name="While (Start)", category="control", inputs=_in("condition:str ; max_iterations:int=1000 ; negate:bool=false"), outputs=(Output("output_1", "int", "Iteration"), Output("output_2", "any", "Last")), region="while", dynamic_handles=True),
    Operator("while-end", name="While (End)", category="control", inputs=_in("item:any"), outputs=(Output("result", "any", "Last value"),), region="while-end", dynamic_handles=True),
    Operator("subprocess-call", name="Subprocess", category="control", inputs=(*_in('flow_id:str="" ; flow_version:int=1'), Input("inputs", "dict", None, optional=True)), outputs=(Output("result", "any", "Sub-flow results"),), region="subprocess", dynamic_handles=True),
)
EVENTS = (
    Operator("signal-wait", name="Wait for Signal", category="event", inputs=_in('kind:str="event" ; signal_name:str="" ; correlation:str="" ; timeout_seconds:float=0'), outputs=(Output("result", "any", "Payload"),), is_signal=True, pauses="signal"),
    Operator("signal-timer", name="Timer", category="event", inputs=_in("seconds:float=60"), outputs=(Output("result", "any", "Fired at"),), is_signal=True, pauses="signal"),
    Operator("human-input", name="Human input", category="human", inputs=(*_in('prompt:str=""'), Input("schema", "dict", None, optional=True)), outputs=(Output("result", "any", "Response"),), pauses="human", actor=Actor("human")),
)


def _parts(i):
    """Text cut at a separator (with escapes \\n \\t \\r), trimmed, empties dropped."""
    mark = i["separator"].column
    for written, meant in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        mark = F.replace(mark, F.lit(written), F.lit(meant))
    raw = F.split(i["text"].column, _literal_pattern(mark), -1)
    trimmed = F.transform(raw, lambda p: F.when(i["trim"].column, strip(p)).otherwise(p))
    return Value(F.filter(trimmed, lambda p: p != ""), T.ArrayType(STR))


def _fold(i):
    """Left fold of the labelled numbers; none give 0, a division by zero gives infinity."""
    values = F.transform(F.map_values(i["numbers"].column), lambda v: v.cast("double"))
    head, tail = F.get(values, F.lit(0)), F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    fold = lambda step: F.reduce(tail, head, step)
    how = i["operation"].column
    out = F.when(how == "Add", fold(lambda a, x: a + x)).when(how == "Subtract", fold(lambda a, x: a - x)).when(how == "Multiply", fold(lambda a, x: a * x))
    out = out.when(how == "Divide", fold(lambda a, x: F.when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(a, x))))
    out = out.when(how == "Min", F.array_min(values)).when(how == "Max", F.array_max(values)).when(how == "Average", F.try_divide(fold(lambda a, x: a + x), F.size(values)))
    return Value(F.when(F.size(values) == 0, F.lit(0.0)).otherwise(out), NUM)


def _branch(i):
    value, how, other = i["value"].column, i["condition"].column, i["compare_to"].column
    holds = F.when(how == "Is empty", strip(value) == "").when(how == "Is not empty", strip(value) != "").when(how == "Equals", value == other).when(how == "Contains", F.contains(value, other)).otherwise(F.lit(False))
    return {"output_1": Maybe(i["value"], holds), "output_2": Maybe(i["value"], ~holds)}


def _first_match(i):
    hit, n = F.regexp_like(i["text"].column, _pattern(i)), _groups(i)
    group = lambda k: F.call_function("regexp_extract", i["text"].column, _pattern(i), k)
    none = F.array().cast("array<string>")
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), group)).otherwise(none)
    if (stated := constant(i["pattern"])) is not None:
        listed = F.array(*[group(F.lit(k + 1)) for k in range(re.compile(stated).groups)]).cast("array<string>")
    return {"output_1": Value(F.when(hit, group(F.lit(0))).otherwise(F.lit("")), STR), "output_2": Value(F.when(hit, listed).otherwise(none), T.ArrayType(STR)), "output_3": Value(hit, BOOL)}


#: Sources and small helpers that example flows use; column reads a column of the run's table.
SOURCES = (
    _op("text", "io", 'value:str=""', "str", lambda i: i["value"]),
    _op("number", "io", "value:float=0", "float", lambda i: i["value"]),
    _op("make-list", "io", 'text:str ; separator:str="," ; trim:bool=true', "list[str]", _parts),
    _op("template", "text", 'template:str ; input:str=""', "str", lambda i: Value(F.replace(i["template"].column, F.lit("{input}"), i["input"].column), STR)),
    _op("combine", "text", 'a:str ; b:str ; separator:str=" "', "str", lambda i: Value(F.concat(i["a"].column, i["separator"].column, i["b"].column), STR)),
    _op("uppercase", "text", "text:str", "str", lambda i: Value(F.upper(i["text"].column), STR)),
    _op("regex", "regex", "text:str ; pattern:str ; ignore_case:bool=false", "str", _first_match, outputs=(Output("output_1", "str", "Match"), Output("output_2", "list[str]", "Groups"), Output("output_3", "bool", "Matched"))),
    Operator("math", name="Math", category="math", inputs=(Input("numbers", "dict", None, widget=widget("ConnectionList")), *_in('operation:str="Add"')), outputs=(Output("result", "float"),), expr=_fold),
    _op("if-else", "logic", 'value:str ; condition:str="Is not empty" ; compare_to:str=""', "str", _branch, outputs=(Output("output_1", "str", "True"), Output("output_2", "str", "False"))),
    Operator("column", name="Column", category="io", inputs=_in("name:str"), outputs=(Output("result", "any"),)),
)
ALL = (*TEXT, *MATH, *JSON, *REGEX, *LOGIC, *REGIONS, *EVENTS, *SOURCES)


def standard() -> Registry:
    return Registry(ALL)
