"""Column recipes: ordered steps that turn a source column into an output column.

Each step has an error policy. Under ANSI mode bad input raises, so FAIL uses the strict form of a
function and RETURN_NULL / USE_DEFAULT use its ``try_`` twin. Consecutive steps that only look at
the running value are folded into one expression; a step that names other columns, or is given as
SQL text, first lands the value in the output column so that it can be referred to.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.conditions import Clause, as_condition, case_when, operand
from millrace.operators.windows import WindowFn, window

FAIL, RETURN_NULL, USE_DEFAULT = "FAIL", "RETURN_NULL", "USE_DEFAULT"

# Cast vocabulary of recipes (fixed values); anything else means text.
CAST_TYPES = {"TEXT": "string", "INTEGER": "int", "DECIMAL": "decimal(18,2)", "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean"}

# Named patterns for extraction and profiling (fixed values).
PATTERNS = {
    "email": r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    "us_phone": r"(\d{3}[-.]\d{3}[-.]\d{4})",
    "url": r"(https?://[^\s]+)",
    "date": r"(\d{2}/\d{2}/\d{4})",
    "digits": r"(\d+)",
    "capitals": r"([A-Z]+)",
    "between_markers": r"START(.*)END",
    "word_after_keyword": r"keyword\s+([\w]+)",
    "in_parentheses": r"\(([^)]+)\)",
}


@dataclass(frozen=True)
class Step:
    type: str
    params: dict = field(default_factory=dict)
    on_error: str = FAIL
    default: object = None
    enabled: bool = True


@dataclass(frozen=True)
class Recipe:
    """``source`` is read by the first step; the result is stored as ``output``. No steps = copy."""

    output: str
    source: str
    steps: Sequence[Step] = ()
    enabled: bool = True


@dataclass(frozen=True)
class _Kind:
    build: Callable[[Column, dict, bool], Column]
    names_columns: bool = False


_KINDS: dict[str, _Kind] = {}


def _step(*names: str, names_columns: bool = False):
    def keep(fn):
        for n in names:
            _KINDS[n] = _Kind(fn, names_columns)
        return fn
    return keep


def step_types() -> list[str]:
    return sorted([*_KINDS, *_RANKS])


# ------------------------------------------------------------------ conversion


def _convert(c: Column, kind: str, tolerant: bool) -> Column:
    return c.try_cast(kind) if tolerant else c.cast(kind)


@_step("to_number")
def _to_number(c, p, tolerant):
    return _convert(F.regexp_replace(c.cast("string"), r"[^0-9.\-]", ""), "decimal(18,2)", tolerant)


@_step("to_date")
def _to_date(c, p, tolerant):
    return (F.try_to_date if tolerant else F.to_date)(c, p.get("format", "yyyy-MM-dd"))


@_step("to_timestamp")
def _to_timestamp(c, p, tolerant):
    fmt = p.get("format", "yyyy-MM-dd HH:mm:ss")
    return F.try_to_timestamp(c, F.lit(fmt)) if tolerant else F.to_timestamp(c, fmt)


@_step("cast")
def _cast(c, p, tolerant):
    return _convert(c, CAST_TYPES.get(str(p.get("targetType", "TEXT")).upper(), "string"), tolerant)


# ------------------------------------------------------------------ text


for _name, _fn in {"upper": F.upper, "lower": F.lower, "title_case": F.initcap, "length": F.length,
                   "ltrim": F.ltrim, "rtrim": F.rtrim}.items():
    _step(_name)(lambda c, p, tolerant, fn=_fn: fn(c))


@_step("trim")
def _trim(c, p, tolerant):
    sides = str(p.get("sides", "BOTH")).upper()
    return {"LEFT": F.ltrim, "LEADING": F.ltrim, "RIGHT": F.rtrim, "TRAILING": F.rtrim}.get(sides, F.trim)(c)


@_step("concat", names_columns=True)
def _concat(c, p, tolerant):
    return F.concat(c, *[operand(v).cast("string") for v in _listed(p.get("values"))])


@_step("substring")
def _substring(c, p, tolerant):
    return F.substring(c, int(p.get("startPos", 1)), int(p.get("length", 1)))


@_step("pad_left")
def _pad_left(c, p, tolerant):
    return F.lpad(c.cast("string"), int(p.get("length", 10)), str(p.get("padChar", "0")))


@_step("pad_right")
def _pad_right(c, p, tolerant):
    return F.rpad(c.cast("string"), int(p.get("length", 10)), str(p.get("padChar", " ")))


@_step("replace")
def _replace(c, p, tolerant):
    return F.replace(c, _text(p.get("search")), _text(p.get("replace")))


def _text(v) -> Column:
    """Search and replacement text is literal unless a Column is passed."""
    if isinstance(v, Column):
        return v
    s = "" if v is None else str(v)
    return F.lit(s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s)


def _listed(v) -> list:
    if v is None:
        return []
    return [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v)


# ------------------------------------------------------------------ dates


@_step("trim_timestamp")
def _trim_timestamp(c, p, tolerant):
    unit = str(p.get("unit", "DAY")).upper()
    return F.to_date(c) if unit not in ("MONTH", "YEAR") else F.trunc(c, unit)


@_step("date_add")
def _date_add(c, p, tolerant):
    n, unit = int(p.get("amount", 0)), str(p.get("unit", "DAY")).upper()
    return F.add_months(c, n * {"MONTH": 1, "YEAR": 12}[unit]) if unit in ("MONTH", "YEAR") else F.date_add(c, n)


@_step("date_sub")
def _date_sub(c, p, tolerant):
    return _date_add(c, {**p, "amount": -int(p.get("amount", 0))}, tolerant)


@_step("date_format")
def _date_format(c, p, tolerant):
    return F.date_format(c, p.get("format", "yyyy-MM-dd"))


@_step("extract_date_part")
def _extract(c, p, tolerant):
    parts = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}
    return parts[str(p.get("part", "MONTH")).upper()](c)


@_step("date_diff", names_columns=True)
def _date_diff(c, p, tolerant):
    """end - column. Months and years count whole units, rounded down. ``fractional`` keeps the
    part of a month; ``sourceFormat`` / ``endFormat`` parse text operands first."""
    end = operand(p.get("endDate", F.current_date()))
    parse = F.try_to_date if tolerant else F.to_date
    start = parse(c, p["sourceFormat"]) if p.get("sourceFormat") else c
    end = parse(end, p["endFormat"]) if p.get("endFormat") else end
    unit = str(p.get("unit", "DAY")).upper()
    if unit == "MONTH":
        months = F.months_between(end, start)
        return months if p.get("fractional") else F.floor(months)
    if unit == "YEAR":
        return F.floor(F.months_between(end, start) / 12)
    return F.datediff(end, start)


# ------------------------------------------------------------------ patterns


def _pattern(p: dict) -> str:
    pattern = PATTERNS.get(p.get("template", ""), str(p.get("pattern", "")))
    return f"(?i){pattern}" if p.get("caseInsensitive") else pattern


@_step("regex_extract", "extract_regex")
def _regex_extract(c, p, tolerant):
    return F.regexp_extract(c, _pattern(p), int(p.get("group", p.get("groupIndex", 1))))


@_step("replace_regex", "regex_replace")
def _replace_regex(c, p, tolerant):
    """``replaceAll=False`` replaces the first match only."""
    pattern, new = _pattern(p), str(p.get("replacement", ""))
    if p.get("replaceAll", True):
        return F.regexp_replace(c, pattern, new)
    # The match takes the rest of the text along; the pattern sees the whole text. Another one could only be the empty
    # match at the end, where the first one stopped (\G), unless that is also the start of the text.
    return F.regexp_replace(c, rf"(?:\A|(?!\G))(?:{pattern})(?<millraceRest>[\s\S]*)", new + "${millraceRest}")


@_step("matches_regex")
def _matches(c, p, tolerant):
    return c.rlike(_pattern(p))


# ------------------------------------------------------------------ missing values and branches


@_step("coalesce", "if_null", names_columns=True)
def _coalesce(c, p, tolerant):
    more = _listed(p.get("fallbacks")) + ([p["defaultValue"]] if "defaultValue" in p else [])
    return F.coalesce(c, *[operand(v) for v in more])


@_step("null_if", "nullif", names_columns=True)
def _null_if(c, p, tolerant):
    return F.nullif(c, operand(p.get("value")))


@_step("case_when", names_columns=True)
def _case(c, p, tolerant):
    return case_when([(b["when"], b["then"]) for b in p.get("branches", [])], p.get("else"))


@_step("if_else", names_columns=True)
def _if_else(c, p, tolerant):
    return F.when(as_condition(p["condition"]), operand(p.get("then"))).otherwise(operand(p.get("else")))


@_step("case_conditions", names_columns=True)
def _case_conditions(c, p, tolerant):
    """Branches ``(field, operator, value, then)`` with the operators of the condition builder."""
    return case_when([(Clause(*b[:3]).to_column(), b[3]) for b in p["conditions"]], p.get("else"))


@_step("map_lookup")
def _map_lookup(c, p, tolerant):
    pairs = [F.lit(x) for kv in p["map"].items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(p.get("default")))


# ------------------------------------------------------------------ numbers


@_step("round")
def _round(c, p, tolerant):
    places, how = int(p.get("places", 2)), str(p.get("mode", "HALF_UP")).upper()
    if how == "HALF_UP":
        return F.round(c, places)
    scale = F.lit(10.0 ** places)
    edge = F.ceil if how == "UP" else F.floor          # away from zero / toward zero
    return F.signum(c) * edge(F.abs(c) * scale) / scale


for _name, _fn in {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "sign": F.signum, "ln": F.ln, "log10": F.log10,
                   "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan}.items():
    _step(_name)(lambda c, p, tolerant, fn=_fn: fn(c))


@_step("trunc")
def _trunc(c, p, tolerant):
    return _round(c, {"places": p.get("places", 0), "mode": "DOWN"}, tolerant)


@_step("atan2", names_columns=True)
def _atan2(c, p, tolerant):
    return F.atan2(c, operand(p["other"]).cast("double"))


@_step("random")
def _random(c, p, tolerant):
    return F.rand(p.get("seed"))


@_step("mod", names_columns=True)
def _mod(c, p, tolerant):
    by = operand(p.get("divisor", 2))
    return F.try_mod(c, by) if tolerant else c % by


@_step("power", names_columns=True)
def _power(c, p, tolerant):
    return F.pow(c, operand(p.get("exponent", 2)))


@_step("math", names_columns=True)
def _math(c, p, tolerant):
    other, op = operand(p.get("operand", 0)), p.get("operator", "+")
    if tolerant:
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](c, other)
    return {"+": lambda: c + other, "-": lambda: c - other, "*": lambda: c * other, "/": lambda: c / other}[op]()


# ------------------------------------------------------------------ context and free SQL


@_step("current_job_name")
def _job(c, p, tolerant):
    return F.lit(p.get("jobName", ""))


@_step("current_user")
def _user(c, p, tolerant):
    return F.current_user()


@_step("current_date")
def _today(c, p, tolerant):
    return F.current_date()


@_step("current_time")
def _now(c, p, tolerant):
    return F.current_timestamp()


@_step("custom_sql", names_columns=True)
def _custom(c, p, tolerant):
    return F.expr(str(p["expression"]))


_RANKS = ("rank", "dense_rank", "row_number")


# ------------------------------------------------------------------ runner


def run_recipes(df: DataFrame, recipes: Sequence[Recipe], *, cache: bool = False) -> DataFrame:
    """Apply enabled recipes in order; a later one may read the output of an earlier one.
    Recipes that do not look at each other share one projection. An unknown step is skipped with
    a warning."""
    pending: dict[str, Column] = {}

    def flush() -> DataFrame:
        done = df.withColumns(pending) if pending else df
        pending.clear()
        return done

    for r in (r for r in recipes if r.enabled):
        if r.source in pending or r.output in pending:
            df = flush()
        value, landed = F.col(r.source), False
        for s in (s for s in r.steps if s.enabled):
            ranked = s.type in _RANKS
            kind = _KINDS.get(s.type)
            if kind is None and not ranked:
                warnings.warn(f"recipe {r.output}: unknown step {s.type!r} skipped", stacklevel=2)
                continue
            if (ranked or kind.names_columns) and not landed:
                pending[r.output] = value
                df = flush()
                value = F.col(r.output)
            if ranked:
                df, landed = _ranked(df, r.output, s), True
                continue
            value = _guarded(kind.build(value, s.params, s.on_error != FAIL), s)
            landed = False
        pending[r.output] = value
    df = flush()
    return df.persist() if cache else df


def _guarded(value: Column, s: Step) -> Column:
    return F.coalesce(value, F.lit(s.default)) if s.on_error == USE_DEFAULT and s.default is not None else value


def _ranked(df, output, s):
    order = s.params.get("orderBy") or output
    done = window(df, [WindowFn(s.type, "__rank")], partition_by=_listed(s.params.get("partitionBy")), order_by=order)
    return done.drop(output).withColumnRenamed("__rank", output)


def mapping_tree(df: DataFrame, output: str, source: str, tree: dict) -> DataFrame:
    """A tree of groups and operations; the root is a group and its result is ``output``.

    An operation is ``{"operation": .., "params": .., "on_error": .., "default": ..}``, a group
    ``{"kind": .., "children": [..]}``; nothing but these kinds is taken.

    * ``sequence`` (the default): every child works on the result of the one before.
    * ``parallel``: every child works on the group's input, and ``"combine"`` joins their results:
      ``coalesce`` (the default), ``concat`` (NULL if one is; ``"separator"`` skips NULLs), ``array``,
      ``least`` or ``greatest`` (both skip NULLs).
    * ``case``: the first child whose ``"when": (column, operator, value)`` holds gives the result; the
      other children's rows are NULL to it, so it cannot fail on them. ``"else"``: a node for the rows
      left, which otherwise keep the group's input. Conditions read the columns of ``df``.

    Groups without children keep their input. Equal children of one input are computed once.
    """
    columns, made = set(df.columns), {}

    def fresh(value: Column) -> str:
        nonlocal df
        name = f"__tree{len(made)}"
        while name in columns:
            name += "_"
        columns.add(name)
        made[name] = None
        df = df.withColumn(name, value)
        return name

    def result(node: dict, at: str, done: dict) -> str:
        key = repr(node)
        if key not in done:
            apply(node, at)
            done[key] = fresh(F.col(_quoted(output)))
        return done[key]

    def put(value: Column) -> None:
        nonlocal df
        df = df.withColumn(output, value)

    def apply(node: dict, at: str) -> None:
        """Puts the node's result for column ``at`` into the output column."""
        nonlocal df
        if "children" not in node:
            df = run_recipes(df, [Recipe(output, at, [_tree_step(node)])])
            return
        kind, children = node.get("kind", "sequence"), node["children"]
        if kind not in _GROUPS:
            raise ValueError(f"unknown group kind {kind!r}")
        if kind == "sequence":
            steps: list[Step] = []
            for child in children:
                if "children" in child and not _plain(child):
                    df = run_recipes(df, [Recipe(output, at, steps)])
                    at, steps = fresh(F.col(_quoted(output))), []
                    apply(child, at)
                    at = fresh(F.col(_quoted(output)))
                else:
                    steps += [_tree_step(c) for c in child.get("children", [child])]
            df = run_recipes(df, [Recipe(output, at, steps)])
            return
        at = fresh(F.col(_quoted(at)))
        if not children:
            put(F.col(at))
        elif kind == "parallel":
            done: dict = {}
            put(_combined(node, [F.col(result(c, at, done)) for c in children]))
        else:
            rest, value = F.lit(True), None
            conditions = [fresh(F.coalesce(Clause(*c["when"]).to_column(), F.lit(False))) for c in children]
            branches = []
            for name, child in zip(conditions, children):
                holds = fresh(rest & F.col(name))
                rest = rest & ~F.col(name)
                branches.append((holds, {k: v for k, v in child.items() if k != "when"}))
            if "else" in node:
                branches.append((fresh(rest), node["else"]))
            for holds, child in branches:
                then = F.col(result(child, fresh(F.when(F.col(holds), F.col(at))), {}))
                value = F.when(F.col(holds), then) if value is None else value.when(F.col(holds), then)
            put(value if "else" in node else value.otherwise(F.col(at)))

    apply(tree, source)
    return df.drop(*made)


def _plain(group: dict) -> bool:
    """A sequence of operations alone."""
    return group.get("kind", "sequence") == "sequence" and not any("children" in c for c in group["children"])


_GROUPS = ("sequence", "parallel", "case")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _tree_step(node: dict) -> Step:
    return Step(node["operation"], node.get("params", {}), node.get("on_error", FAIL), node.get("default"))


def _combined(node: dict, values: list[Column]) -> Column:
    how = node.get("combine", "coalesce")
    if how == "concat":
        return F.concat_ws(node["separator"], *values) if "separator" in node else F.concat(*values)
    made = {"coalesce": F.coalesce, "array": F.array, "least": F.least, "greatest": F.greatest}
    if how not in made:
        raise ValueError(f"unknown way to combine {how!r}")
    return made[how](*values) if len(values) > 1 or how in ("coalesce", "array") else values[0]
