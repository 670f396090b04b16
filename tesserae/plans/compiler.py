"""Syntax trees to DataFrames. Only built-in expressions are used, so plans stay inside code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import aggregates, scalars
from tesserae.functions.aggregates import Aggregate
from tesserae.plans.ast import Binary, Call, Expr, Item, Lit, Ref, Select, Star, Unary
from tesserae.types import FLOAT, INT, STRING, DialectError, Kind, kind_of_spark

COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Typed:
    """An expression: its column, kind, and whether it is still a truth value or a native timestamp."""

    column: Column
    kind: Kind
    truth: bool = False
    native: bool = False

    @property
    def value(self) -> Column:
        """As shown and stored: truth values are 0 or 1."""
        return self.column.cast("bigint") if self.truth else self.column

    @property
    def number(self) -> Column:
        if not self.kind.is_numeric:
            raise DialectError(f"{self.kind} is no number")
        return scalars.epoch(self.column) if self.native else self.value

    @property
    def text(self) -> Column:
        return scalars.to_text(self.value, self.kind, self.native)

    @property
    def condition(self) -> Column:
        """Nonzero, or a non-empty string."""
        if self.truth:
            return self.column
        return self.column != "" if self.kind.is_string else self.number != 0


class Scope:
    """The columns that names stand for."""

    def __init__(self, frame: DataFrame, kinds: dict[str, Kind] | None = None) -> None:
        self.frame = frame
        self.fields = {f.name: f for f in frame.schema}
        self.kinds = kinds or {}

    def kind(self, name: str) -> Kind:
        if name not in self.fields:
            raise DialectError(f"unknown column {name}")
        return self.kinds.get(name) or kind_of_spark(self.fields[name].dataType)

    def get(self, name: str) -> Typed:
        kind = self.kind(name)
        native = isinstance(self.fields[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        return Typed(F.col(f"`{name}`"), kind, native=native)


def compile_expr(e: Expr, scope: Scope) -> Typed:
    if isinstance(e, Ref):
        return scope.get(e.name)
    if isinstance(e, Lit):
        if isinstance(e.value, str):
            return Typed(F.lit(e.value), STRING)
        return Typed(F.lit(e.value).cast("double"), FLOAT) if isinstance(e.value, float) else Typed(F.lit(e.value).cast("bigint"), INT)
    if isinstance(e, Star):
        raise DialectError("* stands alone in a select list or in count(*)")
    if isinstance(e, Unary):
        arg = compile_expr(e.arg, scope)
        if e.op == "NOT":
            return Typed(~arg.condition, INT, truth=True)
        return Typed(-arg.number.cast("double"), FLOAT)
    if isinstance(e, Call):
        if e.name in aggregates.NAMES:
            raise DialectError(f"{e.name} may not stand here")
        args = [compile_expr(a, scope) for a in e.args]
        return Typed(*scalars.call(e.name, [(a.value, a.kind, a.native) for a in args]))
    left, right = compile_expr(e.left, scope), compile_expr(e.right, scope)
    if e.op in ("AND", "OR"):
        return Typed(left.condition & right.condition if e.op == "AND" else left.condition | right.condition, INT, truth=True)
    if e.op in COMPARE:
        if left.kind.is_string or right.kind.is_string:
            return Typed(COMPARE[e.op](left.text, right.text), INT, truth=True)
        return Typed(COMPARE[e.op](left.number, right.number), INT, truth=True)
    a, b = left.number.cast("double"), right.number.cast("double")
    return Typed({"+": a + b, "-": a - b, "*": a * b}[e.op] if e.op != "/" else scalars.divide(a, b), FLOAT)


def default_name(item: Item) -> str:
    """Alias, column name, `function(first argument)` or `expr`."""
    if item.alias:
        return item.alias
    e = item.expr
    if isinstance(e, Ref):
        return e.name
    if isinstance(e, Call):
        first = e.args[0] if e.args else None
        if isinstance(first, Star) or (first is None and e.name == "count"):
            return f"{e.name}(*)"
        return f"{e.name}({first.name})" if isinstance(first, Ref) else f"{e.name}({'' if first is None else 'expr'})"
    return "expr"


def has_aggregate(e: Expr) -> bool:
    if isinstance(e, Call):
        return e.name in aggregates.NAMES or any(map(has_aggregate, e.args))
    if isinstance(e, Binary):
        return has_aggregate(e.left) or has_aggregate(e.right)
    return isinstance(e, Unary) and has_aggregate(e.arg)


def _aggregate(item: Item, scope: Scope) -> Aggregate:
    call = item.expr
    if not isinstance(call, Call) or call.name not in aggregates.NAMES:
        raise DialectError("an aggregate query selects group columns and aggregate calls only")
    args, parameter = list(call.args), None
    if call.name in aggregates.RANKED and len(args) == 2:
        first = args.pop(0)
        sign = 1
        if isinstance(first, Unary) and first.op == "-":
            first, sign = first.arg, -1
        if not isinstance(first, Lit) or isinstance(first.value, str):
            raise DialectError(f"the first argument of {call.name} is a number")
        parameter = sign * first.value
    name = default_name(item)
    if call.name == "count" and (not args or isinstance(args[0], Star)):
        return Aggregate("count", name, None, None)
    if len(args) != 1:
        raise DialectError(f"{call.name} takes one column")
    arg = compile_expr(args[0], scope)
    return Aggregate(call.name, name, scalars.epoch(arg.column) if arg.native else arg.value, arg.kind, arg.text, parameter)


def _grouped(rows: DataFrame, s: Select, scope: Scope) -> tuple[DataFrame, dict[str, Kind]]:
    """Group columns in GROUP BY order, then aggregates in select order."""
    found = []
    for item in s.items:
        if isinstance(item.expr, Ref) and item.expr.name in s.group:
            if item.alias and item.alias != item.expr.name:
                raise DialectError(f"a group column keeps its name: {item.expr.name}")
            continue
        found.append(_aggregate(item, scope))
    keys = list(s.group)
    for k in keys:
        if scope.kind(k).is_state:
            raise DialectError(f"cannot group by the state {k}")
    names = keys + [a.name for a in found]
    if len(set(names)) < len(names):
        raise DialectError("two output columns have one name")
    kinds = {k: scope.kind(k) for k in keys} | {a.name: a.result for a in found}
    quoted = [F.col(f"`{k}`") for k in keys]
    if not found:
        return rows.select(*quoted).distinct(), kinds
    plain = [aggregates.column_of(a).alias(a.name) for a in found if a.function in aggregates.PLAIN and not a.of_sets]
    sets = [a for a in found if a.of_sets]
    placed = [a for a in found if a.function == "quantiles"]
    tops = [a for a in found if a.function == "topk"]
    parts = [aggregates.sets(rows, keys, sets)] if sets else []  # first, as later ones may be broadcast
    if plain:
        parts.append(rows.groupBy(*quoted).agg(*plain))
    if placed:
        parts.append(aggregates.quantiles(rows, keys, placed))
    if tops:
        parts.append(aggregates.tops(rows, keys, tops))
    base = parts[0]  # each part has every group
    for part in parts[1:]:
        base = aggregates.beside(base, part, keys)
    for i, a in enumerate(sets):
        base = base.withColumnRenamed(f"_u{i}", a.name)
    for several, prefix in ((placed, "_q"), (tops, "_t")):
        for i, a in enumerate(several):
            base = base.withColumn(a.name, F.coalesce(F.col(f"{prefix}{i}"), aggregates.empty_value(a)))
    return base.select(*[F.col(f"`{n}`") for n in names]), kinds


def compile_select(s: Select, frame: DataFrame, kinds: dict[str, Kind] | None = None) -> tuple[DataFrame, dict[str, Kind]]:
    """The query over `frame` as a DataFrame, and the kinds of its columns."""
    scope = Scope(frame, kinds)
    rows = frame
    if s.where is not None:
        rows = frame.where(compile_expr(s.where, scope).condition)
    if s.group or any(has_aggregate(i.expr) for i in s.items):
        out, result = _grouped(rows, s, scope)
    elif len(s.items) == 1 and isinstance(s.items[0].expr, Star):
        out, result = rows, {f: scope.kind(f) for f in frame.columns}
    else:
        columns, result = [], {}
        for item in s.items:
            typed, name = compile_expr(item.expr, scope), default_name(item)
            columns.append(typed.value.alias(name))
            result[name] = typed.kind
        out = rows.select(*columns)
    if s.order:
        for name, _ in s.order:
            if name not in out.columns:
                raise DialectError(f"ORDER BY {name}: no such output column")
        out = out.orderBy(*[F.col(f"`{n}`").desc() if d else F.col(f"`{n}`").asc() for n, d in s.order])
    if s.limit is not None:
        out = out.limit(max(0, s.limit))
    return out, result
