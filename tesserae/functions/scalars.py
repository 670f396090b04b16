"""The dialect's scalar functions as built-in Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.types import INT, STRING, DialectError, Kind


def timestamp(column: Column, kind: Kind, native: bool) -> Column:
    """A UTC timestamp: of a timestamp column as it is (`native`), else of seconds since the epoch."""
    if native:
        return column.cast("timestamp")
    if kind.is_string or kind.is_state:
        raise DialectError(f"{kind} is no time")
    return F.timestamp_seconds(column)


def epoch(column: Column) -> Column:
    """Whole seconds since the epoch of a timestamp column."""
    return F.unix_seconds(column.cast("timestamp"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def float_text(column: Column) -> Column:
    """Shortest decimal text of a float: plain for exponents -4 to 5, else d.ddde+NN; no trailing zeros.

    Digits come from Spark's own text, so no Python runs. Parts are bound one after the other, as they are used often.
    """
    text = column.cast("string")

    def digits_of(t: Column) -> Column:
        size = F.substring_index(F.ltrim(t, F.lit("-")), "E", 1)
        shift = F.when(t.contains("E"), F.substring_index(t, "E", -1).try_cast("int")).otherwise(0)
        return F.struct(t.startswith("-").alias("minus"), F.substring_index(size, ".", 1).alias("whole"), F.substring_index(size, ".", -1).alias("fraction"), shift.alias("shift"))

    def placed(p: Column) -> Column:
        every = F.concat(p["whole"], p["fraction"])
        point = F.length(p["whole"]) + p["shift"] - F.length(every) + F.length(F.ltrim(every, F.lit("0")))
        return F.struct(p["minus"].alias("minus"), F.trim(every, F.lit("0")).alias("digits"), point.alias("point"))  # the decimal point stands after so many digits

    def shown(p: Column) -> Column:
        digits, point, size = p["digits"], p["point"], F.length(p["digits"])
        exponent = point - 1
        power = F.abs(exponent).cast("string")
        scientific = F.concat(
            F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), digits.substr(F.lit(2), size))).otherwise(""), F.lit("e"),
            F.when(exponent < 0, "-").otherwise("+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")),
        )
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
            .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, size)))
        )
        number = F.when(size == 0, F.lit("0")).when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
        return F.concat(F.when(p["minus"], "-").otherwise(""), number)

    finite = _bound(text, lambda t: _bound(digits_of(t), lambda p: _bound(placed(p), shown)))
    return F.when(F.isnan(column), "NaN").when(text == "Infinity", "+Inf").when(text == "-Infinity", "-Inf").otherwise(finite)


def to_text(column: Column, kind: Kind, native: bool) -> Column:
    if native:
        return epoch(column).cast("string")
    if kind.is_state:
        return float_text(column) if kind.state == "sum" else F.hex(column if kind.state == "bytes" else F.to_json(column))
    return float_text(column) if kind.is_float else column.cast("string")


def int_div(a: Column, b: Column) -> Column:
    """Division of whole parts toward zero; 0 for a divisor of 0."""
    left, right = a.cast("bigint"), b.cast("bigint")
    return F.when(right == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", left, F.when(right == 0, F.lit(1).cast("bigint")).otherwise(right)))


def divide(a: Column, b: Column) -> Column:
    """Float division; 0 for a divisor of 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


#: Name to (result kind, parts of the timestamp combined).
TIME_PARTS = {
    "toyyyymm": (Kind("UInt32"), lambda t: F.year(t) * 100 + F.month(t)),
    "toyear": (Kind("UInt16"), F.year),
    "tomonth": (Kind("UInt8"), F.month),
    "toyyyymmdd": (Kind("UInt32"), lambda t: F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)),
}


def call(name: str, args: list[tuple[Column, Kind, bool]]) -> tuple[Column, Kind]:
    """A scalar function applied to (column, kind, native timestamp) arguments."""
    wanted = {"intdiv": 2, "tostring": 1} | dict.fromkeys(TIME_PARTS, 1)
    if name not in wanted:
        raise DialectError(f"unknown function {name}")
    if len(args) != wanted[name]:
        raise DialectError(f"{name} takes {wanted[name]} argument(s)")
    if name in TIME_PARTS:
        kind, parts = TIME_PARTS[name]
        return parts(timestamp(*args[0])).cast("bigint"), kind
    if name == "tostring":
        return to_text(*args[0]), STRING
    numbers = [epoch(c) if native else c for c, _, native in args]
    if any(not k.is_numeric for _, k, _ in args):
        raise DialectError("intDiv takes numbers")
    return int_div(*numbers), INT


