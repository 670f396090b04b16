"""Types of the dialect, how Spark stores them, and the wrapping casts of inserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dialect type, width in bits (0: not an integer), signed, Spark type.
_TYPES = {
    "UInt8": (8, False, T.ShortType()),
    "UInt16": (16, False, T.IntegerType()),
    "UInt32": (32, False, T.LongType()),
    "UInt64": (64, False, T.DecimalType(20, 0)),
    "Int8": (8, True, T.ByteType()),
    "Int16": (16, True, T.ShortType()),
    "Int32": (32, True, T.IntegerType()),
    "Int64": (64, True, T.LongType()),
    "Float32": (0, True, T.FloatType()),
    "Float64": (0, True, T.DoubleType()),
    "String": (0, False, T.StringType()),
    "DateTime": (32, False, T.LongType()),
    "AggregateState": (0, False, T.ArrayType(T.StringType())),  # the distinct values as text
}
_BY_LOWER = {name.lower(): name for name in _TYPES}


class DialectError(ValueError):
    """A statement that cannot be parsed, bound or run."""


@dataclass(frozen=True)
class Kind:
    """A dialect type; `state` names the function of an aggregate state, `low` marks LowCardinality."""

    name: str
    state: str = ""
    low: bool = False

    @property
    def spark(self) -> T.DataType:
        return T.DoubleType() if self.state == "sum" else _TYPES[self.name][2]

    @property
    def is_float(self) -> bool:
        return self.name in ("Float32", "Float64")

    @property
    def is_string(self) -> bool:
        return self.name == "String"

    @property
    def is_state(self) -> bool:
        return self.name == "AggregateState"

    @property
    def is_numeric(self) -> bool:
        return not self.is_string and not self.is_state

    def __str__(self) -> str:
        text = f"AggregateFunction({self.state})" if self.state else self.name
        return f"LowCardinality({text})" if self.low else text


INT, FLOAT, STRING, DATETIME = Kind("Int64"), Kind("Float64"), Kind("String"), Kind("DateTime")


def kind_named(name: str) -> Kind:
    """A type by name, in any case."""
    if name.lower() not in _BY_LOWER:
        raise DialectError(f"unknown type {name}")
    return Kind(_BY_LOWER[name.lower()])


def kind_of_spark(kind: T.DataType) -> Kind:
    """The dialect type that an external column is read as."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Kind("Float32" if isinstance(kind, T.FloatType) else "Float64")
    if isinstance(kind, T.StringType):
        return STRING
    if isinstance(kind, T.BooleanType):
        return INT
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return Kind("AggregateState", "uniq")
    if isinstance(kind, T.BinaryType):
        return Kind("AggregateState", "bytes")  # of another maker: shown, never merged
    by_spark = {T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.DecimalType: "UInt64"}
    if type(kind) in by_spark:
        return Kind(by_spark[type(kind)])
    raise DialectError(f"no dialect type for {kind.simpleString()}")


def wrapping_cast(column: Column, source: Kind, target: Kind) -> Column:
    """`column` as `target`, integers wrapping to its width as machine integers do; never fails on numbers."""
    if target.is_state or source.is_state:
        if target.is_state != source.is_state and not (target.state == "sum" and source.is_numeric):
            raise DialectError(f"cannot store {source} as {target}")
        return column.cast(target.spark)
    if target.is_string:
        return column.cast("string")
    if source.is_string:
        number = F.coalesce(column.try_cast("decimal(38,0)" if _TYPES[target.name][0] else "double"), F.lit(0))
        return wrapping_cast(number, INT if _TYPES[target.name][0] else FLOAT, target)
    bits, signed, spark = _TYPES[target.name]
    if not bits:
        return column.cast(spark)
    whole = F.coalesce(column.cast("double").try_cast("decimal(38,0)") if source.is_float else column.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    if source.is_float:  # toward zero
        whole = F.coalesce(F.when(column < 0, F.ceil(column)).otherwise(F.floor(column)).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    span = F.lit(str(1 << bits)).cast("decimal(38,0)")
    wrapped = F.pmod(whole, span)
    if signed:
        half = F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
        wrapped = F.when(wrapped >= half, wrapped - span).otherwise(wrapped)
    return wrapped.cast(spark)
