"""Choosing parts to merge, and the aggregating collapse of equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.aggregates import Aggregate, beside, sets
from tesserae.types import Kind, wrapping_cast

LEAST_PARTS, MOST_PARTS = 3, 10


def select_parts(parts: list[dict]) -> list[dict]:
    """The best range of 3 to 10 neighbouring parts of one partition.

    A range is the better, the more parts it holds and the more alike they are: (sum of sizes / largest) * number.
    """
    best, chosen = 0.0, []
    by_partition: dict[str, list[dict]] = {}
    for p in sorted(parts, key=lambda p: p["min_block"]):
        by_partition.setdefault(p["partition"], []).append(p)
    for group in by_partition.values():
        for start in range(len(group)):
            for count in range(LEAST_PARTS, min(MOST_PARTS, len(group) - start) + 1):
                sizes = [p["bytes"] or p["rows"] for p in group[start : start + count]]
                score = sum(sizes) / max(1, *sizes) * count
                if score > best:
                    best, chosen = score, group[start : start + count]
    return chosen


def collapse(rows: DataFrame, order: list[str], kinds: dict[str, Kind]) -> DataFrame:
    """One row for each key: numbers are summed and wrap to their type, states merge, others keep their first value.

    First means the least (_block, _row). All are partial aggregates, so hot keys shrink before the shuffle; states of
    distinct values are merged value by value.
    """
    place = F.struct("_block", "_row")
    merged, states = [], []
    for name, kind in kinds.items():
        column = F.col(f"`{name}`")
        if name in order:
            continue
        if kind.state == "sum" or kind.is_float:
            value = F.sum(column.cast("double")).cast(kind.spark)
        elif kind.is_state:
            states.append(Aggregate("uniqmergestate", name, column, kind))
            continue
        elif kind.is_numeric:
            value = wrapping_cast(F.sum(column.cast("decimal(38,0)")), Kind("Int64"), kind)
        else:
            value = F.min_by(column, place)
        merged.append(value.alias(name))
    keys = [F.col(f"`{n}`") for n in order]
    first = F.min(place).alias("_first")
    out = rows.groupBy(*keys).agg(*merged, first)
    if states:
        out = beside(sets(rows, order, states), out, order).withColumnsRenamed({f"_u{i}": a.name for i, a in enumerate(states)})
    return out.withColumn("_block", F.col("_first._block")).withColumn("_row", F.col("_first._row")).drop("_first")
