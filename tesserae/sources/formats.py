"""Results as TabSeparated, CSV or JSON text; rows are streamed from the executors, partition by partition."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.scalars import to_text
from tesserae.types import DialectError, Kind, kind_of_spark

FORMATS = ("TabSeparated", "CSV", "JSON")


def texts(frame: DataFrame, kinds: dict[str, Kind]) -> Iterator[list[str]]:
    """Every value as text, made by Spark: floats in their shortest form, states in hexadecimal, times as seconds."""
    columns = []
    for f in frame.schema:
        native = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        column = F.col(f"`{f.name}`")
        truth = isinstance(f.dataType, T.BooleanType)
        columns.append(F.coalesce(to_text(column.cast("int") if truth else column, kinds.get(f.name) or kind_of_spark(f.dataType), native), F.lit("NULL")))
    for row in frame.select(*[c.alias(str(i)) for i, c in enumerate(columns)]).toLocalIterator():
        yield list(row)


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def render(frame: DataFrame, kinds: dict[str, Kind], form: str = "TabSeparated", rows: Iterator[list[str]] | None = None) -> Iterator[str]:
    """Pieces of the text of a result; no piece holds more than a row. `rows` are its `texts`, if they are being read already."""
    chosen = {f.lower(): f for f in FORMATS}.get(form.lower())
    if chosen is None:
        raise DialectError(f"unknown format {form}")
    kind = [kinds.get(f.name) or kind_of_spark(f.dataType) for f in frame.schema]
    rows = texts(frame, kinds) if rows is None else rows
    if chosen == "TabSeparated":
        yield "\t".join(frame.columns) + "\n"
        for row in rows:
            yield "\t".join(row) + "\n"
    elif chosen == "CSV":
        yield ",".join(_quoted(n) if any(c in n for c in ',"\n') else n for n in frame.columns) + "\n"
        for row in rows:
            yield ",".join(_quoted(v) if k.is_string or k.is_state else v for k, v in zip(kind, row, strict=True)) + "\n"
    else:
        meta = [{"name": n, "type": str(k)} for n, k in zip(frame.columns, kind, strict=True)]
        yield '{\n  "meta": ' + json.dumps(meta, ensure_ascii=False) + ',\n  "data": ['
        count = 0
        for row in rows:
            data = {n: None if v == "NULL" and not k.is_string else v if k.is_string or k.is_state or v in ("NaN", "+Inf", "-Inf") else float(v) if k.is_float else int(v) for n, k, v in zip(frame.columns, kind, row, strict=True)}
            yield (",\n    " if count else "\n    ") + json.dumps(data, ensure_ascii=False)
            count += 1
        yield f'{"\n  " if count else ""}],\n  "rows": {count}\n}}\n'
