"""Syntax trees of the dialect, and their text with all needed parentheses."""

from __future__ import annotations

from dataclasses import dataclass, field

from tesserae.types import Kind


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Lit:
    value: int | float | str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


Expr = Ref | Lit | Star | Unary | Binary | Call


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    where: Expr | None = None
    group: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # name, descending
    limit: int | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, Kind], ...]
    engine: str
    order: tuple[str, ...] = ()
    partition: Expr | None = None
    if_absent: bool = False


@dataclass(frozen=True)
class CreateView:
    name: str
    target: str
    select: Select
    if_absent: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[int | float | str, ...], ...] = field(default=())


@dataclass(frozen=True)
class Drop:
    table: str
    if_present: bool = False


@dataclass(frozen=True)
class ShowTables:
    pass


Statement = Select | CreateTable | CreateView | Insert | Drop | ShowTables


def expr_text(e: Expr) -> str:
    """SQL text that parses to the same tree."""
    if isinstance(e, Ref):
        return e.name
    if isinstance(e, Star):
        return "*"
    if isinstance(e, Lit):
        if isinstance(e.value, str):
            return "'" + e.value.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t") + "'"
        if isinstance(e.value, float):
            from decimal import Decimal

            text = format(Decimal(repr(e.value)), "f")
            return text if "." in text else text + ".0"
        return str(e.value)
    if isinstance(e, Unary):
        return f"({e.op} {expr_text(e.arg)})"
    if isinstance(e, Binary):
        return f"({expr_text(e.left)} {e.op} {expr_text(e.right)})"
    return f"{e.name}({', '.join(map(expr_text, e.args))})"


def select_text(s: Select) -> str:
    text = "SELECT " + ", ".join(expr_text(i.expr) + (f" AS {i.alias}" if i.alias else "") for i in s.items) + f" FROM {s.table}"
    if s.where is not None:
        text += f" WHERE {expr_text(s.where)}"
    if s.group:
        text += f" GROUP BY {', '.join(s.group)}"
    if s.order:
        text += " ORDER BY " + ", ".join(f"{n} DESC" if d else n for n, d in s.order)
    return text + (f" LIMIT {s.limit}" if s.limit is not None else "")
