"""Text of the dialect to syntax trees. Whatever is left over after a statement is an error."""

from __future__ import annotations

import re

from tesserae.plans.ast import Binary, Call, CreateTable, CreateView, Drop, Expr, Insert, Item, Lit, Ref, Select, ShowTables, Star, Statement, Unary
from tesserae.types import DialectError, Kind, kind_named

# Reserved words.
RESERVED = frozenset(
    """SELECT FROM WHERE GROUP ORDER BY LIMIT AS AND OR NOT ASC DESC INSERT INTO VALUES CREATE TABLE MATERIALIZED VIEW
    TO IF EXISTS ENGINE PARTITION DROP SHOW TABLES HAVING IN BETWEEN""".split()
)
_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<string>'(?:[^'\\]|''|\\.)*')|(?P<op><>|!=|<=|>=|[-+*/=<>(),;])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t"}
#: Binary operators by how tightly they bind; comparisons do not chain.
LEVELS = (("OR",), ("AND",), None, ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(kind, value, place); words keep their case, reserved ones are upper-cased with kind `key`."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DialectError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "word" and value.upper() in RESERVED:
            kind, value = "key", value.upper()
        elif kind == "string":
            value = re.sub(r"''|\\(.)", lambda e: "'" if e[0] == "''" else _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        elif value == "<>":
            value = "!="
        if kind != "skip":
            out.append((kind, value, at))
        at = m.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    def fail(self, wanted: str) -> DialectError:
        kind, value, place = self.tokens[self.at]
        return DialectError(f"expected {wanted} at {place}, found {value or kind!r}")

    def peek(self, *values: str) -> bool:
        kind, value, _ = self.tokens[self.at]
        return kind in ("key", "op") and value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *values: str) -> str:
        found = self.take(*values)
        if found is None:
            raise self.fail(" or ".join(values))
        return found

    def name(self) -> str:
        kind, value, _ = self.tokens[self.at]
        if kind != "word":
            raise self.fail("a name")
        self.at += 1
        return value

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return tuple(out)

    def number(self) -> int | float:
        kind, value, _ = self.tokens[self.at]
        if kind != "number":
            raise self.fail("a number")
        self.at += 1
        return float(value) if "." in value else int(value)

    # Expressions

    def expr(self, level: int = 0) -> Expr:
        if level == len(LEVELS):
            return self.unary()
        ops = LEVELS[level]
        if ops is None:
            return Unary("NOT", self.expr(level)) if self.take("NOT") else self.expr(level + 1)
        left = self.expr(level + 1)
        while op := self.take(*ops):
            left = Binary(op, left, self.expr(level + 1))
            if op in LEVELS[3]:
                break
        return left

    def unary(self) -> Expr:
        if self.take("-"):
            return Unary("-", self.unary())
        return self.primary()

    def primary(self) -> Expr:
        kind, value, _ = self.tokens[self.at]
        if kind == "number":
            return Lit(self.number())
        if kind == "string":
            self.at += 1
            return Lit(value)
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.take("*"):
            return Star()
        name = self.name()
        if not self.take("("):
            return Ref(name)
        args: list[Expr] = []
        if not self.take(")"):
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
            self.need(")")
        return Call(name.lower(), tuple(args))

    # Statements

    def statement(self) -> Statement:
        found = self.need("SELECT", "CREATE", "INSERT", "DROP", "SHOW")  # each has a method of its name
        out = getattr(self, found.lower())()
        self.take(";")
        if self.tokens[self.at][0] != "end":
            raise self.fail("the end")
        return out

    def select(self) -> Select:
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("FROM")
        table = self.name()
        where = self.expr() if self.take("WHERE") else None
        group: tuple[str, ...] = ()
        if self.take("GROUP"):
            self.need("BY")
            group = self.names()
        order: list[tuple[str, bool]] = []
        if self.take("ORDER"):
            self.need("BY")
            order.append((self.name(), self.take("ASC", "DESC") == "DESC"))
            while self.take(","):
                order.append((self.name(), self.take("ASC", "DESC") == "DESC"))
        limit = None
        if self.take("LIMIT"):
            sign = -1 if self.take("-") else 1
            limit = sign * self.number()
            if not isinstance(limit, int):
                raise DialectError("LIMIT takes a whole number")
        return Select(tuple(items), table, where, group, tuple(order), limit)

    def item(self) -> Item:
        expr = self.expr()
        if self.take("AS") or self.tokens[self.at][0] == "word":
            return Item(expr, self.name())
        return Item(expr)

    def guard(self, *words: str) -> bool:
        if not self.take("IF"):
            return False
        for w in words:
            self.need(w)
        return True

    def create(self) -> CreateTable | CreateView:
        if self.take("MATERIALIZED"):
            self.need("VIEW")
            absent = self.guard("NOT", "EXISTS")
            name = self.name()
            self.need("TO")
            target = self.name()
            self.need("AS")
            self.need("SELECT")
            return CreateView(name, target, self.select(), absent)
        self.need("TABLE")
        absent = self.guard("NOT", "EXISTS")
        name = self.name()
        self.need("(")
        columns = [(self.name(), self.kind())]
        while self.take(","):
            columns.append((self.name(), self.kind()))
        self.need(")")
        self.need("ENGINE")
        self.need("=")
        engine = self.name()
        if self.take("("):
            self.need(")")
        order: tuple[str, ...] = ()
        if self.take("ORDER"):
            self.need("BY")
            if self.take("("):
                order = self.names()
                self.need(")")
            else:
                order = self.names()
        partition = None
        if self.take("PARTITION"):
            self.need("BY")
            partition = self.expr()
        return CreateTable(name, tuple(columns), engine, order, partition, absent)

    def kind(self) -> Kind:
        name = self.name()
        if not self.take("("):
            return kind_named(name)
        if name.lower() == "lowcardinality":
            inner = self.kind()
            self.need(")")
            return Kind(inner.name, inner.state, True)
        if name.lower() == "aggregatefunction":
            function = self.name().lower()
            while self.take(","):
                self.kind()
            self.need(")")
            if function not in ("sum", "uniq"):
                raise DialectError(f"no state of {function}")
            return Kind("AggregateState", function)
        raise DialectError(f"{name} takes no arguments")

    def insert(self) -> Insert:
        self.need("INTO")
        table = self.name()
        columns: tuple[str, ...] = ()
        if self.take("("):
            columns = self.names()
            self.need(")")
        self.need("VALUES")
        rows = [self.row()]
        while self.take(","):
            rows.append(self.row())
        return Insert(table, columns, tuple(rows))

    def row(self) -> tuple:
        self.need("(")
        out = [self.literal()]
        while self.take(","):
            out.append(self.literal())
        self.need(")")
        return tuple(out)

    def literal(self) -> int | float | str:
        if self.take("-"):
            return -self.number()
        kind, value, _ = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return value
        return self.number()

    def drop(self) -> Drop:
        self.need("TABLE")
        present = self.guard("EXISTS")
        return Drop(self.name(), present)

    def show(self) -> ShowTables:
        self.need("TABLES")
        return ShowTables()


def parse(text: str) -> Statement:
    return _Parser(text).statement()


def parse_expr(text: str) -> Expr:
    parser = _Parser(text)
    out = parser.expr()
    if parser.tokens[parser.at][0] != "end":
        raise parser.fail("the end")
    return out
