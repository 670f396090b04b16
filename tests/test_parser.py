import pytest
from hypothesis import given
from hypothesis import strategies as st

from tesserae.plans.ast import Binary, Call, Lit, Ref, Select, Unary, expr_text, select_text
from tesserae.plans.parser import parse, parse_expr
from tesserae.types import DialectError


def test_precedence():
    assert parse_expr("a OR b AND NOT c = 1 + 2 * -3") == Binary("OR", Ref("a"), Binary("AND", Ref("b"), Unary("NOT", Binary("=", Ref("c"), Binary("+", Lit(1), Binary("*", Lit(2), Unary("-", Lit(3))))))))
    assert parse_expr("a-1") == Binary("-", Ref("a"), Lit(1))


def test_strings_and_comments():
    assert parse_expr("'it''s\\n\\t\\\\\\'' -- the rest") == Lit("it's\n\t\\'")


def test_select():
    s = parse("select a AS x, count(*) from t where b <> 'y' group by a order by x desc, a limit 3;")
    assert isinstance(s, Select) and s.group == ("a",) and s.order == (("x", True), ("a", False)) and s.limit == 3
    assert s.items[1].expr.name == "count" and s.where.op == "!="


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a FROM t HAVING a > 1", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t LIMIT 1 2", "SELECT a", "SELECT a FROM t WHERE a = 1 = 2",
        "CREATE TABLE t (a UInt64)", "CREATE TABLE t (a Nope) ENGINE = M", "CREATE TABLE t (a UInt64) ENGINE = M PARTITION BY a ORDER BY a", "INSERT INTO t VALUES (a)", "SELECT a FROM t WHERE a ? 1", "DELETE FROM t",
    ],
)
def test_malformed(text):
    with pytest.raises(DialectError):
        parse(text)


_leaf = st.one_of(st.sampled_from("abc").map(Ref), st.integers(0, 99).map(Lit), st.sampled_from(["x", "it's", "a\\b", "n\n"]).map(Lit), st.sampled_from([0.5, 1e-7, 2.0]).map(Lit))
_tree = st.recursive(
    _leaf,
    lambda e: st.one_of(
        st.tuples(st.sampled_from(["+", "-", "*", "/", "AND", "OR", "=", "<"]), e, e).map(lambda x: Binary(*x)),
        st.tuples(st.sampled_from(["-", "NOT"]), e).map(lambda x: Unary(*x)),
        e.map(lambda x: Call("tostring", (x,))),
    ),
    max_leaves=12,
)


@given(_tree)
def test_text_parses_back(tree):
    assert parse_expr(expr_text(tree)) == tree


def test_select_text_keeps_parentheses():
    s = parse("SELECT a FROM t WHERE (a = 1 OR b = 2) AND c = 3")
    assert parse(select_text(s)) == s
