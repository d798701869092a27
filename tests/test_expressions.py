import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pipespark.errors import ExpressionError, SchemaError
from pipespark.functions import expr as E
from pipespark.operators import filter_rows, project
from pyspark.errors import PySparkException


@pytest.fixture(scope="module")
def people(spark):
    rows = [(25, "Alice", 10.5, 2), (18, "Bob", 20.0, 3), (30, "Charlie", 15.75, 1), (None, "David", 5.0, 4)]
    return spark.createDataFrame(rows, "age int, name string, price double, quantity int")


def kept(df, expr, **more):
    return [r.name for r in filter_rows(df, expr, **more).collect()]


@pytest.mark.parametrize(
    "expr,names",
    [
        ("age > 18", ["Alice", "Charlie"]),
        ("age > 20 AND price < 15", ["Alice"]),
        ("age < 20 OR price > 15", ["Bob", "Charlie"]),
        ("name = 'Bob' or name == \"Alice\"", ["Alice", "Bob"]),
        ("name <> 'Bob' && !(age > 26)", ["Alice"]),
        ("age IS NULL", ["David"]),
        ("age is not null and NOT age = 18", ["Alice", "Charlie"]),
        ("price - 5 - 5 > 5", ["Bob", "Charlie"]),
        ("price / 2 / 2 = 5", ["Bob"]),
        ("price * quantity - 1 >= (20 + 0.0) * 3 - 1", ["Bob"]),
        ("-age < -20", ["Alice", "Charlie"]),
        ("age = 30 OR age = 25 AND price > 100", ["Charlie"]),
        ("(age = 30 OR age = 25) AND price > 12", ["Charlie"]),
        ("quantity", ["Alice", "Bob", "Charlie", "David"]),
        ("quantity - 2", ["Bob", "Charlie", "David"]),
        ("name + '!' = 'Bob!'", ["Bob"]),
        ("price = 15.75", ["Charlie"]),
        ("true", ["Alice", "Bob", "Charlie", "David"]),
        ("null", []),
        ("age != 25", ["Bob", "Charlie"]),
        ("", ["Alice", "Bob", "Charlie", "David"]),
        (None, ["Alice", "Bob", "Charlie", "David"]),
    ],
)
def test_filters(people, expr, names):
    assert kept(people, expr) == names


def test_compat_mode_has_two_values(people):
    assert kept(people, "age < 20", compat=True) == ["Bob", "David"]
    assert kept(people, "age != 25", compat=True) == ["Bob", "Charlie", "David"]
    assert kept(people, "age > 18", compat=True) == ["Alice", "Charlie"]
    assert kept(people, "NOT age >= 20", compat=True) == ["Bob", "David"]
    assert kept(people, "age = null", compat=True) == ["David"]


def test_text_literals_keep_their_operators(spark):
    df = spark.createDataFrame([("2023-01-01",), ("a AND b",), ("x < y",), ("it's",)], "name string")
    assert kept(df, "name >= '2023-01-01' AND name < '2024-01-01'") == ["2023-01-01"]
    assert kept(df, "name = 'a AND b' OR name = \"x < y\"") == ["a AND b", "x < y"]
    assert kept(df, "name = 'it''s'") == ["it's"]


def test_types_of_arithmetic(people):
    got = project(people, ["quantity / 2 AS half", "price / 2 AS p", "age * 3000000000 AS big", "quantity + 1 AS one", "-quantity / 3 AS third"])
    assert got.dtypes == [("half", "int"), ("p", "double"), ("big", "bigint"), ("one", "int"), ("third", "int")]
    assert [tuple(r) for r in got.collect()][:2] == [(1, 5.25, 75_000_000_000, 3, 0), (1, 10.0, 54_000_000_000, 4, -1)]


def test_division_by_zero_and_overflow_are_errors(people):
    for e in ("quantity / 0 = 1", "price / 0 = 1", "quantity * 2000000000 > 0"):
        with pytest.raises(PySparkException):
            kept(people, e)


@pytest.mark.parametrize("bad", ["age >", "(age > 1", "age > 1)", "age ~ 1", "'open", "age > > 1", "AND age", "age 1", "age IS 5"])
def test_bad_syntax(people, bad):
    with pytest.raises(ExpressionError):
        filter_rows(people, bad)


def test_bad_types_and_names(people):
    with pytest.raises(SchemaError) as e:
        filter_rows(people, "agee > 1")
    assert "did you mean 'age'?" in str(e.value) and e.value.suggestions()
    for bad in ("name * 2 = 1", "name > 5", "name + 1 = 2"):
        with pytest.raises(ExpressionError):
            filter_rows(people, bad)


def test_trees():
    assert E.parse("a + 1 > 5 and b") == E.Binary("AND", E.Binary(">", E.Binary("+", E.Name("a"), E.Literal(1)), E.Literal(5)), E.Name("b"))
    assert E.parse("-3") == E.Literal(-3) and E.parse("1e3") == E.Literal(1000.0) and E.parse("`odd name`") == E.Name("odd name")
    assert E.columns_of(E.parse("a = b AND NOT c IS NULL")) == {"a", "b", "c"}


numbers = st.integers(-9, 9)
trees = st.recursive(
    numbers.map(lambda n: (str(n) if n >= 0 else f"({n})", n)),
    lambda inner: st.tuples(inner, st.sampled_from("+-*"), inner).map(lambda t: (f"({t[0][0]} {t[1]} {t[2][0]})", {"+": operator.add, "-": operator.sub, "*": operator.mul}[t[1]](t[0][1], t[2][1]))),
    max_leaves=12,
)


def value_of(tree):
    if isinstance(tree, E.Literal):
        return tree.value
    if isinstance(tree, E.Unary):
        return -value_of(tree.of)
    return {"+": operator.add, "-": operator.sub, "*": operator.mul}[tree.op](value_of(tree.left), value_of(tree.right))


@settings(max_examples=300, deadline=None)
@given(trees)
def test_parentheses_give_the_written_tree(pair):
    assert value_of(E.parse(pair[0])) == pair[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(numbers, st.sampled_from("+-*")), min_size=1, max_size=9))
def test_precedence_equals_pythons(items):
    text = " ".join(f"{n} {op}" for n, op in items) + " 3"
    assert value_of(E.parse(text)) == eval(text)  # digits and + - * only


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_any_text_is_read_or_refused(text):
    try:
        E.parse(text)
    except ExpressionError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=15))
def test_quoted_text_comes_back(text):
    assert E.parse("'" + text.replace("'", "''") + "'") == E.Literal(text)
