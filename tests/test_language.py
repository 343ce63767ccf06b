"""Keys, expressions and predicates against tables of cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidefold.functions.expr import ExprError, evaluate, parse
from tidefold.functions.keys import canonical_number, composite_key, composite_key_binary, decode_composite, key_part
from tidefold.functions.scope import PathError, Scope, steps
from tidefold.functions.when import WhenError, checked, matches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("5", "5"), ("5.0000", "5"), ("5e0", "5"), ("5.25", "5.25"), ("-0", "0"), ("-0.0", "0"), ("100", "100"), ("0.50", "0.5"), ("x", None), ("1e2", "100"), ("007", "7"), ("", None)])
def test_canonical_numbers(spark, text, want):
    assert one(spark, canonical_number(F.lit(text))) == want


def test_key_parts(spark):
    assert one(spark, key_part(F.lit("ABC"), normalize="lower")) == "abc"
    assert one(spark, key_part(F.lit("007"))) == "007"
    assert one(spark, key_part(F.lit("5.0"), key_type="number")) == "5"
    assert one(spark, key_part(F.lit(Decimal("5.2500")), "decimal(10,4)")) == "5.25"
    assert one(spark, key_part(F.lit(5.0), "double")) == "5"


def test_composite_keys(spark):
    assert one(spark, composite_key([F.lit("a")])) == "a"
    assert one(spark, composite_key([F.lit("a"), F.lit("b<c>&")])) == '["a","b\\u003cc\\u003e\\u0026"]'
    assert one(spark, decode_composite(F.lit('["a","b"]'), 2)) == ["a", "b"]
    assert one(spark, decode_composite(F.lit('["a","b"]'), 3)) is None
    raw = F.unbase64(F.lit("/w=="))
    assert one(spark, composite_key_binary([F.lit(b"a"), raw])) == "b64:YQ==./w=="


def scope(spark):
    df = spark.sql("SELECT named_struct('n', 5, 'd', 2.50D, 's', 'five', 'b', true, 'z', cast(null as int), 'o', named_struct('a', 1)) AS payload")
    return df, Scope({"": (F.col("payload"), df.schema["payload"].dataType)})


CASES = [
    ("$.n + 1", Decimal(6)), ("$.n * $.d", Decimal("12.5")), ("-$.n", Decimal(-5)), ("$.n + $.z", None), ("$.n + $.s", None),
    ("round($.n / 3, 2)", Decimal("1.67")), ("round(-2.5, 0)", Decimal(-3)), ("trunc(-2.7)", Decimal(-2)), ("trunc(2.719, 2)", Decimal("2.71")), ("round($.n / 0, 2)", None),
    ("$.n = 5", True), ("$.n = 'five'", False), ("$.s <> 'x'", True), ("$.z = 1", None), ("$.s < 3", None), ("$.n >= 5", True),
    ("true or null = 1", True), ("false and null = 1", False), ("not null = 1", None), ("$.b and $.n > 1", True),
    ("$.n in (1, 5)", True), ("$.n in (1, 2)", False), ("$.z in (1)", None), ("$.n in (1, null)", None), ("$.n not in (1, 2)", True),
    ("$.z is null", True), ("$.o is not null", True), ("$.gone is null", True), ("coalesce($.z, $.n)", Decimal(5)), ("nullif($.n, 5)", None), ("nullif($.s, 'a')", "five"), ("'it''s'", "it's"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_expressions(spark, text, want):
    df, sc = scope(spark)
    assert df.select(evaluate(text, sc).col).first()[0] == want


def test_data_errors_are_told(spark):
    df, sc = scope(spark)
    assert df.select(evaluate("$.n + $.s", sc).err).first()[0] is True
    assert df.select(evaluate("round($.n / ($.n - 5), 1)", sc).err).first()[0] is True
    assert df.select(evaluate("round($.n / $.n, 1)", sc).err).first()[0] is False


@pytest.mark.parametrize("text", ["$.a / 2", "round(1)", "round(1, $.a)", "round(1, 13)", "foo(1)", "1 +", "coalesce(1)", "(1", "'open", "$.a $.b"])
def test_refused_expressions(text):
    with pytest.raises(ExprError):
        parse(text)


def test_paths():
    assert steps("$.a['b c'][2]") == ["a", "b c", 2]
    assert steps("$parent.x") == ["$parent", "x"]
    with pytest.raises(PathError):
        steps("$.a[*]")


@pytest.mark.parametrize("clause,want", [
    ({"path": "$.n", "equals": 5}, True), ({"path": "$.n", "equals": "5"}, False), ({"path": "$.b", "equals": "true"}, False), ({"path": "$.b", "equals": True}, True),
    ({"path": "$.n", "notEquals": 4}, True), ({"path": "$.z", "notEquals": 4}, False), ({"path": "$.s", "notEquals": 4}, False), ({"path": "$.z", "null": True}, True),
    ({"path": "$.gone", "null": True}, False), ({"path": "$.n", "notNull": True}, True), ({"path": "$.d", "greaterThan": 2}, True), ({"path": "$.s", "lessThan": 9}, False),
    ({"expr": "$.n > 1"}, True), ({"expr": "$.z > 1"}, False), ({"expr": "$.n"}, False), ({"expr": "$.s > 1"}, False),
])
def test_clauses(spark, clause, want):
    df, sc = scope(spark)
    assert df.select(matches([clause], sc)).first()[0] is want


def test_null_and_missing_differ_in_variants(spark):
    df = spark.sql("""SELECT parse_json(j) AS payload FROM VALUES ('{"a":null}'), ('{}'), ('{"a":5}'), ('{"a":"5"}') AS t(j)""")
    sc = Scope({"": (F.col("payload"), df.schema["payload"].dataType)})
    got = lambda c: [r[0] for r in df.select(matches([c], sc)).collect()]
    assert got({"path": "$.a", "null": True}) == [True, False, False, False]
    assert got({"path": "$.a", "equals": 5}) == [False, False, True, False]
    assert got({"path": "$.a", "equals": "5"}) == [False, False, False, True]
    assert got({"path": "$.a", "notNull": True}) == [False, False, True, True]
    assert got({"expr": "$.a + 1 > 5"}) == [False, False, True, False]


@pytest.mark.parametrize("bad", [[{"path": "$.a"}], [{"path": "$.a", "equals": 1, "null": True}], [{"path": "$.a", "equals": [1]}], [{"path": "$.a", "lessThan": "x"}], [{"path": "$.a", "null": False}], [{"expr": "1", "path": "$.a"}]])
def test_refused_clauses(bad):
    with pytest.raises(WhenError):
        checked(bad)
