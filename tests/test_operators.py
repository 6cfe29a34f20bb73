"""Operators on edge cases: ties, nulls, cycles, empty tables."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import keys as K, text as S
from factloom.operators import lookup as L, relational as R
from factloom.operators.shared import global_row_number


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column).first()[0]


def test_closure_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 9)], "src int, dst int")
    roots = spark.createDataFrame([(1,)], "node int")
    assert sorted(r.node for r in R.closure(roots, edges).collect()) == [1, 2, 3, 4, 5]
    included = spark.createDataFrame([(2,), (3,)], "node int")
    assert sorted(r.node for r in R.closure(roots, edges, included).collect()) == [1, 2, 3]


def test_closure_in_rounds_equals_the_walk(spark):
    chain = [(i, i + 1) for i in range(60)] + [(70, 71), (60, 3), (None, 5), (5, None), (20, 90)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    roots = spark.createDataFrame([(0,), (None,), (10**12,)], "node long")
    want = [*range(61), 90, 10**12]
    for one_task in (0, R.ONE_TASK):
        assert sorted(r.node for r in R.closure(roots, edges, one_task=one_task).collect()) == want
    assert R.closure(roots.limit(0), edges).count() == 0


def test_containments(spark):
    spans = [("p", "a", 1, 10, 1), ("p", "b", 2, 5, 2), ("p", "c", 3, 4, 3), ("p", "d", 6, 9, 2), ("p", "e", 7, 8, 3), ("p", "f", 11, 14, 1), ("p", "g", 12, 13, 2), ("q", "h", 1, 2, 1)]
    df = spark.createDataFrame(spans, "page string, name string, begin int, end int, depth int")
    got = {(r.name, r.distance, r.a_name) for r in R.containments(df, df, "page").collect()}
    assert got == {("b", 1, "a"), ("c", 1, "b"), ("c", 2, "a"), ("d", 1, "a"), ("e", 1, "d"), ("e", 2, "a"), ("g", 1, "f")}


def test_overlapping_by_literals_equals_the_join(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, []), (4, None), (5, ["b", "b"])], "k int, c array<string>")
    ids = spark.createDataFrame([("b",), ("c",), ("z",)], "id string")
    for few in (1000, 0):
        monkeypatch.setattr(R, "FEW", few)
        assert sorted(r.k for r in R.overlapping(rows, ids, F.col("c"), ["k"]).collect()) == [1, 2, 5]


def test_overlay_without_delta_is_base(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "_key string, v int")
    assert sorted(R.overlay(base, base.limit(0), ["_key"]).collect()) == sorted(base.collect())


def test_last_write_wins_on_nulls(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), (None, 1, "y")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in R.last_write_wins(rows, ["k"], ["seq"]).collect()} == {("k", None), (None, "y")}


def test_changes_tell_new_and_null_values(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", None)], "p string, h string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", None)], "p string, h string")
    assert {r.p: r.change for r in R.changes(was, now, "p", "h").collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "unchanged"}


def test_global_row_number(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = global_row_number(rows, ["x"], "n", "total").collect()
    assert all(r.n == r.x + 1 and r.total == 1000 for r in got)
    assert global_row_number(rows.limit(0), ["x"]).count() == 0


def test_unknown_preset_and_aliases_are_one_hop(spark):
    with pytest.raises(ValueError):
        L.preset(spark.range(1), "no-such", ())
    symbols = spark.createDataFrame([("a", ["b"]), ("c", ["a"]), ("d", ["c"]), ("e", None)], "fqn string, aliases array<string>")
    assert {r.id for r in R.expand_aliases(symbols, "a").collect()} == {"a", "b", "c"}


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, S.short_name(lit("a.b.C#d"))) == "d" and one(spark, S.short_name(lit("plain"))) == "plain"
    assert one(spark, S.before_last(lit("a.b.c"), ".")) == "a.b" and one(spark, S.before_last(lit("abc"), ".")) == "abc"
    assert one(spark, S.normalize_type(lit(" List<String>? "))) == "List" and one(spark, S.normalize_type(lit("T[]"), "[]")) == "T"
    assert one(spark, S.normalized_path(lit("a\\..\\b/./c"))) == "b/c" and one(spark, S.normalized_path(lit("a/../../b"))) is None
    assert one(spark, S.normalized_path(lit("/a"))) is None
    assert [one(spark, S.glob_match(lit(p), "src/**/*.kt")) for p in ("src/A.kt", "src/x/y/A.kt", "src/A.java")] == [True, True, False]
    assert one(spark, S.resource_fqn(lit(" "), lit("t"), lit("n"))) == "res:t:n"
    assert one(spark, S.bean_property(lit("get"))) is None and one(spark, S.module_dir(lit(":a:b"))) == "a/b" and one(spark, S.normalized_module(lit("a"))) == ":a"
    assert one(spark, S.label_path(lit(" //:F.kt"))) == "F.kt" and one(spark, S.label_path(lit("//a/F.kt"))) is None
    assert one(spark, S.facade(lit("a/b/File.kt"), lit(None).cast("string"))) == "FileKt"


def test_keys(spark):
    parsed = K.parse_site_key(F.lit("compose:selection-site:a:b.kt:10:4"), 2)
    assert [one(spark, parsed[c]) for c in ("file", "line", "column")] == ["a:b.kt", 10, 4]
    assert [one(spark, K.is_key(F.lit(k))) for k in ("a:b", "ab", " ")] == [True, False, False]


def test_records_round_trip_and_defaults(spark):
    from factloom.plans.records import references_from_json, symbol_json, symbols_from_json

    short = spark.createDataFrame([('{"type":"symbol","fqn":"a.b","relativeFile":"f","line":1,"kind":"class","name":"b","more":1}',)], "json string")
    symbols = symbols_from_json(short)
    row = symbols.first()
    assert (row.fqn, row.language, row.aliases, row.arity) == ("a.b", "unknown", [], None)
    assert symbols_from_json(symbol_json(symbols)).first() == row
    ref = references_from_json(spark.createDataFrame([('{"symbolFqn":"a.B#c","relativeFile":"f","line":1,"column":2}',)], "json string")).first()
    assert (ref.referenced_name, ref.context, ref.candidate_symbol_fqns) == ("c", "call", ["a.B#c"])
