"""Columns of the caller that bear any name an operator uses inside."""

import os

import pytest
from helpers import documents
from pyspark.sql import functions as F

from factloom.llm import exact_dedup as E, line_dedup as L, mixing as M, near_dedup as N, sentencepiece_wfst as P, sharding as S, token_counts as C, topk as K, toxicity as X, url_filters as U

NAMES = (
    "k target source_size _v_ _verdict _row _id _text _set _sets _at _key _of _gone _lines _bands _sketch _bin _by_id _part _unit _start _n _score _recipe _points _sha _best _size "
    "_source _rank _range _number node key star n least line site h x v id of by size row i t a b _h toxic bucket chunk grp qids is_query held at rest host_ source_"
).split()


def clashing(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


OPERATORS = {
    "toxicity": lambda spark, docs: X.score(docs, X.Model(__import__("numpy").array([5]), __import__("numpy").array([0.5]), 0.1)),
    "accepted": lambda spark, docs: X.accepted(docs, X.Model(__import__("numpy").array([5]), __import__("numpy").array([0.5]), -0.1)),
    "sentencepiece": lambda spark, docs: P.encode(docs, P.compile_model()),
    "sharding": lambda spark, docs: S.shard(docs, 3),
    "near_dedup": lambda spark, docs: N.near_dedup(docs, words=2),
    "near_deduplicated": lambda spark, docs: N.near_deduplicated(docs, words=2),
    "line_dedup": lambda spark, docs: L.drop_spread_lines(docs, least_sites=2),
    "token_counts": lambda spark, docs: C.token_counts(docs, frozenset("ab"), frozenset("ab")),
    "exact_dedup": lambda spark, docs: E.exact_dedup(docs),
    "deduplicated": lambda spark, docs: E.deduplicated(docs),
    "mix": lambda spark, docs: M.mix(docs),
    "mixed": lambda spark, docs: M.mixed(docs),
    "url_filters": lambda spark, docs: U.filter_urls(docs.withColumn("url", F.lit("http://a.org/x"))),
}
#: Results that go by these names take the place of the caller's columns.
MADE = {"mix": set(M.MADE), "sharding": {"size"}, "toxicity": {"score"}, "accepted": set()}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_come_through(spark, name):
    if name == "sentencepiece" and not os.path.isfile(P.MODEL):
        pytest.skip("no public vocabulary here")
    docs = clashing(documents(spark, n=10))
    got = OPERATORS[name](spark, docs)
    own = [n for n in NAMES if n not in MADE.get(name, ()) and n in got.columns]
    assert len(own) >= len(NAMES) - len(MADE.get(name, ()))
    rows = got.select(*[F.col(f"`{n}`") for n in own]).collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in own)


def test_vectors_with_columns_of_any_name(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert K.top_k(clashing(vectors), F.col("vec_id") == 0, 2).count() == 2


def test_labelled_rows_with_columns_of_any_name(spark):
    docs = documents(spark, n=10).withColumn("toxic", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int"))
    assert len(X.fit(clashing(docs)).buckets) >= 0
