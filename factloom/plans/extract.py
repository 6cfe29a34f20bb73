"""From file texts to fact tables: readers run on the executors, references are resolved by joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.functions import keys as K
from factloom.operators.relational import last_write_wins
from factloom.plans.registry import REGISTRY, Producer, Source
from factloom.sources.syntax.facts import SCHEMA, Facts
from factloom.sources.syntax.tree import Lines, SyntaxProblem

SYMBOLS = "ns string, fqn string, relative_file string, line int, column int, kind string, name string, language string, owner_fqn string, signature string, arity int, aliases array<string>, _key string"
REFS = "symbol_fqn string, relative_file string, line int, column int, context string, language string, referenced_name string, qualifier string, candidate_symbol_fqns array<string>, arity int, _key string"
_PLACE = "struct<file: string, line: int, function: string>"
SITES = f"file string, line int, column int, callee string, in_selection_container boolean, selection_container_count int, excluded_by_disable_selection boolean, selection_containers array<{_PLACE}>, disable_selection {_PLACE}, confidence string, indexed_from_commit string, _key string"
HASHES = "relative_path string, content_hash string"


class SourceProblem(ValueError):
    """A file that cannot be read; the message names it."""


def _extractor(producers: Sequence[Producer]):
    def facts_of(path: str, text: str, changed: bool, sites: bool) -> list[dict]:
        kind = path.rpartition(".")[2]
        source, out = Source(path, text), Facts(path, {"kt": "kotlin"}.get(kind, kind))
        try:
            for p in producers:
                if p.read is not None and p.reads(path) and (sites if p.every_file else changed):
                    p.read(source, out)
        except SyntaxProblem as e:
            raise SourceProblem(f"{path}:{Lines(text).at(e.offset)[0]}: {e}") from None
        return out.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(20_000)
        for batch in batches:
            for r in batch.to_pylist():
                rows = facts_of(r["relative_file"], r["content"], r["changed"], r["sites"])
                if rows:
                    yield from pa.Table.from_pylist(rows, schema).to_batches()

    schema = _arrow_schema()
    return run


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SCHEMA))


def extract(files: DataFrame, producers: Sequence[Producer] | None = None) -> DataFrame:
    """files: relative_file, content, changed (read by producers of changed files), sites (by those of every file). All run in one pass."""
    producers = REGISTRY.for_applications(["selection-context"]) if producers is None else producers
    return files.mapInArrow(_extractor(producers), SCHEMA)


def symbols_of(facts: DataFrame) -> DataFrame:
    sym = K.symbol_key(F.col("fqn"), F.col("relative_file"), F.col("line"), F.col("column"))
    res = K.resource_key(F.substring_index(F.col("owner_fqn"), ":", -1), F.col("name"), F.col("relative_file"), F.col("line"))
    other = F.concat_ws(":", "ns", "fqn", "relative_file", "line", "column")  # a namespace of a producer that was added
    rows = facts.filter("what = 'symbol'").withColumn("_key", F.when(F.col("ns") == "res", res).when(F.col("ns") == "sym", sym).otherwise(other))
    names = [c.strip().split(" ")[0] for c in SYMBOLS.replace("array<string>", "array").split(",")]
    return last_write_wins(rows.select(*names, "seq"), ["_key"], ["seq"]).select(*names)


def resolve_references(facts: DataFrame, before: DataFrame) -> DataFrame:
    """References with their targets. before: symbols of earlier builds that survive.

    Java sees what is stored when a file is read: `before`, and Java symbols of files (and places) before. Kotlin sees all
    symbols of this build, and for members the Kotlin ones.
    """
    place = F.struct(F.col("relative_file").alias("file"), F.col("seq").alias("seq"))
    new = facts.filter("what = 'symbol' and ns = 'sym'")
    first = F.struct(F.lit("").alias("file"), F.lit(-1).alias("seq"))
    stored = before.filter("ns = 'sym'").select(F.col("fqn").alias("known_fqn"), first.alias("java"))
    known = new.select(F.col("fqn").alias("known_fqn"), F.when(F.col("language") == "java", place).alias("java")).union(stored).groupBy("known_fqn").agg(F.min("java").alias("java"))
    members = new.filter("language = 'kotlin'").groupBy(F.col("owner_fqn").alias("m_owner"), F.col("name").alias("m_name")).agg(F.min_by("fqn", place).alias("member"))
    opened = facts.filter("what = 'open'")
    choices = opened.select("relative_file", "seq", "language", F.explode("choices").alias("c"))
    # each rule by itself, so that no rows meet in a join whose key they don't have
    place_and_rank = ["relative_file", "seq", F.col("c.rank").alias("rank")]
    target = F.struct(F.col("c.fqn").alias("fqn"), F.col("c.candidates").alias("candidates"))
    always = choices.filter("c.rule = 'always'").select(*place_and_rank, target.alias("target"))
    by_id = choices.filter("c.rule = 'known'").join(known, F.col("c.fqn") == F.col("known_fqn")).filter((F.col("language") == "kotlin") | (F.col("java") < place))
    by_owner = choices.filter("c.rule = 'member'").join(members, (F.col("c.owner") == F.col("m_owner")) & (F.col("c.name") == F.col("m_name")))
    found = F.struct(F.col("member").alias("fqn"), F.coalesce(F.col("c.candidates"), F.array("member")).alias("candidates"))
    met = always.union(by_id.select(*place_and_rank, target.alias("target"))).union(by_owner.select(*place_and_rank, found.alias("target")))
    picked = met.groupBy("relative_file", "seq").agg(F.min_by("target", "rank").alias("t"))
    named = opened.drop("fqn", "candidates").join(picked, ["relative_file", "seq"]).withColumns({"fqn": F.col("t.fqn"), "candidates": F.col("t.candidates")})
    columns = ["relative_file", "seq", "fqn", "line", "column", "context", "language", "name", "qualifier", "candidates", "arity"]
    rows = facts.filter("what = 'ref'").select(*columns).union(named.select(*columns))
    rows = rows.select(
        F.col("fqn").alias("symbol_fqn"), "relative_file", "line", "column", "context", "language", F.col("name").alias("referenced_name"), "qualifier", F.col("candidates").alias("candidate_symbol_fqns"), "arity", "seq",
        K.reference_key(F.col("fqn"), F.col("relative_file"), F.col("line"), F.col("column")).alias("_key"),
    )
    return last_write_wins(rows, ["_key"], ["seq"]).drop("seq")


def sites_of(facts: DataFrame, commit: str) -> DataFrame:
    n = F.size("containers")
    rows = facts.filter("what = 'site'").select(
        F.col("relative_file").alias("file"), "line", "column", "callee", (n > 0).alias("in_selection_container"), n.alias("selection_container_count"), F.col("excluded").alias("excluded_by_disable_selection"),
        F.col("containers").alias("selection_containers"), F.col("disable").alias("disable_selection"), "confidence", F.lit(commit).alias("indexed_from_commit"), K.site_key(F.col("relative_file"), F.col("line"), F.col("column")).alias("_key"), "seq",
    )
    return last_write_wins(rows, ["_key"], ["seq"]).drop("seq")

