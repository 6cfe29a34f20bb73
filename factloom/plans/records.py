"""Fact rows as the JSON records that lookups print: names in camel case, nulls written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import short_name
from factloom.operators.lookup import scope_columns

SYMBOL = {"fqn": "fqn", "relativeFile": "relative_file", "line": "line", "kind": "kind", "name": "name", "language": "language", "ownerFqn": "owner_fqn", "signature": "signature", "arity": "arity", "aliases": "aliases"}
REFERENCE = {"symbolFqn": "symbol_fqn", "relativeFile": "relative_file", "line": "line", "column": "column", "context": "context", "language": "language", "referencedName": "referenced_name", "qualifier": "qualifier", "candidateSymbolFqns": "candidate_symbol_fqns", "arity": "arity"}


def _json(columns: list) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json")


def symbol_json(rows: DataFrame) -> DataFrame:
    return rows.select(_json([F.lit("symbol").alias("type"), *[F.col(c).alias(n) for n, c in SYMBOL.items()]]))


def reference_json(rows: DataFrame) -> DataFrame:
    return rows.select(_json([F.lit("reference").alias("type"), *[F.col(c).alias(n) for n, c in REFERENCE.items()]]))


def site_json(rows: DataFrame, topology: str, scope: str) -> DataFrame:
    target, module = scope_columns(F.lit(topology), F.lit(scope))
    names = {"file": "file", "line": "line", "column": "column", "callee": "callee", "inSelectionContainer": "in_selection_container", "selectionContainerCount": "selection_container_count", "excludedByDisableSelection": "excluded_by_disable_selection", "selectionContainers": "selection_containers", "disableSelection": "disable_selection", "confidence": "confidence"}
    return rows.select(_json([*[F.col(c).alias(n) for n, c in names.items()], target.alias("target"), module.alias("module"), F.lit(topology).alias("topology")]))


_SYMBOL_JSON = "fqn string, relativeFile string, line int, kind string, name string, language string, ownerFqn string, signature string, arity int, aliases array<string>"
_REFERENCE_JSON = "symbolFqn string, relativeFile string, line int, column int, context string, language string, referencedName string, qualifier string, candidateSymbolFqns array<string>, arity int"


def symbols_from_json(rows: DataFrame, json: str = "json") -> DataFrame:
    """Symbol records read back: unknown fields are passed over, missing ones get their defaults."""
    r = rows.select(F.from_json(json, _SYMBOL_JSON).alias("r")).select("r.*")
    filled = {"language": F.coalesce("language", F.lit("unknown")), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))}
    return r.withColumns(filled).select(*[F.col(n).alias(c) for n, c in SYMBOL.items()])


def references_from_json(rows: DataFrame, json: str = "json") -> DataFrame:
    r = rows.select(F.from_json(json, _REFERENCE_JSON).alias("r")).select("r.*")
    filled = {
        "context": F.coalesce("context", F.lit("call")),
        "language": F.coalesce("language", F.lit("unknown")),
        "referencedName": F.coalesce("referencedName", short_name(F.col("symbolFqn"))),
        "candidateSymbolFqns": F.coalesce("candidateSymbolFqns", F.array("symbolFqn")),
    }
    return r.withColumns(filled).select(*[F.col(n).alias(c) for n, c in REFERENCE.items()])
