"""The index lookups, over the fact tables symbols, refs and sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.relational import expand_aliases, overlapping

#: The preset's callees.
PRESETS = ("interactive-in-sc", "nested-selection-container", "all-call-sites")


def find_symbol(symbols: DataFrame, name: str, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Symbols whose name, id or alias is `name`; kind and language filter if given. By fqn, file, line."""
    hit = (F.col("name") == name) | (F.col("fqn") == name) | F.coalesce(F.array_contains("aliases", name), F.lit(False))
    found = symbols.filter(hit)
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    if language is not None:
        found = found.filter(F.col("language") == language)
    return found.orderBy("fqn", "relative_file", "line", F.when(F.col("ns") == "sym", 0).otherwise(1), "_key")


def find_references(symbols: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """References whose target or a candidate is `symbol` or another name of a symbol that bears it. By file, line, column."""
    ids = expand_aliases(symbols, symbol)
    candidates = F.concat(F.array("symbol_fqn"), F.coalesce(F.col("candidate_symbol_fqns"), F.array().cast("array<string>")))
    return overlapping(refs, ids, candidates, ["_key"]).orderBy("relative_file", "line", "column", "_key")


def resolve_resource(symbols: DataFrame, kind: str, name: str) -> DataFrame:
    """Definitions of the local resource. By file, line, fqn."""
    return symbols.filter((F.col("ns") == "res") & (F.col("fqn") == f"res:{kind}:{name}")).orderBy("relative_file", "line", "fqn", "_key")


def has_symbol(symbols: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of wanted whose column is the id of some symbol."""
    return wanted.join(symbols.select(F.col("fqn").alias(column)), column, "left_semi")


def preset(sites: DataFrame, name: str, callees: Sequence[str]) -> DataFrame:
    if name == "interactive-in-sc":
        found = sites.filter(F.col("callee").isin(*callees) & F.col("in_selection_container") & ~F.col("excluded_by_disable_selection"))
    elif name == "nested-selection-container":
        found = sites.filter("selection_container_count > 1")
    elif name == "all-call-sites":
        found = sites
    else:
        raise ValueError(f"unknown preset: {name}")
    return found.orderBy("_key")


def point(sites: DataFrame, file: str, line: int, column: int | None = None) -> DataFrame:
    found = sites.filter((F.col("file") == file) & (F.col("line") == line))
    if column is not None:
        found = found.filter(F.col("column") == column)
    return found.orderBy("_key")


def scope_columns(topology: Column, scope: Column) -> tuple[Column, Column]:
    """(target, module): a Gradle scope is a module, any other a target."""
    gradle = F.startswith(topology, F.lit("gradle"))
    return F.when(~gradle, scope), F.when(gradle, scope)


def fresh(commit: str, indexer_version: str, scope: str, sources_content_hash: str, applications: Sequence[str]) -> Column:
    """Whether a manifest (columns of these names) answers the criteria; applications may come in any order."""
    wanted = {"commit": commit, "indexer_version": indexer_version, "scope": scope, "sources_content_hash": sources_content_hash}
    out = F.sort_array("applications") == F.array(*[F.lit(a) for a in sorted(applications)]).cast("array<string>")
    for name, value in wanted.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out
