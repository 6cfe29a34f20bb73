"""Keys of the fact store: a namespace, then parts joined by colons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.functions.text import before

INDEXER_VERSION_KEY = "meta:indexer:version"


def key(namespace: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(namespace), *parts)


def symbol_key(fqn: Column, file: Column, line: Column, column: Column) -> Column:
    return key("sym", fqn, file, line, column)


def reference_key(fqn: Column, file: Column, line: Column, column: Column) -> Column:
    return key("ref", fqn, file, line, column)


def resource_key(kind: Column, name: Column, file: Column, line: Column) -> Column:
    return key("res", kind, name, file, line)


def file_key(path: Column, content_hash: Column) -> Column:
    return key("file", path, content_hash)


def site_key(file: Column, line: Column, column: Column) -> Column:
    return key("compose", F.lit("selection-site"), file, line, column)


def is_key(value: Column) -> Column:
    return (F.trim(value) != "") & F.contains(value, F.lit(":"))


def namespace(value: Column) -> Column:
    return before(value, ":")


def parse_site_key(value: Column, prefix_parts: int) -> dict[str, Column]:
    """file, line and column of a key, whose file may hold colons itself."""
    parts = F.split(value, ":", -1)
    file = F.array_join(F.slice(parts, F.lit(prefix_parts + 1), F.size(parts) - F.lit(prefix_parts + 2)), ":")
    return {"file": file, "line": F.element_at(parts, -2).cast("int"), "column": F.element_at(parts, -1).cast("int")}
