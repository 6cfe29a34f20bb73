"""Six commands: index, query, status, find-symbol, find-references, resolve-resource. `python -m factloom.cli COMMAND ...`"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import lookup as L
from factloom.plans.config import SelectionRules, interactive_callees, wrapper_rules
from factloom.plans.index import build, git_head, status
from factloom.plans.progress import BuildProgress, LookupProgress, TextProgress
from factloom.plans.records import reference_json, site_json, symbol_json
from factloom.sources.store import Store
from factloom.sources.topology import TopologyError, resolve

OK, ANALYSIS, USAGE, TOPOLOGY = 0, 1, 2, 3


class NotIndexed(Exception):
    pass


class BadFormat(Exception):
    pass


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for option in ("project", *required):
            p.add_argument(f"--{option}", required=True)
        return p

    for name in ("index", "status"):
        p = command(name)
        p.add_argument("--build-system", default="auto", type=str.lower, choices=("auto", "bazel", "gradle"))
        p.add_argument("--bazel-target")
        p.add_argument("--gradle-module")
        p.add_argument("--include-deps", action="store_true")
        if name == "index":
            p.add_argument("--applications", default="")
            p.add_argument("--progress-format", default="text", choices=("text", "jsonl"))
            p.add_argument("--wrapper-rules", help="JSON file of wrappers around selectable content; none there: no rules")
    p = command("query", "application")
    p.add_argument("--preset")
    p.add_argument("--file")
    p.add_argument("--line", type=int)
    p.add_argument("--column", type=int)
    p.add_argument("--session-id")
    p.add_argument("--preset-config", help="JSON file of the callees of the preset for interactive elements")
    p.add_argument("--format", default="jsonl")
    for name, required, optional in (("find-symbol", ("name",), ("kind", "language")), ("find-references", ("symbol",), ()), ("resolve-resource", ("type", "name"), ())):
        p = command(name, *required)
        for option in (*optional, "session-id"):
            p.add_argument(f"--{option}")
        p.add_argument("--format", default="jsonl")
        p.add_argument("--progress-format", default="text", choices=("text", "jsonl"))
    return top


def _index(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None], err: Callable[[str], None], **bazel) -> int:
    progress, root = BuildProgress(out) if a.progress_format == "jsonl" else TextProgress(err), Path(a.project)
    progress.discovery_started()
    try:
        sources = resolve(root, a.build_system, a.bazel_target, a.gradle_module, a.include_deps, **bazel)
        if not sources.files:
            raise TopologyError(f"no sources found for {sources.scope}")
        progress.discovery_completed(len(sources.files))
        build(spark, root, git_head(root), sources, a.applications.split(","), progress=progress, rules=SelectionRules(wrappers=wrapper_rules(a.wrapper_rules)))
    except TopologyError as e:
        progress.failed(TOPOLOGY, str(e))
        err(str(e))
        return TOPOLOGY
    except Exception as e:
        progress.failed(ANALYSIS, str(e).splitlines()[0] if str(e) else type(e).__name__)
        err(str(e))
        return ANALYSIS
    return OK


def _status(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None], **bazel) -> int:
    root = Path(a.project)

    def discover(held):
        if a.bazel_target or a.gradle_module:
            return resolve(root, a.build_system, a.bazel_target, a.gradle_module, a.include_deps, **bazel)
        if held.topology.startswith("gradle"):
            return resolve(root, "gradle", None, held.scope, a.include_deps)
        return resolve(root, "bazel", held.scope, **bazel)

    report, code = status(spark, root, git_head(root), discover)
    out(json.dumps(report, separators=(",", ":"), ensure_ascii=False))
    return code


def _opened(spark: SparkSession, project: str) -> Store:
    root = Path(project)
    store = Store(spark, root, git_head(root), read_only=True)
    if store.manifest() is None:
        raise NotIndexed(f"no index for {root}; run index first")
    return store


def _query(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None]) -> int:
    point = a.file is not None or a.line is not None or a.column is not None
    if a.format != "jsonl":
        raise BadFormat(f"unknown format: {a.format}")
    if point == (a.preset is not None):
        raise ValueError("give either --preset or --file and --line")
    if point and (a.file is None or a.line is None):
        raise ValueError("a point query needs --file and --line")
    if a.application != "selection-context":
        raise ValueError(f"unknown application: {a.application}")
    store = _opened(spark, a.project)
    held, sites = store.manifest(), store.table("sites", a.session_id)
    rows = L.point(sites, a.file, a.line, a.column) if point else L.preset(sites, a.preset, interactive_callees(a.preset_config))
    for r in site_json(rows, held.topology, held.scope).toLocalIterator():
        out(r.json)
    return OK


def _found(store: Store, a: argparse.Namespace) -> DataFrame:
    symbols = store.table("symbols", a.session_id)
    if a.command == "find-symbol":
        return symbol_json(L.find_symbol(symbols, a.name, a.kind, a.language))
    if a.command == "find-references":
        return reference_json(L.find_references(symbols, store.table("refs", a.session_id), a.symbol))
    return symbol_json(L.resolve_resource(symbols, a.type, a.name))


def _lookup(spark: SparkSession, a: argparse.Namespace, out: Callable[[str], None], err: Callable[[str], None]) -> int:
    jsonl = a.progress_format == "jsonl"
    progress, began = LookupProgress(err if jsonl else lambda _: None, a.command), time.monotonic()
    took = lambda: int((time.monotonic() - began) * 1000)
    names = {"find-symbol": ("name", "kind", "language"), "find-references": ("symbol",), "resolve-resource": ("type", "name")}
    progress.started({n: getattr(a, n) for n in names[a.command]})
    try:
        if a.format != "jsonl":
            raise BadFormat(f"unknown format: {a.format}")
        n = 0
        for n, r in enumerate(_found(_opened(spark, a.project), a).toLocalIterator(), 1):
            progress.match(n, json.loads(r.json))
            out(r.json)
        progress.completed(n, took())
        return OK
    except Exception as e:
        reason = "index_not_found" if isinstance(e, NotIndexed) else "invalid_format" if isinstance(e, BadFormat) else "lookup_error"
        progress.failed(reason, str(e), took())
        if not jsonl:
            raise
        return USAGE if isinstance(e, BadFormat) else ANALYSIS


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: Callable[[str], None] = print, err: Callable[[str], None] = lambda s: print(s, file=sys.stderr), **bazel) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        return _index(spark, a, out, err, **bazel)
    if a.command == "status":
        return _status(spark, a, out, **bazel)
    if a.command == "query":
        return _query(spark, a, out)
    return _lookup(spark, a, out, err)


if __name__ == "__main__":
    sys.exit(main())
