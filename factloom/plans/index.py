"""Building an index: hash, compare with the build before, extract what changed, resolve, commit."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import content_hash, extension
from factloom.operators.relational import change_counters, changes, delete_keys
from factloom.operators.shared import global_row_number, written
from factloom.plans.config import SelectionRules
from factloom.plans.extract import extract, resolve_references, sites_of, symbols_of
from factloom.plans.progress import BuildProgress, NoProgress, told
from factloom.plans.registry import REGISTRY, Producer, Registry
from factloom.sources.store import Manifest, Store
from factloom.sources.topology import SourceSet, read_files

INDEXER_VERSION = "1"


def git_head(workspace: Path) -> str:
    done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=workspace, capture_output=True, text=True)
    if done.returncode:
        raise ValueError(f"not a git repository: {workspace}")
    return done.stdout.strip()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, first = hashlib.sha256(), True
    for batch in batches:
        for path, h in zip(batch.column("relative_path").to_pylist(), batch.column("content_hash").to_pylist(), strict=True):
            state.update(("" if first else "\n").encode() + f"{path}:{h}".encode())
            first = False
    yield pa.RecordBatch.from_arrays([pa.array([f"sha256:{state.hexdigest()}"])], ["h"])


def combined_hash(hashes: DataFrame) -> str:
    """One hash over all paths and hashes in the order of paths. A stream: a row a file goes through, none is held."""
    ordered = hashes.select("relative_path", "content_hash").repartition(1).sortWithinPartitions("relative_path")
    return ordered.mapInArrow(_combined, "h string").first().h


def hashes_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("relative_file").alias("relative_path"), content_hash(F.col("content")).alias("content_hash"))


def build(spark: SparkSession, workspace: str | Path, commit: str, sources: SourceSet, applications: Sequence[str] = (), files: DataFrame | None = None, progress: BuildProgress | None = None, indexer_version: str = INDEXER_VERSION, rules: SelectionRules | None = None, registry: Registry = REGISTRY) -> str:
    """`fresh` if the manifest answers for these sources already, else `indexed`. files: relative_file and content, read if not given.

    One build of an index runs at a time: the store's lock is held from the look at the manifest on.
    """
    store = Store(spark, workspace, commit)
    with store.locked():
        return _build(spark, workspace, commit, sources, store, [a.strip() for a in applications if a.strip()], files, progress or NoProgress(), indexer_version, rules, registry)


def _build(spark: SparkSession, workspace, commit: str, sources: SourceSet, store: Store, applications: list[str], files: DataFrame | None, progress: BuildProgress, indexer_version: str, rules: SelectionRules | None, registry: Registry) -> str:
    files = files if files is not None else read_files(spark, Path(workspace), sources.files)
    hashes = written(hashes_of(files), "hashes")
    digest, before = combined_hash(hashes), store.manifest()
    if before and before.is_fresh(commit, indexer_version, sources.scope, digest, applications):
        progress.completed("fresh")
        return "fresh"
    full = before is None or before.indexer_version != indexer_version
    old_hashes = store.table("file_hashes")
    if full:
        old_hashes = old_hashes.limit(0)
    diff = written(changes(old_hashes, hashes, "relative_path", "content_hash"), "changes")
    counts = change_counters(diff).first()
    progress.changes(counts.changed, counts.unchanged, counts.removed)
    affected = diff.filter("change <> 'unchanged'").select(F.col("relative_path").alias("relative_file"))
    changed = diff.filter("change = 'changed'").select(F.col("relative_path").alias("relative_file"), F.lit(True).alias("is_changed"))
    wants_sites = "selection-context" in applications
    every = F.lit(False)
    for p in registry.for_applications(applications, rules):
        every = every | F.col("relative_file").endswith(p.suffix) if p.every_file else every
    totals = {r.kind: r["count"] for r in changed.groupBy(extension(F.col("relative_file")).alias("kind")).count().collect() if r.kind in ("java", "kt", "xml")}
    marked = files.join(changed, "relative_file", "left").select("relative_file", "content", F.coalesce("is_changed", F.lit(False)).alias("changed"), every.alias("sites"))
    phases = registry.for_applications(applications, rules)
    facts = written(extract(marked.filter("changed or sites"), phases), "facts")
    for p in phases:
        total = p.progress_total(totals)
        progress.phase_started(p.id, total, p.display_name)
        _report_files(progress, p, changed, total)
        progress.phase_completed(p.id, total)
    kept_symbols, kept_refs = store.table("symbols"), store.table("refs")
    if full:
        kept_symbols, kept_refs = kept_symbols.limit(0), kept_refs.limit(0)
    kept_symbols = delete_keys(kept_symbols, affected, ["relative_file"])
    kept_refs = delete_keys(kept_refs, affected, ["relative_file"])
    tables = {
        "symbols": kept_symbols.unionByName(symbols_of(facts)),
        "refs": kept_refs.unionByName(resolve_references(facts, kept_symbols)),
        # an application that isn't asked for any more leaves its rows
        "sites": sites_of(facts, commit) if wants_sites else store.table("sites"),
        "file_hashes": hashes,
    }
    now = datetime.now(UTC).isoformat().replace("+00:00", "Z")
    store.commit(tables, Manifest(commit, indexer_version, sources.scope, sources.topology, sources.include_deps, len(sources.files), digest, now, applications))
    progress.completed("indexed")
    return "indexed"


def _report_files(progress: BuildProgress, producer: Producer, changed: DataFrame, total: int) -> None:
    """The files that progress tells of, in the order of their paths: few enough to bring here one by one."""
    if not total or not progress.wants_files:
        return
    read = changed.filter(F.col("relative_file").endswith(producer.suffix)).select("relative_file")
    numbered = global_row_number(read, ["relative_file"])
    for r in numbered.filter(told(F.col("row_number"), total)).orderBy("row_number").toLocalIterator():
        progress.file(producer.id, r.row_number, total, r.relative_file)


def status(spark: SparkSession, workspace: Path, commit: str, discover) -> tuple[dict, int]:
    """The report, and the exit code. discover: a source set for a manifest."""
    store = Store(spark, workspace, commit)
    held = store.manifest()
    if held is None:
        return {"indexed": False, "commit": commit}, 1
    digest = combined_hash(hashes_of(read_files(spark, workspace, discover(held).files)))
    report = {"indexed": True, "commit": commit, "scope": held.scope, "topology": held.topology, "indexerVersion": held.indexer_version, "sourceFileCount": held.source_file_count, "builtAt": held.built_at, "applications": held.applications}
    report |= {"fresh": held.is_fresh(commit, INDEXER_VERSION, held.scope, digest, held.applications), "currentSourcesContentHash": digest, "manifestSourcesContentHash": held.sources_content_hash}
    defaults = ("", 0, [], False, INDEXER_VERSION)
    return {k: v for k, v in report.items() if k in ("indexed", "commit") or v not in defaults}, 0
