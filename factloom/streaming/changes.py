"""An index that follows a stream of file changes: each micro-batch is one incremental build."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import content_hash
from factloom.operators.relational import delete_keys, last_write_wins
from factloom.operators.shared import written
from factloom.plans.extract import extract, resolve_references, sites_of, symbols_of
from factloom.plans.index import INDEXER_VERSION, combined_hash
from factloom.sources.store import Manifest, Store

CHANGES = "seq long, relative_file string, content string"


def apply_changes(store: Store, changes: DataFrame, commit: str, scope: str, applications: list[str]) -> None:
    """changes: seq, relative_file, content (null: the file is gone). Of several changes to a file the last holds."""
    with store.locked():
        _apply(store, changes, commit, scope, applications)


def _apply(store: Store, changes: DataFrame, commit: str, scope: str, applications: list[str]) -> None:
    last = written(last_write_wins(changes.select("seq", "relative_file", "content"), ["relative_file"], ["seq"]), "changes")
    wants_sites = "selection-context" in applications
    files = last.filter("content is not null").select("relative_file", "content", F.lit(True).alias("changed"), (F.lit(wants_sites) & F.col("relative_file").endswith(".kt")).alias("sites"))
    facts = written(extract(files), "facts")
    symbols = delete_keys(store.table("symbols"), last, ["relative_file"])
    sites = store.table("sites")
    if wants_sites:
        sites = delete_keys(sites, last.select(F.col("relative_file").alias("file")), ["file"]).unionByName(sites_of(facts, commit))
    fresh = files.select(F.col("relative_file").alias("relative_path"), content_hash(F.col("content")).alias("content_hash"))
    hashes = written(delete_keys(store.table("file_hashes"), last.select(F.col("relative_file").alias("relative_path")), ["relative_path"]).unionByName(fresh), "hashes")
    tables = {
        "symbols": symbols.unionByName(symbols_of(facts)),
        "refs": delete_keys(store.table("refs"), last, ["relative_file"]).unionByName(resolve_references(facts, symbols)),
        "sites": sites,
        "file_hashes": hashes,
    }
    now = datetime.now(UTC).isoformat().replace("+00:00", "Z")
    store.commit(tables, Manifest(commit, INDEXER_VERSION, scope, "stream", False, hashes.count(), combined_hash(hashes), now, applications))


def follow(spark: SparkSession, source: str, workspace: str | Path, commit: str, checkpoint: str, scope: str = ":", applications: tuple[str, ...] = (), **trigger):
    """Starts a query that reads Parquet files of changes as they arrive in `source`. A batch that ran twice gives the same index."""
    store = Store(spark, workspace, commit)
    stream = spark.readStream.schema(CHANGES).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda rows, _: apply_changes(store, rows, commit, scope, list(applications)))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
