"""The fact store: versioned Parquet tables, and a manifest, written last, that names the version in force."""

from __future__ import annotations

import contextlib
import json
import os
import socket
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from factloom.operators.relational import overlay
from factloom.plans.extract import HASHES, REFS, SITES, SYMBOLS
from factloom.sources.files import Files

TABLES = {"symbols": (SYMBOLS, ["_key"]), "refs": (REFS, ["_key"]), "sites": (SITES, ["_key"]), "file_hashes": (HASHES, ["relative_path"])}
FOLDER = ".factloom"
#: Fixed value: how long a writer waits for the lock.
LOCK_MILLIS = 30_000


@dataclass
class Manifest:
    commit: str
    indexer_version: str
    scope: str
    topology: str
    include_deps: bool
    source_file_count: int
    sources_content_hash: str
    built_at: str
    applications: list[str]
    version: str = field(default="")

    def is_fresh(self, commit: str, indexer_version: str, scope: str, sources_content_hash: str, applications: list[str]) -> bool:
        mine = (self.commit, self.indexer_version, self.scope, self.sources_content_hash, sorted(self.applications))
        return mine == (commit, indexer_version, scope, sources_content_hash, sorted(applications))

    def to_json(self) -> str:
        def camel(name: str) -> str:
            first, *rest = name.split("_")
            return first + "".join(x.capitalize() for x in rest)

        return json.dumps({camel(k): v for k, v in asdict(self).items()}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        def snake(name: str) -> str:
            return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)

        known = {snake(k): v for k, v in json.loads(text).items()}
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})


class StoreLocked(RuntimeError):
    pass


class Store:
    """`<workspace>/.factloom/index/<commit>/`: a folder for each version and `manifest.json`. Sessions lie beside the indexes.

    workspace: a path, or a URI of any file system that Spark knows. Of several that write one index, one holds its lock at a
    time; the others wait for LOCK_MILLIS and give up then. Readers need no lock: a version is never changed.
    """

    def __init__(self, spark: SparkSession, workspace: str | Path, commit: str, read_only: bool = False, lock_millis: int = LOCK_MILLIS):
        self.spark, self.read_only, self.lock_millis = spark, read_only, lock_millis
        self.files = Files(spark)
        self.base = f"{str(workspace).rstrip('/')}/{FOLDER}"
        self.folder = f"{self.base}/index/{commit}"
        self.manifest_path = f"{self.folder}/manifest.json"
        self.lock_path = f"{self.folder}/lock"
        self._held = False

    def manifest(self) -> Manifest | None:
        text = self.files.read(self.manifest_path)
        return None if text is None else Manifest.from_json(text)

    def _read(self, folder: str, name: str) -> DataFrame:
        schema = StructType.fromDDL(TABLES[name][0])
        path = f"{folder}/{name}"
        if not self.files.is_folder(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _delta(self, session: str) -> str:
        return f"{self.base}/sessions/{session}/delta"

    def table(self, name: str, session: str | None = None) -> DataFrame:
        """A table of the version in force; with a session, what that one has written goes before it."""
        held = self.manifest()
        out = self._read(f"{self.folder}/{held.version if held else 'none'}", name)
        if session and session.strip():
            out = overlay(out, self._read(self._delta(session), name), TABLES[name][1])
        return out

    def get(self, name: str, key: str, session: str | None = None) -> Row | None:
        """The row of that key, or None."""
        return self.table(name, session).filter(F.col(TABLES[name][1][0]) == key).first()

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")

    @contextlib.contextmanager
    def locked(self) -> Iterator[None]:
        """Holds the index's lock. One that a build left behind when it was killed has to be removed by hand: its name is told."""
        self._writable()
        if self._held:  # by an outer block of this store
            yield
            return
        until = time.monotonic() + self.lock_millis / 1000
        while not self.files.create(self.lock_path, f"{os.getpid()}@{socket.gethostname()} {datetime.now(UTC).isoformat()}"):
            if time.monotonic() >= until:
                raise StoreLocked(f"{self.lock_path} is held by {self.files.read(self.lock_path)}")
            time.sleep(min(0.2, self.lock_millis / 1000))
        self._held = True
        try:
            yield
        finally:
            self._held = False
            self.files.delete(self.lock_path)

    def write_session(self, session: str, tables: dict[str, DataFrame]) -> None:
        self._writable()
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self._delta(session)}/{name}")

    def fork_session(self, source: str, target: str) -> None:
        self._writable()
        for name in TABLES:
            if self.files.is_folder(f"{self._delta(source)}/{name}"):
                self.write_session(target, {name: self._read(self._delta(source), name)})

    def commit(self, tables: dict[str, DataFrame], manifest: Manifest) -> None:
        """Facts, then hashes, then the manifest: what breaks off leaves the version before in force. Readers of that one keep it."""
        with self.locked():
            version = f"v-{uuid.uuid4().hex}"
            for name in ("symbols", "refs", "sites", "file_hashes"):
                tables[name].write.parquet(f"{self.folder}/{version}/{name}")
            manifest.version = version
            self.files.replace(self.manifest_path, manifest.to_json())
