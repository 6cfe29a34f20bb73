"""Progress as JSON lines, version 1 of the protocol."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

VERSION, EVERY = 1, 25
_NONE = object()


def _line(**fields) -> str:
    return json.dumps({"version": VERSION} | {k: v for k, v in fields.items() if v is not _NONE}, separators=(",", ":"), ensure_ascii=False)


def workspace_path(path: str) -> str:
    clean = posixpath.normpath(path.replace("\\", "/"))
    if clean.startswith(("/", "..")) or re.match("[A-Za-z]:", clean):
        raise ValueError(f"not a path within the workspace: {path}")
    return clean


def told(number, total: int):
    """Whether a file's number is one that progress tells of: the first, each EVERY-th, the last. For numbers and for columns."""
    return (number == 1) | (number == total) | (number % EVERY == 0)


class BuildProgress:
    """JSON lines."""

    wants_files = True

    def __init__(self, emit: Callable[[str], None]):
        self.emit, self.counters, self.done = emit, {}, False

    def _event(self, event: str, phase=_NONE, completed=_NONE, total=_NONE, file=_NONE, **rest) -> None:
        self.emit(_line(event=event, phase=phase, phaseCompleted=completed, phaseTotal=total, currentFile=file, **self.counters, **rest))

    def discovery_started(self) -> None:
        self._event("discovery_started", "discovery", total=None)

    def discovery_completed(self, files: int) -> None:
        self._event("discovery_completed", "discovery", files, files)

    def phase_started(self, phase: str, total: int | None, name: str = "") -> None:
        self._event("phase_started", phase, 0, total)

    def file(self, phase: str, completed: int, total: int, path: str) -> None:
        if 1 <= completed <= total and told(completed, total):
            self._event("progress", phase, completed, total, workspace_path(path))

    def phase_completed(self, phase: str, total: int | None) -> None:
        self._event("phase_completed", phase, total, total)

    def changes(self, changed: int, unchanged: int, removed: int) -> None:
        """Counters never go back: a report with a smaller one is left out."""
        now = {"changedFiles": changed, "unchangedFiles": unchanged, "removedFiles": removed}
        if all(now[k] >= v for k, v in self.counters.items()):
            self.counters = now
            self._event("changes_detected", "source-change-detection")

    def completed(self, outcome: str) -> None:
        if not self.done:
            self.done = True
            self._event("completed", outcome=outcome)

    def failed(self, code: int, message: str) -> None:
        if not self.done:
            self.done = True
            self._event("failed", exitCode=code, message=message)


class NoProgress(BuildProgress):
    wants_files = False

    def __init__(self):
        super().__init__(lambda _: None)


class TextProgress(BuildProgress):
    """The same for people: a line for each phase, file told of, and outcome."""

    def _event(self, event: str, *_, **__) -> None:
        pass

    def phase_started(self, phase: str, total: int | None, name: str = "") -> None:
        self.emit(name or phase)

    def file(self, phase: str, completed: int, total: int, path: str) -> None:
        if 1 <= completed <= total and told(completed, total):
            self.emit(f"[{completed}/{total}] {workspace_path(path)}")

    def completed(self, outcome: str) -> None:
        if not self.done and outcome == "fresh":
            self.emit("index is fresh, nothing to do")
        self.done = True


class LookupProgress:
    def __init__(self, emit: Callable[[str], None], command: str):
        self.emit, self.command = emit, command

    def _event(self, event: str, **rest) -> None:
        self.emit(_line(event=event, command=self.command, **rest))

    def started(self, query: dict) -> None:
        self._event("lookup_started", query={k: v for k, v in query.items() if v is not None})

    def match(self, count: int, record: dict) -> None:
        self._event("lookup_match", emittedMatchCount=count, record=record)

    def completed(self, total: int, millis: int) -> None:
        self._event("lookup_completed", totalMatchCount=total, durationMillis=millis)

    def failed(self, reason: str, message: str, millis: int) -> None:
        self._event("lookup_failed", failureReason=reason, message=message, durationMillis=millis)
