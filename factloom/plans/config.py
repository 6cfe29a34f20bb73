"""What the selection analysis goes by, as values and from configuration files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from factloom.sources.syntax.kotlin_facts import COMPOSABLE, CONTAINERS, DISABLERS

#: What counts as a wrapper around selectable content (callee, argument, value), and the callees of the preset for interactive elements.
WRAPPERS = (("Markdown", "selectable", "true"),)
INTERACTIVE = ("ActionButton", "IconButton", "TextButton", "OutlinedButton", "FloatingActionButton", "IconToggleButton", "Checkbox", "Switch", "RadioButton", "Slider")


@dataclass(frozen=True)
class SelectionRules:
    """Names of containers and of what switches them off, the annotation of functions that are looked into, and wrappers."""

    containers: frozenset[str] = CONTAINERS
    disablers: frozenset[str] = DISABLERS
    annotation: str = COMPOSABLE
    wrappers: tuple[tuple[str, str, str], ...] = WRAPPERS


def wrapper_rules(path: str | Path | None) -> tuple[tuple[str, str, str], ...]:
    """The rules of a JSON file; without a name the built-in ones. A file that isn't there means no rules."""
    if path is None:
        return WRAPPERS
    if not Path(path).is_file():
        return ()
    return tuple((r["callee"], r["providesSelectionWhenNamedArgument"], r["providesSelectionWhenValue"]) for r in json.loads(Path(path).read_text()))


def interactive_callees(path: str | Path | None) -> tuple[str, ...]:
    """The callees of a JSON file; without a name the built-in ones. A file that isn't there is an error."""
    if path is None:
        return INTERACTIVE
    if not Path(path).is_file():
        raise ValueError(f"missing preset configuration: {path}")
    return tuple(json.loads(Path(path).read_text())["callees"])
