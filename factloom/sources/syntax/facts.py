"""The rows that the readers give, before references are resolved across files.

A reference that other files decide holds `choices`, the first of which that applies is its target: `member` needs a symbol of
that owner and name, `known` a symbol of that id, `always` nothing.
"""

from __future__ import annotations

SCHEMA = (
    "what string, relative_file string, seq int, language string, ns string, fqn string, line int, column int, kind string, name string, owner_fqn string, signature string, arity int, aliases array<string>, "
    "context string, qualifier string, candidates array<string>, choices array<struct<rank: int, rule: string, fqn: string, owner: string, name: string, candidates: array<string>>>, "
    "callee string, containers array<struct<file: string, line: int, function: string>>, excluded boolean, disable struct<file: string, line: int, function: string>, confidence string"
)
COLUMNS = [c.strip().split(" ")[0] for c in ("what, relative_file, seq, language, ns, fqn, line, column, kind, name, owner_fqn, signature, arity, aliases, context, qualifier, candidates, choices, callee, containers, excluded, disable, confidence").split(",")]


class Facts:
    def __init__(self, file: str, language: str):
        self.file, self.language = file, language
        self.rows: list[dict] = []

    def _row(self, what: str, at: tuple[int, int], **more) -> None:
        self.rows.append(dict.fromkeys(COLUMNS) | {"what": what, "relative_file": self.file, "seq": len(self.rows), "language": self.language, "line": at[0], "column": at[1]} | more)

    def symbol(self, at, fqn, name, kind, owner=None, signature=None, arity=None, aliases=(), ns="sym") -> None:
        self._row("symbol", at, fqn=fqn, name=name, kind=kind, owner_fqn=owner, signature=signature, arity=arity, aliases=list(aliases), ns=ns)

    def reference(self, at, fqn, name, context, qualifier=None, candidates=None, arity=None) -> None:
        self._row("ref", at, fqn=fqn, name=name, context=context, qualifier=qualifier, candidates=candidates or [fqn], arity=arity)

    def open_reference(self, at, name, choices, arity=None) -> None:
        """choices: dicts with rule, and fqn and candidates, or owner and name."""
        filled = [{"rank": k, "rule": None, "fqn": None, "owner": None, "name": None, "candidates": None} | c for k, c in enumerate(choices)]
        self._row("open", at, name=name, context="call", choices=filled, arity=arity)

    def site(self, at, callee, containers, excluded, disable, confidence) -> None:
        self._row("site", at, callee=callee, containers=containers, excluded=excluded, disable=disable, confidence=confidence)


def unique(values) -> list:
    return list(dict.fromkeys(values))


def upper_first(name: str) -> str:
    return name[:1].upper() + name[1:]


def boolean_style(name: str) -> bool:
    return name.startswith("is") and len(name) > 2 and name[2].isupper()
