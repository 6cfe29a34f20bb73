"""Symbols and references of a Java file."""

from __future__ import annotations

from factloom.sources.syntax.facts import Facts, unique
from factloom.sources.syntax.java import read
from factloom.sources.syntax.tree import Lines, Node

_SCOPES = ("block", "try", "for", "lambda", "catch", "method", "class")


def bean_property(name: str) -> str | None:
    for prefix in ("get", "set", "is"):
        if name.startswith(prefix) and len(name) > len(prefix):
            stem = name[len(prefix) :]
            return stem[:1].lower() + stem[1:]
    return None


class JavaFile:
    """Walks a file in order. `seen` holds, for each scope entered and not left, the variables met so far and their types."""

    def __init__(self, path: str, text: str, out: Facts):
        self.text, self.lines, self.out = text, Lines(text), out
        self.tree = read(text)
        self.package = self.tree.slots["package"]
        self.imports: dict[str, str] = {}
        self.statics: dict[str, str] = {}
        self.wildcards: list[str] = []
        self.classes: list[tuple[str, Node]] = []
        self.seen: list[dict[str, str]] = []

    def at(self, node: Node) -> tuple[int, int]:
        line, column = self.lines.at(node.start)
        return line, column

    def qualify(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name

    def owner(self) -> str | None:
        return self.classes[-1][0] if self.classes else None

    def run(self) -> None:
        self.visit(self.tree)

    def visit(self, node: Node) -> None:
        enter = getattr(self, f"enter_{node.kind}", None)
        scope = node.kind in _SCOPES
        if scope and node.kind != "class":
            self.seen.append({})
        if enter:
            enter(node)
        for kid in node.kids:
            self.visit(kid)
        if scope:
            self.seen.pop()
        if node.kind == "class":
            self.classes.pop()

    def enter_import(self, node: Node) -> None:
        package, _, last = node.name.rpartition(".")
        static, wild = node.slots["static"], last == "*"
        if static and wild:
            self.wildcards.append(package)
        elif static:
            self.statics[last] = package
        elif not wild:
            self.imports[last] = node.name
        self.out.reference(self.at(node), f"{package}#{last}" if static and not wild else node.name, last, "import")

    def enter_class(self, node: Node) -> None:
        above, (line, column) = self.owner(), self.at(node)
        name = node.name or f"<anonymous@{line}:{column}>"
        fqn = f"{above}.{name}" if above else self.qualify(name)
        if node.name:
            self.out.symbol((line, column), fqn, name, node.slots["type"], above)
        self.classes.append((fqn, node))
        self.seen.append({k.name: k.slots["declared"] for k in node.kids if k.kind == "field" and k.slots["declared"]})

    def enter_method(self, node: Node) -> None:
        owner = self.owner()
        if owner is None:
            return
        params, made = node.slots["params"], node.name == "<init>"
        types = ", ".join(p.slots["declared"] or "" for p in params)
        name = owner.rpartition(".")[2] if made else node.name
        self.out.symbol(self.at(node), f"{owner}#{node.name}", name, "constructor" if made else "method", owner, f"({types})", len(params))

    def enter_param(self, node: Node) -> None:
        if node.slots["declared"] and self.seen:
            self.seen[-1][node.name] = node.slots["declared"]

    def enter_local(self, node: Node) -> None:
        kind, value = node.slots["declared"], node.slots.get("value")
        if kind == "var":
            kind = value.slots["type"] if value is not None and value.kind == "new" else None
        if kind and self.seen:
            self.seen[-1][node.name] = kind

    def enter_field(self, node: Node) -> None:
        self.enter_local(node)
        if self.owner():
            self.out.symbol(self.at(node), f"{self.owner()}#{node.name}", node.name, "field", self.owner())

    def above(self) -> str | None:
        kind = self.classes[-1][1].slots["extends"] if self.classes else None
        return self.qualify_type(kind) if kind else None

    def qualify_type(self, text: str) -> str:
        kind = text.split("<", 1)[0].removesuffix("[]").strip()
        if kind in self.imports or "." in kind:
            return self.imports.get(kind, kind)
        for fqn, node in reversed(self.classes):
            if any(k.kind == "class" and k.name == kind for k in node.kids):
                return f"{fqn}.{kind}"
        return self.qualify(kind)

    def candidates(self, owners: list[str], name: str) -> list[str]:
        other = bean_property(name)
        return unique(f"{o}#{x}" for o in owners for x in (name, other) if x)

    def receiver(self, node: Node) -> str | None:
        if node.kind == "name":
            if node.name == "this":
                return self.owner()
            if node.name == "super":
                return self.above()
            held = next((s[node.name] for s in reversed(self.seen) if node.name in s), node.name)
            return self.qualify_type(held)
        if node.kind == "new":
            return self.qualify_type(node.slots["type"])
        if node.kind == "select":
            base = node.slots["receiver"]
            if base.kind == "name" and base.name == "super":
                return None
            if base.kind == "name" and base.name == "this":
                fields = {k.name: k.slots["declared"] for k in self.classes[-1][1].kids if k.kind == "field" and k.slots["declared"]} if self.classes else {}
                return self.qualify_type(fields[node.name]) if node.name in fields else None
            return self.qualify_type(self.text[node.start : node.end])
        return None

    def enter_call(self, node: Node) -> None:
        select, at, count = node.slots["select"], self.at(node), node.slots["count"]
        if select.kind == "select":
            owner = self.receiver(select.slots["receiver"])
            if owner:
                shown = select.slots["receiver"]
                self.out.reference(at, f"{owner}#{select.name}", select.name, "call", self.text[shown.start : shown.end], self.candidates([owner], select.name), count)
            return
        if select.kind != "name" or not self.classes:
            return
        name, owner, above = select.name, self.owner(), self.above()
        local = next((f for f, c in reversed(self.classes) if any(k.kind == "method" and k.name == name for k in c.kids)), None)
        if target := local or self.statics.get(name):
            self.out.reference(at, f"{target}#{name}", name, "call", None, self.candidates([target], name), count)
        elif self.wildcards:
            self.out.reference(at, f"{self.wildcards[0]}#{name}", name, "call", None, self.candidates(self.wildcards, name), count)
        else:
            own = {"rule": "always", "fqn": f"{owner}#{name}", "candidates": self.candidates([owner, *([above] if above else [])], name)}
            inherited = [{"rule": "known", "fqn": f"{above}#{name}", "candidates": self.candidates([above], name)}] if above else []
            self.out.open_reference(at, name, [*inherited, own], count)


def java_facts(path: str, text: str, out: Facts) -> None:
    JavaFile(path, text, out).run()
