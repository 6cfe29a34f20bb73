"""Symbols, references and selection sites of a Kotlin file."""

from __future__ import annotations

from dataclasses import dataclass

from factloom.sources.syntax.facts import Facts, boolean_style, unique, upper_first
from factloom.sources.syntax.kotlin import read
from factloom.sources.syntax.tree import Lines, Node

#: Names that the selection analysis goes by, and the wrapper rules (callee, argument, value).
CONTAINERS, DISABLERS, COMPOSABLE = frozenset(("SelectionContainer",)), frozenset(("DisableSelection",)), "Composable"
_TYPES = ("class", "object")


def bare_type(text: str) -> str:
    return text.split("<", 1)[0].removesuffix("?").strip()


_SPACES = {"property": "value", "fun": "function", "class": "type", "object": "type"}


@dataclass(frozen=True)
class Binding:
    """A name's meaning in a scope. rank orders those of one scope; since: seen only by uses behind it."""

    scope: Node
    node: Node
    space: str
    how: str  # declared or parameter
    rank: int
    since: int
    initial: bool  # a constructor parameter that is no property: unseen from member functions


class KotlinFile:
    """A file's tree with what its names mean."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.tree, self.lines = read(text), Lines(text)
        self.package = self.tree.slots["package"]
        self.imports = {alias or p.rpartition(".")[2]: p for p, alias in self.tree.slots["imports"] if not p.endswith(".*")}
        self.table: dict[tuple[str, str], list[Binding]] | None = None

    def at(self, offset: int) -> tuple[int, int]:
        return self.lines.at(offset)

    def source(self, node: Node) -> str:
        return self.text[node.start : node.end].strip()

    def qualify(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name

    def facade(self) -> str:
        base = self.path.replace("\\", "/").rpartition("/")[2]
        return self.qualify(self.tree.slots["jvm_name"] or (base.rpartition(".")[0] or base) + "Kt")

    @staticmethod
    def owner(node: Node) -> Node | None:
        return next((x for x in node.up() if x.kind in _TYPES), None)

    def fqn(self, node: Node) -> str:
        chain = [node, *(x for x in node.up() if x.kind in _TYPES)]
        return self.qualify(".".join(x.name or f"<anonymous@{x.start}>" for x in reversed(chain)))

    def owner_fqn(self, node: Node) -> str | None:
        owner = self.owner(node)
        return self.fqn(owner) if owner else None

    def bindings(self) -> dict[tuple[str, str], list[Binding]]:
        """All that the file binds, by space and name: one table, made in one pass."""
        if self.table is None:
            self.table = {}
            for node in self.tree.walk():
                space = _SPACES.get(node.kind)
                if space and node.name and node.parent is not None and node.parent.kind in ("block", "class", "object", "file"):
                    inner = node.parent.kind == "block"
                    at = node.slots.get("offset", node.start)
                    # of a block the last one before the use counts, elsewhere the first
                    self._bind(Binding(node.parent, node, space, "declared", -at if inner else at, at if inner else -1, False))
                for k, p in enumerate(node.slots.get("params", ()) if node.kind != "constructor" else ()):
                    self._bind(Binding(node, p, "value", "parameter", k, -1, node.kind == "class" and not p.slots["keyword"]))
        return self.table

    def _bind(self, binding: Binding) -> None:
        self.table.setdefault((binding.space, binding.node.name), []).append(binding)

    def seen(self, use: Node, space: str, name: str, within: tuple[str, ...] | None = None) -> list[Binding]:
        """What name may mean at use, the likeliest first: of each scope around it one declaration, then one parameter."""
        depth, members = {}, []
        for k, scope in enumerate(use.up()):
            depth[id(scope)] = k
            if scope.kind == "fun" and scope.slots.get("member"):
                members.append(k)
        held: dict[tuple[int, str], Binding] = {}
        for b in self.bindings().get((space, name), ()):
            k = depth.get(id(b.scope))
            if k is None or b.since >= use.start or (within and b.scope.kind not in within) or (b.initial and any(m < k for m in members)):
                continue
            if (k, b.how) not in held or b.rank < held[k, b.how].rank:
                held[k, b.how] = b
        return [held[key] for key in sorted(held)]

    def value_type(self, use: Node, name: str) -> str | None:
        return next((t for b in self.seen(use, "value", name) if (t := b.node.slots["type"]) is not None), None)

    def type_id(self, use: Node, name: str) -> str | None:
        found = self.seen(use, "type", name)
        choices = (self.fqn(found[0].node) if found else None, self.imports.get(name), self.qualify(name) if name[:1].isupper() else None)
        return next((c for c in choices if c is not None), None)

    def qualify_type(self, text: str, use: Node) -> str:
        kind = bare_type(text)
        if kind in self.imports or "." in kind:
            return self.imports.get(kind, kind)
        nested = self.seen(use, "type", kind, _TYPES)
        return self.fqn(nested[0].node) if nested else self.qualify(kind)

    def super_fqn(self, use: Node) -> str | None:
        owner = self.owner(use)
        supers = owner.slots["supers"] if owner else ()
        best = min(enumerate(supers), key=lambda s: (not s[1][1], s[0]), default=None)
        return self.qualify_type(best[1][0], use) if best else None

    def receiver_type(self, use: Node, receiver: Node, called: bool) -> str | None:
        """Whose member a use asks for: the first way open to this form of receiver that leads to a type."""
        ways = (_CALLED if called else _READ).get(self._form(receiver), ("spelled",) if called else ())
        return next((t for way in ways if (t := _WAYS[way](self, use, receiver)) is not None), None)

    def _form(self, receiver: Node) -> str:
        if receiver.kind != "qualified" or self.text[receiver.slots["receiver"].end :].lstrip()[:1] != ".":
            return receiver.kind
        first, last = receiver.slots["receiver"], receiver.slots.get("selector")
        if first.kind == "this":
            return "field" if last is not None and last.kind == "name" else "dotted"
        return "dotted super" if first.kind == "super" else "dotted"

    def _typed(self, use: Node, text: str | None) -> str | None:
        return self.qualify_type(text, use) if text else None

    def _returned(self, use: Node, call: Node) -> str | None:
        """By the nearest function of that name, which may leave its type open; else the name is a type's."""
        if not call.name:
            return None
        found = self.seen(call, "function", call.name)
        return self._typed(use, found[0].node.slots["type"] if found else self.type_id(call, call.name))

    def _field(self, use: Node, access: Node) -> str | None:
        name = access.slots["selector"]
        owner = self.owner(name)
        own = [b for b in self.bindings().get(("value", name.name), ()) if b.scope is owner and not b.initial]
        best = min(own, key=lambda b: (b.how == "declared", b.rank), default=None)
        return self._typed(use, best.node.slots["type"]) if best else None


_WAYS = {
    "own": lambda f, use, receiver: f.owner_fqn(use),
    "above": lambda f, use, receiver: f.super_fqn(use),
    "named above": lambda f, use, receiver: f._typed(use, receiver.slots["qualifier"]),
    "value": lambda f, use, receiver: f._typed(use, f.value_type(receiver, receiver.name)),
    "type": lambda f, use, receiver: f.type_id(use, receiver.name),
    "returned": KotlinFile._returned,
    "field": KotlinFile._field,
    "spelled": lambda f, use, receiver: f.qualify_type(f.source(receiver), use),
}
#: By the form of a receiver, the ways to its type in their order: of calls (all other forms count as spelled), and of other members.
_CALLED = {"this": ("own",), "super": ("named above", "above"), "name": ("value", "type"), "call": ("returned",), "field": ("field",), "dotted super": ()}
_READ = {"this": ("own",), "super": ("above",), "name": ("value", "type")}


def _jvm_name(function: Node) -> str | None:
    return next((v for n, v in function.slots["annotations"] if n == "JvmName" and v), None)


def _accessors(owner: str, name: str, var: bool, declared: str | None) -> list[str]:
    boolean = boolean_style(name) and (declared is None or declared.removesuffix("?") in ("Boolean", "kotlin.Boolean"))
    out = [f"{owner}#{name}" if boolean else f"{owner}#get{upper_first(name)}"]
    return out + ([f"{owner}#set{name[2:] if boolean else upper_first(name)}"] if var else [])


def kotlin_symbols(f: KotlinFile, out: Facts) -> None:
    nodes = list(f.tree.walk())
    for n in nodes:
        if n.kind == "class" and n.name:
            out.symbol(f.at(n.start), f.fqn(n), n.name, "interface" if n.slots["interface"] else "class", f.owner_fqn(n))
    for n in nodes:
        if n.kind == "fun" and n.name and (n.parent.kind == "file" or n.slots.get("member")):
            owner = f.owner_fqn(n)
            types = ", ".join(p.slots["type"] or "" for p in n.slots["params"])
            alias = [] if owner else [f"{f.facade()}#{_jvm_name(n) or n.name}"]
            out.symbol(f.at(n.start), f"{owner}#{n.name}" if owner else f.qualify(n.name), n.name, "function", owner, f"({types})", len(n.slots["params"]), alias)
    for n in nodes:
        if n.kind == "property" and n.name and (n.parent.kind == "file" or n.slots.get("member")):
            owner = f.owner_fqn(n)
            out.symbol(f.at(n.start), f"{owner}#{n.name}" if owner else f.qualify(n.name), n.name, "property", owner, n.slots["type"], None, _accessors(owner or f.facade(), n.name, n.slots["var"], n.slots["type"]))
    for n in nodes:
        if n.kind == "class":
            for p in n.slots["params"]:
                if p.slots["keyword"]:
                    owner = f.fqn(n)
                    out.symbol(f.at(p.start), f"{owner}#{p.name}", p.name, "property", owner, p.slots["type"], None, _accessors(owner, p.name, p.slots["keyword"] == "var", p.slots["type"]))


def kotlin_references(f: KotlinFile, out: Facts) -> None:
    nodes = list(f.tree.walk())
    for n in nodes:
        if n.kind != "call" or n.name is None:
            continue
        name, at, arity = n.name, f.at(n.start), n.slots["count"]
        outer = n.parent
        if outer is not None and outer.kind == "qualified" and outer.slots.get("selector") is n:
            receiver = outer.slots["receiver"]
            if owner := f.receiver_type(n, receiver, True):
                out.reference(at, f"{owner}#{name}", name, "call", f.source(receiver), arity=arity)
            continue
        choices, owner, above = [], f.owner_fqn(n), f.super_fqn(n)
        if owner:
            choices.append({"rule": "member", "owner": owner, "name": name})
        for known in (f"{above}#{name}" if above else None, f.qualify(name)):
            if known:
                choices.append({"rule": "known", "fqn": known, "candidates": [known]})
        if imported := f.imports.get(name):
            package, _, last = imported.rpartition(".")
            choices.append({"rule": "always", "fqn": imported, "candidates": [imported, f"{package or imported}#{last}"]})
        out.open_reference(at, name, choices, arity)
    for n in nodes:
        selector = n.slots.get("selector") if n.kind == "qualified" else None
        if selector is None or selector.kind != "name":
            continue
        receiver, name, write = n.slots["receiver"], selector.name, bool(n.slots.get("write"))
        if owner := f.receiver_type(n, receiver, False):
            boolean = boolean_style(name)
            names = [name, f"get{upper_first(name)}", name if boolean else f"is{upper_first(name)}"]
            names += [f"set{name[2:] if boolean else upper_first(name)}"] if write else []
            out.reference(f.at(selector.start), f"{owner}#{name}", name, "member-write" if write else "member", f.source(receiver), unique(f"{owner}#{x}" for x in names))


def _marked(node: Node, annotation: str) -> bool:
    return node.kind == "fun" and any(n == annotation for n, _ in node.slots["annotations"])


def _wraps(call: Node, rules) -> bool:
    rule = next((r for r in rules if r[0] == call.name), None)
    return rule is not None and (rule[1], rule[2]) in call.slots["args"]


def _with_aliases(f: KotlinFile, names: frozenset[str]) -> frozenset[str]:
    return names | {a for p, a in f.tree.slots["imports"] if a and p.rpartition(".")[2] in names}


def call_at_line(f: KotlinFile, line: int) -> Node:
    """The first call on a line that is no container, else the first call."""
    calls = [n for n in f.tree.walk() if n.kind == "call" and n.name and f.at(n.start)[0] == line]
    known = _with_aliases(f, CONTAINERS) | _with_aliases(f, DISABLERS)
    found = [n for n in calls if n.name not in known] or calls
    if not found:
        raise ValueError(f"no call at {f.path}:{line}")
    return found[0]


def kotlin_sites(f: KotlinFile, out: Facts, rules=(), containers=CONTAINERS, disablers=DISABLERS, annotation: str = COMPOSABLE) -> None:
    """Calls within functions that bear the annotation, with the containers around them, innermost first."""
    containers, disablers = _with_aliases(f, containers), _with_aliases(f, disablers)
    local: dict[int, set[str]] = {}
    for call in (n for n in f.tree.walk() if n.kind == "call" and n.name):
        enclosing = next((x for x in call.up() if _marked(x, annotation)), None)
        if enclosing is None or call.name in containers or call.name in disablers:
            continue
        if id(enclosing) not in local:
            local[id(enclosing)] = {x.name for x in enclosing.walk() if x.kind == "fun" and x is not enclosing and x.name and not _marked(x, annotation)}
        if call.name in local[id(enclosing)]:
            continue
        found, disable, by_lambda = [], None, False
        for node in call.up():
            if node is enclosing:
                break
            around = node.parent
            if node.kind == "lambda" and node.slots.get("trailing") and around.kind == "call" and _wraps(around, rules):
                by_lambda = True
                found.append(around)
            elif node.kind == "call" and node.name in disablers:
                if not found and disable is None:
                    disable = node
            elif node.kind == "call" and (node.name in containers or _wraps(node, rules)):
                found.append(node)

        def told(node: Node) -> dict:
            return {"file": f.path, "line": f.at(node.start)[0], "function": enclosing.name or "<anonymous>"}

        out.site(f.at(call.start), call.name, [told(x) for x in found], disable is not None, told(disable) if disable else None, "caller-chain" if by_lambda and found else "lexical")
