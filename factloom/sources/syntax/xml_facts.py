"""Resource definitions and references of an XML file."""

from __future__ import annotations

import re
from xml.parsers import expat

from factloom.functions.text import RESOURCE_PATH, RESOURCE_REFERENCE
from factloom.sources.syntax.facts import Facts

_PATH, _REFERENCE = re.compile(RESOURCE_PATH), re.compile(RESOURCE_REFERENCE)


def xml_facts(path: str, text: str, out: Facts) -> None:
    """Malformed text is an error that names the file, and so is any use of entities that a document type declares."""
    raw = text.encode("utf-8")
    found = _PATH.search(path)
    folder, base = (found.group(1).split("-", 1)[0], found.group(2)) if found else (None, None)
    if folder and folder != "values":
        _resource(out, 1, folder, base)
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True
    depth = 0
    held: list[str] = []

    def place(end: int) -> tuple[int, int]:
        head = raw[:end]
        return head.count(b"\n") + 1, len(head[head.rfind(b"\n") + 1 :].decode("utf-8", "replace")) + 1

    def refer(value: str, line: int, column: int) -> None:
        for m in _REFERENCE.finditer(value):
            plus, package, kind, name = m.groups()
            if plus and not package and kind == "id":
                _resource(out, line, kind, name)
            else:
                target = ":".join(x for x in ("res", package, kind, name) if x)
                out.reference((line, column), target, name, "resource", ":".join(x for x in (package, kind) if x))

    def flush() -> None:
        if held:
            refer("".join(held), *place(parser.CurrentByteIndex))
            held.clear()

    def start(tag: str, attributes: list[str]) -> None:
        nonlocal depth
        flush()
        depth += 1
        # positions are those behind the start tag
        line, column = place(_tag_end(raw, parser.CurrentByteIndex))
        pairs = list(zip(attributes[::2], attributes[1::2], strict=True))
        named = dict(pairs)
        if folder == "values" and depth == 2 and named.get("name", "").strip():
            local = tag.rpartition(":")[2]
            kind = named.get("type") if local == "item" else local
            kind = "array" if kind in ("string-array", "integer-array") else kind
            if kind and kind.strip():
                _resource(out, line, kind, named["name"])
        values = [v for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")]
        for i, value in enumerate(values):
            refer(value, line, column + i)

    def end(_: str) -> None:
        nonlocal depth
        flush()
        depth -= 1

    def refuse(*_) -> None:
        raise ValueError("entities of a document type are not supported")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = flush
    parser.EntityDeclHandler = parser.ExternalEntityRefHandler = parser.SkippedEntityHandler = refuse
    try:
        parser.Parse(raw, True)
    except (expat.ExpatError, ValueError) as e:
        raise ValueError(f"{path}: {e}") from e


def _tag_end(raw: bytes, at: int) -> int:
    quote = 0
    while at < len(raw):
        c = raw[at]
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == ord(">"):
            return at + 1
        at += 1
    return at


def _resource(out: Facts, line: int, kind: str, name: str) -> None:
    out.symbol((line, None), f"res:{kind}:{name}", name, "resource", f"res:{kind}", None, None, [f"@{kind}/{name}"], ns="res")
