"""Tokens and trees that the Kotlin and Java readers share."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator


class SyntaxProblem(Exception):
    def __init__(self, offset: int, message: str):
        super().__init__(message)
        self.offset = offset


class Node:
    """A piece of a file. `slots` holds what its kind needs: types, flags, parts."""

    __slots__ = ("kind", "start", "end", "name", "kids", "parent", "slots")

    def __init__(self, kind: str, start: int, name: str | None = None, **slots):
        self.kind, self.start, self.end, self.name = kind, start, start, name
        self.kids: list[Node] = []
        self.parent: Node | None = None
        self.slots = slots

    def add(self, kid: Node | None) -> Node | None:
        if kid is not None:
            kid.parent = self
            self.kids.append(kid)
        return kid

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.kids))


class Lines:
    """1-based lines and columns of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1


class Tokens:
    """A cursor over (kind, text, offset, newline before). Kinds: id, num, str, op, end."""

    def __init__(self, text: str, pattern: re.Pattern, offset: int = 0, end: int | None = None):
        self.text = text
        self.list: list[tuple[str, str, int, bool]] = []
        self.docs: dict[int, int] = {}
        at, end, fresh, doc = offset, len(text) if end is None else end, False, None
        while at < end:
            m = pattern.match(text, at, end)
            if not m:
                at += 1
                continue
            kind, part = m.lastgroup, m.group()
            if kind == "space":
                fresh |= "\n" in part
            elif kind == "comment":
                if part.startswith("/**") and len(part) > 4:
                    doc = at
                fresh |= "\n" in part or part.startswith("//")
            else:
                if doc is not None:
                    self.docs[len(self.list)] = doc
                self.list.append((kind, part, at, fresh))
                fresh, doc = False, None
            at = m.end()
        self.list.append(("end", "", end, True))
        self.i = 0

    @property
    def kind(self) -> str:
        return self.list[self.i][0]

    @property
    def word(self) -> str:
        return self.list[self.i][1]

    @property
    def offset(self) -> int:
        return self.list[self.i][2]

    @property
    def newline(self) -> bool:
        return self.list[self.i][3]

    def ahead(self, n: int = 1) -> str:
        return self.list[min(self.i + n, len(self.list) - 1)][1]

    def behind(self) -> int:
        """End of the token before."""
        if not self.i:
            return self.offset
        _, part, at, _ = self.list[self.i - 1]
        return at + len(part)

    def take(self) -> str:
        word = self.word
        if self.kind != "end":
            self.i += 1
        return word

    def accept(self, *words: str) -> bool:
        if self.kind != "str" and self.word in words and self.kind != "end":
            self.i += 1
            return True
        return False

    def skip_balanced(self) -> None:
        """Past the bracket here and its partner."""
        depth = 0
        while self.kind != "end":
            word = self.word if self.kind == "op" else ""
            depth += (word in ("(", "[", "{")) - (word in (")", "]", "}"))
            self.take()
            if depth <= 0:
                return

    def angle_end(self, i: int) -> int:
        """Index past `<...>` that begins at token i, if it can be type arguments; else -1."""
        depth = 0
        while i < len(self.list):
            kind, word = self.list[i][:2]
            if word == "<":
                depth += 1
            elif set(word) == {">"}:
                depth -= len(word)
                if depth <= 0:
                    return i + 1 if depth == 0 else -1
            elif kind not in ("id",) and word not in (",", ".", "?", "*", "[", "]", "(", ")", "->", ":", "&", "@", "?."):
                return -1
            i += 1
        return -1
