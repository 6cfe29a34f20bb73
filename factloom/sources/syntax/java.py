"""A reader of Java: declarations, scopes, calls. Brackets that don't match, or an unfinished string, are an error."""

from __future__ import annotations

import re

from factloom.sources.syntax.tree import Node, SyntaxProblem, Tokens

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<str>\"\"\"(?:\\.|[^\\])*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<num>\.?\d[\w.]*)|(?P<id>[^\W\d][\w$]*)|(?P<op>->|::|\+\+|--|&&|\|\||\.\.\.|>>>=|<<=|>>=|[-+*/%=!<>&|^]=|.)"""
)
_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
_STATEMENTS = frozenset("if while for do switch try return throw break continue synchronized assert yield else case default".split())
_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
_OPERATORS = frozenset("+ - * / % = += -= *= /= %= == != < > <= >= && || & | ^ &= |= ^= <<= >>= >>>= ? :".split())


def read(text: str) -> Node:
    return _Reader(text).file()


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.t = Tokens(text, _TOKEN)
        stack, pairs = [], {")": "(", "]": "[", "}": "{"}
        for kind, word, at, _ in self.t.list:
            if kind == "op" and word in ("(", "[", "{"):
                stack.append((word, at))
            elif kind == "op" and word in pairs:
                opener, opened = stack.pop() if stack else ("", at)
                if opener != pairs[word]:
                    raise SyntaxProblem(opened, f"'{opener or word}' has no partner")
            elif kind == "op" and word in ('"', "'"):
                raise SyntaxProblem(at, "unclosed string literal")
        if stack:
            raise SyntaxProblem(len(text), "reached end of file while parsing")

    def close(self, node: Node) -> Node:
        node.end = max(self.t.behind(), node.start)
        return node

    def fail(self, message: str) -> None:
        raise SyntaxProblem(self.t.offset, message)

    def file(self) -> Node:
        t, top = self.t, Node("file", 0, package="")
        while t.kind != "end":
            at, start = t.i, t.offset
            if t.accept(";"):
                continue
            if t.accept("package"):
                top.slots["package"] = self.dotted()
                self.semicolon()
            elif t.accept("import"):
                static = t.accept("static")
                name = self.dotted()
                if t.accept("."):
                    name += "." + t.take()
                self.semicolon()
                top.add(self.close(Node("import", start, name, static=static)))
            else:
                self.member(top)
            if t.i == at:
                self.fail("class, interface, enum, or record expected")
        top.end = len(self.text)
        return top

    def semicolon(self) -> None:
        if not self.t.accept(";"):
            raise SyntaxProblem(self.t.behind(), "';' expected")

    def dotted(self) -> str:
        t, parts = self.t, [self.t.take()]
        while t.word == "." and t.list[t.i + 1][0] == "id":
            t.take()
            parts.append(t.take())
        return ".".join(parts)

    def modifiers(self) -> None:
        t = self.t
        while True:
            if t.word == "@" and t.ahead() != "interface":
                t.take()
                self.dotted()
                if t.word == "(":
                    t.skip_balanced()
            elif t.word in _MODIFIERS and not (t.word == "default" and t.ahead() in (":", "->")) and not (t.word == "synchronized" and t.ahead() == "("):
                t.take()
            elif t.word == "non" and t.ahead() == "-":
                t.take(), t.take(), t.take()
            else:
                return

    def angle(self) -> None:
        t = self.t
        if t.word == "<":
            end = t.angle_end(t.i)
            if end > 0:
                t.i = end

    def type_(self) -> str | None:
        """A type at the cursor, as it is written but for annotations; None, and no move, if there is none."""
        t, at = self.t, self.t.i
        while t.word == "@":
            t.take()
            self.dotted()
        begin = t.offset
        if t.kind != "id" or t.word in _STATEMENTS or t.word in ("new", "this", "super", "instanceof"):
            t.i = at
            return None
        while t.kind == "id":
            t.take()
            self.angle()
            if t.word == "." and t.list[t.i + 1][0] == "id":
                t.take()
            else:
                break
        while t.word == "[" and t.ahead() == "]":
            t.take(), t.take()
        if t.accept("..."):
            return re.sub(r"\s+", " ", self.text[begin : t.behind() - 3].strip()) + "..."
        return re.sub(r"\s+", " ", self.text[begin : t.behind()].strip())

    def is_class(self) -> str | None:
        t = self.t
        if t.word == "@" and t.ahead() == "interface":
            return "annotation"
        if t.word in _KINDS and t.list[t.i + 1][0] == "id" and (t.word != "record" or t.ahead(2) in ("(", "<")):
            return _KINDS[t.word]
        return None

    def class_(self, start: int, kind: str) -> Node:
        t = self.t
        t.take()
        if kind == "annotation":
            t.take()
        node = Node("class", start, t.take(), type=kind, extends=None)
        self.angle()
        if kind == "record" and t.word == "(":
            node.slots["components"] = self.parameters(node)
        while t.kind != "end" and t.word != "{":
            if t.accept("extends") and kind != "interface":
                node.slots["extends"] = self.type_()
            else:
                t.take()
        self.body(node, kind == "enum")
        return self.close(node)

    def body(self, node: Node, enum: bool = False) -> None:
        t = self.t
        if not t.accept("{"):
            self.fail("'{' expected")
        while enum and (t.kind == "id" or t.word == "@") and t.word not in _MODIFIERS:
            self.modifiers()
            constant = Node("field", t.offset, t.take(), type=node.name, declared=None)
            if t.word == "(":
                self.arguments(constant)
            if t.word == "{":
                inner = Node("class", t.offset, None, type="class", extends=None)
                self.body(inner)
                constant.add(self.close(inner))
            node.add(self.close(constant))
            if not t.accept(","):
                break
        while t.kind != "end" and not t.accept("}"):
            at = t.i
            if t.accept(";"):
                continue
            self.member(node)
            if t.i == at:
                self.fail("illegal start of type")

    def member(self, owner: Node) -> None:
        t, start = self.t, self.t.offset
        self.modifiers()
        if kind := self.is_class():
            owner.add(self.class_(start, kind))
            return
        if t.word == "{":
            owner.add(self.block())
            return
        if t.word == "<":
            self.angle()
        if t.kind == "id" and t.ahead() in ("(", "{") and owner.kind == "class" and t.word == owner.name:
            t.take()
            node = Node("method", start, "<init>", params=[], owner=owner)
            if t.word == "(":
                node.slots["params"] = self.parameters(node)
        else:
            kind = self.type_()
            if kind is None or t.kind != "id":
                self.fail("<identifier> expected")
            if t.ahead() != "(":
                self.variables(owner, start, kind, "field")
                return
            node = Node("method", start, t.take(), params=[], owner=owner)
            node.slots["params"] = self.parameters(node)
        while t.word == "[":
            t.take(), t.take()
        if t.accept("throws"):
            while self.type_() and t.accept(","):
                pass
        if t.accept("default"):
            node.add(self.expression())
        if t.word == "{":
            node.add(self.block())
        else:
            self.semicolon()
        owner.add(self.close(node))

    def parameters(self, owner: Node) -> list[Node]:
        t, out = self.t, []
        t.take()
        while t.kind != "end" and not t.accept(")"):
            start = t.offset
            self.modifiers()
            kind = self.type_()
            if t.word == "this":
                t.take()
            elif t.kind == "id":
                param = Node("param", start, t.take(), declared=kind)
                while t.word == "[":
                    t.take(), t.take()
                    param.slots["declared"] += "[]"
                out.append(param)
                owner.add(self.close(param))
            else:
                self.fail("<identifier> expected")
            t.accept(",")
        return out

    def variables(self, owner: Node, start: int, kind: str, what: str) -> None:
        t = self.t
        while True:
            node = Node(what, start, t.take(), declared=kind)
            while t.word == "[":
                t.take(), t.take()
                node.slots["declared"] = kind + "[]"
            if t.accept("="):
                node.slots["value"] = node.add(self.expression())
            owner.add(self.close(node))
            if not t.accept(","):
                break
        if t.word not in (")", ":"):
            self.semicolon()

    def block(self) -> Node:
        t, node = self.t, Node("block", self.t.offset)
        t.take()
        while t.kind != "end" and not t.accept("}"):
            self.statement(node)
        return self.close(node)

    def local(self, owner: Node) -> bool:
        """A declaration of local variables, if one stands here."""
        t, at, start = self.t, self.t.i, self.t.offset
        self.modifiers()
        kind = self.type_()
        if kind is not None and t.kind == "id" and t.word != "instanceof" and t.ahead() in ("=", ";", ",", ":", "["):
            self.variables(owner, start, kind, "local")
            return True
        t.i = at
        return False

    def statement(self, owner: Node) -> None:
        t, at, start = self.t, self.t.i, self.t.offset
        if t.accept(";"):
            return
        if t.word == "{":
            owner.add(self.block())
            return
        if t.kind == "id" and t.ahead() == ":" and t.word not in ("default", "case"):
            t.take(), t.take()
            return
        self.modifiers()
        kind = self.is_class()
        if kind:
            owner.add(self.class_(start, kind))
            return
        t.i = at
        word = t.word if t.kind == "id" else ""
        if word == "for":
            node = Node("for", start)
            t.take(), t.take()
            if not t.accept(";"):
                if not self.local(node):
                    node.add(self.expressions())
                    t.accept(";")
            if t.accept(":"):
                node.add(self.expression())
            while t.kind != "end" and t.word != ")":
                if not t.accept(";"):
                    node.add(self.expressions())
            t.accept(")")
            self.statement(node)
            owner.add(self.close(node))
        elif word == "try":
            self.try_(owner)
        elif word in ("if", "while", "switch", "synchronized"):
            t.take()
            owner.add(self.expression())
            if word == "switch":
                owner.add(self.switch())
            else:
                self.statement(owner)
                if word == "if" and t.accept("else"):
                    self.statement(owner)
        elif word == "do":
            t.take()
            self.statement(owner)
            t.accept("while")
            owner.add(self.expression())
            self.semicolon()
        elif word in ("break", "continue"):
            while not t.accept(";") and t.kind != "end":
                t.take()
        elif word in ("return", "throw", "assert") or (word == "yield" and t.ahead() not in ("=", ".", "(", "++", "--")):
            t.take()
            while t.kind != "end" and t.word != ";":
                owner.add(self.expression())
                t.accept(":")
            self.semicolon()
        elif not self.local(owner):
            owner.add(self.expression())
            self.semicolon()
        if t.i == at:
            self.fail("illegal start of expression")

    def try_(self, owner: Node) -> None:
        t, node = self.t, Node("try", self.t.offset)
        t.take()
        if t.accept("("):
            while t.kind != "end" and not t.accept(")"):
                if t.accept(";"):
                    continue
                start = t.offset
                at = t.i
                self.modifiers()
                kind = self.type_()
                if kind and t.kind == "id" and t.ahead() == "=":
                    resource = Node("local", start, t.take(), declared=kind)
                    t.take()
                    resource.slots["value"] = resource.add(self.expression())
                    node.add(self.close(resource))
                else:
                    t.i = at
                    node.add(self.expression())
        node.add(self.block())
        owner.add(self.close(node))
        while t.word == "catch":
            held = Node("catch", t.offset)
            t.take(), t.take()
            start = t.offset
            self.modifiers()
            kinds = [self.type_()]
            while t.accept("|"):
                kinds.append(self.type_())
            param = Node("param", start, t.take(), declared=" | ".join(k or "" for k in kinds))
            held.add(self.close(param))
            t.accept(")")
            held.add(self.block())
            owner.add(self.close(held))
        if t.accept("finally"):
            owner.add(self.block())

    def switch(self) -> Node:
        t, node = self.t, Node("switch", self.t.offset)
        if not t.accept("{"):
            self.fail("'{' expected")
        while t.kind != "end" and not t.accept("}"):
            if t.accept("case") or t.accept("default"):
                while t.kind != "end" and t.word not in (":", "->"):
                    at = t.i
                    t.accept(",")
                    node.add(self.expression(case=True))
                    if t.i == at:
                        t.take()
                t.take()
            else:
                self.statement(node)
        return self.close(node)

    def expressions(self) -> Node:
        node = Node("expr", self.t.offset)
        node.add(self.expression())
        while self.t.accept(","):
            node.add(self.expression())
        return self.close(node)

    def lambda_(self) -> Node | None:
        t, start = self.t, self.t.offset
        node = Node("lambda", start)
        if t.kind == "id" and t.ahead() == "->":
            node.add(self.close(Node("param", start, t.take(), declared=None)))
        elif t.word == "(":
            i, depth = t.i, 0
            while t.list[i][0] != "end":
                depth += (t.list[i][1] == "(") - (t.list[i][1] == ")")
                i += 1
                if not depth:
                    break
            if t.list[i][1] != "->":
                return None
            t.take()
            while t.kind != "end" and not t.accept(")"):
                at = t.offset
                self.modifiers()
                kind = None if t.ahead() in (",", ")") else self.type_()
                node.add(self.close(Node("param", at, t.take(), declared=kind)))
                t.accept(",")
        else:
            return None
        t.accept("->")
        node.add(self.block() if t.word == "{" else self.expression())
        return self.close(node)

    def expression(self, case: bool = False) -> Node:
        t, whole = self.t, Node("expr", self.t.offset)
        while True:
            while t.kind == "op" and t.word in ("!", "-", "+", "~", "++", "--"):
                t.take()
            whole.add(self.postfix())
            if t.word == "instanceof":
                t.take()
                self.modifiers()
                kind, at = self.type_(), t.offset
                if t.kind == "id" and t.word != "instanceof":
                    whole.add(self.close(Node("local", at, t.take(), declared=kind)))
                    whole.kids[-1].end = t.behind()
                elif t.word == "(":
                    t.skip_balanced()
            word = t.word if t.kind == "op" else ""
            if word == ">" or word == "<":
                while t.word in ("<", ">", ">=", "<="):
                    t.take()
            elif word in _OPERATORS and not (case and word == ":") and not (word == ":" and not whole.slots.get("asked")):
                whole.slots["asked"] = whole.slots.get("asked", 0) + (word == "?") - (word == ":")
                t.take()
            else:
                break
        if len(whole.kids) == 1:
            only = whole.kids[0]
            only.parent = None
            return only
        return self.close(whole)

    def arguments(self, node: Node) -> int:
        t, n = self.t, 0
        t.take()
        while t.kind != "end" and not t.accept(")"):
            at = t.i
            node.add(self.expression())
            n += 1
            if not t.accept(",") and t.word != ")":
                self.fail("')' or ',' expected")
            if t.i == at:
                self.fail("illegal start of expression")
        return n

    def postfix(self) -> Node | None:
        t = self.t
        node = self.primary()
        while node is not None:
            word = t.word if t.kind == "op" else ""
            if word == ".":
                t.take()
                self.angle()
                if t.word == "new":
                    inner = self.primary()
                    inner.add(node)
                    node = inner
                    continue
                outer = Node("select", node.start, t.take(), receiver=node)
                outer.add(node)
                node = self.close(outer)
            elif word == "(":
                outer = Node("call", node.start, node.name, select=node)
                outer.add(node)
                outer.slots["count"] = self.arguments(outer)
                node = self.close(outer)
            elif word == "[":
                outer = Node("index", node.start)
                outer.add(node)
                t.take()
                if t.word != "]":
                    outer.add(self.expression())
                t.accept("]")
                node = self.close(outer)
            elif word == "::":
                t.take(), t.take()
                outer = Node("reference", node.start)
                outer.add(node)
                node = self.close(outer)
            elif word in ("++", "--"):
                t.take()
            else:
                return node
        return node

    def primary(self) -> Node | None:
        t, start = self.t, self.t.offset
        if (found := self.lambda_()) is not None:
            return found
        kind, word = t.kind, t.word
        if kind in ("str", "num"):
            t.take()
            return self.close(Node("literal", start))
        if word == "(":
            return self.paren()
        if word == "{":
            node = Node("literal", start)
            t.take()
            while t.kind != "end" and not t.accept("}"):
                node.add(self.expression())
                t.accept(",")
            return self.close(node)
        if word == "@":
            self.modifiers()
            return self.primary()
        if word == "new":
            t.take()
            node = Node("new", start, None)
            while t.word == "@":
                self.modifiers()
            begin = t.offset
            self.dotted()
            self.angle()
            node.slots["type"] = self.text[begin : t.behind()].strip()
            while t.word == "[":
                t.take()
                if t.word != "]":
                    node.add(self.expression())
                t.accept("]")
            if t.word == "(":
                self.arguments(node)
            if t.word == "{":
                if self.text[t.behind() - 1] == "]":
                    node.add(self.primary())
                else:
                    inner = Node("class", t.offset, None, type="class", extends=None)
                    self.body(inner)
                    node.add(self.close(inner))
            return self.close(node)
        if word == "switch":
            t.take()
            node = Node("expr", start)
            node.add(self.expression())
            node.add(self.switch())
            return self.close(node)
        if kind == "id" and word not in ("instanceof",):
            at = t.i
            array = self.type_() if t.ahead() in ("<", "[") else None
            if array is not None and t.word == "::":
                return self.close(Node("type", start))
            t.i = at
            t.take()
            return self.close(Node("name", start, word))
        return None

    def paren(self) -> Node:
        t, start = self.t, self.t.offset
        at = t.i
        t.take()
        if self.type_() is not None:
            while t.accept("&"):
                self.type_()
            if t.accept(")"):
                nxt, word = t.kind, t.word
                if nxt in ("id", "str", "num") and word != "instanceof" or word in ("(", "!", "~"):
                    node = Node("cast", start)
                    node.add(self.postfix())
                    return self.close(node)
        t.i = at
        t.take()
        node = Node("paren", start)
        node.add(self.expression())
        if not t.accept(")"):
            self.fail("')' expected")
        return self.close(node)
