"""A reader of Kotlin: tolerant, it skips what it doesn't know. Gives a tree of declarations, scopes, calls and accesses."""

from __future__ import annotations

import re

from factloom.sources.syntax.tree import Node, Tokens

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<str>\"\"\"(?:[^"]|"(?!""))*\"\"\"+|"(?:\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<num>\d[\w.]*(?<!\.))|(?P<id>`[^`\n]+`|[^\W\d]\w*)|(?P<op>===|!==|\?\.|\?:|::|\.\.<|\.\.|->|=>|\+\+|--|&&|\|\||[-+*/%=!<>]=|!!|.)"""
)
#: Words that may stand before a declaration.
MODIFIERS = frozenset(
    "public private protected internal open abstract final sealed data inner value inline noinline crossinline suspend operator infix tailrec external override lateinit const vararg expect actual annotation enum companion reified out in".split()
)
ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=", "%=")
_BINARY = frozenset("+ - * / % = += -= *= /= %= == != === !== < > <= >= && || ?: .. ..< : ->".split())
_WORD_OPERATORS = frozenset(("in", "is", "as", "to", "and", "or", "xor", "shl", "shr", "ushr", "until", "downTo", "step"))


def read(text: str) -> Node:
    return _Reader(text).file()


def _plain(name: str) -> str:
    return name[1:-1] if name.startswith("`") else name


class _Reader:
    def __init__(self, text: str, offset: int = 0, end: int | None = None):
        self.text = text
        self.t = Tokens(text, _TOKEN, offset, end)

    def close(self, node: Node) -> Node:
        node.end = max(self.t.behind(), node.start)
        return node

    def file(self) -> Node:
        t, top = self.t, Node("file", 0, package="", imports=[], jvm_name=None)
        while t.kind != "end":
            at = t.i
            if t.word == "@" and t.ahead() == "file":
                self.file_annotation(top)
            elif t.accept("package"):
                top.slots["package"] = self.dotted()
            elif t.accept("import"):
                path, alias = self.dotted(), None
                if t.accept(".") and t.accept("*"):
                    path += ".*"
                if t.accept("as"):
                    alias = _plain(t.take())
                top.slots["imports"].append((path, alias))
            else:
                top.add(self.statement(top=True))
            if t.i == at:
                t.take()
        top.end = len(self.text)
        return top

    def file_annotation(self, top: Node) -> None:
        t = self.t
        t.take(), t.take(), t.accept(":")
        name = t.take()
        if t.word == "(":
            if name == "JvmName" and t.ahead(2) == ")":
                top.slots["jvm_name"] = t.ahead().strip('"')
            t.skip_balanced()

    def dotted(self) -> str:
        t, parts = self.t, []
        while t.kind == "id":
            parts.append(_plain(t.take()))
            if t.word == "." and t.list[t.i + 1][0] == "id":
                t.take()
            else:
                break
        return ".".join(parts)

    # --- declarations

    def statement(self, top: bool = False) -> Node | None:
        """A declaration or an expression. top: accessors of properties may follow, and `init` is a word of its own."""
        t, begin = self.t, self.t.i
        start = t.docs.get(begin, t.offset)
        annotations, words = [], []
        while True:
            if t.word == "@" and t.kind == "op" and not (t.ahead() == "file"):
                annotations.append(self.annotation())
            elif t.word in MODIFIERS and t.kind == "id" and t.ahead() not in (".", "(", "=", ")", ",", "?.", ":") and (t.list[t.i + 1][0] in ("id",) or t.ahead() == "@"):
                words.append(t.take())
            else:
                break
        word = t.word if t.kind == "id" else ""
        if word == "fun" and t.ahead() == "interface":
            t.take()
            word = "interface"
        if word in ("class", "interface"):
            return self.class_(start, annotations, words)
        if word == "object" and (t.list[t.i + 1][0] == "id" or "companion" in words):
            return self.object_(start, words)
        if word == "fun" and self.named_function():
            return self.function(start, annotations)
        if word in ("val", "var"):
            return self.property(start, top)
        if word == "typealias":
            while t.kind != "end" and not (t.newline and t.i > begin):
                t.take()
            return None
        if top and word == "init" and t.ahead() == "{":
            t.take()
            return self.block()
        if top and word == "constructor" and t.ahead() == "(":
            t.take()
            node = Node("constructor", start, params=[])
            self.parameters(node)
            if t.accept(":"):
                node.add(self.expression())
            if t.word == "{":
                node.add(self.block())
            return self.close(node)
        if t.i == begin or word or t.kind != "end":
            return self.expression()
        return None

    def annotation(self) -> tuple[str, str | None]:
        t = self.t
        t.take()
        if t.kind == "id" and t.ahead() == ":":
            t.take(), t.take()
        name, value = self.dotted().rpartition(".")[2], None
        if t.word == "<":
            end = t.angle_end(t.i)
            t.i = end if end > 0 else t.i
        if t.word == "(" and not t.newline:
            if t.list[t.i + 1][0] == "str" and t.ahead(2) == ")":
                value = t.ahead().strip('"')
            t.skip_balanced()
        return name, value

    def named_function(self) -> bool:
        i = self.t.i + 1
        tokens = self.t.list
        if tokens[i][1] == "<":
            i = self.t.angle_end(i)
        return i > 0 and tokens[i][0] == "id"

    def type_(self, arrow: bool = True) -> str | None:
        t, begin = self.t, self.t.offset
        self.skip_type(arrow)
        return self.text[begin : t.behind()].strip() if t.behind() > begin else None

    def skip_type(self, arrow: bool = True) -> None:
        t = self.t
        while t.word == "@" or t.word == "suspend":
            self.annotation() if t.word == "@" else t.take()
        if t.word == "(":
            t.skip_balanced()
        while t.kind == "id":
            t.take()
            if t.word == "<":
                end = t.angle_end(t.i)
                if end > 0:
                    t.i = end
            if t.word == "." and t.list[t.i + 1][0] == "id":
                t.take()
            else:
                break
        while t.word in ("?", "!!") and not t.newline:
            t.take()
        if t.word == "." and t.ahead() == "(":
            t.take()
            t.skip_balanced()
        if arrow and t.accept("->"):
            self.skip_type()
        if t.accept("&"):
            self.skip_type()

    def parameters(self, owner: Node) -> None:
        """`(a: T = x, ...)` into owner.params; default values become kids."""
        t = self.t
        if not t.accept("("):
            return
        while t.kind != "end" and not t.accept(")"):
            start, keyword, words = t.offset, None, []
            while t.word == "@" or (t.word in MODIFIERS and t.list[t.i + 1][0] == "id"):
                self.annotation() if t.word == "@" else words.append(t.take())
            if t.word in ("val", "var"):
                keyword = t.take()
            if t.kind != "id":
                t.take()
                continue
            param = Node("param", start, _plain(t.take()), type=None, keyword=keyword)
            if t.accept(":"):
                param.slots["type"] = self.type_()
            if t.accept("="):
                param.add(self.expression())
            owner.slots["params"].append(param)
            owner.add(self.close(param))
            t.accept(",")

    def class_(self, start: int, annotations: list, words: list[str]) -> Node:
        t = self.t
        kind = t.take()
        node = Node("class", start, None, interface=kind == "interface", params=[], supers=[])
        if t.kind == "id":
            node.name = _plain(t.take())
        if t.word == "<":
            end = t.angle_end(t.i)
            t.i = end if end > 0 else t.i
        at = t.i
        while t.word == "@" or t.word in MODIFIERS:
            self.annotation() if t.word == "@" else t.take()
        if not t.accept("constructor"):
            t.i = at if t.word != "(" else t.i
        if t.word == "(":
            self.parameters(node)
        self.supers(node)
        if t.word == "{":
            self.body(node, "enum" in words)
        return self.close(node)

    def supers(self, node: Node) -> None:
        t = self.t
        if t.accept(":"):
            while True:
                while t.word == "@":
                    self.annotation()
                name = self.type_()
                call = t.word == "(" and not t.newline
                if call:
                    held = Node("super_call", t.offset)
                    self.arguments(held)
                    node.add(self.close(held))
                if t.accept("by"):
                    node.add(self.expression(lambdas=False))
                if name:
                    node.slots["supers"].append((name, call))
                if not t.accept(","):
                    break
        if t.accept("where"):
            while t.kind == "id":
                t.take()
                t.accept(":")
                self.skip_type()
                if not t.accept(","):
                    break

    def object_(self, start: int, words: list[str]) -> Node:
        t = self.t
        t.take()
        node = Node("object", start, "Companion" if "companion" in words else None, supers=[], params=[])
        if t.kind == "id" and not t.newline:
            node.name = _plain(t.take())
        self.supers(node)
        if t.word == "{":
            self.body(node, False)
        return self.close(node)

    def body(self, node: Node, enum: bool) -> None:
        t = self.t
        t.take()
        while enum and t.kind == "id":
            entry = Node("class", t.offset, _plain(t.take()), interface=False, params=[], supers=[])
            if t.word == "(":
                self.arguments(entry)
            if t.word == "{":
                self.body(entry, False)
            node.add(self.close(entry))
            entry.slots["member"] = True
            if not t.accept(","):
                break
        while t.kind != "end" and not t.accept("}"):
            at = t.i
            if t.accept(";"):
                continue
            if (kid := self.statement(top=True)) is not None:
                kid.slots["member"] = True
                node.add(kid)
            if t.i == at:
                t.take()

    def function(self, start: int, annotations: list) -> Node:
        t = self.t
        t.take()
        if t.word == "<":
            end = t.angle_end(t.i)
            t.i = end if end > 0 else t.i
        node = Node("fun", start, None, params=[], type=None, annotations=annotations)
        offset = t.offset
        while t.kind == "id":
            offset, node.name = t.offset, _plain(t.take())
            if t.word == "<":
                end = t.angle_end(t.i)
                t.i = end if end > 0 else t.i
            while t.word == "?":
                t.take()
            if not (t.accept(".") or t.accept("?.")):
                break
        node.slots["offset"] = offset
        self.parameters(node)
        if t.accept(":"):
            node.slots["type"] = self.type_()
        if t.accept("where"):
            while t.kind == "id":
                t.take(), t.accept(":"), self.skip_type()
                if not t.accept(","):
                    break
        if t.accept("="):
            node.add(self.expression())
        elif t.word == "{":
            node.add(self.block())
        return self.close(node)

    def property(self, start: int, top: bool) -> Node:
        t = self.t
        keyword = t.take()
        node = Node("property", start, None, var=keyword == "var", type=None, offset=t.offset)
        if t.word == "<":
            end = t.angle_end(t.i)
            t.i = end if end > 0 else t.i
        if t.word == "(":
            t.skip_balanced()
        while t.kind == "id":
            node.slots["offset"], node.name = t.offset, _plain(t.take())
            if t.word == "<":
                end = t.angle_end(t.i)
                t.i = end if end > 0 else t.i
            while t.word == "?":
                t.take()
            if not (t.accept(".") or t.accept("?.")):
                break
        if t.accept(":"):
            node.slots["type"] = self.type_()
        if t.accept("=") or t.accept("by"):
            node.add(self.expression())
        while top and self.accessor(node):
            pass
        return self.close(node)

    def accessor(self, node: Node) -> bool:
        t, at = self.t, self.t.i
        while t.word == "@" or t.word in MODIFIERS:
            self.annotation() if t.word == "@" else t.take()
        if t.word not in ("get", "set") or (t.ahead() != "(" and not (t.word == "set" and t.i > at)):
            t.i = at
            return False
        t.take()
        held = Node("accessor", t.offset, params=[])
        self.parameters(held)
        if t.accept(":"):
            self.skip_type()
        if t.accept("="):
            held.add(self.expression())
        elif t.word == "{":
            held.add(self.block())
        node.add(self.close(held))
        return True

    def block(self) -> Node:
        t, node = self.t, Node("block", self.t.offset)
        t.take()
        self.statements(node)
        return self.close(node)

    def statements(self, node: Node) -> None:
        t = self.t
        while t.kind != "end" and not t.accept("}"):
            at = t.i
            if t.accept(";"):
                continue
            node.add(self.statement())
            if t.i == at:
                t.take()

    # --- expressions

    def expression(self, lambdas: bool = True) -> Node:
        """Operands and what joins them; the operands are kids. One operand alone is given as it is."""
        t, whole = self.t, Node("expr", self.t.offset)
        while True:
            while t.kind == "op" and t.word in ("!", "-", "+", "++", "--", "*", "&"):
                sign = t.take()
                if sign in ("++", "--"):
                    whole.slots["step"] = len(whole.kids)
            operand = whole.add(self.postfix(lambdas))
            if operand is None:
                break
            if whole.slots.pop("step", -1) == len(whole.kids) - 1:
                operand.slots["write"] = True
            word = t.word
            if t.kind == "op" and word in ASSIGNMENTS:
                operand.slots["write"] = True
            if t.kind == "op" and word in _BINARY and word not in (":", "->"):
                if t.newline and word in ("+", "-", "*", "<", "="):
                    break
                t.take()
            elif word == "!" and t.ahead() in ("in", "is"):
                t.take(), t.take()
            elif t.kind == "id" and not t.newline and (word in _WORD_OPERATORS or self.infix()):
                t.take()
                if word == "as":
                    t.accept("?")
                if word in ("as", "is"):
                    self.skip_type()
                    if not (t.kind == "op" and t.word in _BINARY and t.word not in (":", "->") and not t.newline):
                        if t.word not in (".", "?."):
                            break
                    else:
                        t.take()
            else:
                break
        if len(whole.kids) == 1:
            only = whole.kids[0]
            only.parent = None
            return only
        return self.close(whole)

    def infix(self) -> bool:
        """`a name b` on one line: an infix call, whose name is an operator here."""
        t = self.t
        if t.word in ("else", "while", "catch", "finally", "by", "where", "if", "for", "return", "val", "var", "fun", "class"):
            return False
        kind, word, _, fresh = t.list[min(t.i + 1, len(t.list) - 1)]
        return not fresh and (kind in ("id", "str", "num") or word in ("(", "{") and False)

    def postfix(self, lambdas: bool = True) -> Node | None:
        t = self.t
        node = self.primary()
        if node is None:
            return None
        while True:
            word = t.word if t.kind == "op" else ""
            if word in (".", "?."):
                t.take()
                outer = Node("qualified", node.start, receiver=node)
                outer.add(node)
                if t.kind != "id":
                    node = self.close(outer)
                    continue
                selector = Node("name", t.offset, _plain(t.take()))
                self.close(selector)
                selector = self.call(selector, lambdas)
                outer.add(selector)
                outer.slots["selector"] = selector
                node = self.close(outer)
            elif word == "::":
                t.take()
                t.take()
                node = self.close(self.wrap("reference", node))
            elif word == "!!" and not t.newline:
                t.take()
                node = self.close(self.wrap("expr", node))
            elif word in ("++", "--") and not t.newline:
                t.take()
                node.slots["write"] = True
            elif word == "[" and not t.newline:
                node = self.wrap("index", node)
                self.arguments(node, "]")
                self.close(node)
            else:
                called = self.call(node, lambdas)
                if called is node:
                    return node
                node = called

    def wrap(self, kind: str, inner: Node) -> Node:
        outer = Node(kind, inner.start)
        outer.add(inner)
        return outer

    def call(self, callee: Node, lambdas: bool) -> Node:
        """callee with the type arguments, arguments and lambdas that follow it on its line; callee itself if none do."""
        t, begin = self.t, self.t.i
        if t.newline or callee.kind in ("block", "literal", "control"):
            return callee
        if t.word == "<" and callee.kind == "name":
            end = t.angle_end(t.i)
            if end < 0 or t.list[end][1] not in ("(", "{") or t.list[end][3]:
                return callee
            t.i = end
        if not (t.word == "(" or (t.word == "{" and lambdas and callee.kind in ("name", "call"))):
            t.i = begin
            return callee
        node = Node("call", callee.start, callee.name if callee.kind == "name" else None, callee=callee, args=[], count=0)
        node.add(callee)
        if t.word == "(":
            self.arguments(node)
        while lambdas and t.word == "{" and not t.newline:
            held = self.lambda_()
            held.slots["trailing"] = True
            node.add(held)
            node.slots["count"] += 1
        return self.close(node)

    def arguments(self, node: Node, closer: str = ")") -> None:
        t = self.t
        t.take()
        while t.kind != "end" and not t.accept(closer):
            at, name = t.i, None
            if t.kind == "id" and t.ahead() == "=" and t.list[t.i + 1][0] == "op":
                name = _plain(t.take())
                t.take()
            begin = t.offset
            t.accept("*")
            kid = self.expression()
            node.add(kid)
            if "args" in node.slots:
                node.slots["args"].append((name, self.text[begin : max(t.behind(), begin)].strip()))
                node.slots["count"] += 1
            t.accept(",")
            if t.i == at:
                t.take()

    def lambda_(self) -> Node:
        """`{ a: T, b -> ... }`: the statements stand in a block of its own, which belongs to the lambda."""
        t, node = self.t, Node("lambda", self.t.offset, params=[])
        t.take()
        i, depth = t.i, 0
        while t.list[i][0] != "end":
            word = t.list[i][1] if t.list[i][0] == "op" else ""
            if word == "->" and depth == 0:
                break
            depth += (word in ("(", "<")) - (word in (")", ">"))
            if word in ("{", "}", ";", "=", ".", "+") or depth < 0 or (t.list[i][3] and i > t.i and t.list[i - 1][1] != ","):
                i = -1
                break
            i += 1
        if i >= 0 and t.list[i][1] == "->":
            while t.i < i:
                if t.kind == "id":
                    param = Node("param", t.offset, _plain(t.take()), type=None, keyword=None)
                    if t.accept(":"):
                        param.slots["type"] = self.type_(arrow=False)
                    node.slots["params"].append(param)
                    node.add(self.close(param))
                else:
                    t.take()
            t.i = i + 1
        inner = Node("block", t.offset)
        self.statements(inner)
        node.add(self.close(inner))
        return self.close(node)

    def primary(self) -> Node | None:
        t, start = self.t, self.t.offset
        kind, word = t.kind, t.word
        if kind == "end":
            return None
        if kind == "str":
            node = Node("literal", start)
            t.take()
            if word.startswith('"') and "${" in word:
                for m in re.finditer(r"\$\{", word):
                    depth, j = 1, m.end()
                    while j < len(word) and depth:
                        depth += (word[j] == "{") - (word[j] == "}")
                        j += 1
                    node.add(_Reader(self.text, start + m.end(), start + j - 1).expression())
            return self.close(node)
        if kind == "num":
            t.take()
            return self.close(Node("literal", start))
        if kind == "op":
            if word == "{":
                return self.lambda_()
            if word == "(":
                node = Node("paren", start)
                self.arguments(node)
                return self.close(node)
            if word == "[":
                node = Node("literal", start)
                self.arguments(node, "]")
                return self.close(node)
            if word == "@":
                self.annotation()
                return self.primary()
            return None
        if word in ("this", "super"):
            t.take()
            node = Node(word, start, qualifier=None)
            if word == "super" and t.word == "<":
                t.take()
                node.slots["qualifier"] = self.type_()
                t.accept(">")
            if t.word == "@" and not t.newline and t.list[t.i + 1][0] == "id":
                t.take(), t.take()
            return self.close(node)
        handler = getattr(self, f"on_{word}", None) if word in ("if", "when", "for", "while", "do", "try", "return", "throw", "break", "continue", "object", "fun") else None
        if handler:
            return handler()
        if word in ("else", "catch", "finally", "in", "is", "as") or word in ("val", "var", "class", "interface"):
            return None
        t.take()
        if t.word == "@" and not t.newline and t.offset == t.behind() and t.ahead() in ("{", "for", "while", "do"):
            t.take()
            return self.primary()
        return self.close(Node("name", start, _plain(word)))

    def branch(self, node: Node) -> None:
        t = self.t
        if t.word == "{":
            node.add(self.block())
        elif t.word != ";":
            node.add(self.statement())

    def header(self, node: Node) -> None:
        if self.t.word == "(":
            self.arguments(node)

    def on_if(self) -> Node:
        t, node = self.t, Node("control", self.t.offset)
        t.take()
        self.header(node)
        self.branch(node)
        t.accept(";") if t.ahead() == "else" else None
        if t.accept("else"):
            self.branch(node)
        return self.close(node)

    def on_when(self) -> Node:
        t, node = self.t, Node("control", self.t.offset)
        t.take()
        if t.word == "(" and t.ahead() == "val":
            t.take()
            node.add(self.statement())
            t.accept(")")
        else:
            self.header(node)
        if t.accept("{"):
            while t.kind != "end" and not t.accept("}"):
                at = t.i
                while t.kind != "end" and not t.accept("->"):
                    here = t.i
                    t.accept("!")
                    if t.accept("in"):
                        node.add(self.expression(lambdas=False))
                    elif t.accept("is"):
                        self.skip_type()
                    elif not (t.accept("else") or t.accept(",")):
                        node.add(self.expression(lambdas=False))
                    if t.i == here:
                        t.take()
                self.branch(node)
                t.accept(";")
                if t.i == at:
                    t.take()
        return self.close(node)

    def on_for(self) -> Node:
        t, node = self.t, Node("for", self.t.offset, params=[])
        t.take()
        if t.accept("("):
            while t.word == "@":
                self.annotation()
            if t.word == "(":
                t.skip_balanced()
            elif t.kind == "id":
                param = Node("param", t.offset, _plain(t.take()), type=None, keyword=None)
                if t.accept(":"):
                    param.slots["type"] = self.type_()
                node.slots["params"].append(param)
                node.add(self.close(param))
            t.accept("in")
            node.add(self.expression())
            t.accept(")")
        self.branch(node)
        return self.close(node)

    def on_while(self) -> Node:
        t, node = self.t, Node("control", self.t.offset)
        t.take()
        self.header(node)
        if not t.newline or t.word == "{":
            self.branch(node)
        return self.close(node)

    def on_do(self) -> Node:
        t, node = self.t, Node("control", self.t.offset)
        t.take()
        self.branch(node)
        if t.accept("while"):
            self.header(node)
        return self.close(node)

    def on_try(self) -> Node:
        t, node = self.t, Node("control", self.t.offset)
        t.take()
        if t.word == "{":
            node.add(self.block())
        while t.word == "catch":
            held = Node("catch", t.offset, params=[])
            t.take()
            self.parameters(held)
            if t.word == "{":
                held.add(self.block())
            node.add(self.close(held))
        if t.accept("finally") and t.word == "{":
            node.add(self.block())
        return self.close(node)

    def on_return(self) -> Node:
        t, node = self.t, Node("control", self.t.offset)
        t.take()
        if t.word == "@" and not t.newline and t.offset == t.behind():
            t.take(), t.take()
        if not t.newline and t.word not in ("}", ")", "]", ",", ";", "else", "?:"):
            node.add(self.expression())
        return self.close(node)

    on_throw = on_break = on_continue = on_return

    def on_object(self) -> Node:
        node = self.object_(self.t.offset, [])
        return node

    def on_fun(self) -> Node:
        return self.function(self.t.offset, [])
