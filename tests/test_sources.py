"""Files in, facts out: Java, Kotlin and XML, within a file and across files."""

import pytest
from pyspark.sql import functions as F

from factloom.plans.extract import SYMBOLS, extract, resolve_references, sites_of, symbols_of
from factloom.sources.syntax.facts import Facts
from factloom.sources.syntax.java_facts import java_facts
from factloom.sources.syntax.tree import SyntaxProblem
from factloom.sources.syntax.xml_facts import xml_facts


def java(text, path="src/A.java"):
    out = Facts(path, "java")
    java_facts(path, text, out)
    return out.rows


def xml(text, path):
    out = Facts(path, "xml")
    xml_facts(path, text, out)
    return out.rows


def facts(spark, sources, sites=False):
    rows = [(p, t, True, sites and p.endswith(".kt")) for p, t in sources.items()]
    return extract(spark.createDataFrame(rows, "relative_file string, content string, changed boolean, sites boolean"))


def index(spark, sources):
    found = facts(spark, sources).cache()
    none = spark.createDataFrame([], SYMBOLS)
    refs = [r.asDict() for r in resolve_references(found, none).collect()]
    symbols = [r.asDict() for r in symbols_of(found).collect()]
    found.unpersist()
    return symbols, refs


def has(refs, fqn, **more):
    return any(r["symbol_fqn"] == fqn and all(r[k] == v for k, v in more.items()) for r in refs)


# --- Java


def test_java_symbols_imports_and_calls():
    rows = java("package p;\nimport lib.Tool;\nclass Box {\n  Tool tool;\n  void open(int n) { tool.run(); }\n  void shut() { tool.run(); }\n}\n")
    symbols = {(r["fqn"], r["kind"], r["line"], r["column"]) for r in rows if r["what"] == "symbol"}
    assert {("p.Box", "class", 3, 1), ("p.Box#tool", "field", 4, 3), ("p.Box#open", "method", 5, 3)} <= symbols
    assert [r["signature"] for r in rows if r["fqn"] == "p.Box#open"] == ["(int)"]
    assert sum(r["fqn"] == "lib.Tool#run" and r["context"] == "call" for r in rows) == 2
    assert any(r["fqn"] == "lib.Tool" and r["context"] == "import" for r in rows)


def test_java_overloads_keep_two_rows():
    rows = java("class A { void f() {} void f(int x) {} }")
    assert sum(r["fqn"] == "A#f" for r in rows) == 2


def test_java_static_imports_and_local_methods():
    rows = java("package p;\nimport static u.Util.draw;\nimport static w.Wide.*;\nclass A { void own() {} void f() { draw(); own(); other(); } }")
    calls = [(r["fqn"], r["candidates"]) for r in rows if r["what"] == "ref" and r["context"] == "call"]
    assert calls == [("u.Util#draw", ["u.Util#draw"]), ("p.A#own", ["p.A#own"]), ("w.Wide#other", ["w.Wide#other"])]


def test_java_blocks_and_loops_shadow_fields():
    rows = java("class A { Out x; void f(java.util.List<In> l) { { In x = null; x.go(); } x.go(); for (In x : l) { x.go(); } x.go(); } }")
    targets = [r["fqn"] for r in rows if r["context"] == "call"]
    assert targets == ["In#go", "Out#go", "In#go", "Out#go"]


def test_java_try_catch_super_and_var():
    text = "class A extends B { R r; void f() { try (S r = null) { r.go(); } catch (E r) { r.go(); } finally { r.go(); } super.go(); var v = new V(); v.go(); } }"
    assert [r["fqn"] for r in java(text) if r["context"] == "call"] == ["S#go", "E#go", "R#go", "B#go", "V#go"]


def test_java_anonymous_classes_and_lambdas():
    rows = java("class A { Object o = new Object() { void inner() {} }; void f() { g(x -> x.a()); h((T t) -> t.b()); } }")
    assert any((r["owner_fqn"] or "").startswith("A.<anonymous@1:") for r in rows)
    assert any(r["fqn"] == "T#b" for r in rows)


def test_java_patterns_bind():
    assert [r["fqn"] for r in java("class A { void f(Object o) { if (o instanceof P p && p.ok()) { } } }") if r["context"] == "call"] == ["P#ok"]


def test_kotlin_call_at_line():
    from factloom.sources.syntax.kotlin_facts import KotlinFile, call_at_line

    f = KotlinFile("a.kt", SITES["nested.kt"])
    assert call_at_line(f, 7).name == "ActionButton" and call_at_line(f, 5).name == "SelectionContainer"
    with pytest.raises(ValueError):
        call_at_line(f, 1)


def test_java_bean_candidates():
    rows = java("class A { B b; void f() { b.getName(); b.issue(); } }")
    assert [r["candidates"] for r in rows if r["context"] == "call"] == [["B#getName", "B#name"], ["B#issue", "B#sue"]]


def test_java_errors_name_the_place(spark):
    with pytest.raises(SyntaxProblem):
        java("class A { void f() { ")
    with pytest.raises(Exception, match="src/Broken.java:2"):
        facts(spark, {"src/Broken.java": "class A {\n void f( { }\n}"}).collect()


# --- Kotlin and Java together


def targets(spark, kotlin, java=None, package="shop"):
    """Target of each qualified call and member, by receiver as written and name."""
    sources = {"k/Main.kt": f"package {package}\n{kotlin}"} | ({"j/Main.java": f"package {package};\n{java}"} if java else {})
    _, refs = index(spark, sources)
    out = {}
    for r in refs:
        if r["qualifier"] is not None:
            out.setdefault((r["qualifier"], r["referenced_name"]), set()).add(r["symbol_fqn"])
    return out


def test_what_a_call_returns_owns_the_next(spark):
    got = targets(spark, """
fun Till.pay() = till().close()
fun till(): Till? = null
class Till { fun close() {} }
fun more() {
    fun till() = guess()
    till().open()
    Till().sum()
    lent().back()
}
""")
    assert got == {("till()", "close"): {"shop.Till#close"}, ("Till()", "sum"): {"shop.Till#sum"}}


def test_safe_calls_use_the_type_without_its_mark(spark):
    got = targets(spark, "class Lamp(private val bulb: Bulb<Int>?) { fun shine() { bulb?.glow() } }")
    assert got == {("bulb", "glow"): {"shop.Bulb#glow"}}


def test_objects_own_their_calls(spark):
    got = targets(spark, "fun f() { Clock.tick(); Legacy.tock(); lower.beat() }\nobject Clock", "class Legacy { static void tock() {} }")
    assert got == {("Clock", "tick"): {"shop.Clock#tick"}, ("Legacy", "tock"): {"shop.Legacy#tock"}}


def test_super_is_the_class_before_interfaces(spark):
    got = targets(spark, """
class Dog : Named, Animal(4) { fun bark() { super.breathe(); super<Named>.call(); super.legs } }
class Cat : Named { fun meow() { super.call() } }
""")
    assert got == {("super", "breathe"): {"shop.Animal#breathe"}, ("super<Named>", "call"): {"shop.Named#call"}, ("super", "legs"): {"shop.Animal#legs"}, ("super", "call"): {"shop.Named#call"}}


def test_nested_types_go_before_those_of_the_package(spark):
    got = targets(
        spark,
        "class Part\nclass Bike { val part: Part = Part()\n fun ride() { part.turn() }\n inner class Part { fun turn() {} } }\nfun walk(part: Part) { part.turn() }",
        "class Cart { Axle axle; static class Axle { void spin() {} } void roll() { axle.spin(); } }",
    )
    assert got == {("part", "turn"): {"shop.Bike.Part#turn", "shop.Part#turn"}, ("axle", "spin"): {"shop.Cart.Axle#spin"}}


def test_members_through_this(spark):
    got = targets(spark, """
class Room(val door: Oak, window: Glass) {
    var lamp: Brass? = null
    fun enter(door: Pine) {
        this.door.open()
        door.open()
        this.lamp?.light()
        this.window.shut()
        this.lamp = null
        a.b.C.run()
    }
}
""")
    assert got[("this.door", "open")] == {"shop.Oak#open"} and got[("door", "open")] == {"shop.Pine#open"}
    assert got[("this", "lamp")] == {"shop.Room#lamp"} and got[("a.b.C", "run")] == {"a.b.C#run"}
    assert got[("this.lamp", "light")] == {"shop.Brass#light"} and ("this.window", "shut") not in got


def test_accessors_facades_and_writes(spark):
    symbols, refs = index(spark, {
        "k/Greeter.kt": '@file:JvmName("Greets")\npackage sample\nclass Greeter(var isOn: Boolean) {\n    val title: String = ""\n    fun flip() { this.isOn = !this.isOn\n        this.title }\n}\n@JvmName("hello")\nfun greet() {}\nfun plain() {}\n',
        "j/Caller.java": "package sample;\nclass Caller { Greeter g; void f() { g.getTitle(); g.setOn(true); Greets.hello(); } }\n",
    })
    by = {s["fqn"]: s for s in symbols}
    assert by["sample.Greeter#isOn"]["aliases"] == ["sample.Greeter#isOn", "sample.Greeter#setOn"]
    assert by["sample.Greeter#title"]["aliases"] == ["sample.Greeter#getTitle"]
    assert by["sample.greet"]["aliases"] == ["sample.Greets#hello"] and by["sample.plain"]["aliases"] == ["sample.Greets#plain"]
    assert has(refs, "sample.Greeter#isOn", context="member-write", qualifier="this")
    assert has(refs, "sample.Greeter#isOn", context="member") and has(refs, "sample.Greeter#title", context="member")
    write = next(r for r in refs if r["context"] == "member-write")
    assert write["candidate_symbol_fqns"] == ["sample.Greeter#isOn", "sample.Greeter#getIsOn", "sample.Greeter#setOn"]
    assert any("sample.Greeter#title" in r["candidate_symbol_fqns"] for r in refs if r["language"] == "java")


def test_inheritance_across_languages(spark):
    _, refs = index(spark, {
        "a/JavaBase.java": "package sample;\nclass JavaBase { void hook() {} }\n",
        "k/KotlinChild.kt": "package sample\nclass KotlinChild : JavaBase() { fun f() { hook() } }\nopen class KotlinBase { fun base() {} }\n",
        "z/JavaChild.java": "package sample;\nclass JavaChild extends KotlinBase { void f() { base(); } }\nclass Other extends JavaBase { void g() { hook(); } }\n",
    })
    assert has(refs, "sample.JavaBase#hook", relative_file="k/KotlinChild.kt")
    assert has(refs, "sample.JavaBase#hook", relative_file="z/JavaChild.java")
    own = next(r for r in refs if r["symbol_fqn"] == "sample.JavaChild#base")
    assert "sample.KotlinBase#base" in own["candidate_symbol_fqns"]
    assert not has(refs, "sample.KotlinBase#base")


def test_packages_parameters_and_imports(spark):
    _, refs = index(spark, {
        "k/One.kt": "package one\nfun help() {}\nfun f(x: A) { help()\n x.go() }\nfun g(x: B) { x.go() }\n",
        "k/Two.kt": "package two\nfun help() {}\nfun f() { help() }\n",
        "k/Three.kt": "package three\nimport one.help as aid\nimport lib.Thing as Stuff\nfun f(s: Stuff) { aid()\n s.go()\n nothing() }\n",
    })
    assert has(refs, "one.help", relative_file="k/One.kt") and has(refs, "two.help", relative_file="k/Two.kt")
    assert has(refs, "one.A#go") and has(refs, "one.B#go")
    assert has(refs, "one.help", relative_file="k/Three.kt", candidate_symbol_fqns=["one.help", "one#help"]) and has(refs, "lib.Thing#go")
    assert not any(r["referenced_name"] == "nothing" for r in refs)


def test_scopes(spark):
    symbols, refs = index(spark, {
        "k/Scopes.kt": """package s
class Outer(arg: Early, val held: Held) {
    val first = arg.go()
    init { arg.go() }
    val member: Member = Member()
    fun f(held: Param) {
        this.held.call()
        held.call()
        member.call()
        arg.go()
        list.forEach { item: Item -> item.call() }
        try { } catch (e: Oops) { e.call() }
        for (n: Number in list) { n.call() }
        val late: Late = Late()
        late.call()
        val o = object : Runnable { fun run2() {} }
    }
    val untyped = make()
    fun g() { untyped.call() }
    companion object {
        val member: Inner = Inner()
        fun h() { member.call() }
    }
}
""",
    })
    for kind in ("Held", "Param", "Member", "Item", "Oops", "Number", "Late", "Inner"):
        assert has(refs, f"s.{kind}#call"), kind
    assert sum(r["symbol_fqn"] == "s.Early#go" for r in refs) == 2
    assert not any(r["qualifier"] == "untyped" for r in refs)
    names = {s["fqn"] for s in symbols}
    assert "s.Outer#late" not in names and "s.Outer#held" in names and "s.Outer#arg" not in names
    assert any(s.startswith("s.Outer.<anonymous@") and s.endswith("#run2") for s in names)


def test_kotlin_never_fails(spark):
    odd = ["fun (", "class {{{", "val x = \"${a\"", "}}}", "@", "import", "fun f() { if (a) else }", "when (", "\"\"\"", "a?.b!!.c<D>(e) { f -> g }[h]++", "fun <T : A<B>> T.x(y: (Int) -> Unit = {}) = y(1)"]
    facts(spark, {f"k/{i}.kt": t for i, t in enumerate(odd)}, sites=True).collect()


# --- selection sites

SITES = {
    "nested.kt": "package x\n\n@Composable\nfun Prompt() {\n    SelectionContainer {\n        SelectionContainer {\n            ActionButton()\n        }\n    }\n}\n",
    "disabled.kt": "package x\n\n@Composable\nfun Panel() {\n    SelectionContainer {\n        DisableSelection {\n            ActionButton()\n        }\n    }\n}\n",
    "none.kt": "package x\n\n@Composable\nfun Plain() {\n    ActionButton()\n}\n",
    "helper.kt": "package x\n\n@Composable\nfun Help() {\n    SelectionContainer {\n        fun aid() {\n            ActionButton()\n        }\n        aid()\n    }\n}\n",
    "alias.kt": "package x\n\nimport c.SelectionContainer as SC\n\n@Composable\nfun Alias() {\n    SC {\n        ActionButton()\n    }\n}\n",
    "wrapper.kt": "package x\n\n@Composable\nfun Mark() {\n    Markdown(selectable = true) {\n        Text()\n    }\n}\n",
}


def test_sites(spark):
    found = {r.file: r for r in sites_of(facts(spark, SITES, sites=True), "c0").collect() if r.callee != "Markdown"}
    got = {f: (r.line, r.column, r.callee, r.selection_container_count, r.excluded_by_disable_selection, r.confidence, [c.line for c in r.selection_containers]) for f, r in found.items()}
    assert got == {
        "nested.kt": (7, 13, "ActionButton", 2, False, "lexical", [6, 5]),
        "disabled.kt": (7, 13, "ActionButton", 1, True, "lexical", [5]),
        "none.kt": (5, 5, "ActionButton", 0, False, "lexical", []),
        "helper.kt": (7, 13, "ActionButton", 1, False, "lexical", [5]),
        "alias.kt": (8, 9, "ActionButton", 1, False, "lexical", [7]),
        "wrapper.kt": (6, 9, "Text", 2, False, "caller-chain", [5, 5]),
    }
    assert found["disabled.kt"].disable_selection.line == 6 and found["disabled.kt"].disable_selection.function == "Panel"


# --- XML


def test_xml_values_and_layout():
    values = xml('<resources>\n  <string name="title">@string/app_name</string>\n  <item type="color" name="accent">#fff</item>\n  <string-array name="days"/>\n</resources>', "app/src/main/res/values-de/strings.xml")
    assert {(r["fqn"], r["line"]) for r in values if r["what"] == "symbol"} == {("res:string:title", 2), ("res:color:accent", 3), ("res:array:days", 4)}
    assert [r["fqn"] for r in values if r["what"] == "ref"] == ["res:string:app_name"]
    layout = xml('<L xmlns:a="x"\n  a:id="@+id/box"\n  a:text="@string/title" a:color="?android:attr/tint"/>', "app/src/main/res/layout/main.xml")
    assert [(r["fqn"], r["line"]) for r in layout if r["what"] == "symbol"] == [("res:layout:main", 1), ("res:id:box", 3)]
    assert [(r["fqn"], r["qualifier"]) for r in layout if r["what"] == "ref"] == [("res:string:title", "string"), ("res:android:attr:tint", "android:attr")]


def test_xml_errors_and_entities():
    with pytest.raises(ValueError, match="r/res/values/a.xml"):
        xml("<a><b></a>", "r/res/values/a.xml")
    with pytest.raises(ValueError, match="evil.xml"):
        xml('<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><a>&x;</a>', "evil.xml")


@pytest.mark.parametrize(("path", "fqn"), [("res/layout/a.xml", "res:layout:a"), ("m/feature_res/menu/b.xml", "res:menu:b"), ("m/response/menu/c.xml", None)])
def test_xml_paths(path, fqn):
    assert [r["fqn"] for r in xml("<a/>", path)] == ([fqn] if fqn else [])


def test_resources_on_one_line_collapse(spark):
    rows = symbols_of(facts(spark, {"res/values/a.xml": '<r><string name="a"/><string name="a"/></r>'}))
    assert rows.filter(F.col("ns") == "res").count() == 1
