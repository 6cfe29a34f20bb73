"""Queries over small fixed sources, whose expected rows are spelled out as SQL: readers, resolution, topology and builds.

They show what the readers make of each kind of source; the queries of the catalogue run the relational operators over tables.
"""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import RESOURCE_REFERENCE
from factloom.operators import lookup as L
from factloom.operators.shared import shared_dir
from factloom.plans.config import SelectionRules
from factloom.plans.extract import SYMBOLS, extract, resolve_references, sites_of, symbols_of
from factloom.plans.index import build
from factloom.plans.progress import BuildProgress
from factloom.plans.registry import REGISTRY
from factloom.sources import topology as T
from factloom.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def golden(columns: str, *rows: tuple):
    """columns: Spark DDL. rows: what the query gives, in any order."""
    names = [c.strip().split(" ") for c in columns.split(",")]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    typed = ", ".join(f"{n}::{kinds[k]} AS {n}" for n, k in names)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)

    def add(f: Callable[[SparkSession], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLES[f.__name__] = f"SELECT {typed} FROM (VALUES {values}) t({', '.join(n for n, _ in names)})"
        return f

    return add


def facts(spark: SparkSession, sources: dict[str, str], rules: SelectionRules | None = None) -> DataFrame:
    files = spark.createDataFrame([(p, t, True, p.endswith(".kt")) for p, t in sources.items()], "relative_file string, content string, changed boolean, sites boolean")
    return extract(files, REGISTRY.for_applications(["selection-context"], rules))


def references(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    refs = resolve_references(facts(spark, sources), spark.createDataFrame([], SYMBOLS))
    return refs.select(F.col("relative_file").alias("file"), "line", "context", F.col("qualifier").alias("q"), F.col("symbol_fqn").alias("target"), F.array_join("candidate_symbol_fqns", " ").alias("candidates"))


def calls(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return references(spark, sources).filter("context = 'call'").select("line", "q", "target")


def symbols(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return symbols_of(facts(spark, sources)).select("line", F.col("column").alias("col"), "kind", "name", "fqn", F.col("owner_fqn").alias("owner"), "signature", "arity")


# --- Java ----------------------------------------------------------------------------------------------------------------

SHOP = """package shop;
import lib.Tool;
import lib.more.*;
import static lib.Maths.half;
import static lib.Wide.*;
class Shop extends Base {
  Tool tool; int count;
  static class Shelf { void fill() {} }
  Shop(int n) {}
  void open(String who, int n) {
    half(n);
    open("x", 1);
    spread();
  }
  void serve() {
    tool.run();
    var made = new Shelf();
    made.fill();
    new Tool().stop();
    this.tool.getName();
    super.close();
    a.b.C.run();
  }
  void scopes() {
    { Other tool = null; tool.go(); }
    for (Item tool : things) { tool.pick(); }
    try (Res tool = null) { tool.read(); } catch (Oops tool) { tool.tell(); } finally { tool.run(); }
    list.each((Item it) -> it.pick());
    tool.run();
  }
}
"""


@golden("line int, target string, context string", (2, "lib.Tool", "import"), (3, "lib.more.*", "import"), (4, "lib.Maths#half", "import"), (5, "lib.Wide.*", "import"))
def java_imports(spark):
    return references(spark, {"j/Shop.java": SHOP}).filter("context = 'import'").select("line", "target", "context")


@golden(
    "line int, col int, kind string, name string, fqn string, owner string, signature string, arity int",
    (6, 1, "class", "Shop", "shop.Shop", None, None, None),
    (7, 3, "field", "tool", "shop.Shop#tool", "shop.Shop", None, None),
    (7, 14, "field", "count", "shop.Shop#count", "shop.Shop", None, None),
    (8, 3, "class", "Shelf", "shop.Shop.Shelf", "shop.Shop", None, None),
    (8, 24, "method", "fill", "shop.Shop.Shelf#fill", "shop.Shop.Shelf", "()", 0),
    (9, 3, "constructor", "Shop", "shop.Shop#<init>", "shop.Shop", "(int)", 1),
    (10, 3, "method", "open", "shop.Shop#open", "shop.Shop", "(String, int)", 2),
    (15, 3, "method", "serve", "shop.Shop#serve", "shop.Shop", "()", 0),
    (24, 3, "method", "scopes", "shop.Shop#scopes", "shop.Shop", "()", 0),
)
def java_symbols(spark):
    return symbols(spark, {"j/Shop.java": SHOP})


@golden("line int, q string, target string", (11, None, "lib.Maths#half"), (12, None, "shop.Shop#open"), (13, None, "lib.Wide#spread"))
def java_unqualified_calls(spark):
    return calls(spark, {"j/Shop.java": SHOP}).filter("q is null")


@golden(
    "line int, q string, target string",
    (16, "tool", "lib.Tool#run"), (18, "made", "shop.Shop.Shelf#fill"), (19, "new Tool()", "lib.Tool#stop"), (20, "this.tool", "lib.Tool#getName"),
    (21, "super", "shop.Base#close"), (22, "a.b.C", "a.b.C#run"),
)
def java_receivers(spark):
    return calls(spark, {"j/Shop.java": SHOP}).filter("q is not null and line < 24")


@golden(
    "line int, q string, target string",
    (25, "tool", "shop.Other#go"), (26, "tool", "shop.Item#pick"), (27, "tool", "shop.Res#read"), (27, "tool", "shop.Oops#tell"), (27, "tool", "lib.Tool#run"),
    (28, "list", "shop.list#each"), (28, "it", "shop.Item#pick"), (29, "tool", "lib.Tool#run"),
)
def java_scopes(spark):
    return calls(spark, {"j/Shop.java": SHOP}).filter("line > 24")


@golden("target string, candidates string", ("lib.Tool#getName", "lib.Tool#getName lib.Tool#name"), ("lib.Tool#stop", "lib.Tool#stop"))
def java_bean_candidates(spark):
    return references(spark, {"j/Shop.java": SHOP}).filter("target in ('lib.Tool#getName', 'lib.Tool#stop')").select("target", "candidates")


@golden("line int, q string, target string", (2, None, "p.Top#hook"), (3, None, "p.Low#own"), (4, None, "p.Low#none"))
def java_inherited_calls(spark):
    """A method of a known superclass goes before one that only might be the class's own."""
    low = "package p;\nclass Low extends Top { void f() { hook(); }\n void g() { own(); } void own() {}\n void h() { none(); } }\n"
    return calls(spark, {"a/Top.java": "package p;\nclass Top { void hook() {} }\n", "b/Low.java": low})


@golden("kind string, fqn string, owner string", ("class", "A", None), ("field", "A#o", "A"), ("method", "A.<anonymous@#>#inner", "A.<anonymous@#>"))
def java_anonymous_classes(spark):
    found = symbols(spark, {"A.java": "class A { Object o = new Object() { void inner() {} }; }"})
    place = lambda c: F.regexp_replace(c, r"@\d+:\d+", "@#").alias(c)
    return found.select("kind", place("fqn"), place("owner"))


# --- Kotlin --------------------------------------------------------------------------------------------------------------

ZOO = """@file:JvmName("Zoos")
package zoo
import lib.Food as Feed
import lib.open
import lib.wild.*
interface Loud
open class Animal(val name: String, age: Int) { open fun eat() {} }
class Dog(var isGood: Boolean) : Loud, Animal("x", 1) {
    val tail: Tail = Tail()
    var collar: Collar? = null
    class Tail { fun wag() {} }
    fun bark() {
        super.eat()
        this.eat()
        tail.wag()
        eat()
        bark()
        open()
        nowhere()
    }
    companion object { val pack: Pack = Pack() }
}
object Keeper { fun feed() {} }
@JvmName("count") fun size(of: List<Dog>, n: Int): Tail = Tail()
fun helper() {}
val total: Int = 3
fun tour(dog: Dog, feed: Feed<Int>?) {
    dog.bark()
    feed?.give()
    Keeper.feed()
    size(a, 1).wag()
    helper()
    val late: First = First()
    late.go()
    val late2 = unknown
    late2.go()
    try { } catch (e: Oops) { e.tell() }
    for (i: Item in items) { i.pick() }
    xs.map { x: Elem -> x.use() }
    dog.isGood = dog.isGood
    dog.collar++
}
"""


@golden(
    "line int, col int, kind string, name string, fqn string, owner string, signature string, arity int",
    (6, 1, "interface", "Loud", "zoo.Loud", None, None, None),
    (7, 1, "class", "Animal", "zoo.Animal", None, None, None),
    (7, 19, "property", "name", "zoo.Animal#name", "zoo.Animal", "String", None),
    (7, 49, "function", "eat", "zoo.Animal#eat", "zoo.Animal", "()", 0),
    (8, 1, "class", "Dog", "zoo.Dog", None, None, None),
    (8, 11, "property", "isGood", "zoo.Dog#isGood", "zoo.Dog", "Boolean", None),
    (9, 5, "property", "tail", "zoo.Dog#tail", "zoo.Dog", "Tail", None),
    (10, 5, "property", "collar", "zoo.Dog#collar", "zoo.Dog", "Collar?", None),
    (11, 5, "class", "Tail", "zoo.Dog.Tail", "zoo.Dog", None, None),
    (11, 18, "function", "wag", "zoo.Dog.Tail#wag", "zoo.Dog.Tail", "()", 0),
    (12, 5, "function", "bark", "zoo.Dog#bark", "zoo.Dog", "()", 0),
    (21, 24, "property", "pack", "zoo.Dog.Companion#pack", "zoo.Dog.Companion", "Pack", None),
    (23, 17, "function", "feed", "zoo.Keeper#feed", "zoo.Keeper", "()", 0),
    (24, 1, "function", "size", "zoo.size", None, "(List<Dog>, Int)", 2),
    (25, 1, "function", "helper", "zoo.helper", None, "()", 0),
    (26, 1, "property", "total", "zoo.total", None, "Int", None),
    (27, 1, "function", "tour", "zoo.tour", None, "(Dog, Feed<Int>?)", 2),
)
def kotlin_symbols(spark):
    return symbols(spark, {"k/Zoo.kt": ZOO})


@golden(
    "fqn string, aliases string",
    ("zoo.size", "zoo.Zoos#count"), ("zoo.helper", "zoo.Zoos#helper"), ("zoo.total", "zoo.Zoos#getTotal"), ("zoo.Dog#isGood", "zoo.Dog#isGood zoo.Dog#setGood"),
    ("zoo.Dog#tail", "zoo.Dog#getTail"), ("zoo.Dog#collar", "zoo.Dog#getCollar zoo.Dog#setCollar"),
)
def kotlin_aliases(spark):
    wanted = "fqn in ('zoo.size', 'zoo.helper', 'zoo.total', 'zoo.Dog#isGood', 'zoo.Dog#tail', 'zoo.Dog#collar')"
    return symbols_of(facts(spark, {"k/Zoo.kt": ZOO})).filter(wanted).select("fqn", F.array_join("aliases", " ").alias("aliases"))


@golden("line int, q string, target string", (16, None, "zoo.Animal#eat"), (17, None, "zoo.Dog#bark"), (18, None, "lib.open"))
def kotlin_unqualified_calls(spark):
    """Of the class, of its superclass, imported; what nothing explains gives no row."""
    return calls(spark, {"k/Zoo.kt": ZOO}).filter("q is null and line between 13 and 19")


@golden(
    "line int, q string, target string",
    (13, "super", "zoo.Animal#eat"), (14, "this", "zoo.Dog#eat"), (15, "tail", "zoo.Dog.Tail#wag"), (28, "dog", "zoo.Dog#bark"), (29, "feed", "lib.Food#give"),
    (30, "Keeper", "zoo.Keeper#feed"), (31, "size(a, 1)", "zoo.Tail#wag"),
)
def kotlin_receivers(spark):
    return calls(spark, {"k/Zoo.kt": ZOO}).filter("q is not null and line <= 31")


@golden("line int, q string, target string", (34, "late", "zoo.First#go"), (37, "e", "zoo.Oops#tell"), (38, "i", "zoo.Item#pick"), (39, "x", "zoo.Elem#use"))
def kotlin_scopes(spark):
    """Types of locals, catch, loop and lambda parameters; a local without a type gives no row."""
    return calls(spark, {"k/Zoo.kt": ZOO}).filter("q in ('late', 'late2', 'e', 'i', 'x')")


@golden(
    "line int, context string, target string, candidates string",
    (40, "member-write", "zoo.Dog#isGood", "zoo.Dog#isGood zoo.Dog#getIsGood zoo.Dog#setGood"),
    (40, "member", "zoo.Dog#isGood", "zoo.Dog#isGood zoo.Dog#getIsGood"),
    (41, "member-write", "zoo.Dog#collar", "zoo.Dog#collar zoo.Dog#getCollar zoo.Dog#isCollar zoo.Dog#setCollar"),
)
def kotlin_members(spark):
    return references(spark, {"k/Zoo.kt": ZOO}).filter("context like 'member%' and line >= 40").select("line", "context", "target", "candidates")


@golden("line int, q string, target string", (4, "a", "s.First#go"), (6, "a", "s.Second#go"), (9, "a", "s.Field#go"))
def kotlin_last_declaration_before(spark):
    """In a block the last declaration before the use counts; behind the block, what stands around it."""
    text = "package s\nclass C(val a: Field) { fun f() { run {\n val a: First = x\n a.go()\n val a: Second = x\n a.go()\n val a: Third = x\n }\n a.go()\n} }\n"
    return calls(spark, {"k/S.kt": text}).filter("q = 'a'")


@golden("line int, q string, target string", (2, "make()", "s.Box#open"), (4, "make()", "s.Crate#open"), (5, "Box()", "s.Box#open"), (6, "box", "s.Outer.Box#shut"))
def kotlin_returned_and_nested_types(spark):
    text = "package s\nfun f() { make().open() }\nfun make(): Box = Box()\nclass D { fun make(): Crate = x\n fun g() { make().open() } }\nfun h() { Box().open() }\nclass Outer { class Box\n val box: Box = Box()\n fun k() { box.shut() } }\n"
    return calls(spark, {"k/S.kt": text.replace("fun make(): Crate = x\n fun g()", "fun make(): Crate = x; fun g()").replace("class Box\n val box: Box = Box()\n fun k()", "class Box; val box: Box = Box(); fun k()")}).filter("q is not null")


@golden("line int, q string, target string", (3, "this.a", "s.Kept#go"), (4, "a", "s.Given#go"), (6, "c", "s.Early#go"))
def kotlin_self_properties(spark):
    """A property through `this`; a parameter before it by its bare name; a constructor parameter only where the class is made."""
    text = "package s\nclass P(val a: Kept, c: Early) {\n fun f(a: Given) { this.a.go()\n a.go()\n c.go() }\n init { c.go() }\n}\n"
    return calls(spark, {"k/S.kt": text}).filter("q is not null and (q <> 'c' or line = 6 or target = 's.Early#go')")


@golden("file string, target string", ("k/Low.kt", "p.Top#hook"), ("j/Caller.java", "p.Low#getSize"))
def references_across_languages(spark):
    sources = {
        "a/Top.java": "package p;\nclass Top { void hook() {} }\n",
        "k/Low.kt": "package p\nclass Low(val size: Int) : Top() { fun f() { hook() } }\n",
        "j/Caller.java": "package p;\nclass Caller { Low low; void g() { low.getSize(); } }\n",
    }
    return references(spark, sources).filter("context = 'call'").select("file", "target")


@golden("file string, line int, context string", ("j/Caller.java", 2, "call"), ("k/Use.kt", 2, "member"))
def references_of_a_property(spark):
    """By the name of the property: Java's getter and Kotlin's access both refer to it."""
    sources = {"k/Low.kt": "package p\nclass Low(val size: Int)\n", "k/Use.kt": "package p\nfun f(low: Low) { low.size }\n", "j/Caller.java": "package p;\nclass Caller { Low low; void g() { low.getSize(); } }\n"}
    found = facts(spark, sources)
    rows = L.find_references(symbols_of(found), resolve_references(found, spark.createDataFrame([], SYMBOLS)), "p.Low#size")
    return rows.select(F.col("relative_file").alias("file"), "line", "context")


# --- XML -----------------------------------------------------------------------------------------------------------------

VALUES = '<resources>\n  <string name="title">@string/app</string>\n  <item type="color" name="dark">#000</item>\n  <string-array name="days"><item>@string/mon</item></string-array>\n  <style name="S"><item name="x">?attr/y</item></style>\n</resources>'
LAYOUT = '<L xmlns:a="x"\n  a:id="@+id/box"\n  a:text="@string/title"\n  a:tint="?android:attr/tint">\n  <T a:ref="@id/box">@color/dark</T>\n</L>'


@golden(
    "file string, line int, fqn string, aliases string",
    ("m/src/main/res/values/v.xml", 2, "res:string:title", "@string/title"), ("m/src/main/res/values/v.xml", 3, "res:color:dark", "@color/dark"),
    ("m/src/main/res/values/v.xml", 4, "res:array:days", "@array/days"), ("m/src/main/res/values/v.xml", 5, "res:style:S", "@style/S"),
    ("m/src/main/res/layout/main.xml", 1, "res:layout:main", "@layout/main"), ("m/src/main/res/layout/main.xml", 4, "res:id:box", "@id/box"),
)
def xml_resources(spark):
    """What a start tag defines stands where the tag ends."""
    found = symbols_of(facts(spark, {"m/src/main/res/values/v.xml": VALUES, "m/src/main/res/layout/main.xml": LAYOUT, "m/src/main/response/layout/no.xml": "<a/>"}))
    return found.select(F.col("relative_file").alias("file"), "line", "fqn", F.array_join("aliases", " ").alias("aliases"))


@golden(
    "target string, q string",
    ("res:string:app", "string"), ("res:string:mon", "string"), ("res:attr:y", "attr"), ("res:string:title", "string"), ("res:android:attr:tint", "android:attr"),
    ("res:id:box", "id"), ("res:color:dark", "color"),
)
def xml_references(spark):
    return references(spark, {"m/src/main/res/values/v.xml": VALUES, "m/src/main/res/layout/main.xml": LAYOUT}).select("target", "q")


@golden("plus string, package string, kind string, name string", ("", "", "string", "a"), ("+", "", "id", "b"), ("", "android", "attr", "c.d"))
def resource_pattern(spark):
    texts = spark.createDataFrame([("see @string/a, @+id/b and ?android:attr/c.d; not @here or a/b",)], "t string")
    m = texts.select(F.explode(F.regexp_extract_all("t", F.lit(RESOURCE_REFERENCE), F.lit(0))).alias("m"))
    return m.select(*[F.regexp_extract("m", RESOURCE_REFERENCE, i).alias(n) for i, n in enumerate(("plus", "package", "kind", "name"), 1)])


# --- selection sites -----------------------------------------------------------------------------------------------------

SCREENS = """package x
import c.SelectionContainer as Pick
@Composable
fun Screen() {
    Pick {
        SelectionContainer { Tap() }
        DisableSelection { Tap() }
        fun aid() { Tap() }
        aid()
    }
    Markdown(selectable = true) { Text() }
    Markdown(selectable = false) { Text() }
    Tap()
}
fun plain() { Tap() }
"""


@golden(
    "line int, col int, callee string, n int, excluded boolean, confidence string, containers string",
    (6, 30, "Tap", 2, False, "lexical", "6 5"), (7, 28, "Tap", 1, True, "lexical", "5"), (8, 21, "Tap", 1, False, "lexical", "5"),
    (11, 5, "Markdown", 0, False, "lexical", ""), (11, 35, "Text", 2, False, "caller-chain", "11 11"),
    (12, 5, "Markdown", 0, False, "lexical", ""), (12, 36, "Text", 0, False, "lexical", ""), (13, 5, "Tap", 0, False, "lexical", ""),
)
def selection_sites(spark):
    lines = F.array_join(F.transform("selection_containers", lambda c: c["line"].cast("string")), " ")
    found = sites_of(facts(spark, {"k/Screen.kt": SCREENS}), "c0")
    return found.select("line", F.col("column").alias("col"), "callee", F.col("selection_container_count").alias("n"), F.col("excluded_by_disable_selection").alias("excluded"), "confidence", lines.alias("containers"))


@golden("line int, n int, excluded boolean", (4, 1, False), (5, 2, False), (6, 1, True), (7, 0, False))
def selection_rules(spark):
    """Names, annotation and wrappers of the caller's own."""
    rules = SelectionRules(frozenset(("Group",)), frozenset(("Drop",)), "Shown", (("Wrap", "on", "1"),))
    text = "package x\n@Shown\nfun f() {\n Group { Tap() }\n Wrap(on = 1) { Tap() }\n Group { Drop { Tap() } }\n SelectionContainer { Tap() }\n}\n@Composable\nfun g() { Group { Tap() } }\n"
    found = sites_of(facts(spark, {"k/F.kt": text}, rules), "c0").filter("callee = 'Tap'")
    return found.select("line", F.col("selection_container_count").alias("n"), F.col("excluded_by_disable_selection").alias("excluded"))


@golden("line int, callee string", (5, "Pick"), (6, "Tap"), (7, "Tap"), (9, "aid"))
def selection_call_at_line(spark):
    from factloom.sources.syntax.kotlin_facts import KotlinFile, call_at_line

    f = KotlinFile("k/Screen.kt", SCREENS)
    return spark.createDataFrame([(n, call_at_line(f, n).name) for n in (5, 6, 7, 9)], "line int, callee string")


# --- topology ------------------------------------------------------------------------------------------------------------


def _list(spark: SparkSession, column: str, values) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k int, {column} string")


@golden("k int, module string", (0, ":ui"), (1, ":core"), (2, ":tools"))
def settings_includes(spark):
    return _list(spark, "module", T.settings_includes('include(":ui", ":core")\ninclude(project(":tools"))\ninclude(":ui")\ninclude \':no\'\n'))


@golden("k int, module string", (0, ":core"), (1, ":net"), (2, ":fake"))
def gradle_dependencies(spark):
    text = 'implementation(project(":core"))\napi( project( ":net" ) )\ntestImplementation(project(":fake"))\nimplementation("x:y:1")\nkapt(project(":no"))\napi(project(":core"))\n'
    return _list(spark, "module", T.project_dependencies(text))


def _workspace(files: dict[str, str]) -> Path:
    """A folder of the driver's own, whose build files only the driver reads."""
    root = Path(tempfile.mkdtemp(prefix="factloom-golden-"))
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def _from_workspace(files: dict[str, str], look: Callable[[Path], list]) -> list:
    root = _workspace(files)
    try:
        return look(root)
    finally:
        shutil.rmtree(root)


GRADLE = {
    "settings.gradle.kts": 'include(":ui", ":core", ":far")\n',
    "ui/build.gradle.kts": 'implementation(project(":core"))\n',
    "core/build.gradle.kts": 'api(project(":ui"))\napi(project(":far"))\napi(project(":out"))\n',
    "ui/src/main/kotlin/a/A.kt": "",
    "ui/src/main/java/B.java": "",
    "ui/src/main/res/layout/c.xml": "",
    "ui/src/main/kotlin/c.xml": "",
    "ui/src/androidTest/kotlin/T.kt": "",
    "core/src/main/kotlin/C.kt": "",
    "far/src/debug/java/D.kt": "",
}


@golden("k int, file string", (0, "ui/src/main/java/B.java"), (1, "ui/src/main/kotlin/a/A.kt"), (2, "ui/src/main/res/layout/c.xml"))
def gradle_module_sources(spark):
    return _list(spark, "file", _from_workspace(GRADLE, lambda root: T.gradle_sources(root, "ui", False).files))


@golden(
    "k int, file string",
    (0, "core/src/main/kotlin/C.kt"), (1, "far/src/debug/java/D.kt"), (2, "ui/src/main/java/B.java"), (3, "ui/src/main/kotlin/a/A.kt"), (4, "ui/src/main/res/layout/c.xml"),
)
def gradle_sources_with_dependencies(spark):
    """Only included modules are followed, cycles or not."""
    return _list(spark, "file", _from_workspace(GRADLE, lambda root: T.gradle_sources(root, ":ui", True).files))


BUILD = """
lib(
    name = "x",  # srcs = ["no.kt"]
    srcs = ["foo#bar.kt", 'One.kt', "gen.sh"] + glob(["src/**/*.kt"], exclude = ["src/**/*Test.kt"]) + glob(
        include = ["more/*.java"],
        exclude = glob(["more/Skip*.java"]),
    ),
    resource_files = glob(["res/**/*.xml"]) + ["extra/a.xml",
        # "extra/gone.xml",
    ]
)
lib(srcs = glob(["none/**/*.kt"]))
"""
BAZEL = {f"p/{f}": "" for f in ("src/A.kt", "src/d/B.kt", "src/ATest.kt", "src/sub/BUILD", "src/sub/C.kt", "more/M.java", "more/Skip1.java", "res/l/a.xml")} | {"p/BUILD.bazel": BUILD, "WORKSPACE": ""}


@golden(
    "k int, file string",
    (0, "p/src/A.kt"), (1, "p/src/d/B.kt"), (2, "p/more/M.java"), (3, "p/foo#bar.kt"), (4, "p/One.kt"), (5, "p/extra/a.xml"), (6, "p/res/l/a.xml"),
)
def build_file_sources(spark):
    """Globs less what they exclude and what other packages own, literals, resources; comments don't count."""
    return _list(spark, "file", _from_workspace(BAZEL, lambda root: T.build_file_sources(root / "p/BUILD.bazel", root)[0]))


@golden("k int, warning string", (0, "BUILD glob 'none/**/*.kt' under p matched no indexable files"))
def build_file_warnings(spark):
    return _list(spark, "warning", _from_workspace(BAZEL, lambda root: T.build_file_sources(root / "p/BUILD.bazel", root)[1]))


@golden(
    "how string, topology string, deps boolean, files string",
    ("query", "bazel-query", True, "a/B.kt"), ("fallback", "bazel-query", False, "a/C.java"), ("injected", "bazel-query", True, "a/D.xml"),
)
def bazel_queries(spark):
    def narrow(query, _):
        return (1, []) if query.startswith("kind") else (0, ["//a:C.java"])

    found = {
        "query": T.bazel_sources(Path(), "//a:a", runner=lambda *_: (0, ["//a:B.kt", "//a:no.txt", "@x//a:B.kt"])),
        "fallback": T.bazel_sources(Path(), "//a:a", runner=narrow, warn=lambda _: None),
        "injected": T.bazel_sources(Path(), "//a:a", executor=lambda *_: [" //a:D.xml"]),
    }
    return spark.createDataFrame([(k, s.topology, s.include_deps, " ".join(s.files)) for k, s in found.items()], "how string, topology string, deps boolean, files string")


@golden("section string, value string", ("directories", "."), ("directories", "a/b"), ("targets", "//a:b"))
def project_view(spark):
    held = T.bazel_project("directories:\n  .\n  # no\n  a/b\n\ntargets:\n  //a:b\n")
    return spark.createDataFrame([(s, v) for s, vs in held.items() for v in vs], "section string, value string")


@golden("files string, system string", ("MODULE.bazel settings.gradle", "bazel"), ("WORKSPACE.bazel", "bazel"), ("settings.gradle", "gradle"), ("settings.gradle.kts", "gradle"), ("pom.xml", None))
def build_systems(spark):
    names = ("MODULE.bazel settings.gradle", "WORKSPACE.bazel", "settings.gradle", "settings.gradle.kts", "pom.xml")
    rows = [(n, _from_workspace(dict.fromkeys(n.split(" "), ""), lambda root: [T.detect(root)])[0]) for n in names]
    return spark.createDataFrame(rows, "files string, system string")


@golden("k int, producer string", (0, "java-source"), (1, "kotlin-psi-symbols"), (2, "xml-resources"), (3, "selection-context"), (4, "file-hash"))
def producers_of_applications(spark):
    return _list(spark, "producer", [p.id for p in REGISTRY.for_applications(["unknown", "selection-context"])])


# --- builds --------------------------------------------------------------------------------------------------------------


_stores: dict[tuple, tuple[str, list[str]]] = {}


def _built(spark: SparkSession, *versions: dict[str, str]) -> tuple[Store, list[str]]:
    """A store in the shared folder after a build of each version of the sources (once an application), and what the builds told."""
    at = (spark.sparkContext.applicationId, *(tuple(v.items()) for v in versions))
    if at not in _stores:
        where, lines = f"{shared_dir(spark)}/golden-{uuid.uuid4().hex}", []
        for files in versions:
            rows = spark.createDataFrame(list(files.items()), "relative_file string, content string")
            build(spark, where, "c", T.SourceSet(tuple(files), "gradle-parse", False, ":"), files=rows, progress=BuildProgress(lines.append))
        _stores[at] = where, lines
    where, lines = _stores[at]
    return Store(spark, where, "c"), lines


def _events(spark: SparkSession, fields: str, *versions: dict[str, str]) -> DataFrame:
    lines = [(x,) for x in _built(spark, *versions)[1]]
    return spark.createDataFrame(lines, "line string").select(F.from_json("line", f"event string, {fields}").alias("e")).select("e.*")


ONE = {"a.kt": "package p\nfun a() { help() }\n", "b.kt": "package p\nfun help() {}\n", "c.kt": "package p\nfun c() {}\n"}
TWO = {"a.kt": "package p\nfun a2() { help() }\n", "b.kt": ONE["b.kt"]}


@golden("fqn string, file string", ("p.a2", "a.kt"), ("p.help", "b.kt"))
def incremental_symbols(spark):
    return _built(spark, ONE, TWO)[0].table("symbols").select("fqn", F.col("relative_file").alias("file"))


@golden("target string, file string", ("p.help", "a.kt"))
def incremental_references(spark):
    """What did not change is not read again, and is still found."""
    return _built(spark, ONE, TWO)[0].table("refs").select(F.col("symbol_fqn").alias("target"), F.col("relative_file").alias("file"))


@golden("event string, changed int, unchanged int, removed int", ("changes_detected", 3, 0, 0), ("changes_detected", 1, 1, 1))
def build_counters(spark):
    told = _events(spark, "changedFiles int, unchangedFiles int, removedFiles int", ONE, TWO).filter("event = 'changes_detected'")
    return told.select("event", F.col("changedFiles").alias("changed"), F.col("unchangedFiles").alias("unchanged"), F.col("removedFiles").alias("removed"))


@golden("completed int, total int, file string", (1, 30, "f00.kt"), (25, 30, "f24.kt"), (30, 30, "f29.kt"))
def build_file_progress(spark):
    files = {f"f{i:02}.kt": f"fun f{i}() {{}}\n" for i in range(30)}
    told = _events(spark, "phase string, phaseCompleted int, phaseTotal int, currentFile string", files).filter("event = 'progress' and phase = 'kotlin-psi-symbols'")
    return told.select(F.col("phaseCompleted").alias("completed"), F.col("phaseTotal").alias("total"), F.col("currentFile").alias("file"))


@golden("scope string, topology string, files int, version string", (":", "gradle-parse", 2, "1"))
def manifest_written(spark):
    held = _built(spark, ONE, TWO)[0].manifest()
    return spark.createDataFrame([(held.scope, held.topology, held.source_file_count, held.indexer_version)], "scope string, topology string, files int, version string")


@golden("name string, kind string", ("a2", "changed"), ("help", "function"))
def session_overlay(spark):
    """A session's rows go before those of the index; its copy shows the same."""
    store = _built(spark, ONE, TWO)[0]
    base = store.table("symbols")
    store.write_session("s", {"symbols": base.filter("name = 'a2'").withColumn("kind", F.lit("changed"))})
    store.fork_session("s", "t")
    return store.table("symbols", "t").select("name", "kind")


@golden("case_ string, error string", ("preset", "unknown preset: none"), ("read_only", "the store is read-only"), ("java", "j/Bad.java:2"), ("module", "module :no is not included in the settings"), ("target", "--bazel-target is required for Bazel projects"))
def errors_told(spark):
    def message(run: Callable[[], object]) -> str:
        try:
            run()
        except Exception as e:
            return str(e)
        return ""

    store = Store(spark, shared_dir(spark), "none", read_only=True)
    bad = message(lambda: facts(spark, {"j/Bad.java": "class A {\n void f( { }\n}"}).collect())
    rows = [
        ("preset", message(lambda: L.preset(spark.range(1), "none", ()))),
        ("read_only", message(lambda: store.write_session("s", {}))),
        ("java", (re.search(r"j/Bad.java:\d+", bad) or [""])[0]),
        ("module", _from_workspace(GRADLE, lambda root: [message(lambda: T.gradle_sources(root, "no", False))])[0]),
        ("target", _from_workspace(BAZEL, lambda root: [message(lambda: T.resolve(root))])[0]),
    ]
    return spark.createDataFrame(rows, "case_ string, error string")
