"""Topology, builds, incremental builds, overlays and the commands, on small workspaces."""

import json
import subprocess

import pytest

from factloom import cli
from factloom.plans.config import WRAPPERS, SelectionRules, interactive_callees, wrapper_rules
from factloom.plans.index import build, git_head
from factloom.plans.progress import BuildProgress, workspace_path
from factloom.plans.registry import REGISTRY, Producer, Registry
from factloom.sources import topology as T
from factloom.sources.store import Manifest, Store, StoreLocked


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def commit(root):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-q", "--allow-empty", "-m", "x")


GRADLE = {
    "settings.gradle.kts": 'include(":ui", ":core")\ninclude(project(":tools"))\n',
    "ui/build.gradle.kts": 'dependencies { implementation(project(":core")) }\n',
    "core/build.gradle.kts": 'dependencies { api(project(":ui")) }\n',
    "ui/src/main/kotlin/App.kt": "package app\nimport core.help\nfun start() { help() }\n@Composable\nfun Screen() { SelectionContainer { IconButton() } }\n",
    "ui/src/main/java/Panel.java": "package app;\nclass Panel { Panel other; void draw() { other.draw(); } }\n",
    "ui/src/main/res/layout/main.xml": '<L a="@string/title"/>\n',
    "ui/src/androidTest/kotlin/T.kt": "class T\n",
    "core/src/main/kotlin/Core.kt": "package core\nfun help() {}\n",
}


@pytest.fixture
def workspace(tmp_path):
    put(tmp_path, GRADLE)
    commit(tmp_path)
    return tmp_path


def test_gradle(workspace):
    assert T.settings_includes(GRADLE["settings.gradle.kts"]) == [":ui", ":core", ":tools"]
    assert len(T.gradle_sources(workspace, ":ui", False).files) == 3
    assert len(T.gradle_sources(workspace, "ui", True).files) == 4
    assert len(T.gradle_sources(workspace, ":", False).files) == 4
    with pytest.raises(T.TopologyError):
        T.gradle_sources(workspace, ":none", False)


def test_labels_and_detection(tmp_path):
    assert T.label_paths([" //a/b:c/D.kt", "//:Root.java", "//a:x.txt", "@ext//a:b.kt", "//a/b.kt"]) == ["a/b/c/D.kt", "Root.java"]
    assert T.detect(tmp_path) is None
    put(tmp_path, {"settings.gradle": ""})
    assert T.detect(tmp_path) == "gradle"
    put(tmp_path, {"WORKSPACE": ""})
    assert T.detect(tmp_path) == "bazel"
    with pytest.raises(T.TopologyError):
        T.resolve(tmp_path)


def test_bazel_fallback(tmp_path):
    told = []

    def runner(query, _):
        return (1, []) if query.startswith("kind") else (0, ["//a:B.kt"])

    found = T.bazel_sources(tmp_path, "//a:a", runner=runner, warn=told.append)
    assert (found.files, found.include_deps, found.topology) == (("a/B.kt",), False, "bazel-query") and len(told) == 1
    assert T.bazel_sources(tmp_path, "//a:a", executor=lambda *_: ["//a:B.kt"]).include_deps


BUILD = '''
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
OTHER = "later.kt"
lib(srcs = glob(["none/**/*.kt"]))
'''


def test_build_files(tmp_path):
    put(tmp_path, {f"p/{f}": "" for f in ("src/A.kt", "src/d/B.kt", "src/ATest.kt", "src/sub/BUILD", "src/sub/C.kt", "more/M.java", "more/Skip1.java", "res/l/a.xml", "later.kt")} | {"p/BUILD.bazel": BUILD})
    paths, warnings = T.build_file_sources(tmp_path / "p/BUILD.bazel", tmp_path)
    assert paths == ["p/src/A.kt", "p/src/d/B.kt", "p/more/M.java", "p/foo#bar.kt", "p/One.kt", "p/extra/a.xml", "p/res/l/a.xml"]
    assert len(warnings) == 1 and "none/**/*.kt" in warnings[0]
    put(tmp_path, {"BUILD": 'x(resource_files = ["res/a.xml"])'})
    assert T.build_file_sources(tmp_path / "BUILD", tmp_path)[0] == ["res/a.xml"]


def test_bazel_project():
    assert T.bazel_project("directories:\n  .\n  # no\n  a/b\n\ntargets:\n  //a:b\n") == {"directories": [".", "a/b"], "targets": ["//a:b"]}


def test_paths_and_progress():
    assert workspace_path("a\\./b/../c.kt") == "a/c.kt"
    for bad in ("/a", "C:\\a", "../a"):
        with pytest.raises(ValueError):
            workspace_path(bad)
    lines = []
    p = BuildProgress(lines.append)
    p.changes(2, 0, 0), p.changes(1, 0, 0)
    for i in range(1, 61):
        p.file("java-source", i, 60, "a.java")
    p.completed("indexed"), p.failed(1, "late")
    events = [json.loads(x) for x in lines]
    assert [e.get("phaseCompleted") for e in events] == [None, 1, 25, 50, 60, None]
    assert events[-1]["outcome"] == "indexed" and list(events[1])[:3] == ["version", "event", "phase"]


def test_registry():
    ids = [p.id for p in REGISTRY.for_applications(["selection-context", "unknown"])]
    assert ids == ["java-source", "kotlin-psi-symbols", "xml-resources", "selection-context", "file-hash"]
    assert "selection-context" not in [p.id for p in REGISTRY.for_applications([])] and REGISTRY.get("none") is None
    mine = Registry(REGISTRY.all())
    mine.register(Producer("java-source", "sym", "Another", ".java"))
    assert mine.get("java-source").display_name == "Another" and len(mine.all()) == len(REGISTRY.all())


def test_a_registered_producer_runs(spark, tmp_path):
    def todos(source, out):
        for n, line in enumerate(source.text.split("\n"), 1):
            if "TODO" in line:
                out.symbol((n, line.index("TODO") + 1), f"todo.{n}", line.strip(), "todo", ns="todo")

    registry = Registry([*REGISTRY.all(), Producer("todos", "todo", "Todos", ".kt", read=todos)])
    lines = []
    build(spark, tmp_path, "c", T.SourceSet(("a.kt",), "gradle-parse", False, ":"), files=kotlin(spark, {"a.kt": "fun a() {}\n// TODO later\n"}), progress=BuildProgress(lines.append), registry=registry)
    rows = {(r._key, r.kind) for r in Store(spark, tmp_path, "c").table("symbols").collect()}
    assert ("todo:todo.2:a.kt:2:4", "todo") in rows and len(rows) == 2
    assert "todos" in [json.loads(x).get("phase") for x in lines]


def test_rules_go_through_a_build(spark, tmp_path):
    rules = SelectionRules(frozenset(("Pick",)), frozenset(("Drop",)), "Shown", (("Wrap", "on", "1"),))
    text = "@Shown\nfun f() {\n Pick { Tap() }\n Wrap(on = 1) { Tap() }\n SelectionContainer { Tap() }\n Pick { Drop { Tap() } }\n}\n@Composable\nfun g() { Pick { Tap() } }\n"
    build(spark, tmp_path, "c", T.SourceSet(("a.kt",), "gradle-parse", False, ":"), ["selection-context"], kotlin(spark, {"a.kt": text}), rules=rules)
    rows = Store(spark, tmp_path, "c").table("sites").filter("callee = 'Tap'").collect()
    assert {(r.line, r.selection_container_count, r.excluded_by_disable_selection) for r in rows} == {(3, 1, False), (4, 2, False), (5, 0, False), (6, 1, True)}


def test_configuration_files(tmp_path):
    assert wrapper_rules(None) == WRAPPERS and wrapper_rules(tmp_path / "none.json") == ()
    put(tmp_path, {"w.json": '[{"callee": "A", "providesSelectionWhenNamedArgument": "b", "providesSelectionWhenValue": "c"}]', "p.json": '{"callees": ["X", "Y"]}'})
    assert wrapper_rules(tmp_path / "w.json") == (("A", "b", "c"),) and interactive_callees(tmp_path / "p.json") == ("X", "Y")
    with pytest.raises(ValueError, match="none.json"):
        interactive_callees(tmp_path / "none.json")


def test_store_lock_read_only_and_get(spark, tmp_path):
    where = tmp_path.as_uri()  # a URI as well as a path
    build(spark, where, "c", T.SourceSet(("a.kt",), "gradle-parse", False, ":"), files=kotlin(spark, {"a.kt": "fun a() {}\n"}))
    store = Store(spark, where, "c")
    assert store.manifest().scope == ":" and store.get("symbols", "sym:a:a.kt:1:1").name == "a" and store.get("symbols", "sym:b") is None
    with store.locked():
        with pytest.raises(StoreLocked, match="lock"), Store(spark, where, "c", lock_millis=300).locked():
            pass
        store.commit({n: store.table(n) for n in ("symbols", "refs", "sites", "file_hashes")}, store.manifest())
    with Store(spark, where, "c", lock_millis=0).locked():
        pass
    reader = Store(spark, where, "c", read_only=True)
    assert reader.table("symbols").count() == 1
    for write in (lambda: reader.commit({}, store.manifest()), lambda: reader.write_session("s", {}), lambda: reader.fork_session("s", "t")):
        with pytest.raises(PermissionError):
            write()


def test_names_that_look_like_globs(spark, tmp_path):
    odd = {"a/[id].kt": "1", "a/{x}.kt": "2", "b*/q?.java": "3", "b*/un asked+%.xml": "4", "c/skip.kt": "5", "c/x.txt": "6"}
    put(tmp_path, odd)
    wanted = tuple(f for f in odd if f.startswith(("a", "b")))
    assert {r.relative_file: r.content for r in T.read_files(spark, tmp_path, wanted).collect()} == {f: odd[f] for f in wanted}


def test_text_progress(spark, workspace):
    out, err = [], []
    assert cli.main(["index", "--project", str(workspace), "--gradle-module", ":ui"], spark, out.append, err.append) == 0
    assert not out and "JavaSourceProducer" in err and "[1/1] ui/src/main/java/Panel.java" in err


def test_files_are_told_of(spark, tmp_path):
    files = {f"f{i:02}.kt": f"fun f{i}() {{}}\n" for i in range(30)}
    lines = []
    build(spark, tmp_path, "c", T.SourceSet(tuple(files), "gradle-parse", False, ":"), files=kotlin(spark, files), progress=BuildProgress(lines.append))
    events = [e for e in map(json.loads, lines) if e["event"] == "progress" and e["phase"] == "kotlin-psi-symbols"]
    assert [(e["phaseCompleted"], e["phaseTotal"], e["currentFile"]) for e in events] == [(1, 30, "f00.kt"), (25, 30, "f24.kt"), (30, 30, "f29.kt")]


def test_manifest():
    m = Manifest("c", "1", ":", "gradle-parse", False, 1, "h", "t", ["b", "a"])
    assert Manifest.from_json(m.to_json()) == m and '"sourcesContentHash"' in m.to_json()
    assert m.is_fresh("c", "1", ":", "h", ["a", "b"])
    assert not any([m.is_fresh("d", "1", ":", "h", ["a", "b"]), m.is_fresh("c", "2", ":", "h", ["a", "b"]), m.is_fresh("c", "1", ":x", "h", ["a", "b"]), m.is_fresh("c", "1", ":", "i", ["a", "b"]), m.is_fresh("c", "1", ":", "h", [])])


def call(spark, *args, **more):
    out, err = [], []
    code = cli.main(list(args), spark, out.append, err.append, **more)
    return code, [json.loads(x) for x in out], [json.loads(x) for x in err if x.startswith("{")]


def test_commands(spark, workspace):
    at = ("--project", str(workspace))
    index = ("index", *at, "--gradle-module", ":ui", "--include-deps", "--applications", "selection-context", "--progress-format", "jsonl")
    assert call(spark, "status", *at)[:2] == (1, [{"indexed": False, "commit": git_head(workspace)}])
    code, events, _ = call(spark, *index)
    assert code == 0 and [e["event"] for e in events][:3] == ["discovery_started", "discovery_completed", "changes_detected"]
    assert events[-1]["outcome"] == "indexed" and events[-1]["changedFiles"] == 4
    assert call(spark, *index)[1][-1]["outcome"] == "fresh"
    code, report, _ = call(spark, "status", *at, "--include-deps")
    assert code == 0 and report[0]["fresh"] and report[0]["scope"] == ":ui"
    code, found, told = call(spark, "find-references", *at, "--symbol", "core.help", "--progress-format", "jsonl")
    assert code == 0 and [(r["relativeFile"], r["line"], r["type"]) for r in found] == [("ui/src/main/kotlin/App.kt", 3, "reference")]
    assert [e["event"] for e in told] == ["lookup_started", "lookup_match", "lookup_completed"] and told[1]["record"] == found[0]
    assert [r["fqn"] for r in call(spark, "find-symbol", *at, "--name", "draw", "--language", "java")[1]] == ["app.Panel#draw"]
    assert call(spark, "find-symbol", *at, "--name", "None")[1] == []
    assert [r["aliases"] for r in call(spark, "resolve-resource", *at, "--type", "layout", "--name", "main")[1]] == [["@layout/main"]]
    sites = call(spark, "query", *at, "--application", "selection-context", "--preset", "interactive-in-sc")[1]
    assert [(s["callee"], s["module"], s["target"]) for s in sites] == [("IconButton", ":ui", None)]
    assert len(call(spark, "query", *at, "--application", "selection-context", "--file", sites[0]["file"], "--line", str(sites[0]["line"]))[1]) == 1
    assert call(spark, "find-symbol", *at, "--name", "x", "--format", "text", "--progress-format", "jsonl")[0] == 2
    with pytest.raises(ValueError):
        call(spark, "query", *at, "--application", "selection-context")


def test_no_index_and_bad_sources(spark, workspace):
    at = ("--project", str(workspace))
    code, _, told = call(spark, "find-symbol", *at, "--name", "x", "--progress-format", "jsonl")
    assert code == 1 and told[-1]["failureReason"] == "index_not_found"
    assert call(spark, "index", *at, "--gradle-module", ":tools")[0] == 3
    put(workspace, {"core/src/main/java/Bad.java": "class {"})
    code, events, _ = call(spark, "index", *at, "--gradle-module", ":core", "--progress-format", "jsonl")
    assert code == 1 and events[-1]["event"] == "failed"


def kotlin(spark, files):
    return spark.createDataFrame(list(files.items()), "relative_file string, content string")


def test_incremental_build(spark, tmp_path):
    def run(files, version="1"):
        lines = []
        out = build(spark, tmp_path, "c", T.SourceSet(tuple(files), "gradle-parse", False, ":"), files=kotlin(spark, files), progress=BuildProgress(lines.append), indexer_version=version)
        counts = [(e["changedFiles"], e["unchangedFiles"], e["removedFiles"]) for e in map(json.loads, lines) if e["event"] == "changes_detected"]
        return out, counts[-1] if counts else None

    def names():
        return {r.fqn for r in Store(spark, tmp_path, "c").table("symbols").collect()}

    one = {"a.kt": "package p\nfun a() { help() }\n", "b.kt": "package p\nfun help() {}\n", "c.kt": "package p\nfun c() {}\n"}
    assert run(one) == ("indexed", (3, 0, 0)) and names() == {"p.a", "p.help", "p.c"}
    assert run(one) == ("fresh", None)
    two = {"a.kt": "package p\nfun a2() { help() }\n", "b.kt": one["b.kt"]}
    assert run(two) == ("indexed", (1, 1, 1)) and names() == {"p.a2", "p.help"}
    refs = Store(spark, tmp_path, "c").table("refs").collect()
    assert [r.symbol_fqn for r in refs] == ["p.help"]
    assert run(two, "2") == ("indexed", (2, 0, 0))


def test_overlay_and_sessions(spark, tmp_path):
    build(spark, tmp_path, "c", T.SourceSet(("a.kt",), "gradle-parse", False, ":"), files=kotlin(spark, {"a.kt": "fun a() {}\nfun b() {}\n"}))
    store = Store(spark, tmp_path, "c")
    base = store.table("symbols")
    changed = base.filter("name = 'a'").replace("function", "changed", "kind")
    store.write_session("s", {"symbols": changed})
    store.fork_session("s", "t")
    for session in ("s", "t"):
        assert {(r.name, r.kind) for r in store.table("symbols", session).collect()} == {("a", "changed"), ("b", "function")}
    assert {r.kind for r in store.table("symbols", "").collect()} == {"function"}
