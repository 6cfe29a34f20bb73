"""Which files belong to an index: source sets from Gradle and Bazel build files, which are small and read on the driver."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.text import GRADLE_DEPENDENCY, INDEXABLE, glob_regex

#: The patterns of Gradle settings.
_INCLUDE, _PROJECT, _QUOTED = re.compile(r"include\s*\(([^)]+)\)"), re.compile(r'project\s*\(\s*"([^"]+)"\s*\)'), re.compile(r'"([^"]+)"')


class TopologyError(Exception):
    pass


@dataclass(frozen=True)
class SourceSet:
    files: tuple[str, ...]
    topology: str
    include_deps: bool
    scope: str


def is_indexable(path: str) -> bool:
    return path.rpartition(".")[2] in INDEXABLE and "." in path


def unique(values) -> list[str]:
    return list(dict.fromkeys(values))


# --- Gradle


def settings_includes(text: str) -> list[str]:
    return unique(x for m in _INCLUDE.finditer(text) for p in (_PROJECT, _QUOTED) for x in p.findall(m.group(1)))


def project_dependencies(text: str) -> list[str]:
    return unique(re.findall(GRADLE_DEPENDENCY, text))


def module_folder(root: Path, module: str) -> Path:
    return root.joinpath(*[p for p in module.split(":") if p])


def module_sources(root: Path, module: str) -> list[str]:
    """Main code and resources below a module's src, relative to the workspace."""
    folder = module_folder(root, module)
    out = set()
    for path in (folder / "src").rglob("*") if (folder / "src").is_dir() else ():
        parts = path.relative_to(folder / "src").parts
        if path.is_file() and len(parts) >= 3 and "test" not in parts[0].lower():
            kind = path.suffix[1:]
            if (parts[1] in ("kotlin", "java") and kind in ("kt", "java")) or (parts[1] == "res" and kind == "xml"):
                out.add(path.relative_to(root).as_posix())
    return sorted(out)


def _read(folder: Path, *names: str) -> str | None:
    return next((p.read_text() for p in (folder / n for n in names) if p.is_file()), None)


def reachable(root: str, edges: dict[str, list[str]], included: set[str]) -> list[str]:
    """root and the included modules it depends on, nearest first; each once, cycles or not."""
    order, at = [root], 0
    while at < len(order):
        order += [d for d in unique(edges.get(order[at], ())) if d in included and d not in order]
        at += 1
    return order


def gradle_sources(root: Path, module: str, include_deps: bool) -> SourceSet:
    settings = _read(root, "settings.gradle.kts", "settings.gradle")
    if settings is None:
        raise TopologyError(f"no settings.gradle(.kts) in {root}")
    norm = lambda m: m if m.startswith(":") else f":{m}"
    modules, scope = [norm(m) for m in settings_includes(settings)], norm(module)
    if scope == ":":
        wanted = [":", *modules]
    elif scope not in modules:
        raise TopologyError(f"module {scope} is not included in the settings")
    elif include_deps:
        edges = {m: [norm(d) for d in project_dependencies(_read(module_folder(root, m), "build.gradle.kts", "build.gradle") or "")] for m in modules}
        wanted = reachable(scope, edges, set(modules))
    else:
        wanted = [scope]
    files = sorted({f for m in wanted for f in module_sources(root, m)})
    return SourceSet(tuple(files), "gradle-parse", include_deps, scope)


# --- Bazel


def label_paths(lines: list[str]) -> list[str]:
    out = []
    for line in (x.strip() for x in lines):
        package, colon, name = line.removeprefix("//").partition(":")
        if line.startswith("//") and colon and is_indexable(name):
            out.append(f"{package}/{name}" if package else name)
    return out


_STARLARK = re.compile(r"""(?P<space>\s+|\#[^\n]*)|(?P<str>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<id>[^\W\d]\w*)|(?P<op>==|.)""")


@dataclass
class _Value:
    """What an attribute holds: plain strings, and globs (includes, excludes)."""

    literals: list[str]
    globs: list[tuple[list[str], list[str]]]


class _BuildFile:
    """A BUILD file's tokens without comments, and the values of its source attributes."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m.group()) for m in _STARLARK.finditer(text) if m.lastgroup != "space"] + [("end", "")]
        self.i = 0

    def word(self, n: int = 0) -> str:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)][1]

    def values(self, attribute: str) -> Iterator[_Value]:
        self.i = 0
        while self.i < len(self.tokens):
            if self.tokens[self.i] == ("id", attribute) and self.word(1) == "=":
                self.i += 2
                yield self.value()
            else:
                self.i += 1

    def value(self) -> _Value:
        """Terms joined by `+`: lists, globs; others are passed over."""
        out = _Value([], [])
        while True:
            if self.word() == "[":
                out.literals += self.strings()
            elif self.word() == "glob" and self.word(1) == "(":
                out.globs.append(self.glob())
            else:
                self.skip()
            if self.word() != "+":
                return out
            self.i += 1

    def skip(self) -> None:
        depth = 0
        while self.tokens[self.i][0] != "end":
            kind, word = self.tokens[self.i]
            if kind == "op" and depth == 0 and word in (",", ")", "]", "}", "+"):
                return
            depth += (kind == "op") * ((word in ("(", "[", "{")) - (word in (")", "]", "}")))
            self.i += 1
            if depth == 0 and kind == "id" and self.tokens[self.i][0] == "id":
                return

    def strings(self) -> list[str]:
        out, depth = [], 0
        while self.tokens[self.i][0] != "end":
            kind, word = self.tokens[self.i]
            self.i += 1
            if kind == "str":
                out.append(word.strip("\"'"))
            elif kind == "op":
                depth += (word in ("[", "(")) - (word in ("]", ")"))
                if depth == 0:
                    break
        return out

    def glob(self) -> tuple[list[str], list[str]]:
        self.i += 2
        includes, excludes = [], []
        while self.tokens[self.i][0] != "end" and self.word() != ")":
            into = includes
            if self.tokens[self.i][0] == "id" and self.word(1) == "=":
                into = {"include": includes, "exclude": excludes}.get(self.word(), [])
                self.i += 2
            held = self.value()
            into += held.literals + [p for g in held.globs for p in g[0]]
            if self.word() == ",":
                self.i += 1
        self.i += 1
        return includes, excludes


def expand_glob(folder: Path, pattern: str) -> list[str]:
    """Files of a package that a pattern names; packages within it keep their own."""
    if "*" not in pattern and "?" not in pattern:
        return [pattern] if (folder / pattern).is_file() else []
    matches, out = re.compile(glob_regex(pattern)), []
    for top, folders, names in os.walk(folder, followlinks=True):
        folders[:] = [d for d in folders if not any((Path(top, d, b)).is_file() for b in ("BUILD.bazel", "BUILD"))]
        out += [p for n in names if matches.match(p := Path(top, n).relative_to(folder).as_posix())]
    return sorted(out)


def build_file_sources(build_file: Path, root: Path) -> tuple[list[str], list[str]]:
    """Workspace-relative sources that a BUILD file names, and warnings for globs that match none."""
    folder, parsed = build_file.parent, _BuildFile(build_file.read_text())
    package = folder.relative_to(root).as_posix()
    prefix = "" if package == "." else f"{package}/"
    paths, literals, warnings = [], [], []
    for value in parsed.values("srcs"):
        literals += [x for x in value.literals if is_indexable(x) and "*" not in x]
        for includes, excludes in value.globs:
            out = {x for p in excludes for x in expand_glob(folder, p)}
            for pattern in includes:
                found = [x for x in expand_glob(folder, pattern) if x not in out and is_indexable(x)]
                if not found and any(f".{e}" in pattern for e in INDEXABLE):
                    warnings.append(f"BUILD glob '{pattern}' under {prefix.rstrip('/')} matched no indexable files")
                paths += found
    resources = []
    for value in parsed.values("resource_files"):
        resources += [x for x in value.literals if x.endswith(".xml") and "*" not in x]
        for includes, excludes in value.globs:
            out = {x for p in excludes for x in expand_glob(folder, p)}
            resources += [x for p in includes for x in expand_glob(folder, p) if x not in out and x.endswith(".xml")]
    return unique(prefix + x for x in [*paths, *literals, *resources]), warnings


def run_bazel(query: str, root: Path) -> tuple[int, list[str]]:
    done = subprocess.run(["bazel", "query", query, "--output=label"], cwd=root, capture_output=True, text=True)
    return done.returncode, done.stdout.splitlines()


def bazel_sources(root: Path, target: str, executor: Callable[[str, Path], list[str]] | None = None, runner: Callable[[str, Path], tuple[int, list[str]]] | None = None, warn: Callable[[str], None] = lambda s: print(s, file=sys.stderr)) -> SourceSet:
    """By an injected executor, by `bazel query` (with its narrower fallback), or by the target's BUILD file where there is no bazel."""
    if executor is not None:
        return SourceSet(tuple(label_paths(executor(target, root))), "bazel-query", True, target)
    if runner is not None or shutil.which("bazel"):
        runner, query = runner or run_bazel, f"kind('source file', deps({target}))"
        code, lines = runner(query, root)
        deep = code == 0
        if not deep:
            warn(f"bazel query failed ({query}); retrying with labels(srcs, {target})")
            code, lines = runner(f"labels(srcs, {target})", root)
            if code:
                raise TopologyError("bazel query failed: " + "\n".join(lines))
        return SourceSet(tuple(label_paths(lines)), "bazel-query", deep, target)
    package = target.removeprefix("//").partition(":")[0]
    build = next((p for p in (root / package / n for n in ("BUILD.bazel", "BUILD")) if p.is_file()), None)
    if build is None:
        raise TopologyError(f"no BUILD file for {target}")
    paths, warnings = build_file_sources(build, root)
    for w in warnings:
        warn(w)
    if not paths:
        warn(f"build-parse: no Kotlin sources found for {target} under {package}")
    labels = [f"//{package}:{p.removeprefix(f'{package}/')}" for p in paths]
    return SourceSet(tuple(label_paths(labels)), "build-parse", False, target)


def bazel_project(text: str) -> dict[str, list[str]]:
    """The directories and targets of a project view file."""
    out, section = {"directories": [], "targets": []}, None
    for line in (x.strip() for x in text.splitlines()):
        if line.removesuffix(":") in out and line.endswith(":"):
            section = line[:-1]
        elif line and not line.startswith("#") and section:
            out[section].append(line)
    return out


# --- both


def detect(root: Path) -> str | None:
    if any((root / n).is_file() for n in ("MODULE.bazel", "WORKSPACE", "WORKSPACE.bazel")):
        return "bazel"
    return "gradle" if any((root / n).is_file() for n in ("settings.gradle.kts", "settings.gradle")) else None


def resolve(root: Path, build_system: str = "auto", bazel_target: str | None = None, gradle_module: str | None = None, include_deps: bool = False, **bazel) -> SourceSet:
    system = detect(root) if build_system == "auto" else build_system
    if system == "bazel":
        if not bazel_target:
            raise TopologyError("--bazel-target is required for Bazel projects")
        return bazel_sources(root, bazel_target, **bazel)
    if system == "gradle":
        if not gradle_module:
            raise TopologyError("--gradle-module is required for Gradle projects")
        return gradle_sources(root, gradle_module, include_deps)
    raise TopologyError(f"could not detect a build system in {root}")


def read_files(spark: SparkSession, root: Path, files: tuple[str, ...], overrides: dict[str, str] | None = None) -> DataFrame:
    """relative_file and content of the files, read by the executors; overrides (unsaved buffers) go before what is stored."""
    from pyspark.sql import functions as F

    base = Path(root).resolve().as_uri() + "/"
    schema = "relative_file string, content string"
    held = [(p, t) for p, t in (overrides or {}).items() if p in files]
    wanted = [f for f in files if f not in dict(held)]
    out = spark.createDataFrame(held, schema)
    if wanted:
        # by folder, so that Spark lists in parallel; what is not asked for goes by the join
        folders = sorted({str((Path(root).resolve() / f).parent) for f in wanted})
        read = spark.read.option("pathGlobFilter", "*.{" + ",".join(INDEXABLE) + "}").text([_no_glob(f) for f in folders], wholetext=True)
        path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
        cut = len(base.removeprefix("file://")) + 1
        named = read.select(F.substring(F.regexp_replace(path, "^file:/*", "/"), F.lit(cut), F.length(path)).alias("relative_file"), F.col("value").alias("content"))
        out = out.union(named.join(spark.createDataFrame([(f,) for f in wanted], "relative_file string"), "relative_file", "left_semi"))
    return out


def _no_glob(path: str) -> str:
    """A path for Spark to take as it is, although its characters have a meaning in globs."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
