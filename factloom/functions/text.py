"""String functions over columns, all built from Spark's own, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the fact model: kinds of files, resource paths and references, values types.
INDEXABLE = ("kt", "java", "xml")
RESOURCE_PATH = r"(?:^|/)(?:src/[^/]+/)?(?:res|[^/]+[_-]res)/([^/]+)/([^/]+)\.xml$"
RESOURCE_REFERENCE = r"[@?](\+)?(?:([A-Za-z0-9_.]+):)?([A-Za-z0-9_]+)/([A-Za-z0-9_.]+)"
GRADLE_DEPENDENCY = r'(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(\s*project\s*\(\s*"([^"]+)"\s*\)\s*\)'


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def after_last(text: Column, delimiter: str) -> Column:
    """What follows the last delimiter; the whole text without one."""
    return F.substring_index(text, delimiter, -1)


def before(text: Column, delimiter: str) -> Column:
    return F.substring_index(text, delimiter, 1)


def before_last(text: Column, delimiter: str) -> Column:
    n = F.length(text) - F.length(after_last(text, delimiter)) - len(delimiter)
    return F.when(F.contains(text, F.lit(delimiter)), F.substring(text, F.lit(1), n)).otherwise(text)


def short_name(fqn: Column) -> Column:
    """The name a reference to fqn uses: behind the last `#`, then behind the last `.`."""
    return after_last(after_last(fqn, "#"), ".")


def extension(path: Column) -> Column:
    return after_last(path, ".")


def indexable(path: Column) -> Column:
    return F.contains(path, F.lit(".")) & extension(path).isin(*INDEXABLE)


def normalize_type(name: Column, suffix: str = "?") -> Column:
    """A type's name without type arguments, and without `?` (Kotlin) or `[]` (Java) at its end."""
    bare = F.trim(before(name, "<"))
    return F.trim(F.when(F.endswith(bare, F.lit(suffix)), F.substring(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(bare))


def capitalize(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def decapitalize(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def bean_property(method: Column) -> Column:
    """The property that a getter or setter name stands for; null for other names. The stem's case isn't looked at."""
    stem = (
        F.when((F.startswith(method, F.lit("get")) | F.startswith(method, F.lit("set"))) & (F.length(method) > 3), F.substring(method, F.lit(4), F.length(method)))
        .when(F.startswith(method, F.lit("is")) & (F.length(method) > 2), F.substring(method, F.lit(3), F.length(method)))
    )
    return decapitalize(stem)


def _boolean_style(name: Column) -> Column:
    third = F.substring(name, 3, 1)
    return F.startswith(name, F.lit("is")) & (F.length(name) > 2) & (F.upper(third) == third) & (F.lower(third) != third)


def accessor_aliases(owner: Column, name: Column, declared_type: Column, mutable: Column) -> Column:
    """Java names under which a Kotlin property can be reached: its getter (or `isX` itself for a Boolean) and, if mutable, its setter."""
    kind = F.regexp_replace(declared_type, r"\?$", "")
    boolean = _boolean_style(name) & (kind.isNull() | kind.isin("Boolean", "kotlin.Boolean"))
    getter = F.when(boolean, name).otherwise(F.concat(F.lit("get"), capitalize(name)))
    setter = F.concat(F.lit("set"), F.when(boolean, F.substring(name, F.lit(3), F.length(name))).otherwise(capitalize(name)))
    prefix = F.concat(owner, F.lit("#"))
    return F.when(mutable, F.array(F.concat(prefix, getter), F.concat(prefix, setter))).otherwise(F.array(F.concat(prefix, getter)))


def member_candidates(owner: Column, name: Column, is_write: Column) -> Column:
    """Ids that an access to owner.name may mean: the field, its getters, and its setter on writes."""
    cap, boolean = capitalize(name), _boolean_style(name)
    reads = [name, F.concat(F.lit("get"), cap), F.when(boolean, name).otherwise(F.concat(F.lit("is"), cap))]
    reads = [F.concat(owner, F.lit("#"), x) for x in reads]
    write = F.concat(owner, F.lit("#set"), F.when(boolean, F.substring(name, F.lit(3), F.length(name))).otherwise(cap))
    return F.array_distinct(F.when(is_write, F.array(*reads, write)).otherwise(F.array(*reads)))


def signature(types: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(types, ", "), F.lit(")"))


def qualify(package: Column, name: Column) -> Column:
    return F.when(F.trim(F.coalesce(package, F.lit(""))) == "", name).otherwise(F.concat_ws(".", package, name))


def facade(path: Column, jvm_name: Column) -> Column:
    """The class that holds a Kotlin file's top-level functions."""
    base = after_last(path, "/")
    return F.coalesce(F.when(F.trim(jvm_name) != "", jvm_name), F.concat(before_last(base, "."), F.lit("Kt")))


def resource_type(path: Column) -> Column:
    """The resource type of an XML file's folder, without qualifiers; null if it isn't in a resource folder."""
    found = F.regexp_extract(path, RESOURCE_PATH, 1)
    return F.when(found != "", before(found, "-"))


def resource_name(path: Column) -> Column:
    found = F.regexp_extract(path, RESOURCE_PATH, 2)
    return F.when(found != "", found)


def resource_fqn(package: Column, kind: Column, name: Column) -> Column:
    """`res:` ids; a null or blank package is left out."""
    return F.concat_ws(":", F.lit("res"), F.when(F.trim(package) != "", package), kind, name)


def values_type(tag: Column, item_type: Column) -> Column:
    """The resource type that an element of a values file defines."""
    return F.when(tag.isin("string-array", "integer-array"), F.lit("array")).when(tag == "item", item_type).otherwise(tag)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalized_path(path: Column) -> Column:
    """A workspace-relative path with `/`, without `.` and `..` steps; null if absolute, on a drive, or outside the workspace."""
    clean = slashes(path)
    steps = F.filter(F.split(clean, "/", -1), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(folded, "/")
    bad = F.startswith(clean, F.lit("/")) | F.rlike(clean, F.lit("^[A-Za-z]:")) | F.startswith(joined, F.lit(".."))
    return F.when(~bad, joined)


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob: `*` and `?` stay within a folder, `**/` may match no folder."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], glob[i] if glob[i].isalnum() or glob[i] in "/_-" else "\\" + glob[i])
            i += 1
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return F.rlike(path, F.lit(glob_regex(glob)))


def in_source_root(path: Column) -> Column:
    """Of a path below `src`: source set, folder and more; main code in kotlin/java, or XML in res. Sets named like tests don't count."""
    parts = F.split(path, "/", -1)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    code = second.isin("kotlin", "java") & extension(path).isin("kt", "java")
    return (F.size(parts) >= 3) & ~F.contains(F.lower(first), F.lit("test")) & (code | ((second == "res") & (extension(path) == "xml")))


def module_dir(module: Column) -> Column:
    """`:a:b` as `a/b`; the root module as the empty path."""
    return F.array_join(F.filter(F.split(module, ":", -1), lambda s: s != ""), "/")


def normalized_module(module: Column) -> Column:
    return F.when(F.startswith(module, F.lit(":")), module).otherwise(F.concat(F.lit(":"), module))


def label_path(label: Column) -> Column:
    """`//p:f` as `p/f` for indexable files; null for all other lines."""
    line = F.trim(label)
    package, name = F.regexp_extract(line, "^//([^:]*):(.*)$", 1), F.regexp_extract(line, "^//([^:]*):(.*)$", 2)
    found = F.startswith(line, F.lit("//")) & F.contains(line, F.lit(":")) & indexable(name)
    return F.when(found, F.when(package == "", name).otherwise(F.concat_ws("/", package, name)))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.translate(head, "\n", "")) + 1


def column_of(text: Column, offset: Column) -> Column:
    head = F.substring(text, F.lit(1), offset)
    return F.length(after_last(head, "\n")) + 1
