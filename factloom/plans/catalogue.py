"""Every operator on the star-schema tables, with the SQL that says the same.

`documents` serve as source files, `pages` as markup, `part` as symbols, `lineitem` as references, `orders` as a keyed store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions import keys as K, text as S
from factloom.operators import lookup as L, relational as R
from factloom.operators.shared import global_row_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return add


def _path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("lang"))


PATH = "source || '/' || doc_id || '.' || lang"


# --- scans, keys, codecs -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group: each group's hash, fed line by line; nothing of a group is held."""
    import hashlib

    at, state, first, n = None, None, True, 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([n], pa.int64()), pa.array([f"sha256:{state.hexdigest()}"])], ["source", "files", "combined_hash"])

    for batch in batches:
        for group, line in zip(batch.column("source").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if state is None or group != at:
                if state is not None:
                    yield made()
                at, state, first, n = group, hashlib.sha256(), True, 0
            state.update(line.encode() if first else b"\n" + line.encode())
            first, n = False, n + 1
    if state is not None:
        yield made()


@query(f"""WITH d AS (SELECT source, {PATH} AS path, 'sha256:' || sha256(text) AS h FROM documents)
SELECT source, count(*) AS files, 'sha256:' || sha256(string_agg(path || ':' || h, chr(10) ORDER BY path)) AS combined_hash FROM d GROUP BY source""")
def combined_hash(t):
    # a hash over an ordered sequence is read in that order; a row is 100 bytes, and is streamed, not collected
    lines = t("documents").select("source", _path().alias("path"), S.content_hash(F.col("text")).alias("h")).select("source", "path", F.concat_ws(":", "path", "h").alias("line"))
    dealt = lines.repartition("source").sortWithinPartitions("source", "path").select("source", "line")
    return dealt.mapInArrow(_digests, "source string, files long, combined_hash string")


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def point_get(t):
    return t("orders").filter(F.col("o_orderkey") == 42)


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def prefix_scan(t):
    return t("customer").filter(F.col("c_name").startswith("Customer#0000001")).select("c_custkey", "c_name").orderBy("c_name")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_last_wins(t):
    rows = t("events").select("user_id", "event_type", "event_id", "ts", "value")
    return R.last_write_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_keys(t):
    gone = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.delete_keys(t("orders"), gone, ["o_custkey"]).select("o_orderkey", "o_orderstatus")


def _line_key() -> Column:
    return K.reference_key(F.concat_ws(".", F.lit("part"), "l_partkey"), F.concat_ws(":", F.lit("order"), "l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"))


LINE_KEY = "'ref:part.' || l_partkey || ':order:' || l_orderkey || ':' || l_linenumber || ':' || l_suppkey"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {LINE_KEY} AS key FROM lineitem")
def key_build(t):
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _line_key().alias("key"))


@query(f"SELECT {LINE_KEY} AS key, 'order:' || l_orderkey AS file, l_linenumber AS line, l_suppkey::INTEGER AS col FROM lineitem")
def key_parse(t):
    keyed = t("lineitem").select(_line_key().alias("key"))
    parsed = K.parse_site_key(F.col("key"), 2)
    return keyed.select("key", parsed["file"].alias("file"), parsed["line"].alias("line"), parsed["column"].alias("col"))


@query("""SELECT ns, count(*) AS n FROM (SELECT lower(o_orderstatus) AS ns FROM orders UNION ALL SELECT 'sup' FROM supplier) GROUP BY ns""")
def key_namespace_count(t):
    orders = t("orders").select(K.key("x", F.col("o_orderkey")).alias("k"), F.lower("o_orderstatus").alias("s")).select(F.concat_ws(":", "s", "k").alias("k"))
    keyed = orders.union(t("supplier").select(K.key("sup", F.col("s_suppkey"))))
    return keyed.filter(K.is_key(F.col("k"))).groupBy(K.namespace(F.col("k")).alias("ns")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, to_json(struct_pack("type" := 'nation', "key" := n_nationkey, "name" := n_name))::VARCHAR AS json FROM nation""")
def record_json(t):
    return t("nation").select("n_nationkey", F.to_json(F.struct(F.lit("nation").alias("type"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json"))


@query("""SELECT r_regionkey, '{"region":' || r_regionkey || ',"name":"' || r_name || '","target":null}' AS json FROM region""")
def site_rows_json(t):
    row = F.struct(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("target"))
    return t("region").select("r_regionkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


# --- lookups -------------------------------------------------------------------------------------------------------------


def _symbols(t) -> DataFrame:
    fqn = F.concat(F.lit("part."), F.col("p_partkey"))
    return t("part").select(
        F.lit("sym").alias("ns"), fqn.alias("fqn"), F.col("p_brand").alias("relative_file"), F.col("p_size").alias("line"), F.lit(1).alias("column"),
        F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.lit("part").alias("language"), F.array("p_brand", F.concat_ws("@", "p_type", "p_size")).alias("aliases"), K.key("sym", fqn).alias("_key"),
    )


def _refs(t) -> DataFrame:
    parts = t("lineitem")
    return parts.select(
        F.concat(F.lit("part."), F.col("l_partkey")).alias("symbol_fqn"), F.concat(F.lit("order"), F.col("l_orderkey")).alias("relative_file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("column"),
        F.array(F.concat(F.lit("supplier."), F.col("l_suppkey")), F.concat(F.lit("part."), F.col("l_partkey"))).alias("candidate_symbol_fqns"), _line_key().alias("_key"),
    )


@query("""SELECT 'part.' || p_partkey AS fqn, p_brand AS relative_file, p_size AS line, p_type AS kind FROM part
WHERE (p_name = 'small ring' OR 'part.' || p_partkey = 'small ring' OR list_contains([p_brand, p_type || '@' || p_size], 'small ring')) AND p_type = 'ECONOMY'""")
def find_symbol(t):
    return L.find_symbol(_symbols(t), "small ring", kind="ECONOMY", language="part").select("fqn", "relative_file", "line", "kind")


ALIASES = "SELECT unnest(['part.' || p_partkey, p_brand, p_type || '@' || p_size]) AS id FROM part WHERE 'part.' || p_partkey = 'Brand#7' OR p_brand = 'Brand#7' OR p_type || '@' || p_size = 'Brand#7' UNION SELECT 'Brand#7'"


@query(ALIASES)
def alias_expand(t):
    return R.expand_aliases(_symbols(t), "Brand#7")


@query(f"""WITH ids AS ({ALIASES}) SELECT 'part.' || l_partkey AS symbol_fqn, 'order' || l_orderkey AS relative_file, l_linenumber AS line, l_suppkey AS "column" FROM lineitem
WHERE EXISTS (SELECT 1 FROM ids WHERE id = 'part.' || l_partkey OR id = 'supplier.' || l_suppkey)""")
def find_references(t):
    return L.find_references(_symbols(t), _refs(t), "Brand#7").select("symbol_fqn", "relative_file", "line", "column")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_semi(t):
    return R.keep_keys(t("customer"), t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def deleted_anti(t):
    return R.delete_keys(t("customer"), t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT p_partkey, 'res:' || p_type || ':' || p_name AS fqn, p_brand AS relative_file, p_size AS line FROM part WHERE p_type = 'PROMO' AND p_name = 'red widget'")
def resolve_resource(t):
    rows = t("part").select("p_partkey", F.lit("res").alias("ns"), S.resource_fqn(F.lit(None).cast("string"), F.col("p_type"), F.col("p_name")).alias("fqn"), F.col("p_brand").alias("relative_file"), F.col("p_size").alias("line"), F.col("p_partkey").cast("string").alias("_key"))
    return L.resolve_resource(rows, "PROMO", "red widget").select("p_partkey", "fqn", "relative_file", "line")


def _sites(t) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select("event_id", F.col("event_type").alias("callee"), (k > 20).alias("in_selection_container"), (F.col("value") > 50).alias("excluded_by_disable_selection"), F.floor(k / 30).cast("int").alias("selection_container_count"), K.site_key(F.col("user_id"), k, F.col("event_id")).alias("_key"))


@query("SELECT event_id, event_type AS callee FROM events WHERE event_type IN ('click', 'purchase') AND (props->>'$.k')::INT > 20 AND NOT value > 50")
def preset_interactive(t):
    return L.preset(_sites(t), "interactive-in-sc", ("click", "purchase")).select("event_id", "callee")


@query("SELECT event_id, ((props->>'$.k')::INT // 30)::INTEGER AS selection_container_count FROM events WHERE (props->>'$.k')::INT // 30 > 1")
def preset_nested(t):
    return L.preset(_sites(t), "nested-selection-container", ()).select("event_id", "selection_container_count")


@query("SELECT event_id, event_type AS callee FROM events")
def preset_all(t):
    return L.preset(_sites(t), "all-call-sites", ()).select("event_id", "callee")


def _line_sites(t) -> DataFrame:
    return t("lineitem").select(F.concat(F.lit("order"), F.col("l_orderkey")).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("column"), "l_partkey", _line_key().alias("_key"))


@query("SELECT l_partkey, l_linenumber AS line, l_suppkey AS col FROM lineitem WHERE l_orderkey = 5979 AND l_linenumber = 6")
def point_query_line(t):
    return L.point(_line_sites(t), "order5979", 6).select("l_partkey", "line", F.col("column").alias("col"))


@query("SELECT l_partkey, l_linenumber AS line, l_suppkey AS col FROM lineitem WHERE l_orderkey = 5979 AND l_linenumber = 6 AND l_suppkey = 79")
def point_query_column(t):
    return L.point(_line_sites(t), "order5979", 6, 79).select("l_partkey", "line", F.col("column").alias("col"))


# --- functions -----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN NOT starts_with(lower(o_orderpriority), '1') THEN o_orderpriority END AS target,
CASE WHEN starts_with(lower(o_orderpriority), '1') THEN o_orderpriority END AS module FROM orders""")
def scope_projection(t):
    kind = F.when(F.col("o_orderpriority").startswith("1"), "gradle-parse").otherwise("bazel-query")
    target, module = L.scope_columns(kind, F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", target.alias("target"), module.alias("module"))


@query("""SELECT p_partkey, p_brand = 'Brand#1' AND p_type = 'PROMO' AND list_sort([p_name, p_brand]) = list_sort(['red widget', 'Brand#1']) AS fresh FROM part""")
def manifest_fresh(t):
    m = t("part").select("p_partkey", F.lit("c").alias("commit"), F.lit("v").alias("indexer_version"), F.col("p_brand").alias("scope"), F.col("p_type").alias("sources_content_hash"), F.array("p_name", "p_brand").alias("applications"))
    return m.select("p_partkey", L.fresh("c", "v", "Brand#1", "PROMO", ["red widget", "Brand#1"]).alias("fresh"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'array' WHEN p_type = 'SMALL' THEN p_name ELSE p_type END AS kind FROM part""")
def case_mapping(t):
    tag = F.when(F.col("p_type") == "PROMO", "string-array").when(F.col("p_type") == "LARGE", "integer-array").when(F.col("p_type") == "SMALL", "item").otherwise(F.col("p_type"))
    return t("part").select("p_partkey", S.values_type(tag, F.col("p_name")).alias("kind"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'm' || l_suppkey AS name FROM lineitem")
def short_name(t):
    fqn = F.concat(F.lit("a.b.Order"), F.col("l_orderkey"), F.lit("#m"), F.col("l_suppkey"))
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.short_name(fqn).alias("name"))


@query("SELECT p_partkey, p_type AS kotlin, p_name AS java FROM part")
def type_normalize(t):
    kotlin = F.concat(F.col("p_type"), F.when(F.col("p_size") > 25, "<String>?").otherwise(" ?"))
    return t("part").select("p_partkey", S.normalize_type(kotlin).alias("kotlin"), S.normalize_type(F.concat(F.col("p_name"), F.lit("[]")), "[]").alias("java"))


@query("""SELECT p_partkey, CASE WHEN p_size > 30 THEN lower(p_type[1]) || p_type[2:] WHEN p_size > 20 THEN lower(p_name[1]) || p_name[2:] WHEN p_size > 10 THEN 'sue' END AS property FROM part""")
def bean_property(t):
    size = F.col("p_size")
    method = F.when(size > 30, F.concat(F.lit("get"), "p_type")).when(size > 20, F.concat(F.lit("is"), "p_name")).when(size > 10, "issue").otherwise("put")
    return t("part").select("p_partkey", S.bean_property(method).alias("property"))


@query("""SELECT p_partkey, 'O#get' || upper(p_name[1]) || p_name[2:] || CASE WHEN p_size > 25 THEN ',O#set' || upper(p_name[1]) || p_name[2:] ELSE '' END AS aliases,
'O#' || p_name || ',O#get' || upper(p_name[1]) || p_name[2:] || ',O#is' || upper(p_name[1]) || p_name[2:] || CASE WHEN p_size > 25 THEN ',O#set' || upper(p_name[1]) || p_name[2:] ELSE '' END AS candidates FROM part""")
def accessor_aliases(t):
    name, write = F.col("p_name"), F.col("p_size") > 25
    return t("part").select("p_partkey", F.array_join(S.accessor_aliases(F.lit("O"), name, F.col("p_type"), write), ",").alias("aliases"), F.array_join(S.member_candidates(F.lit("O"), name, write), ",").alias("candidates"))


@query("SELECT p_partkey, '(' || p_type || ', ' || p_brand || ')' AS signature, 2 AS arity FROM part")
def signature_join(t):
    types = F.array("p_type", "p_brand")
    return t("part").select("p_partkey", S.signature(types).alias("signature"), F.size(types).alias("arity"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment || '.' || c_name END AS name FROM customer")
def qualify_name(t):
    return t("customer").select("c_custkey", S.qualify(F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("name"))


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE doc_id || 'Kt' END AS facade FROM documents")
def facade_name(t):
    return t("documents").select("doc_id", S.facade(_path(), F.when(F.col("lang") == "en", F.col("source"))).alias("facade"))


@query("SELECT p_partkey, concat_ws(':', 'res', CASE WHEN p_size > 25 THEN p_brand END, p_type, p_name) AS fqn FROM part")
def null_skipping_concat(t):
    return t("part").select("p_partkey", S.resource_fqn(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" "), F.col("p_type"), F.col("p_name")).alias("fqn"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"'))::INTEGER AS n, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS hrefs FROM pages""")
def regex_extract_all(t):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t("pages").select("page_id", F.size(found).alias("n"), F.array_join(found, " ").alias("hrefs"))


@query(r"""SELECT page_id, regexp_extract(url, '://([^/]*)', 1) || '/' || regexp_extract(url, '/([0-9]+)', 1) || '.kt' AS path FROM pages""")
def label_to_path(t):
    label = F.concat(F.lit(" //"), F.regexp_extract("url", "://([^/]*)", 1), F.lit(":"), F.regexp_extract("url", "/([0-9]+)", 1), F.lit(".kt "))
    return t("pages").select("page_id", S.label_path(label).alias("path"))


@query(f"""SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN lang = 'fr' THEN NULL ELSE 'b/' || {PATH} END AS path FROM documents""")
def path_normalize(t):
    raw = F.when(F.col("lang") == "es", F.concat(F.lit("../"), _path())).when(F.col("lang") == "fr", F.concat(F.lit("C:\\"), _path())).otherwise(F.concat(F.lit("a\\..\\.\\b\\"), _path()))
    return t("documents").select("doc_id", S.normalized_path(raw).alias("path"))


@query("""SELECT page_id, CASE WHEN url LIKE '%.org/%' THEN regexp_extract(url, '://([^/]*)', 1) END AS kind, CASE WHEN url LIKE '%.org/%' THEN page_id::VARCHAR END AS name FROM pages""")
def resource_path(t):
    folder = F.when(F.col("url").contains(".org/"), F.lit("app/main_res/")).otherwise(F.lit("app/response/"))
    path = F.concat(folder, F.translate(F.regexp_extract("url", "://([^/]*)", 1), "-", "_"), F.lit("-land/"), F.col("page_id"), F.lit(".xml"))
    return t("pages").select("page_id", F.translate(S.resource_type(path), "_", "-").alias("kind"), S.resource_name(path).alias("name"))


@query(f"SELECT doc_id, {PATH} AS path FROM documents WHERE regexp_matches({PATH}, '^src1[^/]*/[^/]*\\.(fr)$')")
def glob_match(t):
    return t("documents").withColumn("path", _path()).filter(S.glob_match(F.col("path"), "**/src1*/*.fr")).select("doc_id", "path")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND NOT source = 'src7'")
def source_root_filter(t):
    folder = F.when(F.col("lang") == "en", "kotlin").when(F.col("lang") == "de", "java").otherwise("other")
    first = F.when(F.col("source") == "src7", "androidTest").otherwise("main")
    path = F.concat_ws("/", first, folder, F.concat(F.col("doc_id"), F.lit(".kt")))
    return t("documents").filter(S.in_source_root(path)).select("doc_id")


@query("""SELECT doc_id, (length(substr(text, 1, instr(text, ' the ') - 1)) - length(replace(substr(text, 1, instr(text, ' the ') - 1), chr(10), '')) + 1)::INTEGER AS line,
(length(string_split(substr(text, 1, instr(text, ' the ') - 1), chr(10))[-1]) + 1)::INTEGER AS col FROM documents WHERE instr(text, ' the ') > 0""")
def line_column(t):
    off = F.instr(F.col("text"), " the ") - 1
    return t("documents").filter(F.instr(F.col("text"), " the ") > 0).select("doc_id", S.line_of(F.col("text"), off).alias("line"), S.column_of(F.col("text"), off).alias("col"))


# --- changes between snapshots -------------------------------------------------------------------------------------------

PREV = f"(SELECT {PATH} AS path, sha256(CASE WHEN lang = 'fr' THEN lower(text) ELSE text END) AS h FROM documents WHERE source <> 'src3')"
CUR = f"(SELECT {PATH} AS path, sha256(text) AS h FROM documents WHERE source <> 'src5')"
DIFF = f"SELECT path, CASE WHEN c.h IS NULL THEN 'deleted' WHEN p.h = c.h THEN 'unchanged' ELSE 'changed' END AS change FROM {PREV} p FULL OUTER JOIN {CUR} c USING (path)"


def _previous(t) -> DataFrame:
    text = F.when(F.col("lang") == "fr", F.lower("text")).otherwise(F.col("text"))
    return t("documents").filter("source <> 'src3'").select(_path().alias("path"), F.sha2(text, 256).alias("h"))


def _current(t) -> DataFrame:
    return t("documents").filter("source <> 'src5'").select(_path().alias("path"), F.sha2("text", 256).alias("h"))


def _diff(t) -> DataFrame:
    return R.changes(_previous(t), _current(t), "path", "h")


@query(DIFF)
def change_detect(t):
    return _diff(t)


@query(f"SELECT count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'deleted') AS removed FROM ({DIFF})")
def change_counters(t):
    return R.change_counters(_diff(t))


@query(f"SELECT path FROM ({DIFF}) WHERE change <> 'unchanged'")
def affected_union(t):
    diff = _diff(t)
    return diff.filter("change = 'changed'").select("path").union(diff.filter("change = 'deleted'").select("path")).distinct()


@query(f"SELECT p.path, p.h FROM {PREV} p JOIN ({DIFF}) d ON d.path = p.path WHERE d.change = 'unchanged'")
def hash_gc(t):
    changed = _diff(t).filter("change = 'changed'").select("path")
    return R.surviving_hashes(_previous(t), _current(t).select("path"), changed, "path")


@query(f"""SELECT doc_id, {PATH} AS path FROM documents WHERE source <> 'src3' AND NOT (lang = 'fr' AND {PATH} IN (SELECT path FROM ({DIFF}) WHERE change <> 'unchanged'))""")
def record_cleanup(t):
    rows = t("documents").filter("source <> 'src3'").select("doc_id", "lang", _path().alias("path"))
    affected = _diff(t).filter("change <> 'unchanged'").select("path")
    gone = R.keep_keys(rows.filter("lang = 'fr'"), affected, ["path"])
    return R.delete_keys(rows, gone, ["path"]).select("doc_id", "path")


@query(f"SELECT string_split(path, '.')[-1] AS phase, count(*) AS total FROM ({DIFF}) WHERE change = 'changed' GROUP BY 1")
def phase_totals(t):
    return _diff(t).filter("change = 'changed'").groupBy(S.extension(F.col("path")).alias("phase")).agg(F.count("*").alias("total"))


def _delta(t) -> DataFrame:
    return t("orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def overlay_merge(t):
    return R.overlay(t("orders").select("o_orderkey", "o_orderstatus"), _delta(t), ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey = 7")
def overlay_get(t):
    return R.overlay(t("orders").select("o_orderkey", "o_orderstatus"), _delta(t), ["o_orderkey"]).filter("o_orderkey = 7")


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(p.p_name, s.s_name, c.c_name) AS target FROM lineitem l
LEFT JOIN part p ON p_partkey = l_partkey AND p_size > 25 LEFT JOIN supplier s ON s_suppkey = l_suppkey AND s_nationkey < 10
LEFT JOIN customer c ON c_custkey = l_orderkey WHERE coalesce(p.p_name, s.s_name, c.c_name) IS NOT NULL""")
def precedence_join(t):
    parts = t("part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    suppliers = t("supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    customers = t("customer").select(F.col("c_custkey").alias("l_orderkey"), "c_name")
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    joined = rows.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left").join(customers, "l_orderkey", "left")
    return R.precedence(joined, [F.col("p_name"), F.col("s_name"), F.col("c_name")], "target").select(*rows.columns, "target")


TAGS = ("nav", "ul", "li", "article", "div", "a")
SPANS = r"""WITH k AS (SELECT page_id, unnest(regexp_extract_all(html, '</?(?:nav|ul|li|article|div|a)[\s>]')) AS token, generate_subscripts(regexp_extract_all(html, '</?(?:nav|ul|li|article|div|a)[\s>]'), 1) - 1 AS pos FROM pages),
d AS (SELECT page_id, pos, regexp_replace(token[:-2], '^</?', '') AS name, starts_with(token, '</') AS closes, sum(CASE WHEN starts_with(token, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM k),
e AS (SELECT page_id, pos::INTEGER AS pos, name, closes, (run + closes::INT)::INTEGER AS depth FROM d),
s AS (SELECT page_id, name, pos AS "begin", lead(pos) OVER (PARTITION BY page_id, depth ORDER BY pos) AS "end", depth, closes FROM e),
sp AS (SELECT page_id, name, "begin", "end", depth FROM s WHERE NOT closes AND "end" IS NOT NULL),
an AS (SELECT i.page_id, i.name, i."begin", a.name AS a_name, a."begin" AS a_begin, row_number() OVER (PARTITION BY i.page_id, i."begin" ORDER BY a."begin" DESC) AS distance
FROM sp i JOIN sp a ON a.page_id = i.page_id AND a."begin" < i."begin" AND i."end" < a."end") """


def _tags(t) -> DataFrame:
    return R.tag_spans(t("pages"), "page_id", "html", TAGS)


@query(SPANS + "SELECT page_id, pos, name, depth FROM e")
def tag_depth(t):
    tokens = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"</?(?:nav|ul|li|article|div|a)(?=[\s>])"), F.lit(0))).alias("pos", "token"))
    deep = R.tag_depths(tokens.withColumn("closes", F.col("token").startswith("</")), "page_id")
    return deep.select("page_id", "pos", F.regexp_replace("token", "^</?", "").alias("name"), "depth")


@query(SPANS + """SELECT page_id, name, "begin", a_name AS nearest FROM an WHERE distance = 1""")
def nearest_ancestor(t):
    spans = _tags(t)
    return R.containments(spans, spans, "page_id").filter("distance = 1").select("page_id", "name", "begin", F.col("a_name").alias("nearest"))


@query(SPANS + """SELECT page_id, name, "begin", string_agg(a_name, '<' ORDER BY distance) AS ancestors, count(*) AS n FROM an GROUP BY ALL""")
def ancestor_walk(t):
    spans = _tags(t)
    walked = R.containments(spans, spans, "page_id").groupBy("page_id", "name", "begin")
    listed = walked.agg(F.array_sort(F.collect_list(F.struct("distance", "a_name"))).alias("l"), F.count("*").alias("n"))  # as many as it is deep
    return listed.select("page_id", "name", "begin", F.array_join(F.transform("l", lambda x: x["a_name"]), "<").alias("ancestors"), "n")


@query(SPANS + """SELECT page_id, name, "begin", coalesce(string_agg(a_name, '<' ORDER BY distance) FILTER (WHERE a_name IN ('nav', 'ul')), '') AS containers,
count(*) FILTER (WHERE a_name IN ('nav', 'ul')) > 1 AS nested, coalesce(min(distance) FILTER (WHERE a_name IN ('article', 'li')) < coalesce(min(distance) FILTER (WHERE a_name IN ('nav', 'ul')), 1000), false) AS excluded FROM an GROUP BY ALL""")
def exclusion_rule(t):
    spans = _tags(t)
    found = R.exclusion(R.containments(spans, spans, "page_id"), ["page_id", "name", "begin"], F.col("a_name").isin("article", "li"), F.col("a_name").isin("nav", "ul"))
    return found.select("page_id", "name", "begin", F.array_join("containers", "<").alias("containers"), (F.col("container_count") > 1).alias("nested"), "excluded")


@query("""SELECT user_id, event_id, prev_event_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_event_id FROM events) WHERE event_type = 'purchase'""")
def asof_last_before(t):
    found = R.last_before(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", ["event_id"])
    return found.select("user_id", "event_id", "prev_event_id")


@query("SELECT p_partkey, n_name FROM part JOIN nation ON n_nationkey = p_size WHERE p_brand = 'Brand#3' OR p_type = 'PROMO'")
def wrapper_rule_join(t):
    rules = F.broadcast(t("nation").select(F.col("n_nationkey").alias("p_size"), "n_name"))  # 25 rules at every scale
    matches = F.exists(F.array("p_brand", "p_type"), lambda x: x.isin("Brand#3", "PROMO"))
    return t("part").join(rules, "p_size").filter(matches).select("p_partkey", "n_name")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = l_suppkey)")
def local_anti(t):
    local = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("l_suppkey"))
    return R.delete_keys(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), local, ["l_partkey", "l_suppkey"])


@query("SELECT DISTINCT p_name FROM part WHERE p_type = 'PROMO' EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#1'")
def include_except(t):
    included = t("part").filter("p_type = 'PROMO'").select("p_name").distinct()
    return R.delete_keys(included, t("part").filter("p_brand = 'Brand#1'"), ["p_name"])


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS src, (2 * s_suppkey + 1) % n AS dst FROM supplier, n UNION ALL SELECT s_suppkey, (3 * s_suppkey + 2) % n FROM supplier, n),
r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""")
def closure_bfs(t):
    suppliers = t("supplier")
    n = suppliers.count()
    k = F.col("s_suppkey")
    edges = suppliers.select(k.alias("src"), ((2 * k + 1) % n).alias("dst")).union(suppliers.select(k, (3 * k + 2) % n))
    return R.closure(suppliers.sparkSession.range(1, 2).select(F.col("id").alias("node")), edges, suppliers.select(k.alias("node")))


@query("""SELECT conv_id, turn, section FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)""")
def section_fill(t):
    filled = R.fill_forward(t("conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "section")
    return filled.select("conv_id", "turn", "section")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS emitted_match_count FROM orders")
def emitted_match_count(t):
    return global_row_number(t("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "emitted_match_count").select("o_orderkey", "emitted_match_count")


@query("SELECT event_id, n FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS total FROM events) WHERE n = 1 OR n = total OR n % 25 = 0")
def progress_sampling(t):
    numbered = global_row_number(t("events").select("ts", "event_id"), ["ts", "event_id"], "n", "total")
    return numbered.filter("n = 1 OR n = total OR n % 25 = 0").select("event_id", "n")


@query("""SELECT event_id, user_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events) WHERE most IS NULL OR value >= most""")
def monotonic_guard(t):
    return R.increasing_only(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all_scans(t):
    return t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("SELECT DISTINCT p_name FROM part")
def distinct_sorted(t):
    return t("part").select("p_name").distinct().orderBy("p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE length(trim(c_mktsegment)) > 0")
def blank_filter(t):
    return t("customer").filter(F.trim("c_mktsegment") != "").select("c_custkey", "c_name")
