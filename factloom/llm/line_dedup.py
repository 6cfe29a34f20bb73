"""Lines that spread over many sites, taken out of documents.

A line's spread is the number of distinct sites that hold it. HyperLogLog sketches of the sites, one per line hash, merge by
aggregation; where an estimate lies near the threshold the distinct sites are counted exactly. Lines of at least that spread
are boilerplate and go from all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.common import fresh, stored, table

#: Distinct sites from which a line is boilerplate; base-2 logarithm of a sketch's registers.
LEAST_SITES, LOG_REGISTERS = 6, 11
#: Estimates within this share of the threshold are settled by exact counts: over six standard errors of 1.04 / 2 ** 5.5.
NEAR = 0.15


def _lines(docs: DataFrame, text: str) -> F.Column:
    return F.split(F.col(f"`{text}`"), "\n", -1)


def _hash(line: F.Column) -> F.Column:
    """Of a line without its outer white space; null for a blank line, which is never boilerplate."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare))


def spread_lines(docs: DataFrame, site: str = "source", text: str = "text", least_sites: int = LEAST_SITES) -> DataFrame:
    """line (hash) and sites (estimate, or exact if near the threshold) of the lines on at least least_sites distinct sites.

    A null site is a site like others. Lines on one site alone, nearly all there are, get no sketch.
    """
    seen = docs.select(F.xxhash64(F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("\x00null"))).alias("site"), F.explode(F.array_distinct(F.transform(_lines(docs, text), _hash))).alias("line")).filter("line is not null")
    wide = seen.groupBy("line").agg(F.min("site").alias("one"), F.max("site").alias("other")).filter("one <> other").select("line")
    wide = stored(wide, "wide")
    held = seen.join(wide, "line", "left_semi")
    estimated = held.groupBy("line").agg(F.round(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS))).cast("long").alias("sites"))
    estimated = stored(estimated.filter(F.col("sites") >= least_sites * (1 - NEAR) - 1), "estimates")
    near = F.col("sites") <= least_sites * (1 + NEAR) + 1
    exact = held.join(estimated.filter(near).select("line"), "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= least_sites)
    return stored(exact.union(estimated.filter(~near)), "spread")


def drop_spread_lines(docs: DataFrame, site: str = "source", text: str = "text", least_sites: int = LEAST_SITES) -> DataFrame:
    """docs with the text free of boilerplate lines, and n_lines and n_removed (columns so named are replaced).

    What stays keeps its order and its line ends. Null texts stay null, with 0 lines; a text whose lines all go is empty.
    Repeated rows lose the same lines. An empty table gives an empty one.
    """
    spread = spread_lines(docs, site, text, least_sites)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"n_lines", "n_removed"} and c != text])
    key, of, gone, marked = (fresh(docs, x) for x in ("_key", "_of", "_gone", "_lines"))
    column = F.col(f"`{text}`")
    of_text = F.struct(F.xxhash64(column).alias("h"), F.crc32(column.cast("binary")).alias("c"), F.length(column).alias("n"))
    # equal texts lose equal lines: one list for each distinct text that loses any
    found = docs.filter(column.isNotNull()).select(of_text.alias("_key"), F.explode(F.array_distinct(F.transform(_lines(docs, text), _hash))).alias("line")).filter("line is not null")
    lists = found.join(spread.select("line"), "line", "left_semi").distinct().groupBy("_key").agg(F.collect_list("line").alias("_gone"))
    lists = stored(lists.select(F.col("_key").alias(of), F.col("_gone").alias(gone)), "lists")
    joined = docs.withColumn(key, of_text).join(lists, F.col(key) == F.col(of), "left")
    lines = F.coalesce(_lines(docs, text), F.array().cast("array<string>"))
    none = F.array().cast("array<long>")
    kept = F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.coalesce(F.col(gone), none), _hash(x)), F.lit(False))))
    out = joined.withColumn(marked, kept).withColumn(key, F.size(lines))
    rest = [F.col(f"`{c}`") if c != text else F.when(column.isNotNull(), F.when(F.col(gone).isNull(), column).otherwise(F.array_join(marked, "\n"))).alias(text) for c in docs.columns]
    return out.select(*rest, F.col(key).cast("long").alias("n_lines"), (F.col(key) - F.size(marked)).cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_spread_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
b AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
s AS (SELECT line FROM b WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= 6),
r AS (SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_removed, string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE s.line IS NULL) AS kept
      FROM b LEFT JOIN s USING (line) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END) AS kept_chars, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
