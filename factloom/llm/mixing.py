"""Mixing sources to target weights.

Sizes are summed by source, targets and with them repetition rates derived, and each document is emitted floor(rate) times
plus once more with the probability of the rate's fraction. That one draw is a hash of a seed and the document's id, so that
a rerun takes the same documents, and it is independent of the size: long and short documents have the same chance. A source's
words therefore spread around its target by sqrt(f * (1 - f) * sum of squared sizes) for the fraction f.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.common import stored, table, word_count
from factloom.operators.shared import global_row_number

#: Weights of the sources in their order, repeated; the share of all sizes that they divide (in halves); the most repetitions.
WEIGHTS, SHARE_HALVES, MOST = (3, 1, 2), 3, 2
#: Columns that mix adds.
MADE = ("_size", "_source_size", "_target", "_copies", "_taken")
SEED = "mix-1"


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, share_halves: int = SHARE_HALVES, most: int = MOST) -> DataFrame:
    """Of each source: source_size and target. sizes: a row for each document.

    The sources in code point order, null last, weigh as `weights`, repeated, and share share_halves / 2 of all sizes; a
    target stops at `most` times the source's size, and its excess is shared anew by weight among the others until none is above.
    """
    sums = sizes.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.sum(size).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    by_source = stored(global_row_number(sums, [F.col("_source").isNull(), F.col("_source")], "_rank").withColumn("_weight", weight.cast("long")), "sources")
    cap = F.lit(most) * F.col("source_size")
    total, weigh = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    halves, full_weight, full, above = share_halves * total, 0, 0, F.lit(False)
    while full_weight < weigh:
        # in halves, so that all sums are whole numbers
        above = 2 * cap * F.lit(weigh - full_weight) <= F.lit(halves - 2 * full) * F.col("_weight")
        w, c = by_source.filter(above).agg(F.coalesce(F.sum("_weight"), F.lit(0)), F.coalesce(F.sum(cap), F.lit(0))).first()
        if w == full_weight:
            break
        full_weight, full = w, c
    else:
        above = F.lit(True)
    share = F.lit(halves - 2 * full) * F.col("_weight") / F.lit(2.0 * max(weigh - full_weight, 1))
    return by_source.select("_source", "source_size", F.when(above, cap.cast("double")).otherwise(share.cast("double")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with _size (words), _source_size, _target, _copies and _taken (words the mix takes); columns so named are replaced.

    A null text has no words; null is a source of its own, the last. Copies of a row: floor(rate), plus one where the hash
    of seed and id falls below the rate's fraction; repeated ids are drawn alike, a null id as an empty one. A source
    without words has rate 0. An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c.lower() not in MADE]
    held = F.struct(*[F.col(f"`{c}`") for c in rest])
    sized = docs.select(held.alias("row"), F.col(f"`{source}`").alias("of"), F.col(f"`{doc_id}`").cast("string").alias("id"), word_count(F.col(f"`{text}`")).alias("size"))
    by_source = stored(targets(sized, "of", "size").withColumnRenamed("_source", "by"), "targets")
    met = sized.join(by_source, F.col("of").eqNullSafe(F.col("by")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(F.col("id"), seed) < rate - F.floor(rate)).cast("long")
    kept = [F.col(f"row.`{c}`").alias(c) for c in rest]
    out = met.select(*kept, F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies"))
    return out.withColumn("_taken", F.col("_size") * F.col("_copies"))


def draw(ident: F.Column, seed: str | F.Column = SEED) -> F.Column:
    """A number from 0 up to 1 (not 1 itself), by the first 32 bits of a hash of seed and id."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    digits = F.substring(F.sha2(F.concat(seed, F.lit(":"), F.coalesce(ident, F.lit(""))), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = mix(plain, names[doc_id], names[text], names[source], seed).filter("_copies > 0")
    return out.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*[F.col(n).alias(c) for c, n in names.items()])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM w),
p AS (SELECT *, sum(2 * source_size) OVER (ORDER BY k) AS caps, sum(weight) OVER (ORDER BY k) AS full_weight,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM o),
f AS (SELECT coalesce(max(caps) FILTER (WHERE 4 * source_size * (weights - full_weight + weight) <= (3 * total - 2 * (caps - 2 * source_size)) * weight), 0) AS caps,
             coalesce(max(full_weight) FILTER (WHERE 4 * source_size * (weights - full_weight + weight) <= (3 * total - 2 * (caps - 2 * source_size)) * weight), 0) AS full_weight,
             coalesce(max(k) FILTER (WHERE 4 * source_size * (weights - full_weight + weight) <= (3 * total - 2 * (caps - 2 * source_size)) * weight), 0) AS k FROM p),
t AS (SELECT p.source, p.source_size, CASE WHEN p.k <= f.k THEN (2 * p.source_size)::DOUBLE
             ELSE ((3 * p.total - 2 * f.caps) * p.weight)::DOUBLE / (2.0 * (p.weights - f.full_weight))::DOUBLE END AS target FROM p, f),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             sha256('mix-1:' || coalesce(d.doc_id::VARCHAR, '')) AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + (('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM r
"""
