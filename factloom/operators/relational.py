"""Operators on tables with columns named by the caller: the same functions serve the fact tables and any others."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.operators.shared import written

#: Ids that may be literals of a filter.
FEW = 1000
#: Rows of a graph that one task may hold, and steps that a round takes in a larger one.
ONE_TASK, HOPS = 1_000_000, 4


def last_write_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with the same key, that with the greatest order. An aggregate: combined before the shuffle, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*rows.columns)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys), list(keys), "left_anti")


def keep_keys(rows: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(kept.select(*keys), list(keys), "left_semi")


def overlay(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """delta's rows, and those of base whose key delta doesn't have. There are no tombstones."""
    return delta.unionByName(delete_keys(base, delta, keys))


def changes(previous: DataFrame, current: DataFrame, path: str, value: str) -> DataFrame:
    """path and change: `changed` (new or other value), `unchanged`, `deleted`. One full outer join serves all three."""
    p = previous.select(F.col(path), F.col(value).alias("_was"), F.lit(True).alias("_old"))
    c = current.select(F.col(path), F.col(value).alias("_is"), F.lit(True).alias("_new"))
    kind = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNotNull() & F.col("_was").eqNullSafe(F.col("_is")), "unchanged").otherwise("changed")
    return p.join(c, path, "full_outer").select(path, kind.alias("change"))


def change_counters(changed: DataFrame) -> DataFrame:
    return changed.agg(
        F.count_if(F.col("change") == "changed").alias("changed"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        F.count_if(F.col("change") == "deleted").alias("removed"),
    )


def surviving_hashes(hashes: DataFrame, current: DataFrame, changed: DataFrame, path: str) -> DataFrame:
    """Stored hashes of files that are still there and have not changed."""
    return delete_keys(keep_keys(hashes, current, [path]), changed, [path])


def expand_aliases(symbols: DataFrame, wanted: str, fqn: str = "fqn", aliases: str = "aliases") -> DataFrame:
    """id: the name asked for, and fqn and aliases of every symbol that bears it. One hop, not a closure."""
    hit = (F.col(fqn) == wanted) | F.coalesce(F.array_contains(aliases, wanted), F.lit(False))
    found = symbols.filter(hit).select(F.explode(F.concat(F.array(fqn), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("id"))
    return found.union(symbols.sparkSession.range(1).select(F.lit(wanted).alias("id"))).filter("id is not null").distinct()


def overlapping(rows: DataFrame, ids: DataFrame, candidates: Column, keys: Sequence[str]) -> DataFrame:
    """Rows with a candidate among ids, each once; keys identify a row.

    Up to FEW ids (one symbol's names, say) are literals of a filter: one scan, no shuffle. More are joined: candidates are
    exploded so that an equi-join finds them.
    """
    few = [r.id for r in ids.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return rows.filter(F.arrays_overlap(candidates, F.array(*[F.lit(i) for i in few]).cast("array<string>")))
    named = rows.select(*keys, F.explode(F.array_distinct(candidates)).alias("id"))
    hits = named.join(ids, "id", "left_semi").select(*keys).distinct()
    return rows.join(hits, list(keys), "left_semi")


def precedence(rows: DataFrame, choices: Sequence[Column], name: str) -> DataFrame:
    """rows with the first choice that isn't null; rows without any are dropped."""
    return rows.withColumn(name, F.coalesce(*choices)).filter(F.col(name).isNotNull())


def last_before(events: DataFrame, by: Sequence[str], order: Sequence[str], source: Column, use: Column, values: Sequence[str]) -> DataFrame:
    """Rows where use holds, with prev_ values of the last row before them where source holds. A backward as-of join in one window."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumns({f"prev_{v}": F.last(F.when(source, F.struct(F.col(v).alias("v"))), ignorenulls=True).over(w)["v"] for v in values})
    return seen.filter(use)


def fill_forward(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row: sections of a line-wise file, say."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def increasing_only(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value isn't below any before it: counters that never go back."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_most", F.max(value).over(w))
    return seen.filter(F.col("_most").isNull() | (F.col(value) >= F.col("_most"))).drop("_most")


def containments(inner: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """inner x the spans of the same `by` that contain it strictly: columns a_*; distance 1 is the innermost.

    inner and spans: begin, end (numbers) and depth (from 1); spans of one `by` nest, none overlaps another in part. Of each
    depth above its own, a row asks for the last span that began before it: one window, whose rows are the spans and the
    pairs that come out, not all pairs of a `by`.
    """
    held = [c for c in spans.columns if c != by]
    deep = inner.filter("depth > 1")  # a sequence from 1 to 0 would count down
    asks = deep.select(by, F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("_level"), F.col("begin").alias("_at"), F.struct(*inner.columns).alias("_inner"))
    opens = spans.select(by, F.col("depth").alias("_level"), F.col("begin").alias("_at"), F.struct(*held).alias("_span"))
    before = Window.partitionBy(by, "_level").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    met = asks.unionByName(opens, allowMissingColumns=True).withColumn("_around", F.last("_span", ignorenulls=True).over(before))
    met = met.filter(F.col("_inner").isNotNull() & (F.col("_inner.end") < F.col("_around.end")))
    out = met.select(*[F.col(f"_inner.{c}").alias(c) for c in inner.columns], *[F.col(f"_around.{c}").alias(f"a_{c}") for c in held])
    return out.withColumn("distance", F.row_number().over(Window.partitionBy(by, "begin").orderBy(F.desc("a_begin"))))


def tag_spans(pages: DataFrame, page: str, html: str, tags: Sequence[str]) -> DataFrame:
    """page, name, begin, end, depth of the elements of balanced markup; begin and end number the tags of the page."""
    names = "|".join(tags)
    tokens = pages.select(page, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rf"</?(?:{names})(?=[\s>])"), F.lit(0))).alias("pos", "token"))
    return spans_of(tokens.withColumn("name", F.regexp_replace("token", "^</?", "")).withColumn("closes", F.startswith("token", F.lit("</"))), page)


def tag_depths(tokens: DataFrame, page: str) -> DataFrame:
    """tokens (pos, closes) with depth: how many elements are open at a tag, its own included."""
    w = Window.partitionBy(page).orderBy("pos")
    run = F.sum(F.when(F.col("closes"), -1).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("depth", (run + F.when(F.col("closes"), 1).otherwise(0)).cast("int"))


def spans_of(tokens: DataFrame, page: str) -> DataFrame:
    deep = tag_depths(tokens, page)
    end = F.lead("pos").over(Window.partitionBy(page, "depth").orderBy("pos"))
    return deep.withColumn("end", end).filter("not closes and end is not null").select(page, "name", F.col("pos").alias("begin"), "end", "depth")


def exclusion(ancestors: DataFrame, keys: Sequence[str], disables: Column, contains: Column) -> DataFrame:
    """Of each site: containers (names, innermost first), their count, and excluded: a disabling ancestor lies within all containers."""
    found = ancestors.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(contains, F.struct("distance", "a_name")))).alias("_c"),  # a site's ancestors: as many as it is deep
        F.min(F.when(disables, F.col("distance"))).alias("_d"),
        F.min(F.when(contains, F.col("distance"))).alias("_s"),
    )
    excluded = F.col("_d").isNotNull() & (F.col("_s").isNull() | (F.col("_d") < F.col("_s")))
    return found.select(*keys, F.transform("_c", lambda x: x["a_name"]).alias("containers"), F.size("_c").alias("container_count"), excluded.alias("excluded"))


def _reached(node: str):
    """Breadth first over a graph that one task holds: rows without dst are roots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches])
        first = rows.loc[rows["dst"].isna(), "src"]
        arcs = rows.loc[~rows["dst"].isna()].groupby("src")["dst"].agg(list).to_dict()
        seen, stack = set(first), list(first)
        while stack:
            for there in arcs.get(stack.pop(), ()):
                if there not in seen:
                    seen.add(there)
                    stack.append(there)
        yield pd.DataFrame({node: pd.Series(list(seen), dtype=rows["src"].dtype)})

    return run


def closure(roots: DataFrame, edges: DataFrame, included: DataFrame | None = None, node: str = "node", one_task: int = ONE_TASK) -> DataFrame:
    """All nodes reachable from roots (these too) over edges (src, dst); only nodes in included are followed, but for roots.

    Safe on cycles; null nodes take no part. Up to one_task rows of edges and roots are walked by one task. Larger graphs go
    breadth first: a round takes HOPS steps in one plan and writes what it has found anew, and what has been seen is
    written together every HOPS rounds, so that neither plans nor the number of tables grow with the depth. Both give the same.
    """
    if included is not None:
        edges = edges.join(included.select(F.col(node).alias("dst")), "dst", "left_semi")
    edges = written(edges.select("src", "dst").dropna().distinct(), "edges")
    seen = written(roots.select(node).dropna().distinct(), "roots")
    if edges.count() + seen.count() <= one_task:
        kind = seen.schema[node].dataType
        rows = seen.select(F.col(node).alias("src"), F.lit(None).cast(kind).alias("dst")).union(edges.select(F.col("src").cast(kind), F.col("dst").cast(kind)))
        text = rows.select(F.col("src").cast("string"), F.col("dst").cast("string"))  # nulls and long numbers come through whole
        return text.coalesce(1).mapInPandas(_reached(node), f"`{node}` string").select(F.col(node).cast(kind).alias(node))
    frontier, pieces = seen, 1
    while frontier.take(1):
        step = reached = frontier
        for _ in range(HOPS):
            step = step.join(edges, F.col(node) == F.col("src")).select(F.col("dst").alias(node)).distinct()
            reached = reached.union(step)
        frontier = written(reached.distinct().join(seen, node, "left_anti"), "frontier")
        seen, pieces = seen.union(frontier), pieces + 1
        if pieces == HOPS:
            seen, pieces = written(seen, "seen"), 1
    return seen
