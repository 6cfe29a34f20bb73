"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in an order that keeps like ones together and cut into ranges: blocks of BLOCK, stored with the maximum and
the minimum of each component beside the rows themselves (the block's forward index), CHUNK rows to a stored row. A block's
bound for a query is the sum of its components' best terms. Each query takes blocks by falling bound and stops where the
bound falls below its k-th score. Queries come in groups, as packed as the chunks. First each query's most promising chunks
give every query a k-th score; then only chunks whose bound reaches it are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.llm.common import small_batches, stored, table
from factloom.operators.shared import global_row_number

BLOCK, CHUNK, GROUP, PACK = 128, 4096, 1024, 4096
#: Sums below this are exact in doubles, and leave room for a rank beside them.
EXACT = float(1 << 48)
_PACKED = "chunk long, ids binary, rows binary, high binary, low binary, top binary, bottom binary, size int"


def _valid(scale: float, width: int):
    turn = np.random.default_rng(20240613).standard_normal((width, 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keep = np.zeros((len(batch), width)), np.zeros(len(batch), bool)
            for k in range(len(batch)):
                v = batch.column("v")[k].values
                if v is not None and not v.null_count and batch.column("id")[k].is_valid:
                    x[k, : len(v)], keep[k] = v.to_numpy(), True
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                keep &= np.isfinite(x).all(1)
            x = x[keep]
            seen = (x / np.maximum(np.abs(x).max(1, initial=1.0), 1.0)[:, None]) @ turn
            cell = np.abs(seen).argmax(1) if len(x) else np.zeros(0, np.int64)
            cells = 2 * cell + (seen[np.arange(len(x)), cell] > 0)
            ids = batch.column("id").filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cells, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "cell", "x"])

    return run


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                held = batch.column("held")[k].values
                order = np.argsort(held.field("at").to_numpy(), kind="stable")
                ids = held.field("id").to_numpy()[order]
                x = np.frombuffer(b"".join(held.field("x").to_pylist())).reshape(-1, width)[order]
                cuts = np.arange(0, len(x), BLOCK)
                high, low = np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts)
                small = x.astype(np.float32) if np.abs(x).max(initial=0) < 1 << 24 else x
                values = [batch.column("chunk")[k].as_py(), ids.tobytes(), small.tobytes(), high.tobytes(), low.tobytes(), high.max(0).tobytes(), low.min(0).tobytes(), len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 6, pa.int32()], strict=True)], ["chunk", "ids", "rows", "high", "low", "top", "bottom", "size"])

    return run


def _matrix(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * width else np.float64).reshape(n, width).astype(np.float64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def scored(qids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best rows of a chunk, without those that cannot reach its score `least`."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) >= EXACT:
        yield from _scored_large(qids, q, ids, x, k)
        return
    bounds = _bounds(q, high, low)
    order = np.argsort(-bounds, 1, kind="stable")
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    none = np.iinfo(np.int64).min
    best = np.full((len(q), k), none)
    kth = least.copy()
    for step in range(bounds.shape[1]):
        blocks = order[:, step]
        live = np.flatnonzero(bounds[np.arange(len(q)), blocks] >= kth)
        if not len(live):
            break
        for b in np.unique(blocks[live]).tolist():
            some = live[blocks[live] == b]
            rows = slice(b * BLOCK, (b + 1) * BLOCK)
            # score first, then the smaller id, in one number
            keys = ((q[some] @ x[rows].T).astype(np.int64) << 13) + (CHUNK - 1 - rank[rows])
            keys[ids[rows][None, :] == qids[some][:, None]] = none
            both = np.concatenate([best[some], keys], 1)
            both.partition(both.shape[1] - k, 1)
            best[some] = both[:, -k:]
            last = best[some].min(1)
            kth[some] = np.where(last > none, np.maximum(kth[some], last >> 13), kth[some])
    best.sort(1)
    for i in range(len(q)):
        for key in best[i][::-1].tolist():
            if key == none or key >> 13 < least[i]:
                break
            yield int(qids[i]), int(ids[by_id[CHUNK - 1 - (key & 8191)]]), key >> 13


def _scored_large(qids, q, ids, x, k):
    """The same with whole numbers of any size; scores beyond a long count as its largest or smallest."""
    most = (1 << 63) - 1
    vectors = [[int(c) for c in row] for row in x]
    for i, row in zip(qids.tolist(), q, strict=True):
        a = [int(c) for c in row]
        found = [(-max(-most - 1, min(most, sum(c * d for c, d in zip(a, v, strict=True)))), j) for j, v in zip(ids.tolist(), vectors, strict=True) if j != i]
        for s, j in sorted(found)[:k]:
            yield i, j, -s


def _row(batch: pa.RecordBatch, k: int) -> dict:
    """One row of a batch; the others stay as they are."""
    return {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _score_cells(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                r = _row(batch, at)
                qids, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                high, low = (np.frombuffer(r[c]).reshape(-1, width) for c in ("high", "low"))
                least = np.full(len(qids), -np.inf)
                if r["least"]:
                    held = {e["query_id"]: e["least"] for e in r["least"]}
                    least = np.array([held.get(i, -np.inf) for i in qids.tolist()], float)
                out = list(scored(qids, _matrix(r["q"], len(qids), width), least, ids, _matrix(r["rows"], len(ids), width), high, low, k))
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * len(out), pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["grp", "query_id", "vec_id", "score"])

    return run


def _cells(width: int, seeds: bool):
    """Chunks of a pack to be scored for a group: each query's best (seeds), or all whose bound reaches a query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                r = _row(batch, at)
                qids = np.frombuffer(r["qids"], np.int64)
                chunks = np.array([c["chunk"] for c in r["held"]], np.int64)
                top, bottom = (np.frombuffer(b"".join(c[x] for c in r["held"])).reshape(-1, width) for x in ("top", "bottom"))
                with np.errstate(all="ignore"):
                    bounds = _bounds(_matrix(r["q"], len(qids), width), top, bottom)
                bounds[~np.isfinite(bounds)] = np.inf
                if seeds:
                    take = np.unique(bounds.argmax(1))
                else:
                    held = {e["query_id"]: e["least"] for e in r["least"] or ()}
                    least = np.array([held.get(i, -np.inf) for i in qids.tolist()], float)
                    # doubles round: a bound counts as reached a little below the score
                    take = np.flatnonzero((bounds >= least[:, None] - 1e-9 * np.abs(bounds)).any(0))
                yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * len(take), pa.int64()), pa.array(chunks[take], pa.int64())], ["grp", "chunk"])

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of the largest inner product of floor(scale * x), x as double.

    Queries are the rows for which is_query holds; a query's own row (any with its id) isn't among its results; of equal
    scores the smaller id comes first. Rows with a null id, a null vector, or a null or non-finite component take no part.
    Shorter vectors have zeros behind. Of queries with the same id the smallest vector is asked; repeated candidates count each. With fewer than k candidates all are returned; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    width = max(1, plain.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])

    def packed(rows: DataFrame, most: int) -> DataFrame:
        """Chunks of `most` rows, numbered from 0, however the rows are dealt over partitions."""
        cells = rows.select("id", "v").mapInArrow(_valid(scale, width), "id long, cell int, x binary")
        numbered = global_row_number(cells, ["cell", "id"], "at")
        chunk = F.floor((F.col("at") - 1) / most).alias("chunk")
        held = numbered.groupBy(chunk).agg(F.collect_list(F.struct("at", "id", "x")).alias("held"))  # `most` rows
        return stored(held.mapInArrow(_pack(width), _PACKED), "packed")

    with small_batches(spark):
        chunks = packed(plain, CHUNK)
        asked = plain.filter("is_query").groupBy("id").agg(F.min("v").alias("v"))
        groups = packed(asked, GROUP).select(F.col("chunk").alias("grp"), F.col("ids").alias("qids"), F.col("rows").alias("q"))
        # what is known of PACK chunks, side by side
        packs = stored(chunks.groupBy(F.floor(F.col("chunk") / PACK).alias("pack")).agg(F.collect_list(F.struct("chunk", "top", "bottom")).alias("held")), "packs")
    last = packs.agg(F.max("pack")).first()[0]
    no_least = F.lit(None).cast("array<struct<query_id: long, least: double>>").alias("least")

    def cells(some: DataFrame, seeds: bool) -> DataFrame:
        """Every group of queries meets every pack: a row for GROUP queries and PACK x CHUNK vectors."""
        met = some.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(last or 0)).cast("array<long>"))).join(packs, "pack")
        return met.mapInArrow(_cells(width, seeds), "grp long, chunk long")

    def scores(which: DataFrame, some: DataFrame) -> DataFrame:
        met = which.join(some, "grp").join(chunks.select("chunk", "ids", "rows", "high", "low"), "chunk")
        with small_batches(spark):
            return stored(met.mapInArrow(_score_cells(width, k), "grp long, query_id long, vec_id long, score long"), "scores")

    with small_batches(spark):
        first = stored(cells(groups.withColumn("least", no_least), True), "seeds")
    found = scores(first, groups.withColumn("least", no_least))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    least = kth.groupBy("grp").agg(F.collect_list(F.struct("query_id", F.col("score").cast("double").alias("least"))).alias("least"))  # GROUP at most
    bounded = stored(groups.join(least, "grp", "left"), "groups")
    with small_batches(spark):
        reached = stored(cells(bounded, False), "reached")
    found = found.union(scores(reached.join(first, ["grp", "chunk"], "left_anti"), bounded))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
