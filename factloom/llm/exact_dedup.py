"""Exact dedup by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of its last 32 bytes says so, so that equal passages give equal
chunks wherever they stand. Chunks are deduplicated once, bytes and all, to verified identifiers; from then on a document
is its ordered list of identifiers (its recipe), and only recipes are grouped and joined: long texts are not moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom.llm.common import SPACES, _IS_SPACE, fresh, lean, stored, table, text_blocks

#: Content-defined chunks: about 2 ** CUT_BITS bytes each on average, never over MOST_BYTES.
CUT_BITS, WINDOW, MOST_BYTES = 11, 32, 1 << 16

_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First byte of every chunk: those of texts (starts), and each byte after a window whose gear hash has CUT_BITS zeros."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            earlier = h[:-width] << np.uint32(width)
            h = h.copy()
            h[width:] += earlier
    cut = (h >> np.uint32(32 - CUT_BITS)) == 0
    at = np.flatnonzero(cut) + 1
    # a window that reaches into the text before would tie a chunk to its neighbour
    owner = np.searchsorted(starts, at, "right") - 1
    at = at[(at - starts[owner] >= WINDOW) & (at < len(data))]
    cuts = np.union1d(starts, at)
    gaps = np.diff(np.append(cuts, len(data)))
    if len(gaps) and gaps.max() > MOST_BYTES:
        cuts = np.concatenate([np.arange(a, a + g, MOST_BYTES) for a, g in zip(cuts, gaps) if g])
    return cuts


def _chunks(column: pa.Array) -> Iterator[tuple[int, bytes, list[int], int]]:
    """Of each text of a column: row, bytes without white space, ends of its chunks, code points with white space."""
    for first, end, offsets, data in text_blocks(column):
        keep = ~_IS_SPACE[data]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        before = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
        starts, ends = before[:-1], before[1:]
        cuts = cut_points(data, np.unique(starts[ends > starts])) if len(data) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
        whole = data.tobytes()
        for k in range(end - first):
            a, b = int(starts[k]), int(ends[k])
            yield first + k, whole[a:b], [*(cuts[lo[k] + 1 : hi[k]] - a).tolist(), b - a] if b > a else [], int(points[k + 1] - points[k])


def _identity(chunk: bytes, bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True) >> (64 - bits)


def _pieces(text: bytes, ends: list[int]) -> Iterator[bytes]:
    a = 0
    for b in ends:
        yield text[a:b]
        a = b


def _recipes(bits: int, twins: dict[int, list[bytes]]):
    """twins: chunks that share an identity; a chunk's place in that list tells it apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, points, sha = [], [], []
            for _, text, ends, n in _chunks(batch.column("_text")):
                ids = []
                for piece in _pieces(text, ends):
                    ids.append(k := _identity(piece, bits))
                    if k in twins:
                        ids.append(twins[k].index(piece))
                recipe.append(ids)
                points.append(n)
                sha.append(hashlib.sha256(text).hexdigest())
            rest = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(recipe, pa.list_(pa.int64())), pa.array(points, pa.int64()), pa.array(sha, pa.string())], [*(x for x in batch.schema.names if x != "_text"), "_recipe", "_points", "_sha"])

    return run


def _bodies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, held = [], [], 0
            seen: set[bytes] = set()
            for _, text, ends, _ in _chunks(batch.column("_text")):
                for piece in _pieces(text, ends):
                    if piece not in seen:
                        seen.add(piece)
                        ids.append(_identity(piece, bits))
                        bodies.append(piece)
                        held += len(piece)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], ["id", "body"])
                    ids, bodies, held = [], [], 0
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], ["id", "body"])

    return run


def twin_chunks(texts: DataFrame, bits: int) -> dict[int, list[bytes]]:
    """Identities that stand for more than one chunk, after every distinct chunk was compared byte by byte.

    A 64-bit identity has such twins about once in 2 ** 64 pairs of chunks, so that the list needs no more room than that.
    """
    bodies = texts.mapInArrow(lean(_bodies(bits)), "id long, body binary").distinct()
    shared = bodies.groupBy("id").count().filter("count > 1").select("id")
    if not shared.take(1):
        return {}
    found: dict[int, list[bytes]] = {}
    for r in bodies.join(shared, "id", "left_semi").orderBy("id", "body").toLocalIterator():
        found.setdefault(r.id, []).append(bytes(r.body))
    return found


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """The rows of docs without the text, with the columns keep_id, group_size, kept, text_sha256 and n_points.

    Texts are equal when identical without `[\\x20\\x09-\\x0D]`; a null text counts as empty, and all empty texts are equal.
    Of equal texts the row with the most code points in its original text stays, then that with the smallest id (null ids
    come last), then the first read: of repeated rows one stays. Columns of docs that bear a result's name are replaced. An
    empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in {"keep_id", "group_size", "kept", "text_sha256", "n_points"}]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    twins = twin_chunks(docs.select(whole), bits)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), whole)
    schema = held.drop("_text").schema.add("_recipe", T.ArrayType(T.LongType())).add("_points", "long").add("_sha", "string")
    made = stored(held.mapInArrow(lean(_recipes(bits, twins)), schema).withColumn("_at", F.monotonically_increasing_id()), "recipes")
    order = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_at").alias("a"))
    # written, so that the join's skewed side can be split
    best = stored(made.groupBy("_recipe").agg(F.count("*").alias("_n"), F.min(order).alias("_best")), "best")
    return made.join(best, "_recipe").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rest],
        F.col("_best.i").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_at") == F.col("_best.a")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_points").alias("n_points"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns as they are; texts move once."""
    key, sha, points = (fresh(docs, x) for x in ("_key", "_sha", "_points"))
    told = exact_dedup(docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")), "i", "t").withColumnsRenamed({"i": key, "text_sha256": sha, "n_points": points})
    told = stored(told.groupBy(key, sha, points).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("kept"), "kept")
    kept = told.select(key, sha, points)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.withColumns({key: F.col(f"`{doc_id}`"), sha: F.sha2(F.translate(whole, SPACES, ""), 256), points: F.length(whole).cast("long")})
    same = [marked[c].eqNullSafe(kept[c]) for c in (key, sha, points)]
    out = marked.join(kept, same[0] & same[1] & same[2], "left_semi")
    if told.filter("n > 1").take(1):  # repeated rows, or the same id with other white space: one of each
        out = out.dropDuplicates([key, sha, points])
    return out.drop(key, sha, points)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_BARE = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({_BARE}) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
