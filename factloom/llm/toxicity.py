"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

Documents with each n-gram are counted by label; the ratio r of the smoothed counts tells how much an n-gram speaks for one
label. Features are the n-grams present in a text, each worth its r; a logistic regression over them gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.common import fresh, lean, stored, table, text_blocks, trim

#: Lengths of the n-grams, and bits of their hash.
ORDERS, BITS = (3, 4, 5, 6, 7), 20
#: The classifier is fitted on at most this many labelled texts: those whose ids hash lowest.
TRAIN_ROWS = 10_000
#: Features kept: those of the highest |r| * sqrt(documents) that occur in so many documents at least.
FEATURES, LEAST_DOCS = 2000, 8
SMOOTH, RIDGE, STEPS = 1.0, 3.0, 200
#: Bytes of text whose n-grams are held at once.
BLOCK = 1 << 18
_PRIME = np.uint32(0x01000193)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # of the features, ascending
    weights: np.ndarray  # by which a feature's presence moves the score
    bias: float


def _grams(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each order: buckets of the n-grams at all characters, and the text each lies in (-1: it would cross an end).

    A text is seen with a space before and after it, so that its first and last words look like others.
    """
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = len(at) - 1
    # every text moved behind a space of its own; one more stands at the end
    padded = np.full(len(chars) + n + 1, 32, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(at))
    padded[np.arange(len(chars)) + owner + 1] = chars
    padded[np.isin(padded, (9, 10, 11, 12, 13))] = 32
    ends = at[1:] + np.arange(1, n + 1) + 1  # past the space after each text, which is the next one's first
    first = at[:-1] + np.arange(n)
    text_of = np.repeat(np.arange(n), ends - first - 1)
    left = np.repeat(ends, ends - first - 1) - np.arange(len(text_of))
    h = np.zeros(len(padded), np.uint32)
    scrambled = (padded + np.uint32(1)) * np.uint32(0x9E3779B1)
    scrambled ^= scrambled >> np.uint32(15)
    done = 0
    for order in ORDERS:
        for k in range(done, min(order, len(h))):
            h[: len(h) - k] = (h[: len(h) - k] ^ scrambled[k:]) * _PRIME
            h[: len(h) - k] ^= h[: len(h) - k] >> np.uint32(13)
        done = order
        bucket = ((h * np.uint32(0x85EBCA6B)) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        yield bucket[: len(text_of)], np.where(left >= order, text_of, -1)


def features(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, and pairs (text from the first, bucket), each once; only buckets wanted (a table of bools) if given."""
    for first, end, offsets, data in text_blocks(column, BLOCK):
        found = []
        for bucket, text in _grams(offsets, data):
            keep = text >= 0 if wanted is None else wanted[bucket] & (text >= 0)
            found.append((text[keep] << BITS) | bucket[keep])
        pairs = np.unique(np.concatenate(found))
        yield first, end, pairs >> BITS, pairs & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        for first, _, text, bucket in features(batch.column("_text")):
            for label in (0, 1):
                counts[label] += np.bincount(bucket[toxic[first + text] == label], minlength=1 << BITS)
    seen = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[0, seen], pa.int64()), pa.array(counts[1, seen], pa.int64())], ["bucket", "clean", "toxic"])


def _rows(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[buckets] = True
        for batch in batches:
            out = []
            for first, end, text, bucket in features(batch.column("_text"), wanted):
                out += np.split(np.searchsorted(buckets, bucket), np.searchsorted(text, np.arange(1, end - first)))
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["_h", "toxic", "x"])

    return run


def _regress(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge on the weights, by the limited-memory BFGS method; gives the weights times r, and the bias."""
    at = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value, n = r[at], len(r)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, value * w[at], len(rows)) + w[n]
        e = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        slope = np.append(np.bincount(at, value * e[of], n) + RIDGE * w[:n], e.sum())
        return float((np.logaddexp(0, z) - y * z).sum() + RIDGE / 2 * (w[:n] ** 2).sum()), slope

    w = np.zeros(n + 1)
    w[n] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    f, g = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, used = g.copy(), []
        for s, t in reversed(moves):
            c = (s @ d) / (s @ t)
            used.append(c)
            d -= c * t
        d *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, t), c in zip(moves, reversed(used), strict=True):
            d += s * (c - (t @ d) / (s @ t))
        step = 1.0
        while True:
            f2, g2 = loss(w - step * d)
            if f2 <= f - 1e-4 * step * (g @ d) or step < 1e-10:
                break
            step /= 2
        s, t = -step * d, g2 - g
        if s @ t > 1e-12:
            moves = [*moves[-9:], (s, t)]
        done = f - f2 < 1e-7 * abs(f)
        w, f, g = w + s, f2, g2
        if done:
            break
    return w[:n] * r, float(w[n])


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """labelled: texts with a label 0 or 1 (rows with others take no part). Fitted on train_rows of them at most.

    Without a row of either label the model has no features: it gives every text the share of toxic rows.
    """
    known = labelled.filter(F.col(f"`{toxic}`").isin(0, 1)).select(F.xxhash64(F.col(f"`{doc_id}`")).alias("_h"), F.col(f"`{toxic}`").cast("int").alias("toxic"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_text"))
    train = stored(known.orderBy("_h", "_text").limit(train_rows).repartition(24), "train")
    n = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, bad = n.get(0, 0), n.get(1, 0)
    if not clean or not bad:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((bad + 0.5) / (clean + 0.5))))
    counts = train.mapInArrow(lean(_count), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + SMOOTH) / (bad + 2 * SMOOTH)) - F.log((F.col("clean") + SMOOTH) / (clean + 2 * SMOOTH))
    best = counts.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS).withColumn("r", ratio).orderBy(F.desc(F.abs("r") * F.sqrt(F.col("clean") + F.col("toxic"))), "bucket").limit(FEATURES)
    kept = sorted((x.bucket, x.r) for x in best.collect())
    buckets, r = np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept])
    # in one order whatever the tasks did, so that sums round alike and reruns give the same model
    rows = sorted(train.mapInArrow(lean(_rows(buckets)), "_h long, toxic int, x array<int>").collect())
    weights, bias = _regress([np.array(x.x, np.int64) for x in rows], np.array([x.toxic for x in rows], float), r)
    return Model(buckets, weights, bias)


def _scorer(model: Model):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pa.set_memory_pool(pa.system_memory_pool())
        weights, wanted = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weights[model.buckets], wanted[model.buckets] = model.weights, True
        for column in batches:
            z = np.full(len(column), model.bias)
            for first, end, text, bucket in features(column, wanted):
                z[first:end] += np.bincount(text, weights[bucket], end - first)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        trim()

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5); columns so named are replaced.

    Only the text counts, the whole of it; a null text is scored as an empty one. Repeated rows score alike. Texts go to
    Python and only scores come back.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"score", "predicted"}]
    whole = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.select(*rest, _scorer(model)(whole).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_tables(spark: SparkSession, sf_dir: str) -> Model:
    """From the labelled documents outside the held-out fifth. The labels' ids join a bounded sample, so that few texts move."""
    labels = table(spark, sf_dir, "labels").filter(~held_out()).filter("toxic in (0, 1)").select("doc_id", "toxic")
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # TRAIN_ROWS x 12 bytes
    return fit(table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(sample), "doc_id"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't take for toxic, with their columns as they are."""
    mark = fresh(docs, "_score")
    whole = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.withColumn(mark, _scorer(model)(whole)).filter(F.col(mark) < 0.5).drop(mark)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    return score(docs, fit_tables(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
