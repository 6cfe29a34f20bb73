"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A text's hash is its key, so that equal texts stand at one place of the ring. The ring is cut into a fixed number of bins;
a bin belongs to the next virtual node clockwise. Loads are summed by bin, and a bin that finds its shard full goes on
clockwise to the next shard with room. What the driver holds is the list of bins, whose length never grows with the data.
A bin with over half a shard's bytes is dealt into sub-bins by a hash of the text, and only what overflows moves on; a text
whose copies alone are over a quarter of a shard is dealt by a hash of the id.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.llm.common import stored, table

#: The ring has 2 ** RING_BITS bins; a heavy bin is dealt into PARTS sub-bins.
RING_BITS, PARTS = 17, 256
#: Virtual nodes of a shard, and a shard's room over the mean load. With so many bins and nodes a shard's own arcs hold the mean
#: within two percent, so that even this little room keeps 96 percent of bins at home, and a shard more moves 4.4 percent of
#: bytes (4 is the least for the 25th).
NODES, ROOM = 2048, 0.0003


def ring_owners(shards: int, bits: int = RING_BITS, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The virtual nodes clockwise: place and shard of each; and for each bin the index of the first node at or after it."""
    points = sorted((int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:6], "big"), s) for s in range(shards) for v in range(nodes))
    places, owners = np.array([p for p, _ in points]), np.array([s for _, s in points])
    bins = np.arange(1 << bits, dtype=np.int64) << (48 - bits)
    return places, owners, np.searchsorted(places, bins) % len(points)


def place(units: list[tuple[int, int, int]], shards: int, bits: int = RING_BITS, nodes: int = NODES, room: float = ROOM) -> list[int]:
    """The shard of each unit (bin, part, load): its node's shard, or the next one clockwise with room.

    Larger units choose first, so that the small ones even out the rest. A unit that no shard has room for (it is larger
    than what any has left) goes to the least loaded shard.
    """
    _, owners, first = ring_owners(shards, bits, nodes)
    loads = np.zeros(shards, np.int64)
    total = sum(u[2] for u in units)
    most = int(-(-total * (1 + room) // shards))
    out = [0] * len(units)
    for k in sorted(range(len(units)), key=lambda k: (-units[k][2], units[k][0], units[k][1])):
        b, _, load = units[k]
        at, tried = int(first[b]), 0
        shard = int(owners[at])
        if loads[shard] + load > most:
            if not (loads + load <= most).any():
                shard = int(loads.argmin())
            else:
                while loads[shard] + load > most:
                    at, tried = (at + 1) % len(owners), tried + 1
                    shard = int(owners[at])
        loads[shard] += load
        out[k] = shard
    return out


def _part(of: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(of, F.lit("part")), F.lit(PARTS)).cast("int")


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", bits: int = RING_BITS, room: float = ROOM) -> DataFrame:
    """The rows of docs without the text, with size, text_crc32, law, shard, slot and grown_shard (columns so named are replaced).

    Size: UTF-8 bytes of the text (null: none) plus 8. The law is `bytes`: no shard holds more than (1 + room) times the mean,
    so far as single texts allow it. Equal texts (null and empty ones too) go to one shard, but for those whose copies hold
    over a quarter of a shard's bytes: they are dealt by id, and their parts find room apart. Repeated rows are placed alike.
    slot counts a shard's rows from 0 without a gap. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    names = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    rest = [c for c in docs.columns if c != text and c.lower() not in names]
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    key = F.xxhash64(raw)
    keyed = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"),
            (F.length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.shiftrightunsigned(key, 64 - bits).cast("int").alias("_bin"),
            key.alias("_text"),
            _part(F.col(f"`{doc_id}`").cast("string")).alias("_by_id"),
        ).withColumn("_at", F.monotonically_increasing_id()),
        "keyed",
    )
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("rows")]
    bins = keyed.groupBy("_bin").agg(*sums).collect()  # 2 ** bits rows at most
    all_bytes, all_rows = sum(r.bytes for r in bins), sum(r.rows for r in bins)
    share = {r._bin: max(r.bytes / all_bytes, r.rows / all_rows) for r in bins if r.rows > 1}
    # rows of a large bin are numbered by parts; only of a bin over half a shard's bytes the parts are placed apart
    dealt = sorted(b for b, x in share.items() if 16 * shards * x > 1)  # under 32 x shards of them
    apart = {r._bin for r in bins if r._bin in set(dealt) and 2 * shards * r.bytes > all_bytes}
    counts = [(r._bin, 0, r.bytes, r.rows) for r in bins if r._bin not in set(dealt)]
    part = F.lit(0)
    if dealt:
        held = keyed.filter(F.col("_bin").isin(dealt))
        # under 4 x shards texts are that heavy
        heavy = [r._text for r in held.groupBy("_text").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * 4 * shards > all_bytes).collect()]
        by_text = _part(F.col("_text"))
        within = F.when(F.col("_text").isin(heavy), F.col("_by_id") + PARTS).otherwise(by_text) if heavy else by_text
        part = F.when(F.col("_bin").isin(dealt), within).otherwise(0)
        counts += [(r._bin, r.part, r.bytes, r.rows) for r in held.groupBy("_bin", part.alias("part")).agg(*sums).collect()]
    units: dict[tuple[int, int], int] = {}
    for b, p, size, _ in counts:
        key = (b, p if b in apart else 0)
        units[key] = units.get(key, 0) + size
    placed = dict(zip(units, place([(b, p, size) for (b, p), size in units.items()], shards, bits, room=room), strict=True))
    plan, filled = [], [0] * shards
    for b, p, _, rows in sorted(counts):
        s = placed[b, p if b in apart else 0]
        plan.append((b, p, s, filled[s]))
        filled[s] += rows
    # at most 2 ** bits + 64 x shards x PARTS rows of 24 bytes, whatever the input
    plan = spark.createDataFrame(plan, "_bin int, _unit int, shard int, _start long")
    within = Window.partitionBy("_bin", "_unit").orderBy("_at")
    return (
        keyed.withColumn("_unit", part)
        .withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(plan), ["_bin", "_unit"])
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
