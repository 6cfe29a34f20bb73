"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

Documents with the same shingle set are one node. A node's signature has BANDS x ROWS slots; nodes that agree in all slots
of a band meet in a bucket. A bucket of two asks one question. What links the nodes of a larger one is found in two steps:

1. Rounds: in each bucket that holds several components, one node of the component with the smallest root leads, and the
   others are asked about it; each node takes that of its leaders that looks most alike (by sketches: four bits of each
   slot), is held against it on full sets, and union-find joins what is linked. Nodes of the leading component ask nothing
   any more: a group of copies costs a few comparisons a node, whatever its size. Rounds end when they find few links.
2. What is still apart in a bucket is compared whole, in blocks of nodes: a row is a pair of blocks, not of nodes. The largest
   component of a bucket is the home of all in it; nodes of one home fill blocks, those that are the home apart from those
   that are not, and each block of the latter meets all blocks of its home, and blocks of other homes that it shares a bucket
   with. Sketches rule pairs out first, full sets decide on all others. No cap ends this early.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom.llm.common import _IS_SPACE, forget, fresh, lean, mix64, small_batches, stored, table, text_blocks
from factloom.llm.components import components, forest

#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS = 1.2e-6.
BANDS, ROWS = 45, 6
SLOTS = BANDS * ROWS
#: Probability with which a sketch may rule out a pair right at the threshold (less above it): a twelfth of what banding loses.
MISSED = 1e-7
#: Rounds go on while one in so many asking nodes finds a link.
WORTH = 8
#: Nodes of a block, and shingles of its sets: what two blocks hold fits any task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Similarity from which documents are linked, in hundredths.
PERCENT = 80
#: Sets of this size and more run their few steps with a list of swaps, smaller ones with whole permutations.
LONG_SET = 160
_STEP = 1 << 16

_random = np.random.default_rng(20240611)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[_IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(0, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 1 << 63, SLOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, and where each text's words begin (and the last end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data))
    place -= np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mix64(np.add.reduceat(_BYTE[data] * powers[place], starts)), np.searchsorted(starts, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `words` words; with fewer, of the whole sequence; [] without words."""
    hashes, first = word_hashes(offsets, data)
    n = len(hashes)
    runs = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        if len(runs):
            runs += hashes[k : k + len(runs)] * _PLACE[k % 64] + np.uint64(k // 64)
    runs = mix64(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            k = np.arange(b - a)
            whole = (hashes[a:b] * _PLACE[k % 64] + (k // 64).astype(np.uint64)).sum(dtype=np.uint64)
            out.append(mix64(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            out.append(hashes[:0])
    return out


def _draw(elements: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element in step j: its value, j plus a fraction, and the place from j on that it swaps to the front."""
    x = mix64(elements + np.uint64(((j + 1) * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
    return j + (x >> np.uint64(32)) * 2.0**-32, (j + (x & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS - j)).astype(np.int64)


def _ranks(elements: np.ndarray, owner: np.ndarray, h: np.ndarray, whole: bool) -> None:
    """Lowers h (sets x SLOTS) by the elements' ranks, step by step, until no later step can lower any."""
    flat, base = h.reshape(-1), owner * SLOTS
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.arange(len(elements))
    perm = np.broadcast_to(np.arange(SLOTS, dtype=np.uint16), (len(elements), SLOTS)).copy() if whole else None
    for j in range(SLOTS):
        value, k = _draw(elements, j)
        if perm is not None:
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        else:
            slot, moved = k.copy(), np.full(len(k), j)
            for k2, v2 in swaps:
                np.copyto(slot, v2, where=k2 == k)
                np.copyto(moved, v2, where=k2 == j)
            swaps.append((k, moved))
        np.minimum.at(flat, base + slot, value)
        if perm is None or j % 8 == 7:
            open_ = h.max(1) >= j + 1
            if not open_.any():
                return
            if perm is not None and not open_.all():
                keep = open_[owner]
                if keep.sum() * 4 < 3 * len(keep):
                    elements, owner, base, perm = elements[keep], owner[keep], base[keep], perm[keep]
                    at = np.arange(len(elements))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: sets x SLOTS. Each element takes all places in an order of its own, with values that grow by 1 a step."""
    h = np.full((len(sets), SLOTS), np.inf)
    sizes = np.array([len(s) for s in sets])
    order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i]]
    while order:
        whole = sizes[order[0]] < LONG_SET
        most = (_STEP if not whole else _STEP // 8) or 1
        take, total = [], 0
        for i in order:
            if take and (total + sizes[i] > most or (sizes[i] < LONG_SET) != whole or 2 * sizes[i] < sizes[take[0]]):
                break
            take.append(i)
            total += sizes[i]
        order = order[len(take) :]
        part = h[take]
        if len(take) == 1 and total > most:
            for lo in range(0, total, most):
                piece = sets[take[0]][lo : lo + most]
                _ranks(piece, np.zeros(len(piece), np.int64), part, whole)
        else:
            _ranks(np.concatenate([sets[i] for i in take]), np.repeat(np.arange(len(take)), sizes[take]), part, whole)
        h[take] = part
    return h


def band_keys(h: np.ndarray) -> np.ndarray:
    """Sets x BANDS: what all slots of a band, and its number, hash to."""
    bits = mix64(h.view(np.uint64)) * _BAND
    with np.errstate(over="ignore"):
        return mix64(bits.reshape(len(h), BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(h: np.ndarray) -> np.ndarray:
    """Sets x words: four bits of each slot, sixteen slots to a word."""
    bits = mix64(h.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(15)
    bits = np.pad(bits, ((0, 0), (0, -SLOTS % 16))).reshape(len(h), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def _agreeing(a: str, b: str) -> F.Column:
    """How many slots agree in the sketches a and b."""
    total = F.lit(SLOTS)
    for i in range(-(-SLOTS // 16)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        z = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        total = total - F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def least_agreeing(percent: int, missed: float = MISSED) -> int:
    """The fewest agreeing slots with which a pair is held to be possible: a pair at the threshold has fewer with at most that probability."""
    p = percent / 100 + (1 - percent / 100) / 16
    if p >= 1:
        return SLOTS
    below = 0.0
    for k in range(SLOTS + 1):
        below += math.exp(math.lgamma(SLOTS + 1) - math.lgamma(k + 1) - math.lgamma(SLOTS - k + 1) + k * math.log(p) + (SLOTS - k) * math.log(1 - p))
        if below > missed:
            return k
    return SLOTS


def possible(sizes: np.ndarray, shown: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Which pairs (i, j) of nodes can be linked, by their sizes and sketches."""
    ok = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), _STEP):
        some = at[lo : lo + _STEP]
        x = shown[i[some]] ^ shown[j[some]]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= np.uint64(0x1111111111111111)
        ok[some] = SLOTS - np.bitwise_count(x).sum(1, dtype=np.int64) >= least
    return ok


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(words: int, least: int):
    """least: the smallest set that can be like a different one. Gives a batch for each block of texts, so that little is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "_text"]
            for first, end, offsets, data in text_blocks(batch.column("_text"), 1 << 20):
                sets = shingle_sets(offsets, data, words)
                keys, shown = [None] * len(sets), [None] * len(sets)
                if large := [i for i, s in enumerate(sets) if len(s) >= least]:
                    h = signatures([sets[i] for i in large])
                    for i, k, d in zip(large, band_keys(h), sketches(h), strict=True):
                        keys[i], shown[i] = k, d.tobytes()
                made = {
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "_set": pa.array([_name(s) if len(s) else None for s in sets], pa.binary()),
                    "_bands": pa.array(keys, pa.list_(pa.int64())),
                    "_sketch": pa.array(shown, pa.binary()),
                }
                held = {n: batch.column(n).slice(first, end - first) for n in rest}
                yield pa.RecordBatch.from_pydict(held | made)

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in text_blocks(batch.column("_text"), 1 << 20):
                sets = [s for s in shingle_sets(offsets, data, words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["_set", "s"])

    return run


def _words_of(sketch: str) -> F.Column:
    """A sketch's words as numbers (their order of bytes does not matter, agreement being counted by bits)."""
    return F.transform(F.sequence(F.lit(0), F.lit(-(-SLOTS // 16) - 1)), lambda i: F.conv(F.hex(F.substring(F.col(sketch), i * 8 + 1, 8)), 16, -10).cast("long"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: a written table, by whose size Spark decides whether sets have to move to be found."""
    one = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    needed = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
    two = needed.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    sizes = F.size("sa") + F.size("sb")
    return pairs.join(one, "a").join(two, "b").filter(100 * shared >= percent * (sizes - shared)).select("a", "b")


def _alike(pairs: DataFrame, about: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) that can be linked by their sizes and sketches, with the number of slots that agree."""
    one, two = (about.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), _words_of("shown").alias(f"s{x}")) for x in "ab")
    like = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(one, "a").join(two, "b").filter(like).select("a", "b", _agreeing("sa", "sb").alias("same")).filter(F.col("same") >= least)


def _packed(column: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _compared(percent: int, least: int):
    """Of pairs of blocks: the possible pairs of nodes of different components, as places in a list of the nodes that they take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one, two = batch.column("one")[k].values, batch.column("two")[k].values
                if batch.column("same")[k].as_py():
                    nodes = one
                    i, j = np.triu_indices(len(one), 1)
                else:
                    nodes = pa.concat_arrays([one, two])
                    i, j = (x.ravel() for x in np.indices((len(one), len(two))))
                    j = j + len(one)
                star = nodes.field("star").to_numpy()
                apart = star[i] != star[j]
                i, j = i[apart], j[apart]
                ok = possible(nodes.field("n").to_numpy(), _packed(nodes.field("shown").to_pylist(), np.uint64), i, j, percent, least)
                i, j = i[ok], j[ok]
                if len(i):
                    taken, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                    pairs = at.reshape(2, -1).astype(np.int16)
                    held = nodes.field("node").to_numpy()[taken]
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.int64())), pa.array([pairs.tobytes()], pa.binary())], ["nodes", "pairs"])

    return run


def _linked(percent: int):
    """Of lists of nodes with their sets, and places of pairs: a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                nodes = batch.column("nodes")[k].values.to_numpy()
                held = batch.column("held")[k].values
                place = {n: x for x, n in enumerate(held.field("node").to_pylist())}
                sets = [held.field("s")[place[n]].values.to_numpy() for n in nodes.tolist()]
                sizes = np.array([len(s) for s in sets])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                values, at = np.unique(np.concatenate(sets), return_inverse=True)
                found: list[tuple[int, int]] = []
                pairs = np.frombuffer(batch.column("pairs")[k].as_py(), np.int16).reshape(2, -1).astype(np.int64)
                if len(np.unique(pairs[0])) > len(np.unique(pairs[1])):
                    pairs = pairs[::-1]
                mine = np.zeros(len(values), bool)
                for i in np.unique(pairs[0]).tolist():
                    others = pairs[1][pairs[0] == i]
                    mine[at[ends[i] : ends[i + 1]]] = True
                    shared = np.array([np.count_nonzero(mine[at[ends[j] : ends[j + 1]]]) for j in others.tolist()])
                    mine[at[ends[i] : ends[i + 1]]] = False
                    linked = 100 * shared >= percent * (sizes[i] + sizes[others] - shared)
                    found += [(i, j) for j in others[linked].tolist()]
                if found:
                    a, b = forest(nodes[[i for i, _ in found]], nodes[[j for _, j in found]])
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _starred(members: DataFrame, stars: DataFrame) -> DataFrame:
    """members with each node's component: the smallest node of it."""
    return members.join(stars.select(F.col("a").alias("node"), F.col("b").alias("star")), "node", "left").select("key", "node", F.coalesce("star", "node").alias("star"))


def _unsettled(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Those of buckets that hold several components."""
    named = _starred(members, stars)
    several = named.groupBy("key").agg(F.min("star").alias("lo"), F.max("star").alias("hi")).filter("lo < hi").select("key")
    return stored(named.join(several, "key"), "unsettled")


def _round(members: DataFrame, about: DataFrame, stars: DataFrame, seen: DataFrame, sets: DataFrame, percent: int, least: int, number: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Components, pairs asked about so far, and how many nodes asked and how many links were found."""
    named = _unsettled(members, stars)
    lead = named.groupBy("key").agg(F.min(F.struct("star", F.xxhash64("node", "key", F.lit(number)).alias("h"), "node")).alias("l"))
    lead = stored(lead.select("key", F.col("l.node").alias("leader"), F.col("l.star").alias("leads")), "leaders")
    met = named.join(lead, "key").filter("star <> leads").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    met = stored(met.join(seen, ["a", "b"], "left_anti"), "met")
    asked = stored(_alike(met, about, percent, least).groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b")), "asked")
    links = stored(_verified(asked, sets, percent), "links")
    n, found = asked.count(), links.count()
    if found:
        stars = components(stars.select("a", "b").union(links))
    forget(named, lead, met)
    return stars, seen.union(asked), n, found


def _rest_of_links(members: DataFrame, about: DataFrame, stars: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame | None:
    """Links between components that rounds left apart: all possible pairs of each bucket, in blocks. None if nothing is left."""
    left = _unsettled(members, stars)
    if not left.take(1):
        return None
    counts = left.groupBy("key", "star").agg(F.count("*").alias("n"))
    main = stored(counts.groupBy("key").agg(F.max_by("star", F.struct("n", -F.col("star"))).alias("home")), "homes")
    # a node may have several homes; it lives in one and is met from the others
    homes = left.join(main, "key")
    own = F.bool_or(F.col("home") == F.col("star"))
    lives = stored(homes.groupBy("node", "star").agg(F.when(own, F.col("star")).otherwise(F.min("home")).alias("home"), (~own).alias("guest")), "lives")
    sized = lives.join(about, "node")
    parts = sized.groupBy("home", "guest").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    block = F.struct("home", "guest", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    placed = stored(lives.join(parts, ["home", "guest"]).select("node", "star", block.alias("block")), "placed")
    filled = placed.join(about, "node").groupBy("block").agg(F.collect_list(F.struct("node", "star", "n", "shown")).alias("held"))  # about BLOCK nodes
    blocks = stored(filled, "blocks")
    known = blocks.select("block")
    guests = known.filter("block.guest")
    at_home = guests.select(F.col("block").alias("a")).join(known.select(F.col("block").alias("b")), F.expr("a.home = b.home and (not b.guest or a.part <= b.part)"))
    seen_in = left.join(placed.select("node", "block"), "node").select("key", "block").distinct()
    seen_in = stored(seen_in.join(_several_homes(seen_in), "key"), "seen_in")
    abroad = seen_in.select("key", F.col("block").alias("a")).join(seen_in.select("key", F.col("block").alias("b")), "key").filter("a.home < b.home").select("a", "b").distinct()
    pairs = stored(at_home.union(abroad), "block_pairs")
    one, two = (blocks.select(F.col("block").alias(x), F.col("held").alias(name)) for x, name in (("a", "one"), ("b", "two")))
    met = pairs.join(one, "a").join(two, "b").select("one", "two", F.expr("a = b").alias("same"))
    found = met.mapInArrow(lean(_compared(percent, least)), "nodes array<long>, pairs binary")
    found = stored(found.withColumn("at", F.monotonically_increasing_id()), "possible")
    taken = stored(found.select("at", F.explode("nodes").alias("node")), "taken")
    held = taken.join(sets, "node").groupBy("at").agg(F.collect_list(F.struct("node", "s")).alias("held"))
    return found.join(held, "at").select("nodes", "pairs", "held").mapInArrow(lean(_linked(percent)), "a long, b long")


def _several_homes(seen_in: DataFrame) -> DataFrame:
    """Buckets whose nodes live in several homes."""
    return seen_in.groupBy("key").agg(F.min("block.home").alias("lo"), F.max("block.home").alias("hi")).filter("lo < hi").select("key")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without the text, with n_shingles, component_id and kept (columns so named are replaced).

    Words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. A document's set: its distinct runs of `words` words; with fewer words the
    whole sequence as one. Documents are linked when 100 * intersection >= percent * union. component_id: the smallest id
    reachable. Documents without words (or text) are linked with nothing, as are those with a null id, whose component_id is
    null and which are kept. Repeated ids share a component if their sets do. An empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in {"n_shingles", "component_id", "kept"}]
    least = max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 62
    ids = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = ids.drop("_text").schema.add("n_shingles", "long").add("_set", "binary").add("_bands", T.ArrayType(T.LongType())).add("_sketch", "binary")
    possible_from = least_agreeing(percent)
    with small_batches(docs.sparkSession):
        signed = stored(ids.mapInArrow(lean(_signed(words, least)), schema), "signed")
    classes = signed.filter("_set is not null and _id is not null").groupBy("_set").agg(F.min("_id").alias("least"), F.max("n_shingles").alias("n"), F.first(F.struct("_bands", "_sketch")).alias("_f"))
    classes = stored(classes.select("_set", "least", "n", "_f.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = classes.select("node", F.explode("_bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("nodes"), F.min("node").alias("a"), F.max("node").alias("b")).filter("nodes > 1")
    buckets = stored(buckets, "buckets")  # by its size Spark decides how to find its members
    twos = stored(buckets.filter("nodes = 2").select("a", "b").distinct(), "twos")
    members = stored(spread.join(buckets.filter("nodes > 2").select("key"), "key"), "members")
    nodes = stored(twos.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct(), "nodes")
    wanted = stored(classes.select("node", "least", "_set", "n", F.col("_sketch").alias("shown")).join(nodes, "node"), "wanted")
    forget(buckets, nodes)
    # written by itself, so that Spark sees how small it is: texts then need not move
    named = stored(wanted.select("least", "_set", "node"), "named")
    texts = ids.select("_id", "_text").join(named.select(F.col("least").alias("_id")), "_id", "left_semi").select("_text")
    with small_batches(docs.sparkSession):
        sets = stored(texts.mapInArrow(lean(_whole_sets(words)), "_set binary, s array<long>").join(named.select("_set", "node"), "_set").select("node", "s"), "sets")
    if sets.count() > wanted.count():  # of repeated rows
        sets = stored(sets.dropDuplicates(["node"]), "sets")

    about = wanted.select("node", "n", "shown")
    seen = stored(_alike(twos, about, percent, possible_from).select("a", "b"), "asked")
    stars = components(_verified(seen, sets, percent))
    number, asked, found = 0, 1, 1
    while found and WORTH * found >= asked:
        stars, seen, asked, found = _round(members, about, stars, seen, sets, percent, possible_from, number)
        number += 1
    with small_batches(docs.sparkSession):
        links = _rest_of_links(members, about, stars, sets, percent, possible_from)
        if links is not None:
            stars = components(stars.select("a", "b").union(stored(links, "links")))
    forget(members, sets, wanted)
    starred = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), "b").distinct())
    smallest = starred.join(classes.select(F.col("node").alias("a"), "least"), "a").groupBy("b").agg(F.min("least").alias("component_id"))
    of = classes.select("node", "_set", "least").join(starred.join(smallest, "b").select(F.col("a").alias("node"), "component_id"), "node", "left").select(F.col("_set").alias("_of"), F.coalesce("component_id", "least").alias("component_id"))
    out = signed.drop("_bands", "_sketch").join(of, F.col("_set") == F.col("_of"), "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def near_deduplicated(docs: DataFrame, words: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns as they are."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"))
    dropped = near_dedup(plain, words, percent, "i", "t").filter("not kept").select("i").distinct()
    gone = fresh(docs, "_gone")
    return docs.join(stored(dropped.select(F.col("i").alias(gone)), "dropped"), F.col(f"`{doc_id}`") == F.col(gone), "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
