"""Toxicity, SentencePiece, token counts, search, sharding, mixing and URL filters."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from helpers import documents, empty, sentence, words
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import mixing as M, sentencepiece_wfst as P, sharding as S, token_counts as C, topk as K, toxicity as X, url_filters as U

VOCABULARY = pytest.mark.skipif(not os.path.isfile(P.MODEL), reason="no public vocabulary here")


# --- toxicity


def labelled(spark, n=400):
    rnd = random.Random(8)
    rows = [(i, sentence(rnd, 40) + (" you utter MORON" if i % 4 == 0 else "") + " " + sentence(rnd, 20), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns(spark):
    docs = labelled(spark)
    model = X.fit(docs.filter("doc_id < 300"))
    got = X.score(docs.filter("doc_id >= 300").withColumn("predicted", F.lit("old")), model)
    assert got.filter("predicted = toxic").count() == 100 and got.filter("score < 0 or score > 1").count() == 0


def test_toxicity_bears_odd_rows(spark):
    model = X.fit(labelled(spark, 100))
    docs = documents(spark)
    got = X.score(docs.drop("score"), model)
    assert got.count() == docs.count() and got.filter("score is null or isnan(score)").count() == 0
    assert got.filter("text is null or text = ''").select("score").distinct().count() == 1
    assert X.accepted(docs, model).columns == docs.columns and X.accepted(empty(spark), model).count() == 0
    for some in (empty(spark).withColumn("toxic", F.lit(1)), labelled(spark).filter("toxic = 0"), labelled(spark).withColumn("toxic", F.lit(2))):
        one_sided = X.fit(some)
        assert not len(one_sided.weights) and X.score(docs, one_sided).filter("score is null").count() == 0


def test_ngrams_stay_within_texts():
    import pyarrow as pa

    def seen(texts):
        return [set(bucket[text == i].tolist()) for _, _, text, bucket in X.features(pa.array(texts)) for i in range(len(texts))]

    alone = [seen([t])[0] for t in ("abc def", "été", "")]
    assert seen(["abc def", "été", ""]) == alone and not alone[2]


def plain_grams(text):
    """Character n-grams of a text with a space before and after it, white space as spaces."""
    padded = " " + "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text) + " "
    return {padded[i : i + n] for n in X.ORDERS for i in range(len(padded) - n + 1)} if text else set()


def test_toxicity_equals_plain_python(spark):
    """Fifty texts: counts and ratios by n-gram, the loss at its least, and scores, all without the operator's arrays."""
    rnd = random.Random(11)
    rows = [(i, sentence(rnd, 12) + (" vile MORON" if i % 3 == 0 else " fine day") + (" été" if i % 5 == 0 else ""), int(i % 3 == 0)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.fit(docs)
    grams = [plain_grams(t.lower()) for _, t, _ in rows]
    bucket = {g: int(b) for g in set().union(*grams) for b in [gram_bucket(g)]}
    seen = [{bucket[g] for g in gs} for gs in grams]
    label = [y for _, _, y in rows]
    bad, clean = sum(label), len(label) - sum(label)
    ratio = {}
    for b in set().union(*seen):
        t, c = sum(b in s for s, y in zip(seen, label, strict=True) if y), sum(b in s for s, y in zip(seen, label, strict=True) if not y)
        if t + c >= X.LEAST_DOCS:
            r = math.log((t + X.SMOOTH) / (bad + 2 * X.SMOOTH)) - math.log((c + X.SMOOTH) / (clean + 2 * X.SMOOTH))
            ratio[b] = (r, abs(r) * math.sqrt(t + c))
    least = sorted((v for _, v in ratio.values()), reverse=True)[: X.FEATURES][-1]
    assert {b for b, (_, v) in ratio.items() if v > least + 1e-12} <= set(model.buckets.tolist()) <= {b for b, (_, v) in ratio.items() if v >= least - 1e-12}
    # the weights are r times w, where w has the least ridge loss: no small step lowers it
    w = {b: float(x) / ratio[b][0] for b, x in zip(model.buckets.tolist(), model.weights, strict=True) if ratio[b][0]}

    def loss(w, bias):
        total = X.RIDGE / 2 * sum(x * x for x in w.values())
        for s, y in zip(seen, label, strict=True):
            z = bias + sum(w[b] * ratio[b][0] for b in s if b in w)
            total += math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z
        return total

    here = loss(w, model.bias)
    for b in rnd.sample(sorted(w), 12):
        for step in (-0.02, 0.02):
            assert loss(w | {b: w[b] + step}, model.bias) > here - 1e-4
    assert min(loss(w, model.bias + 0.05), loss(w, model.bias - 0.05)) > here - 1e-4
    for r in X.score(docs, model).collect():
        z = model.bias + sum(w[b] * ratio[b][0] for b in seen[r.doc_id] if b in w)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def gram_bucket(gram):
    """The bucket of an n-gram: by the operator's own hash, of a text that is nothing else."""
    chars = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
    with np.errstate(over="ignore"):
        mixed = (chars + np.uint32(1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        h = np.zeros(1, np.uint32)
        for c in mixed:
            h = (h ^ c) * X._PRIME
            h ^= h >> np.uint32(13)
        return ((h * np.uint32(0x85EBCA6B)) + np.uint32(len(gram) * 0x27D4EB2F & 0xFFFFFFFF))[0] >> np.uint32(32 - X.BITS)


def test_held_out_labels_change_no_score(spark, tmp_path):
    rnd = random.Random(12)
    docs = [(i, sentence(rnd, 20) + (" moron" if i % 4 == 0 else "")) for i in range(120)]
    scores = []
    for flip in (False, True):
        where = tmp_path / str(flip)
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
        labels = [(i, int(i % 4 == 0) ^ int(flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in docs]
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
        got = X.op1_toxicity(spark, str(where)).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        scores.append({r.doc_id: r.score for r in got})
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 10


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = X.op1_toxicity(spark, d).join(labels, "doc_id").filter("held_out").toPandas()
    order = got.score.rank().to_numpy()
    y = got.toxic.to_numpy()
    auc = (order[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()
    assert auc > 0.8


# --- SentencePiece


@VOCABULARY
def test_encoding_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    docs = documents(spark)
    got = P.encode(docs, P.compile_model())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        if r.doc_id is not None:
            assert r.piece_ids == library.encode(texts[r.doc_id] or "") and r.round_trip
    back = {r.doc_id: r.text for r in P.decode(got, P.compile_model()).collect()}
    assert all(back[i] == (t or "") for i, t in texts.items() if i is not None)
    assert P.encode(empty(spark), P.compile_model()).count() == 0


@pytest.fixture(scope="module")
def machines():
    import sentencepiece

    return P.Transducer(P.compile_model()), sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@VOCABULARY
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab theing\n\t.▁é😀ß1日\x00"), max_size=60))
def test_encoding_equals_the_library_on_odd_texts(machines, text):
    mine, library = machines
    ids = mine.encode(text)
    assert ids == library.encode(text) and mine.decode(ids) == library.decode(ids)


def test_unigram_paths_are_shortest():
    pieces = ["<unk>", "▁a", "b", "ab", "▁", "a", "▁ab", "bb"]
    scores = [0.0, -1.0, -1.5, -1.2, -2.0, -1.1, -2.2, -1.0]
    m = P.Transducer(P.Compiled(tuple(pieces), tuple(scores), (2, *[1] * 7), True, True, False))
    rnd = random.Random(2)

    def best(text):
        cost = {0: 0.0}
        for j in range(1, len(text) + 1):
            options = [cost[j - len(p)] - s for p, s in zip(pieces[1:], scores[1:], strict=True) if text[:j].endswith(p) and j - len(p) in cost]
            options += [cost[j - 1] + 12.2] if text[j - 1] not in pieces else []
            if options:
                cost[j] = min(options)
        return cost[len(text)]

    for _ in range(300):
        text = m.normalise("".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 12))))
        ids = m.path(text)
        assert abs(sum(12.2 if i == 0 else -scores[i] for i in ids) - best(text)) < 1e-9


def test_users_pieces_go_first_and_squeezed_spaces():
    pieces = ["<unk>", "▁", "a", "b", "ab", "bab", "▁a"]
    m = P.Transducer(P.Compiled(tuple(pieces), (0.0, -2.0, -1.0, -1.0, -1.5, 0.0, -1.0), (2, 1, 1, 1, 1, 4, 1), True, True, True))
    assert m.normalise("  a   b ") == "▁a▁b" and m.normalise("   ") == "" and m.encode("abab") == [6, 5]
    assert m.decode(m.encode("  a  b")) == "a b"


def test_byte_pairs_on_the_whole_equal_merging(machines):
    mine, _ = machines
    rnd = random.Random(6)
    for _ in range(300):
        text = mine.normalise("".join(rnd.choice(["th", "e ", "an", "in", "s", ",", "er", " ", "on", "1", "é", "the", "ing"]) for _ in range(rnd.randint(1, 14))))
        assert [mine.model.pieces[i] for i in mine.path(text)] == mine._merge(text)
    whole = [i for i in mine.ids.values() if mine._edges(i)]
    for _ in range(3000):
        a, b = rnd.choice(whole), rnd.choice(whole)
        x, y = mine.model.pieces[a], mine.model.pieces[b]
        assert mine._stay_apart(a, b) == (mine._merge(x + y) == [x, y])


def test_segments_cut_where_no_piece_crosses(machines):
    mine, _ = machines
    pairs = {(a, b) for p in mine.ids for a, b in zip(p, p[1:], strict=False)}
    for text in ("▁the▁², end.\n▁▁x=1;▁日本語のテスト!?▁naïve…", "▁" * 5, "\n\n"):
        parts = mine.segments.findall(text)
        assert "".join(parts) == text and not any((a[-1], b[0]) in pairs for a, b in zip(parts, parts[1:], strict=False))


# --- token counts


def greedy(word, begin, within):
    n = at = 0
    while at < len(word):
        found = next((j for j in range(len(word), at, -1) if word[at:j] in (begin if at == 0 else within)), None)
        if found is None:
            return -1
        n, at = n + 1, found
    return n


@settings(max_examples=300, deadline=None)
@given(st.frozensets(st.text("abcd", min_size=1, max_size=4), max_size=8), st.frozensets(st.text("abcd", min_size=1, max_size=4), max_size=8), st.text("abcde", max_size=14))
def test_longest_match_counts(begin, within, word):
    assert C.Automaton(begin, within).count(word) == greedy(word, begin, within)


@VOCABULARY
def test_token_counts(spark):
    begin, within = C.read_vocabulary()
    docs = documents(spark).withColumn("n_tokens", F.lit("x"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in C.token_counts(docs, begin, within, unknown=3).collect():
        if r.doc_id is not None:
            counts = [greedy(w, begin, within) if len(w) < 1000 else C.Automaton(begin, within).count(w) for w in words(texts[r.doc_id])]
            assert (r.n_words, r.n_tokens) == (len(counts), sum(3 if c < 0 else c for c in counts))
    assert C.token_counts(empty(spark), begin, within).count() == 0


# --- search


def brute_top(rows, k, queries):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(64 * np.float64(x))) for x in v]))
    out = {}
    for q, a in sorted({i: v for i, v in sorted(kept, key=lambda r: (r[0], r[1]), reverse=True)}.items()):
        if queries(q):
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in kept if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def check_top(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = {}
    for r in sorted(K.top_k(df, F.col("vec_id") % 4 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(rows, k, lambda q: q % 4 == 0)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 8)
    monkeypatch.setattr(K, "CHUNK", 32)
    monkeypatch.setattr(K, "GROUP", 16)
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.1 * rnd.normal(size=12)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [float("nan")] * 12), (402, [None] * 12), (None, rows[1][1]), (403, rows[2][1][:3]), (404, [0.0] * 12), (408, rows[3][1]), (409, [float("inf")] * 12)]
    check_top(spark, rows)
    check_top(spark, rows[:3])
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True), 3).count() == 0


def test_top_k_of_large_components(spark):
    check_top(spark, [(i, [1e8 * (i - 3), -2e7 * i, 1.0]) for i in range(12)])
    check_top(spark, [(i, [1e17 * (i - 3), 5.0]) for i in range(6)])


def test_blocks_are_pruned():
    rnd = np.random.default_rng(2)
    x = np.floor(64 * np.concatenate([c + 0.05 * rnd.normal(size=(K.BLOCK, 8)) for c in 4 * rnd.normal(size=(32, 8))]))
    cuts = np.arange(0, len(x), K.BLOCK)
    touched = []

    class Rows(np.ndarray):
        def __getitem__(self, at):
            touched.append(at)
            return np.asarray(super().__getitem__(at))

    out = list(K.scored(np.array([-1]), x[:1], np.array([-np.inf]), np.arange(len(x)), x.view(Rows), np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts), 10))
    want = sorted(((-int(s), i) for i, s in enumerate(x @ x[0])))[:10]
    assert [(-s, i) for _, i, s in out] == want and len([t for t in touched if isinstance(t, slice)]) < 8


# --- sharding


def test_sharding(spark):
    docs = documents(spark).withColumn("law", F.lit(3))
    got = S.shard(docs, 4)
    rows = got.collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for k, held in by.items():
        assert 0 <= k < 4 and sorted(r.slot for r in held) == list(range(len(held)))
    sizes = {r.doc_id: len((r.text or "").encode()) + 8 for r in docs.collect()}
    assert all(r.size == sizes[r.doc_id] for r in rows if r.doc_id is not None)
    again = S.shard(docs.repartition(3), 4).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in rows}
    assert S.shard(empty(spark), 3).count() == 0


def test_shards_are_even_and_groups_whole(spark):
    plain = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), (F.col("id") % 2500).cast("string"), F.lit("with some more words")).alias("text"))
    rows = S.shard(plain, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    mean = sum(r.n for r in rows) / 8
    assert len(rows) == 8 and max(r.n for r in rows) <= mean * 1.02 + 50
    assert S.shard(plain, 8).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


def test_a_hot_text_is_dealt_and_others_in_its_bin_stay_whole(spark):
    """Four bins only, so that many texts share the hot one's."""
    text = F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("own text "), (F.col("id") / 4).cast("int")))
    rows = S.shard(spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text")), 8, bits=2, room=0.02).collect()
    loads, places = [0] * 8, {}
    for r in rows:
        loads[r.shard] += r.size
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(loads) <= 1.05 * sum(loads) / 8
    whole, dealt = sorted(map(len, places.values()))[-2:]
    assert whole == 1 and dealt > 2 and len(places) == 1001


def ring_walk(units, shards, nodes, room, bits):
    """The same law, spelled out: units by falling load step clockwise over the points of all virtual nodes."""
    ring = sorted((int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:6], "big"), s) for s in range(shards) for v in range(nodes))
    most = math.ceil(sum(x for _, _, x in units) * (1 + room) / shards)
    loads, out = [0] * shards, {}
    for b, p, x in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        start = next((k for k, (place, _) in enumerate(ring) if place >= b << (48 - bits)), 0)
        walk = [ring[(start + k) % len(ring)][1] for k in range(len(ring))]
        s = next((s for s in walk if loads[s] + x <= most), min(range(shards), key=lambda s: loads[s]))
        loads[s] += x
        out[b, p] = s
    return out


def test_places_equal_a_plain_ring_walk():
    rnd = random.Random(4)
    for shards, room in ((1, 0.0), (3, 0.0), (7, 0.1), (5, 0.01)):
        units = [(b, p, rnd.choice([1, 5, 40, 400])) for b in range(64) for p in range(rnd.choice([1, 1, 2]))]
        got = S.place(units, shards, bits=6, nodes=9, room=room)
        assert {(b, p): s for (b, p, _), s in zip(units, got, strict=True)} == ring_walk(units, shards, 9, room, 6)
    assert S.place([], 3) == []


def test_sharding_equals_brute_force(spark):
    """Shards of whole documents by plain Python, from the hash that the ring takes."""
    docs = documents(spark).drop("score")
    keys = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()}
    bits, rows = 10, docs.collect()
    sizes = {}
    for r in rows:
        b = (keys[r.text] % (1 << 64)) >> (64 - bits)
        sizes[b] = sizes.get(b, 0) + len((r.text or "").encode()) + 8
    total, shards = sum(sizes.values()), 2
    got = S.shard(docs, shards, bits=bits).collect()
    want = ring_walk([(b, 0, x) for b, x in sizes.items()], shards, S.NODES, S.ROOM, bits) if max(sizes.values()) * 2 * shards <= total else None
    for r, mine in ((r, {(x.doc_id, x.text_crc32): x for x in got}) for r in rows):
        x = mine[r.doc_id, zlib.crc32((r.text or "").encode())]
        assert x.size == len((r.text or "").encode()) + 8 and (want is None or x.shard == want[(keys[r.text] % (1 << 64)) >> (64 - bits), 0])


def test_few_bytes_move_to_a_new_shard():
    rnd = random.Random(1)
    units = [(b, 0, int(1000 * rnd.lognormvariate(0, 0.5))) for b in range(1 << S.RING_BITS)]
    old, new = (S.place(units, n) for n in (24, 25))
    moved = sum(u[2] for u, a, b in zip(units, old, new, strict=True) if a != b)
    assert moved < 1.2 * sum(u[2] for u in units) / 25


# --- mixing


def waterfill(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
        if len(full) == len(order):
            return full


def test_mixing(spark):
    docs = documents(spark)
    rows = M.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want = waterfill(sizes)
    assert len(rows) == docs.count()
    for r in rows:
        assert r._source_size == sizes[r.source] and abs(r._target - want[r.source]) < 1e-6
        assert r._taken == r._size * r._copies and 0 <= r._copies <= 2
    assert sorted((r.doc_id or -1, r._taken) for r in rows) == sorted((r.doc_id or -1, r._taken) for r in M.mix(docs.repartition(3)).collect())
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._copies for r in rows)
    assert M.mix(empty(spark)).count() == 0


def test_every_document_has_the_chance_of_the_fraction(spark):
    rows = [(0, "one two three", "alone"), *((i, "w " * (100 if i == 1 else 10), "few") for i in range(1, 6)), *((i, "w " * 8, "many") for i in range(6, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = M.mix(docs).select("doc_id", "_target", "_source_size").withColumn("rate", F.col("_target") / F.col("_source_size"))
    fraction = {r.doc_id: r.rate - int(r.rate) for r in seen.collect()}
    seeds = spark.range(500).select(F.concat(F.lit("s"), "id").alias("seed"))
    drawn = docs.crossJoin(seeds).select("doc_id", "seed", M.draw(F.col("doc_id").cast("string"), F.col("seed")).alias("x"))
    by = {}
    for r in drawn.collect():
        by.setdefault(r.doc_id, {})[r.seed] = r.x
    for i, f in fraction.items():
        share = sum(x < f for x in by[i].values()) / 500
        assert abs(share - f) <= 4.5 * (max(f * (1 - f), 1e-4) / 500) ** 0.5, i
    for seed in ("s0", "s7"):  # and what the mix takes is just that draw
        for r in M.mix(docs, seed=seed).collect():
            rate = r._target / r._source_size
            assert r._copies == int(rate) + (by[r.doc_id][seed] < rate - int(rate))


def test_mixed_words_come_near_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 50).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    for r in M.mix(docs).groupBy("source", "_target").agg(F.sum("_taken").alias("t")).collect():
        assert abs(r.t - r._target) < 0.05 * r._target


def test_targets_of_many_sources(spark):
    rnd = random.Random(5)
    sizes = {f"s{i:03}": rnd.randint(0, 1000) ** 2 for i in range(90)} | {None: 5}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    want = waterfill(sizes)
    assert all(abs(r.target - want[r._source]) < 1e-6 * max(1, r.target) for r in M.targets(rows).collect())


# --- URL filters

URLS = [None, "", "example.org/es/", "://", "http://", "https://Example.ORG/es/1", "http://a.example.org/en/15?x=/es/", "http://example.org", "http://example.org/en/2#f", "x://b.com/fr/", "x://b.com/de/é", "x://com/de/1", "http://notexample.org/es/1",
        "http://evil.net/x.org/es/", "http://a.adult-x.net/p", "http://a.net/f.exe", "http://a.net:80/é/f.zip?q", "http://b.com?/fr/", "a://b://c.org/x", "http://a.net/" + "y" * 20000, "http://a.net/\n/f.exe"]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(r), r, v) for r, v in U.HOST_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        return host, path, *max(fits)[1:]
    block = any(x in "." + host for x in (".adult", ".casino", ".porn")) or path.endswith((".exe", ".zip"))
    return host, path, None, "block" if block else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("Host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS)}
    assert U.filter_urls(pages.limit(0)).count() == 0


def glob_to_regex(g):
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g, re.S))
    return re.compile(f"(?s:{out})\\Z".encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?", min_size=1, max_size=30), min_size=1, max_size=12), st.lists(st.text("ab/", max_size=40), min_size=1, max_size=8))
def test_automaton_equals_regular_expressions(globs, texts):
    a = U.compile_globs(globs)
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    hit = U.run_automaton(a, offsets, np.frombuffer(data, np.uint8), block=3)
    want = [[bool(glob_to_regex(g).match(t.encode())) for g in globs] for t in texts]
    assert hit.tolist() == want
