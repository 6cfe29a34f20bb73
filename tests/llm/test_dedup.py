"""Exact dedup, near dedup and line dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from helpers import documents, empty, sentence, words
from pyspark.sql import functions as F

from factloom.llm import exact_dedup as E, line_dedup as L, near_dedup as N
from factloom.llm.components import components, forest


def bare(text):
    return "".join(words(text))


def test_exact_dedup(spark):
    docs = documents(spark)
    got = E.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[bare(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in groups.items()}
    assert len(got) == docs.count() and {r.text_sha256: (r.keep_id, r.group_size) for r in got} == want
    assert sum(r.kept for r in got) == len(want) and all(r.keep_id == r.doc_id for r in got if r.kept)
    assert "score" in got[0] and E.exact_dedup(empty(spark)).count() == 0


def test_deduplicated_keeps_one_row_of_each(spark):
    docs = documents(spark).withColumn("_key", F.lit(7))
    got = E.deduplicated(docs)
    assert got.columns == docs.columns
    texts = [bare(r.text) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({bare(r.text) for r in docs.collect()})
    assert E.deduplicated(empty(spark)).count() == 0


def test_twin_identities_are_told_apart(spark):
    docs = spark.createDataFrame([(i, sentence(random.Random(i), 30)) for i in range(40)], "doc_id long, text string")
    assert E.twin_chunks(docs.select(F.col("text").alias("_text")), 3)
    got = E.exact_dedup(docs, bits=3)
    assert got.filter("group_size = 1").count() == 40


def test_chunks_do_not_depend_on_what_is_around():
    rnd = random.Random(3)
    body = "".join(rnd.choice("abcdefgh") for _ in range(60000))
    whole = {p for _, t, ends, _ in E._chunks(pa.array([body, "other " + body + " end", ""])) for p in E._pieces(t, ends)}
    alone = [set(E._pieces(t, ends)) for _, t, ends, _ in E._chunks(pa.array([body]))][0]
    assert len(alone) > 5 and len(alone - whole) == 0 and len(whole) <= len(alone) + 4
    assert b"".join(next(E._pieces(t, e) for _, t, e, _ in E._chunks(pa.array([body])))) == body.encode()


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n):
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows if r.doc_id is not None]
    label = {i: i for i, _ in sets}
    links = [(a, b) for a, s in sets for b, t in sets if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def check_near(spark, docs, n):
    got = N.near_dedup(docs, words=n).collect()
    label = brute_components(docs.collect(), n)
    assert len(got) == docs.count()
    for r in got:
        assert r.component_id == label.get(r.doc_id), r.doc_id
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return got


def near_copies(seed, groups=6, size=14):
    """Chains of edits: neighbours are alike, ends are not."""
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        w = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([12, 60, 200]))]
        for _ in range(size):
            w = list(w)
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 9999)}"
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_near_dedup(spark):
    docs = documents(spark)
    got = check_near(spark, docs, 2)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert all(sizes[r.doc_id] == len(shingles(r.text, 2)) for r in docs.collect() if r.doc_id is not None)
    check_near(spark, docs, 5)
    assert N.near_dedup(empty(spark)).count() == 0


def test_near_dedup_of_chains(spark):
    check_near(spark, spark.createDataFrame(near_copies(1), "doc_id long, text string"), 2)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    for name, value in {"BLOCK": 5, "WORTH": 0}.items():
        monkeypatch.setattr(N, name, value)
    check_near(spark, spark.createDataFrame(near_copies(7, 3, 24), "doc_id long, text string"), 2)


def edited_copies(n, edits, seed=3, length=120):
    """Copies of one text, each with edits of its own: two of them share about (length - 2 * edits) words."""
    rnd = random.Random(seed)
    base, rows = [f"w{i}" for i in range(length)], []
    for i in range(n):
        w = list(base)
        for k in rnd.sample(range(length), edits):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_pairs_a_node_do_not_grow_with_a_group(spark, monkeypatch):
    """Neighbours just under the threshold: the rows that rounds and blocks make, for each node."""
    made = {}
    plain = N.stored

    def counting(df, name):
        out = plain(df, name)
        if name in ("asked", "possible", "leaders"):
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(N, "stored", counting)
    share = {}
    for n in (300, 2400):
        made.clear()
        got = N.near_dedup(spark.createDataFrame(edited_copies(n, 4), "doc_id long, text string"), words=2)
        assert got.select("component_id").distinct().count() == 1
        share[n] = sum(made.values()) / n
    assert share[2400] <= 1.5 * share[300] and made["asked"] <= 12 * 2400


def test_sketches_count_agreeing_slots(spark):
    rnd = np.random.default_rng(4)
    h = rnd.random((2, N.SLOTS))
    h[1, :200] = h[0, :200]
    shown = N.sketches(h)
    row = spark.createDataFrame([tuple(x.tobytes() for x in shown)], "x binary, y binary").select(N._words_of("x").alias("a"), N._words_of("y").alias("b")).select(N._agreeing("a", "b").alias("n")).first()
    assert 200 <= row.n <= 200 + 20
    i, j = np.array([0]), np.array([1])
    for least in (row.n, row.n + 1):
        assert N.possible(np.array([10, 10]), shown.view(np.uint64), i, j, 80, least).tolist() == [least == row.n]


def test_sketches_rule_out_less_than_banding_loses():
    least, p = N.least_agreeing(80), 0.8 + 0.2 / 16
    draws = np.random.default_rng(1).binomial(N.SLOTS, p, 2_000_000)
    assert (draws < least).sum() <= 2 and (draws < least + 25).sum() > 0 and N.MISSED < (1 - 0.8**N.ROWS) ** N.BANDS


def test_near_deduplicated_keeps_one_of_each(spark):
    docs = spark.createDataFrame(near_copies(2, 4, 8), "doc_id long, text string").withColumn("i", F.lit(1))
    got = N.near_deduplicated(docs, words=2)
    label = brute_components(docs.collect(), 2)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(label.values()))


def test_superminhash_estimates_similarity():
    rnd = np.random.default_rng(5)
    for size in (20, 900):  # both ways of drawing places
        base = rnd.integers(1, 1 << 62, size).astype(np.uint64)
        other = base.copy()
        other[: size // 5] = rnd.integers(1, 1 << 62, size // 5).astype(np.uint64)
        a, b = N.signatures([np.unique(base), np.unique(other)])
        assert np.isfinite(a).all() and abs((a == b).mean() - 4 / 6) < 0.12


def test_long_sets_in_pieces_equal_whole_ones(monkeypatch):
    s = np.unique(np.random.default_rng(6).integers(1, 1 << 62, 5000).astype(np.uint64))
    whole = N.signatures([s])
    monkeypatch.setattr(N, "_STEP", 700)
    assert (N.signatures([s]) == whole).all()


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    want = dict(zip(*(x.tolist() for x in forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))), strict=True))
    for one_task in (10**6, 0):  # union-find in one task, and stars
        assert {r.a: r.b for r in components(links, one_task).collect()} == want
    assert components(links.limit(0)).count() == 0


def brute_lines(rows, least):
    sites = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if x.strip(" \t\x0b\x0c\r"):
                sites[x.strip(" \t\x0b\x0c\r")].add(r.source)
    gone = {x for x, s in sites.items() if len(s) >= least}
    return Counter((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip(" \t\x0b\x0c\r") not in gone)) for r in rows)


def test_line_dedup(spark):
    rnd, rows = random.Random(4), []
    for i in range(80):
        lines = [rnd.choice(["All rights reserved.", " All rights reserved.\t", f"common {rnd.randrange(6)}", f"own {i}", ""]) for _ in range(rnd.randint(0, 8))]
        rows.append((i, "\n".join(lines), rnd.choice([None, *(f"s{k}" for k in range(9))]), 5))
    docs = spark.createDataFrame([*rows, rows[0], (90, None, "s1", 5)], "doc_id long, text string, source string, n_lines int")
    for least in (3, 8):
        got = L.drop_spread_lines(docs, least_sites=least)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == brute_lines(docs.collect(), least)
    assert got.filter("doc_id = 90").first().n_lines == 0
    assert L.drop_spread_lines(empty(spark)).count() == 0


def test_many_sites_are_estimated(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same line\nown "), "id").alias("text"), (F.col("id") % 500).cast("string").alias("source"))
    spread = L.spread_lines(docs, least_sites=100).collect()
    assert len(spread) == 1 and abs(spread[0].sites - 500) < 75
