"""The corpus pipeline against a plain version of its stages, on rows of every odd kind."""

import hashlib
import os
import random
from collections import Counter

import pytest
from helpers import sentence, words
from pyspark.sql import functions as F

import corpus_pipeline as P
from factloom.llm import mixing, sentencepiece_wfst, toxicity
from test_dedup import bare, brute_components
from test_models import waterfill

pytestmark = pytest.mark.skipif(not os.path.isfile(sentencepiece_wfst.MODEL), reason="no public vocabulary here")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, where, rows, labels, extra=()):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCUMENTS)
    docs.select("*", *[F.lit(f"own {n}").alias(n) for n in extra]).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def odd_rows(seed=3):
    rnd = random.Random(seed)
    texts = [sentence(rnd, rnd.randint(4, 40)) + (" you vile MORON" if i % 4 == 0 else "") for i in range(120)]
    base = sentence(rnd, 60).split()
    near = [" ".join(w if k != at else "changed" for k, w in enumerate(base)) for at in (3, 30, 31, 58)]
    texts += [*near, texts[1], texts[1] + "\n", " " + texts[2].replace(" ", "  "), "", " \t", None, None, "x", sentence(rnd, 6000), "z" * 40000, "日本語 " * 30]
    rows = [(i, t, rnd.choice(["s1", "s2", "s1", None])) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[7], "s1"), (None, "an own text without an id", None), (None, None, None)]


def plain_run(rows, scores):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_wfst.MODEL)
    kept = [r for r in rows if scores[r[1]] < 0.5]
    best = {}
    for i, t, s in kept:
        key = (-len(t or ""), i is None, i if i is not None else 0)
        if bare(t) not in best or key < best[bare(t)][0]:
            best[bare(t)] = (key, (i, t, s))
    kept = [r for _, r in best.values()]

    class Row:
        def __init__(self, r):
            self.doc_id, self.text = r[0], r[1]

    label = brute_components([Row(r) for r in kept], 5)
    kept = [r for r in kept if r[0] is None or label[r[0]] == r[0]]
    sizes = Counter()
    for _, t, s in kept:
        sizes[s] += len(words(t))
    target = waterfill(dict(sizes)) if sizes else {}
    out = []
    for i, t, s in kept:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        drawn = int(hashlib.sha256(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, s, tuple(library.encode(t or "")))] * (int(rate) + (drawn < rate - int(rate)))
    return Counter(out)


@pytest.mark.parametrize("extra", [(), ("score", "_score", "kept", "_key", "_gone", "target", "k")])
def test_the_pipeline_equals_its_plain_version(spark, tmp_path, extra):
    rows = odd_rows()
    where = corpus(spark, tmp_path, rows, [(i, int(i % 4 == 0)) for i in range(120)], extra)
    scored = toxicity.score(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text"), toxicity.fit_tables(spark, where))
    scores = {r.text: r.score for r in scored.collect()}
    got = P.run(spark, where).collect()
    assert Counter((r.doc_id, r.source, tuple(r.piece_ids)) for r in got) == plain_run(rows, scores)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got)
    assert 10 < len({r.doc_id for r in got}) < 130


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    where = corpus(spark, tmp_path, odd_rows(5), [(i, int(i % 4 == 0)) for i in range(120)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns


def test_an_empty_corpus(spark, tmp_path):
    where = corpus(spark, tmp_path, [], [])
    got = P.run(spark, where)
    assert got.count() == 0 and got.columns == ["doc_id", "lang", "source", "piece_ids", "n_pieces", "round_trip"]
