"""Small tables with the awkward rows that every operator has to bear."""

import random
import re

WORDS = "the a of red green blue stone river cloud moss lamp glass über señor été 日本 😀".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def documents(spark, seed=1, n=60):
    """Ids, texts (copies, near copies, blank, null, long), sources (one of them holds a third), and clashing columns."""
    rnd = random.Random(seed)
    texts = [sentence(rnd, rnd.randint(1, 60)) for _ in range(n)]
    texts += [texts[0]] * 5 + [f" {texts[0]}\n", texts[1].upper(), texts[2] + " lamp", texts[3] + "\n" + texts[4]]
    texts += ["", " \t\n", None, None, "x", "x y", sentence(rnd, 5000), "z" * 30000]
    rows = [(i, t, rnd.choice(["s1", "s2", "s3", "s1", None]), 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], "s1", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
