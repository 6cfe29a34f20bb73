"""URL filters as one bit-parallel wildcard automaton.

All glob rules are packed, one bit a position, into the words of a Shift-And mask. A step takes every rule at once, and one
byte of every URL of a batch at once: D = ((D << 1) & arrives[byte]) | (D & stays[byte]).
Globs: `*` is any run without `/`, `**` any run, `?` one byte other than `/`; the rest stands for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.common import fresh, table, text_blocks

#: Rule (host and path prefix) and verdict. A rule fits its host and all subdomains.
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Where no host rule fits: these globs over `.host/path` block, all else is allowed.
BLOCK_GLOBS = ("*.adult*", "*.adult*/**", "*.casino*", "*.casino*/**", "*.porn*", "*.porn*/**", "*/**.exe", "*/**.zip")


@dataclass(frozen=True)
class Automaton:
    start: np.ndarray  # words
    arrives: np.ndarray  # 256 x words
    stays: np.ndarray
    finals: np.ndarray  # of each pattern: its accepting bit


def compile_globs(globs: Sequence[str]) -> Automaton:
    tokens = []
    for g in globs:
        out, raw, i = [], g.encode(), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                out.append("**")
                i += 2
            else:
                out.append({b"*": "*", b"?": "?"}.get(raw[i : i + 1], raw[i]))
                i += 1
        tokens.append(out)
    size = sum(1 + sum(t not in ("*", "**") for t in ts) for ts in tokens)
    words = max(1, -(-size // 64))
    start, arrives, stays = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    within = np.arange(256) != ord("/")
    finals, bit = [], 0
    for ts in tokens:
        start[bit // 64] |= np.uint64(1 << bit % 64)
        for t in ts:
            if t == "*":
                stays[within, bit // 64] |= np.uint64(1 << bit % 64)
            elif t == "**":
                stays[:, bit // 64] |= np.uint64(1 << bit % 64)
            else:
                bit += 1
                on = within if t == "?" else np.arange(256) == t
                arrives[on, bit // 64] |= np.uint64(1 << bit % 64)
        finals.append(bit)
        bit += 1
    return Automaton(start, arrives, stays, np.array(finals, np.int64))


def run_automaton(a: Automaton, offsets: np.ndarray, data: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Texts x patterns: does the pattern accept the whole text? Texts run in order of length, so that none waits for a longer one."""
    lengths = np.diff(offsets)
    accepted = np.zeros((len(lengths), len(a.finals)), bool)
    order = np.argsort(-lengths, kind="stable")
    one, top = np.uint64(1), np.uint64(63)
    for lo in range(0, len(order), block):
        rows = order[lo : lo + block]
        length, at = lengths[rows], offsets[:-1][rows]
        d = np.repeat(a.start[None, :], len(rows), 0)
        for k in range(int(length[0]) if len(rows) else 0):
            n = int(np.searchsorted(-length, -k, "left"))  # texts longer than k
            live = d[:n]
            byte = data[at[:n] + k]
            moved = live << one
            moved[:, 1:] |= live[:, :-1] >> top
            moved &= a.arrives[byte]
            live &= a.stays[byte]
            live |= moved
            if k & 63 == 63 and not live.any():
                d[:n] = 0
                break
        f = a.finals
        accepted[rows] = (d[:, f // 64] >> (f % 64).astype(np.uint64)) & one == one
    return accepted


def filter_urls(pages: DataFrame, url: str = "url", host_rules: Sequence[tuple[str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced.

    Host: from the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end;
    both empty for a null URL or one without `://`. The longest host rule that fits decides (of equally long ones the first);
    else the globs do: block if one accepts `.host` + path, allow otherwise (rule is null then). Nothing here grows with the data but the rows.
    """
    globs = [g for rule, _ in host_rules for g in (f"*.{rule}**",)] + list(block_globs)
    automaton, n = compile_globs(globs), len(host_rules)
    by_length = sorted(range(n), key=lambda i: (-len(host_rules[i][0]), i))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for canonical in batches:
            column = pa.array(canonical, pa.large_string())
            rule, verdict = np.full(len(canonical), None, object), np.full(len(canonical), "allow", object)
            for first, end, offsets, data in text_blocks(column):
                hit = run_automaton(automaton, offsets, data)
                verdict[first:end][hit[:, n:].any(1)] = "block"
                for i in reversed(by_length):
                    rule[first:end][hit[:, i]], verdict[first:end][hit[:, i]] = host_rules[i]
            yield pd.DataFrame({"rule": rule, "verdict": verdict})

    def column(name: str) -> F.Column:
        return F.col(f"`{name}`")

    after = F.when(column(url).contains("://"), F.regexp_extract(column(url), r"^(?s)(?:.*?)://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    rest = [column(c) for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    verdict = fresh(pages, "_verdict")
    judged = F.pandas_udf(judge, "rule string, verdict string")
    row = pages.select(*rest, host.alias("host"), path.alias("path"))
    return row.withColumn(verdict, judged(F.concat(F.lit("."), "host", "path"))).select(*rest, "host", "path", f"{verdict}.rule", f"{verdict}.verdict")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


ORACLE_SQL = """
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '.' || host AS h FROM b),
d AS (SELECT page_id, host, path, h, CASE
    WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(h, '.adult') OR contains(h, '.casino') OR contains(h, '.porn') OR path LIKE '%.exe' OR path LIKE '%.zip' THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
"""
