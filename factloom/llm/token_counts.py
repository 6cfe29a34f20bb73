"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie, of pieces that begin a word and of pieces that go on within one. Each node has a failure link: where
no arc goes on, the longest pieces that the automaton can be sure of are popped, and it goes on from the node that the rest
of the characters spells. As only their number is asked for, a link holds how many pieces it pops, not which. Every
character is read once, and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom.llm.common import lean, table, text_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words whose length a worker keeps.
KEPT = 200_000


def read_vocabulary(path: str = MODEL) -> tuple[frozenset[str], frozenset[str]]:
    """Pieces that begin a word, and those that go on, of a SentencePiece model file: those with U+2581 before, and the others."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = [p.piece for p in model.pieces if p.type in (1, 4) and SPACE not in p.piece[1:]]
    return frozenset(p[1:] for p in pieces if p[0] == SPACE and p != SPACE), frozenset(p for p in pieces if p[0] != SPACE)


class Automaton:
    """Nodes are numbers; arcs one dict a node. Node 0 begins a word, node 1 goes on within it."""

    def __init__(self, begin: frozenset[str], within: frozenset[str]):
        self.arcs: list[dict[str, int]] = [{}, {}]
        piece, depth, char, parent = [False, False], [0, 0], ["", ""], [-1, -1]
        for root, pieces in ((0, begin), (1, within)):
            for p in sorted(pieces):
                node = root
                for c in p:
                    there = self.arcs[node].get(c)
                    if there is None:
                        there = self.arcs[node][c] = len(self.arcs)
                        self.arcs.append({})
                        piece.append(False)
                        depth.append(depth[node] + 1)
                        char.append(c)
                        parent.append(node)
                    node = there
                piece[node] = True
        n = len(self.arcs)
        #: Where to go on when no arc does (-1: nowhere, some characters lie in no piece), and how many pieces that pops.
        self.link, self.popped = [-1] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if piece[v]:
                self.link[v], self.popped[v] = 1, 1
                continue
            node, pops = self.link[parent[v]], self.popped[parent[v]]
            while node >= 0:
                there = self.arcs[node].get(char[v])
                if there is not None:
                    self.link[v], self.popped[v] = there, pops
                    break
                pops += self.popped[node]
                node = self.link[node]

    def count(self, word: str) -> int:
        """Pieces of a word, longest first; -1 if some part of it is no piece."""
        arcs, link, popped = self.arcs, self.link, self.popped
        node = total = 0
        for c in word:
            while (there := arcs[node].get(c)) is None:
                if link[node] < 0:
                    return -1
                total += popped[node]
                node = link[node]
            node = there
        while node > 1:
            if link[node] < 0:
                return -1
            total += popped[node]
            node = link[node]
        return total


def _counter(begin: frozenset[str], within: frozenset[str], unknown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kept = Automaton(begin, within), {}

        def length(word: bytes) -> int:
            n = automaton.count(word.decode("utf-8", "replace"))
            n = unknown if n < 0 else n
            if len(kept) >= KEPT:
                kept.clear()
            if len(word) <= 64:
                kept[word] = n
            return n

        for batch in batches:
            words, tokens = [], []
            for _, _, offsets, data in text_blocks(batch.column("_text")):
                whole = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    total, seen = 0, whole[a:b].split()
                    for w in seen:
                        n = kept.get(w)
                        total += length(w) if n is None else n
                    words.append(len(seen))
                    tokens.append(total)
            keep = [i for i, x in enumerate(batch.schema.names) if x != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*[batch.schema.names[i] for i in keep], "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, begin: frozenset[str], within: frozenset[str], text: str = "text", unknown: int = 1) -> DataFrame:
    """The rows of docs without the text, with n_words and n_tokens (columns so named are replaced).

    Words are `[^\\x20\\x09-\\x0D]+`. A word's first piece is the longest of `begin` that it starts with, each further one the
    longest of `within`; a word that cannot be covered so counts as `unknown` tokens. Null and empty texts have none. The
    vocabulary goes to the executors; it doesn't grow with the data.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in {"n_words", "n_tokens"}]
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = T.StructType([seen.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return seen.mapInArrow(lean(_counter(begin, within, unknown)), schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], "n_words", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), *read_vocabulary(model))
