"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file:

* the normaliser, arcs from a state and a symbol to a state and what is written: a space becomes U+2581, one more goes before
  the text, and, if the model says so, runs of spaces become one;
* the pieces, a trie whose arcs read characters and write a piece, and arcs that read a character without a piece of its own
  and write its bytes;
* the sequences, an acceptor of pieces with weights. A unigram model's has one state, and an arc weighs the negated score. A
  byte-pair model's has a state for each piece, and an arc weighs 0 if the two pieces may follow each other, that is, if
  merging their characters gives back just these two, and is infinite otherwise. A sequence all of whose neighbours may
  follow each other is the one that merging the whole gives.

An input is composed with the three as its shortest path in the tropical semiring is looked for: a state of the composition
is a position and a state of the sequences, an arc's weight is computed when it may be the next best, and (min, +) settles
positions in the order of their distance, of equal ones the furthest first. Both kinds of model take this one way.
"""

from __future__ import annotations

import math
import re
import sys
import types
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom.llm.common import lean, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose encoding a worker keeps, the longest that it keeps, and arcs between pieces that it keeps.
KEPT, KEPT_CHARS, FOLLOWS = 150_000, 40, 200_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass(frozen=True)
class Compiled:
    """What executors get: a vocabulary of bounded size, nothing that grows with the data."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unigram: bool
    dummy_prefix: bool
    squeeze: bool


def compile_model(path: str = MODEL) -> Compiled:
    """Reads a SentencePiece model file. Rule tables of a normaliser other than `identity` are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap:
        raise ValueError("only models whose normaliser is the identity can be compiled")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and byte-pair models can be compiled")
    kinds = tuple(p.type or _NORMAL for p in model.pieces)
    return Compiled(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, model.trainer_spec.model_type == 1, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces)


def compile_normaliser(model: Compiled) -> dict[int, dict[str, tuple[int, str]]]:
    """Arcs by state and symbol ("": any other character, which is copied behind what is written). State 0 is the start.

    What arcs write is no symbol of theirs, so that a state that is never left can rewrite symbol by symbol.
    """
    prefix = SPACE if model.dummy_prefix else ""
    if model.squeeze:  # 0: before the first word, 1: within a word, 2: behind one
        return {0: {" ": (0, ""), "": (1, prefix)}, 1: {" ": (2, ""), "": (1, "")}, 2: {" ": (2, ""), "": (1, SPACE)}}
    return {0: {" ": (1, prefix + SPACE), "": (1, prefix)}, 1: {" ": (1, SPACE), "": (1, "")}}


class _Segments(dict):
    """Packed ids by segment, filled as segments come; `odd` are those that don't decode to themselves."""

    def __init__(self, machine: Transducer):
        self.machine, self.odd = machine, set()

    def __missing__(self, segment: str) -> bytes:
        machine = self.machine
        ids = machine.path(segment)
        raw = array("i", ids).tobytes()
        if "".join(map(machine.shown.__getitem__, ids)) != segment and machine.decode(ids, whole=False) != segment.replace(SPACE, " "):
            self.odd.add(segment)
        if len(segment) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = raw
        return raw


class Transducer:
    def __init__(self, model: Compiled):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (_NORMAL, _USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == _BYTE}
        self.unknown = model.kinds.index(_UNKNOWN)
        #: What each piece decodes to, and the pieces that do so wherever they stand: all but bytes over 127.
        self.shown = ["" if k == _CONTROL else " \u2047 " if k == _UNKNOWN else chr(int(p[3:5], 16)) if k == _BYTE else p for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.plain = frozenset(i for i, k in enumerate(model.kinds) if k != _BYTE or int(model.pieces[i][3:5], 16) < 128)
        self.normaliser = compile_normaliser(model)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        chars = {c for p in self.ids for c in p}
        if not model.unigram and any(c not in self.ids for c in chars):
            raise ValueError("every character of a byte-pair model's pieces must be a piece")
        #: Weights of the sequences: of a unigram model by piece (a user's piece goes before all others), and of what no piece has.
        self.weights = [-(s if k == _NORMAL else 0.1 * len(p)) for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True)]
        self.fallback_weight = 10.0 - min(model.scores, default=0.0) if model.unigram else 0.0
        #: Added for each character read, which changes no choice: so that no arc weighs less than 0.
        self.lift = max([0.0, *(-self.weights[i] / len(p) for p, i in self.ids.items())]) if model.unigram else 0.0
        #: Of a byte-pair model, the arcs computed so far, by a * size + b.
        self.follows: dict[int, float] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.segments = self._cutter(chars)
        self.kept = _Segments(self)

    def _cutter(self, chars: set[str]) -> re.Pattern:
        """Segments that no piece crosses, so that no path does: between them, the shortest paths are looked for one by one.

        Characters that stand side by side in some piece belong to one class; a segment is a run of one class, with the
        spaces before it where no piece holds a space behind another character.
        """
        of = {c: c for c in chars}

        def root(c: str) -> str:
            while of[c] != c:
                of[c] = c = of[of[c]]
            return c

        spaced = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        for p in self.ids:
            p = p.lstrip(SPACE) if spaced else p
            for a, b in zip(p, p[1:], strict=False):
                of[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in sorted(chars - {SPACE} if spaced else chars):
            classes.setdefault(root(c), []).append(c)
        runs = ["[" + "".join(map(re.escape, cs)) + "]+" for cs in sorted(classes.values(), key=len, reverse=True) if len(cs) > 1]
        before = f"{SPACE}*" if spaced else ""
        other = f"[^{SPACE}]" if spaced else "."
        return re.compile("|".join([*(before + r for r in runs), before + other, f"{SPACE}+"]), re.S)

    def normalise(self, text: str) -> str:
        """text composed with the normaliser. Where a state's arcs all lead back to it, the rest is rewritten at once."""
        out, state = [], 0
        for i, c in enumerate(text):
            arcs = self.normaliser[state]
            if all(to == state for to, _ in arcs.values()) and not arcs[""][1]:
                rest = text[i:]
                for x, (_, made) in arcs.items():
                    rest = rest.replace(x, made) if x else rest
                out.append(rest)
                break
            state, made = arcs.get(c) or arcs[""]
            out.append(made if c in arcs else made + c)
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text)[0], np.int32).tolist()

    def packed(self, text: str) -> tuple[bytes, bool]:
        """The ids as 32-bit numbers, and whether they decode to the normalised text: they do if those of each segment do."""
        segments = self.segments.findall(self.normalise(text))
        raw = b"".join(map(self.kept.__getitem__, segments))
        return raw, not self.kept.odd or self.kept.odd.isdisjoint(segments)

    def _fallback(self, char: str) -> tuple[int, ...]:
        if self.bytes:
            return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path through the composition of a normalised text with pieces and sequences.

        The queue holds arcs, with their distance so far. Arcs of a byte-pair model enter it with the least weight there is
        and are weighed when their turn comes. One state a position is of finite distance (the last piece of what merging
        the text up to there gives), so that a position is settled when its first arc of finite weight is taken.
        """
        n, unigram, lift, trie = len(text), self.model.unigram, self.lift, self.trie
        weights, fallback, follows, size = self.weights, self.fallback_weight, self.follows, len(self.model.pieces)
        came, last = [-1] * (n + 1), [-1] * (n + 1)
        queue: list[tuple[float, int, int, int]] = []
        at, distance = 0, 0.0
        while at < n:
            # arcs of the pieces from here; bytes (-1) where the character is no piece
            node, j, single = trie, at, False
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if (piece := node.get("")) is not None:
                    single |= j == at + 1
                    if came[j] < 0:
                        heappush(queue, (distance + weights[piece] + lift * (j - at) if unigram else 0.0, -j, at, piece))
            if not single and came[at + 1] < 0:
                heappush(queue, (distance + fallback + lift, -at - 1, at, -1))
            while True:
                distance, j, start, piece = heappop(queue)
                j = -j
                if came[j] >= 0:
                    continue
                if unigram or piece < 0:
                    break
                weight = follows.get(last[start] * size + piece)
                if (self._weigh(last[start], piece) if weight is None else weight) == 0.0:
                    break
            at, came[j], last[j] = j, start, piece
        ends, j = [], n
        while j:
            ends.append(j)
            j = came[j]
        ends.reverse()
        ids = [last[j] for j in ends]
        if -1 in ids:
            ids = [x for j in ends for x in ((last[j],) if last[j] >= 0 else self._fallback(text[came[j] : j]))]
        return ids

    def _weigh(self, before: int, piece: int) -> float:
        """An arc of a byte-pair model's sequences. Behind nothing, or bytes (-1), a piece must merge to itself."""
        if len(self.follows) >= FOLLOWS:
            self.follows.clear()
        made = 0.0 if self._edges(piece) and (before < 0 or self._stay_apart(before, piece)) else math.inf
        self.follows[before * len(self.model.pieces) + piece] = made
        return made

    def _edges(self, piece: int) -> tuple[list, list] | None:
        """How merging a piece's characters goes: the score of each merge, and its first (and last) part behind it. None if it ends in several parts."""
        if piece not in self.edges:
            firsts, lasts = [], []
            parts = self._merge(self.model.pieces[piece], firsts, lasts)
            self.edges[piece] = (firsts, lasts) if len(parts) == 1 else None
        return self.edges[piece]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b never joins a part of one with a part of the other.

        Merges within a and within b go on as they would alone, always the best of all next; the parts that meet at the
        boundary join if that is better than what either side does next (of equals the leftmost goes first).
        """
        pieces, ids, scores, none = self.model.pieces, self.ids, self.model.scores, -math.inf
        left, right = self._edges(a)[1], self._edges(b)[0]
        x, y, i, j = pieces[a][-1], pieces[b][0], 0, 0
        met = ids.get(x + y)
        while True:
            one, two = left[i][0] if i < len(left) else none, right[j][0] if j < len(right) else none
            if met is not None and scores[met] > one and scores[met] >= two:
                return False
            if one == two == none:
                return True
            if one >= two:
                now, i = left[i][1], i + 1
                if now != x:
                    x, met = now, ids.get(now + y)
            else:
                now, j = right[j][1], j + 1
                if now != y:
                    y, met = now, ids.get(x + now)

    def _merge(self, text: str, firsts: list | None = None, lasts: list | None = None) -> list[str]:
        """Of neighbours whose concatenation is a piece, always the best one, of equals the leftmost, becomes one.

        firsts and lasts get each merge's score, with the first (the last) part behind it.
        """
        ids, scores, none = self.ids, self.model.scores, -math.inf

        def worth(a: str, b: str) -> float:
            i = ids.get(a + b)
            return none if i is None else scores[i]

        parts = list(text)
        worths = [worth(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while worths and (best := max(worths)) > none:
            k = worths.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del worths[k]
            if k:
                worths[k - 1] = worth(parts[k - 1], parts[k])
            if k < len(worths):
                worths[k] = worth(parts[k], parts[k + 1])
            if firsts is not None:
                firsts.append((best, parts[0]))
                lasts.append((best, parts[-1]))
        return parts

    def decode(self, ids: Sequence[int], whole: bool = True) -> str:
        """The inverse transduction: pieces to characters, byte pieces to bytes (what is no UTF-8 to U+FFFD), U+2581 to spaces.

        whole: the ids are those of a whole text, whose first space goes if the normaliser has put it there.
        """
        model, out, raw = self.model, [], bytearray()
        if self.plain.issuperset(ids):
            return self._unprefixed("".join(map(self.shown.__getitem__, ids)), whole)
        for i in ids:
            if model.kinds[i] == _BYTE:
                raw.append(int(model.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if model.kinds[i] == _UNKNOWN:
                out.append(" ⁇ ")
            elif model.kinds[i] != _CONTROL:
                out.append(model.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return self._unprefixed("".join(out), whole)

    def _unprefixed(self, text: str, whole: bool) -> str:
        text = text.replace(SPACE, " ")
        return text[1:] if whole and self.model.dummy_prefix and text.startswith(" ") else text


def worker_machine(model: Compiled) -> Transducer:
    """The machine of this process: workers serve many tasks, and build it once. One model is held at a time.

    What a task has found goes with it (`forgotten`), so that other stages find the memory free.
    """
    holder = sys.modules.setdefault("_factloom_worker", types.ModuleType("_factloom_worker"))
    if getattr(holder, "model", None) != model:
        holder.model, holder.machine = model, Transducer(model)
    return holder.machine


def forgotten(machine: Transducer) -> None:
    machine.kept.clear()
    machine.kept.odd.clear()
    machine.follows.clear()


def _encoder(model: Compiled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_machine(model)
        try:
            yield from encoded(machine, batches)
        finally:
            forgotten(machine)

    def encoded(machine: Transducer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            rest = [n for n in batch.schema.names if n != "_text"]
            at, size = 0, len(batch)
            while at < size:  # ids of at most some megabytes of text at a time
                some, ends, same, held, first = [], [0], [], 0, at
                while at < size and held < 1 << 20:
                    text = texts[at].as_py() or ""
                    raw, ok = machine.packed(text)
                    some.append(raw)
                    ends.append(ends[-1] + len(raw) // 4)
                    same.append(ok)
                    held += len(text)
                    at += 1
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(some), np.int32)))
                made = {"piece_ids": ids, "round_trip": pa.array(same)}
                yield pa.RecordBatch.from_pydict({n: batch.column(n).slice(first, at - first) for n in rest} | made)

    return run


def encode(docs: DataFrame, model: Compiled, text: str = "text") -> DataFrame:
    """The rows of docs without the text, with piece_ids, n_pieces and round_trip (columns so named are replaced).

    The whole text is encoded, as the model's own library does without begin and end marks; a null text as an empty one,
    which has no pieces. round_trip: decoding gives the normalised text back (U+2581 in a text becomes a space).
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in {"piece_ids", "n_pieces", "round_trip"}]
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([seen.schema["_row"], T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return seen.mapInArrow(lean(_encoder(model)), schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "round_trip")


def decode(encoded: DataFrame, model: Compiled, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """encoded with the decoded text instead of the ids; null for null ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = worker_machine(model)
        for batch in batches:
            rest = [i for i, x in enumerate(batch.schema.names) if x != "_ids"]
            made = [None if x is None else machine.decode(x) for x in (v.as_py() for v in batch.column("_ids"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(made, pa.string())], [*[batch.schema.names[i] for i in rest], "_text"])

    rest = [c for c in encoded.columns if c != ids and c.lower() != text.lower()]
    seen = encoded.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(f"`{ids}`").alias("_ids"))
    schema = T.StructType([seen.schema["_row"], T.StructField("_text", T.StringType())])
    return seen.mapInArrow(lean(run), schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], F.col("_text").alias(text))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), compile_model(model))
