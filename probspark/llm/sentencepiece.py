"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text (one space put before it, spaces written as U+2581) becomes the sequence of vocabulary pieces with the
greatest sum of scores. A character that
begins no piece of its own may stand alone as unknown, at 10 below the least score, and is written as its UTF-8
bytes. Scores are whole numbers (`UNIT` to a natural logarithm), so sums are exact at any length. Below their last
digit they carry a weight of the piece's place in its unit (`TIES`), which decides between equal sums and is additive
like the scores: a text has the same best way whether it is cut into chunks or not. A file of unigram
log probabilities gives them directly. A file of merge ranks (whole numbers from 0 down) has no probabilities, and none
are trained here: a piece of rank r counts as having the Zipf-Mandelbrot probability of the r-th of a ranked list,
score -log(r + `OFFSET`). Segmentation is then that of a unigram model over these pieces. It is not greedy merging, the
library's use of such a file, which is no max-plus problem: most pieces agree, the ids of a text need not. Decoding is
the library's.

Giant texts (over `Config.giant` characters) are cut into chunks that are dealt over the cluster. A chunk yields
its boundary-state transfer matrix: entry (i, j) is the best score from a piece that ended i characters before
the chunk to one that ends j characters before its end. Matrices are combined associatively: products of `block`
chunks each, then along a text's blocks, then inside each block. The states at all borders follow, and each chunk is
traced back on its own between its two states. Chunks end between words where there is one; only a chunk's length or
more without any word end is cut anywhere. Where no piece contains a space behind another character, words are
independent and the inside of a chunk collapses to a sum, so the matrix only needs the words at its ends. Other texts
are one chunk.

Null texts give null ids and decode to null; empty texts give no ids. Repeated rows are repeated; extra
columns are ignored. A text that itself holds U+2581 decodes with spaces there.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, write_table

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
NONE = -(1 << 60)
UNIT, OFFSET = 1024, 100
#: One step of a score, and the weights below it by place in a unit (modulo the rows) and length of a piece.
STEP = 1 << 20
TIES = np.random.default_rng(23).integers(0, STEP // 4, (1024, 64)).tolist()


def weight(place: int, size: int) -> int:
    return TIES[place & 1023][size & 63]


@dataclass(frozen=True)
class Config:
    giant: int = 40_000
    chunk: int = 8_192
    block: int = 256


class Vocabulary:
    """Pieces with whole-number scores and ids; about 32 thousand entries, read once on the driver and broadcast."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], names: list[str], kinds: list[str]):
        self.pieces, self.byte_ids, self.names, self.kinds = pieces, byte_ids, names, kinds
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for s, _ in pieces.values()), default=0) - 10 * UNIT
        #: Every beginning of a piece; None where it is no piece itself.
        self.prefixes = {p[:n]: None for p in pieces for n in range(1, len(p))} | pieces
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        newline = any("\n" in p for p in pieces)
        stop = SPACE if newline else SPACE + "\n"
        #: Units that no piece straddles; without such a guarantee the whole text is one unit.
        # Latin letters part from other characters too, where no piece joins the two
        mixed = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN}{SPACE}][{LATIN}]")
        whole = f"{SPACE}*[^{stop}]+" if any(mixed.search(p) for p in pieces) else f"{SPACE}*(?:[{LATIN}]+|[^{LATIN}{stop}]+)"
        self.unit = re.compile(r"(?s).+") if inner else re.compile(f"{whole}|{SPACE}+" + ("" if newline else "|\n"))
        self.splits = not inner
        #: What each id decodes to: bytes over 127 as lone surrogates, which join to UTF-8 afterwards.
        self.texts = [(chr(b) if (b := int(t[3:5], 16)) < 128 else chr(0xDC00 + b)) if k == "byte" else t if k == "normal" else "" for t, k in zip(names, kinds, strict=True)]
        self.escaped = re.compile("[\udc80-\udcff]")
        self.singles = frozenset(p for p in pieces if len(p) == 1)
        self.machine = None
        self.known: dict[str, tuple[int, bytes]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None, "known": {}}

    def _machine(self):
        """Automaton of all pieces, built once in each worker."""
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for p, (score, i) in self.pieces.items():
            self.machine.add_word(p, (len(p), score, i))
        self.machine.make_automaton()
        return self.machine

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a model file."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        kinds = ["byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in range(n)]
        names = [m.id_to_piece(i) for i in range(n)]
        raw = {i: m.get_score(i) for i in range(n) if kinds[i] == "normal"}
        ranks = all(x <= 0 and float(x).is_integer() for x in raw.values())
        pieces = {names[i]: (round(-UNIT * math.log(OFFSET - x) if ranks else UNIT * x), i) for i, x in raw.items()}
        return Vocabulary(pieces, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], names, kinds)

    def edges(self, text: str, s: int, place: int) -> Iterator[tuple[int, int, int]]:
        """(length, score with weight, id or -1) of the pieces that start at s; unknown characters have id -1."""
        prefixes = self.prefixes
        if prefixes.get(text[s]) is None:
            yield 1, self.unknown * STEP + weight(place, 1), -1
        for n in range(1, len(text) - s + 1):
            v = prefixes.get(text[s : s + n], 0)
            if v == 0:
                break
            if v is not None:
                yield n, v[0] * STEP + weight(place, n), v[1]

    def best(self, text: str, place: int = 0) -> tuple[int, bytes]:
        """Score with weights and ids (int32) of one stretch of text between two borders, from that place of its unit."""
        n = len(text)
        score, back = [0] + [NONE] * n, [(0, -1)] * (n + 1)
        if self.singles.issuperset(text):
            for last, (size, gain, i) in (self.machine or self._machine()).iter(text):
                s, e = last + 1 - size, last + 1
                total = score[s] + gain * STEP + TIES[place + s & 1023][size & 63]
                if total > score[e]:
                    score[e], back[e] = total, (s, i)
            return score[n], self._trace(text, back)
        for s in range(n):
            for size, gain, i in self.edges(text, s, place + s):
                if score[s] + gain > score[s + size]:
                    score[s + size], back[s + size] = score[s] + gain, (s, i)
        return score[n], self._trace(text, back)

    def _trace(self, text: str, back: list[tuple[int, int]]) -> bytes:
        out: list[int] = []
        at = len(text)
        while at:
            s, i = back[at]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in reversed(text[s:at].encode("utf-8", "replace"))]
            at = s
        return array("i", out[::-1]).tobytes()

    def encode_units(self, text: str, place: int = 0) -> bytes:
        """Ids of a text that starts (at that place of a unit) and ends at a border, unit by unit."""
        return b"".join([x[1] for x in self._each(text, place)])

    def _each(self, text: str, place: int = 0) -> list[tuple[int, bytes]]:
        """Score and ids of each unit; a bounded memory keeps frequent units."""
        known = self.known
        if len(known) > 400_000:
            known.clear()
        out = []
        for u in self.unit.findall(text):
            got = known.get(u) if not place else None
            if got is None:
                got = self.best(u, place)
                if len(u) <= 48 and not place:
                    known[u] = got
            place = 0
            out.append(got)
        return out

    def encode(self, text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        return np.frombuffer(self.encode_units(prepared(text)), np.int32) if text else np.empty(0, np.int32)

    def dense(self, text: str, entry: int, states: int, place: int = 0) -> np.ndarray:
        """(entry, states) scores of ways through text[entry - 1:], for text with entry - 1 characters of context:
        from each start 0 .. entry - 1 characters before the border to each end 0 .. states - 1 before the last.
        place: that of the border in its unit."""
        n = len(text)
        v = np.full((n + 1, entry), NONE, np.int64)
        v[np.arange(entry - 1, -1, -1), np.arange(entry)] = 0
        for s in range(n):
            for size, gain, _ in self.edges(text, s, place + s - entry + 1):
                np.maximum(v[s + size], v[s] + gain, out=v[s + size])
        out = np.full((entry, states), NONE, np.int64)
        k = min(states, n + 1)
        out[:, :k] = v[n - np.arange(k)].T
        return np.where(out < NONE // 2, NONE, out)

    def transfer(self, context: str, text: str, place: int = 0) -> np.ndarray:
        """Transfer matrix (longest, longest) of a chunk that begins at that place of a unit, given up to longest - 1
        characters before it."""
        w = self.longest
        if self.splits and not place:
            context = ""  # the border lies between two units: every way passes it
        lead = " " * (w - 1 - len(context)) + context  # states before the text's or the unit's start can't be reached
        borders = [m.start() for m in self.unit.finditer(text)][1:] if self.splits else []
        if not borders:
            out = self.dense(lead + text, w, w, place)
        else:
            a, b = borders[0], borders[-1]
            head = self.dense(lead + text[:a], w, 1, place)
            middle = sum(x[0] for x in self._each(text[a:b]))
            tail = self.dense(text[b:], 1, w)
            out = head + middle + tail
        out[min(len(context), place if self.splits else w) + 1 :] = NONE
        return np.where(out < NONE // 2, NONE, out)

    def cuts(self, text: str, chunk: int) -> list[tuple[int, int, int]]:
        """(start, end, place of the start in its unit) of all chunks: each ends behind the last whole unit of a stretch
        of that size, or after that size where no unit ends."""
        out, a, unit = [], 0, 0
        while len(text) - a > chunk:
            units = [m.start() for m in self.unit.finditer(text, a, a + chunk)] if self.splits else []
            b = units[-1] if len(units) > 1 else a + chunk
            if len(units) <= 1 and self.splits and self._border(text[b - 1], text[b]):
                units = [a, b]
            out.append((a, b, a - unit))
            a, unit = b, b if len(units) > 1 else unit
        return [*out, (a, len(text), a - unit)]

    def _border(self, before: str, after: str) -> bool:
        return bool(before) and len(self.unit.findall(before + after)) == 2

    def decode(self, ids: np.ndarray | list | None) -> str | None:
        """The text of ids; control ids are silent, byte ids join to UTF-8."""
        if ids is None:
            return None
        joined = "".join(map(self.texts.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if self.escaped.search(joined):
            joined = joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return joined.replace(SPACE, " ").removeprefix(" ")


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    out = (a[..., :, :, None] + b[..., None, :, :]).max(-2)
    return np.where(out < NONE // 2, NONE, out)


def product(matrices: np.ndarray) -> np.ndarray:
    """Max-plus product of (n, w, w) matrices, by pairs of neighbours."""
    while len(matrices) > 1:
        half = len(matrices) // 2 * 2
        matrices = np.concatenate((combine(matrices[:half:2], matrices[1:half:2]), matrices[half:]))
    return matrices[0]


def border_states(matrices: np.ndarray, ahead: np.ndarray | None = None, leave: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Best scores ahead of each of n matrices (n, w), from the given ones (else state 0), and the states at the n + 1
    borders of the best way into state `leave`."""
    n, w = len(matrices), matrices.shape[1]
    v = np.full((n, w), NONE, np.int64)
    v[0] = ahead if ahead is not None else np.where(np.arange(w) == 0, 0, NONE)
    for k in range(n - 1):
        x = (v[k][:, None] + matrices[k]).max(0)
        v[k + 1] = np.where(x < NONE // 2, NONE, x)
    states = np.full(n + 1, leave, np.int64)
    for k in range(n - 1, -1, -1):
        states[k] = int((v[k] + matrices[k][:, states[k + 1]]).argmax())
    return v, states


def encode(docs: DataFrame, path: str, config: Config = Config(), check: bool = True) -> DataFrame:
    """doc_id, ids array<int>, n_tokens (null for null texts), and round_trip: whether decoding gives the text back."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"

    def result(ids: list, texts: list, tokens: list) -> pd.DataFrame:
        v = shared.value
        same = [t is None or not check or v.decode(k) == t.replace(SPACE, " ") for t, k in zip(texts, tokens, strict=True)]
        return pd.DataFrame({"doc_id": ids, "ids": tokens, "n_tokens": [None if k is None else len(k) for k in tokens], "round_trip": same}).astype({"doc_id": "Int64", "n_tokens": "Int64"})

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p["text"].tolist()
            yield result(p["doc_id"].tolist(), texts, [shared.value.encode(t) for t in texts])

    short = F.coalesce(F.length("text") <= config.giant, F.lit(True))
    plain = source.where(short).mapInPandas(whole, schema)
    # a key of their own for the rows of giant texts, fixed by writing them
    giants = write_table(source.where(~short).withColumn("row_id", F.monotonically_increasing_id()), "giants")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value.longest - 1
        for p in parts:
            for row, text in zip(p["row_id"], p["text"], strict=True):
                t = prepared(text)
                at = shared.value.cuts(t, config.chunk)
                number = np.arange(len(at))
                yield pd.DataFrame({"row_id": row, "block": number // config.block, "chunk": number, "place": [x[2] for x in at], "context": [t[max(0, a - w) : a] for a, *_ in at], "piece": [t[a:b] for a, b, _ in at]})

    def matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            m = [shared.value.transfer(c, t, k).ravel() for c, t, k in zip(p["context"], p["piece"], p["place"], strict=True)]
            yield p[["row_id", "block", "chunk"]].assign(matrix=m)

    def stacked(p: pd.DataFrame) -> np.ndarray:
        w = shared.value.longest
        return np.stack(p["matrix"].to_numpy()).reshape(-1, w, w)

    def blocks(p: pd.DataFrame) -> pd.DataFrame:
        return p[["row_id", "block"]].iloc[:1].assign(matrix=[product(stacked(p.sort_values("chunk"))).ravel()])

    def along(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        ahead, states = border_states(stacked(p))
        return p[["row_id", "block"]].assign(ahead=list(ahead), leave=states[1:].astype(np.int32))

    def inside(m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("chunk")
        _, states = border_states(stacked(m), np.asarray(p["ahead"].iloc[0]), int(p["leave"].iloc[0]))
        return m[["row_id", "chunk"]].assign(enter=states[:-1].astype(np.int32), out=states[1:].astype(np.int32))

    def trace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ids = []
            for c, t, k, i, j in zip(p["context"], p["piece"], p["place"], p["enter"], p["out"], strict=True):
                ids.append(np.frombuffer(shared.value.encode_units((c[len(c) - i :] + t)[: len(t) + i - j], k - i), np.int32))
            yield p[["row_id", "chunk"]].assign(ids=ids)

    chunks = write_table(giants.select("row_id", "text").mapInPandas(cut, "row_id long, block int, chunk int, place long, context string, piece string").repartition("row_id", "chunk"), "chunks")
    moved = write_table(chunks.mapInPandas(matrices, "row_id long, block int, chunk int, matrix array<long>"), "matrices")
    spine = moved.groupBy("row_id", "block").applyInPandas(blocks, "row_id long, block int, matrix array<long>")
    spine = spine.groupBy("row_id").applyInPandas(along, "row_id long, block int, ahead array<long>, leave int")
    borders = moved.groupBy("row_id", "block").cogroup(spine.groupBy("row_id", "block")).applyInPandas(inside, "row_id long, chunk int, enter int, out int")
    traced = chunks.join(borders, ["row_id", "chunk"]).mapInPandas(trace, "row_id long, chunk int, ids array<int>")
    joined = traced.groupBy("row_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))

    def verified(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield result(p["doc_id"].tolist(), p["text"].tolist(), p["ids"].tolist())

    return plain.unionByName(giants.join(joined, "row_id").mapInPandas(verified, schema))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "text": [shared.value.decode(x) for x in p["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
