"""SentencePiece encoding and decoding as shortest paths through weighted transducers."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
INFINITE = float("inf")
#: Segments whose path is kept, per Python worker, in each of two generations; when the young one is full it becomes the old one.
KEPT = 200_000
#: What an unknown character costs beyond the costliest piece, in a unigram model.
UNKNOWN_COST = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Normaliser:
    """The transducer of a model's normaliser: the rules of its character map (a double-array trie over bytes; of all that match, the longest), white space, and the space in front.

    It is sequential: each input has one path, and composing with an input gives its output text, in which spaces are U+2581.
    """

    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze
        size = struct.unpack_from("<I", charsmap)[0] if charsmap else 0
        self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4) if size else ()
        self.outputs = charsmap[4 + size :]

    #: Nothing but spaces changes: so the lexicon is composed with this normaliser once and for all.
    @property
    def plain(self) -> bool:
        return not self.units and not self.squeeze

    def _rule(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Output and input length of the arc taken at ``at``: that of the longest rule, or of one character."""
        node, found, end = 0, None, at
        if self.units:
            node = self._below(self.units[0])
            while end < len(data):
                node ^= data[end]
                unit = self.units[node] if node < len(self.units) else 0
                if unit & 0x800000FF != data[end]:
                    break
                end += 1
                node ^= self._below(unit)
                if unit >> 8 & 1:
                    found = (self.units[node] & 0x7FFFFFFF, end - at)
        if found:
            return self.outputs[found[0] : self.outputs.index(0, found[0])], found[1]
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + n], n

    @staticmethod
    def _below(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def compose(self, text: str) -> str:
        data, at, out = text.encode(), 0, bytearray()
        spaced = self.squeeze
        while at < len(data):
            piece, n = self._rule(data, at)
            at += n
            if spaced:
                piece = piece.lstrip(b" ")
            out += piece
            if piece and self.squeeze:
                spaced = piece.endswith(b" ")
        if self.squeeze:
            out = out.rstrip(b" ")
        return ((" " if self.prefix and out else "") + out.decode("utf-8", "replace")).replace(" ", SPACE)


class Transducer:
    """Normaliser, pieces and byte fallback of a model file, compiled to one weighted transducer from characters to piece ids; ``encode`` composes it with an input.

    States are beginnings of pieces; an arc reads a character, an arc back to the start writes a piece and weighs its cost. The lexicon is composed with the normaliser, so a space
    has the arcs of U+2581. A character in no piece has an arc that writes its bytes, compiled when first seen. In a BPE model the lexicon is
    composed with an acceptor of neighbouring pieces, whose arcs weigh nothing where merging the pair's characters would give just this pair, and infinity elsewhere; lexicon
    costs are zero, and the only path of finite weight is the one that merging finds. In a unigram model costs are negated scores. Weights add along a path and
    the least is taken (the tropical semiring). Normalisers with a character map are composed with the input first.
    """

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        trainer, rules = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.model_type, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        if self.model_type not in (UNIGRAM, BPE) or trainer.get(24, 0) or not rules.get(5, 1) or USER in kinds:
            raise ValueError("only unigram and BPE models that mark spaces in front of words, without pieces of the user's own, are compiled")
        self.normaliser = Normaliser(rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)))
        self.unknown = kinds.index(UNKNOWN)
        self.kinds = kinds
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.cost = {self.ids[p]: -scores[self.ids[p]] for p in self.ids}
        self.unknown_cost = max(self.cost.values(), default=0.0) + UNKNOWN_COST
        chars = set("".join(self.ids))
        # no piece goes on over these places, so paths on either side are independent
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in chars)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        space = f" {SPACE}"
        self.cuts = None if inner else re.compile(rf"[{alone}]|[{space}]*[^{space}{alone}]+|[{space}]+" if alone else rf"[{space}]*[^{space}]+|[{space}]+")
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        #: (state, character) to state, each as one number, and what is written where a piece ends: (piece, cost). State 0 is the start.
        self.arcs: dict[int, int] = {}
        self.finals: list[tuple[int, float] | None] = [None]
        self.fallback: dict[str, tuple[int, ...]] = {}
        for text, i in self.ids.items():
            # a piece that merging never makes has no path
            if self.model_type == UNIGRAM or self.halves(i) is not None:
                state = 0
                for c in text:
                    key = state << 21 | ord(c)
                    if key not in self.arcs:
                        self.arcs[key] = len(self.finals)
                        self.finals.append(None)
                    if c == SPACE:  # composed with the normaliser
                        self.arcs[state << 21 | ord(" ")] = self.arcs[key]
                    state = self.arcs[key]
                self.finals[state] = (i, self.cost[i] if self.model_type == UNIGRAM else 0.0)

    # the acceptor of neighbouring pieces (BPE)

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one when its characters are merged; (-1, -1) for a character, None if merging never makes it."""
        if piece not in self._halves:
            text = self.pieces[piece]
            parts, last = list(text), (-1, -1)
            while len(parts) > 1:
                best = min(((self.cost[i], at) for at in range(len(parts) - 1) if (i := self.ids.get(parts[at] + parts[at + 1])) is not None), default=None)
                if best is None:
                    break
                at = best[1]
                last = (self.ids.get(parts[at], -1), self.ids.get(parts[at + 1], -1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[piece] = last if len(parts) == 1 else None
        return self._halves[piece]

    def _edge(self, piece: int, right: bool) -> list[tuple[int, float, float]]:
        """The pieces that stand at one edge of ``piece`` while it is merged, each with the times (costs) it comes and goes."""
        out, goes = [], INFINITE
        while piece >= 0:
            below = self.halves(piece)
            comes = -INFINITE if below == (-1, -1) else self.cost[piece]
            out.append((piece, comes, goes))
            goes, piece = comes, below[right]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of ``a`` then ``b`` leaves the two as they are: no merge over their border comes before both edges have gone."""
        return not any(
            (over := self.ids.get(self.pieces[x] + self.pieces[y])) is not None and (t := max(self.cost[over], xc, yc)) < xg and t <= yg
            for x, xc, xg in self._edge(a, True)
            for y, yc, yg in self._edge(b, False)
        )

    # composition with an input, and its shortest path

    def _fallback(self, char: str) -> tuple[int, ...]:
        """What the arc of a character in no piece writes."""
        if char not in self.fallback:
            self.fallback[char] = tuple(self.bytes[b] for b in char.encode()) if self.byte_fallback else (self.unknown,)
        return self.fallback[char]

    def path(self, segment: str) -> tuple[int, ...]:
        """Output of the shortest path through the composition with ``segment``.

        The composition's states are a position and, in a BPE model, the acceptor's state: the piece before. Positions are in topological order, so one pass takes the least
        weight of each state; arcs of infinite weight aren't there. The pieces of a beginning are those that merging gives it, so in a BPE model a position has one state.
        """
        n, arcs, finals, fits, bpe = len(segment), self.arcs, self.finals, self._fits, self.model_type == BPE
        weight: list[float] = [0.0] + [INFINITE] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for start in range(n):
            so_far = weight[start]
            if so_far == INFINITE:
                continue
            before = back[start][1]
            state, end = arcs.get(ord(segment[start])), start
            if state is None or finals[state] is None:
                total = so_far + self.unknown_cost
                if total < weight[start + 1]:
                    weight[start + 1], back[start + 1] = total, (start, -1)
            while state is not None:
                end += 1
                final = finals[state]
                if final is not None:
                    total = so_far + final[1]
                    if total < weight[end]:
                        piece = final[0]
                        if not bpe or before < 0:
                            fit = True
                        elif (fit := fits.get(before << 32 | piece)) is None:
                            fit = fits[before << 32 | piece] = self.fits(before, piece)
                        if fit:
                            weight[end], back[end] = total, (start, piece)
                if end == n:
                    break
                state = arcs.get(state << 21 | ord(segment[end]))
        out: list[tuple[int, ...]] = []
        while n:
            start, piece = back[n]
            out.append((piece,) if piece >= 0 else self._fallback(segment[start]))
            n = start
        return tuple(chain.from_iterable(reversed(out)))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.normaliser.plain:
            text = self.normaliser.compose(text)
        elif self.normaliser.prefix:
            text = " " + text
        young, old, out = self._young, self._old, []
        for segment in self.cuts.findall(text) if self.cuts else [text] if text else []:
            found = young.get(segment)
            if found is None:
                found = old.get(segment)
                if found is None:
                    found = self.path(segment)
                if len(segment) <= 64:
                    if len(young) >= KEPT:
                        self._old, self._young = old, young = young, {}
                    young[segment] = found
            out += found
        if not self.byte_fallback:  # runs of unknown characters are one unknown piece
            out = [t for i, t in enumerate(out) if t != self.unknown or not i or out[i - 1] != t]
        return out

    def decode(self, ids) -> str:
        """The text of piece ids: byte pieces joined as UTF-8 (what isn't becomes U+FFFD), U+2581 to spaces, less the one in front. Control pieces have no text."""
        out, run = [], bytearray()
        of_byte, kinds, pieces = self.of_byte, self.kinds, self.pieces
        for i in ids:
            if (b := of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if kinds[i] != CONTROL:
                out.append(" ⁇ " if i == self.unknown else pieces[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array) of every row of ``docs`` (doc_id, text), by the model file at ``model`` (a path that all executors have).

    Null and empty texts have no ids, very long ones are read whole; null doc_ids and repeated rows are rows like any other; other columns are left out; an empty table gives no rows.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = compiled(model)
        return pd.Series([np.array(own.encode(t), dtype=np.int32) for t in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids(text_or_empty()).alias("ids"))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids). Null ids give a null text."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        own = compiled(model)
        return pd.Series([None if i is None else own.decode(i.tolist()) for i in ids], dtype=object)

    return encoded.select("doc_id", texts("ids").alias("text"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, lossless. Rows as in ``encode``; an empty table gives no rows."""

    @F.pandas_udf("n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = compiled(model), []
        low, high = min(own.of_byte, default=1), max(own.of_byte, default=0)
        for text in texts:
            ids = own.encode(text)
            flat = np.array(ids, dtype="<u4")
            back = own.decode(ids)
            rows.append((len(ids), int(((flat >= low) & (flat <= high)).sum()), zlib.crc32(flat.tobytes()), sha256(back.encode()).hexdigest(), back == text))
        return pd.DataFrame(rows, columns=["n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(text_or_empty()).alias("r")).select("doc_id", "r.*")
