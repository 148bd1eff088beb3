"""SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a piece of text the table holds the one token that ends the prefix's
encoding. An Aho-Corasick automaton yields the tokens that end at a position; the one that
is compatible with the token stored for the remaining prefix is the entry. The ids are then
read backwards from the last entry.

Two adjacent tokens are compatible if byte pair merging would leave both standing: undoing
their merges from the latest one back, no earlier merge may join a part of the left token
with a part of the right one.

A null text is an empty one; an empty text has begin and end ids only. Rows are taken one by
one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_chunks, texts

SPACE = "▁"
#: Texts are cut where no piece crosses: before a run of spaces and around line feeds.
UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
FREE = 1 << 30
#: Units held of either generation of the cache.
CACHE = 200_000


class PrefixTable(dict):
    """Encoder of text units; as a dictionary, unit -> little-endian uint32 ids, bounded in size.

    A full cache becomes the old generation, from which units that are met again are taken back.
    """

    def __init__(self, model_file: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.id_of = {sp.id_to_piece(i): i for i in ids}
        self.byte_of = {bytes([int(sp.id_to_piece(i)[3:5], 16)]): i for i in range(len(sp)) if sp.is_byte(i)}
        self.runs = {len(p): i for p, i in self.id_of.items() if set(p) == {SPACE}}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.id_of):
            raise ValueError("the model has pieces across spaces")
        self.text, self.rank, self.parts = [], [], []
        self.number: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self._tokens(sp)

    def _tokens(self, sp) -> None:
        """Number the tokens that merging can reach, each with its rank and its two last parts."""
        found = [(p, i) for p, i in self.id_of.items() if len(p) == 1 or set(p) != {SPACE}]
        automaton = ahocorasick.Automaton()
        joined = {p: r for r, (p, i) in enumerate(sorted((x for x in found if len(x[0]) > 1), key=lambda x: (-sp.get_score(x[1]), x[1])))}
        self.joined = joined
        for p, _ in found:
            if len(p) == 1:
                self._add(p, FREE, (-1, -1), automaton)
        for p, r in joined.items():
            for cut in range(1, len(p)):
                left, right = self.number.get(p[:cut]), self.number.get(p[cut:])
                if left is not None and right is not None and self._compatible(left, right, r):
                    self._add(p, r, (left, right), automaton)
                    break
        automaton.make_automaton()
        self.automaton = automaton
        self.size = [len(p) for p in self.text]
        self.ids = np.array([self.id_of[p] for p in self.text], np.uint32)
        self.id_list = self.ids.tolist()

    def _add(self, piece: str, rank: int, parts: tuple[int, int], automaton) -> None:
        n = self.number[piece] = len(self.text)
        self.text.append(piece)
        self.rank.append(rank)
        self.parts.append(parts)
        automaton.add_word(piece, n)

    def _compatible(self, left: int, right: int, limit: int = FREE) -> bool:
        """Whether both stay when their joint text is merged with ranks below `limit`."""
        text, rank, parts, joined = self.text, self.rank, self.parts, self.joined
        while True:
            if joined.get(text[left] + text[right], FREE) < limit:
                return False
            a, b = rank[left], rank[right]
            if a == b == FREE:
                return True
            # Undo the later merge. Among equal ranks the one to the right is later.
            if b == FREE or a != FREE and a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def known(self, text: str) -> list[int]:
        """Token numbers of a text whose characters are all pieces."""
        last, pairs, size = [-1] * len(text), self.pairs, self.size
        done = -1
        # Of the tokens that end at a place the longest comes first; once one is found, the rest can't be it.
        for end, token in self.automaton.iter(text):
            if end == done:
                continue
            start = end - size[token]
            if start >= 0:
                own = pairs.get(key := last[start] << 20 | token)
                if own is None:
                    if len(pairs) > 4 * CACHE:
                        pairs.clear()
                    own = pairs[key] = self._compatible(last[start], token)
                if not own:
                    continue
            last[end] = token
            done = end
        out, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                raise ValueError(f"no token ends at {at} of {text!r}")
            out.append(token)
            at -= size[token]
        return out[::-1]

    def _run(self, n: int) -> list[int]:
        """Ids of n spaces. Their scores are equal and the lowest: the leftmost pair that has a piece joins first."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return [self.runs[k] for k in out]

    def _unit(self, unit: str) -> list[int]:
        ids: list[int] = []
        word = unit.lstrip(SPACE)
        spaces = len(unit) - len(word)
        if spaces > 1 or not word:
            if not word:
                return self._run(spaces)
            rest = self._unit(SPACE + word)
            if rest[0] != self.runs[1]:
                return self._run(spaces - 1) + rest
            return self._run(spaces) + rest[1:]
        start = 0
        for at, c in enumerate(unit):
            if c not in self.number:
                if at > start:
                    ids += [self.id_list[t] for t in self.known(unit[start:at])]
                ids += [self.byte_of[c.encode()[i : i + 1]] for i in range(len(c.encode()))]
                start = at + 1
        if start < len(unit):
            ids += [self.id_list[t] for t in self.known(unit[start:])]
        return ids

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit)
        if out is None:
            ids = self._unit(unit)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(unit) < 64:
            self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text between begin and end ids, as little-endian uint32."""
        edge = [np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id())]
        body = map(self.__getitem__, UNIT.findall(SPACE + text.replace(" ", SPACE))) if text else ()
        return edge[0] + b"".join(body) + edge[1]

    def decode(self, many: list[bytes]) -> list[str]:
        """The texts that the library makes of little-endian uint32 ids."""
        some = [i for i, x in enumerate(many) if x]
        out = [""] * len(many)
        if some:
            for i, text in zip(some, self.library.decode([np.frombuffer(many[i], "<u4").tolist() for i in some]), strict=True):
                out[i] = text
        return out


_tables: dict[str, PrefixTable] = {}


def table(model_file: str) -> PrefixTable:
    """The table of this Python worker."""
    if model_file not in _tables:
        _tables[model_file] = PrefixTable(model_file)
    return _tables[model_file]


def round_trip(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) as `decode` of `encode` gives them, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(model_file)
        for batch in text_chunks(batches):
            ids = [own.encode(x) for x in texts(batch)]
            columns = [batch[0], pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as binary, little-endian uint32, begin and end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(model_file)
        for batch in text_chunks(batches):
            ids = pa.array([own.encode(x) for x in texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch[0], ids], names=["id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the text that the library makes of all ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(model_file)
        for batch in text_chunks(batches, "ids"):
            decoded = own.decode([x or b"" for x in batch[1].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)
