"""Best-fit packing by patterns fitted with non-negative least squares.

Pieces of at most `room` tokens go into sequences of `room` tokens. All planning is done on
the histogram of piece lengths (at most `room` numbers, whatever the size of the corpus):

1. patterns of up to three length bins that fill a sequence are enumerated, and their repeat
   counts are fitted to the histogram by non-negative least squares and rounded;
2. each repeat takes exact lengths from its bins, the last one the longest that still fits;
3. residual pieces are packed by best fit, longest first, into what room is left.

The plan says which ranks among the pieces of a length go to which sequences, so the pieces
themselves are placed by Spark: their rank comes from a window over (length, bucket) and the
counts of the buckets before.

A null text is an empty one: a document of one id, the separator. Repeated rows and ids are
documents of their own.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import free_name, materialize, text_chunks

#: Texts of these characters only take the fast path.
_PLAIN = re.compile("[\\x20-\\x7E\\nªµºÀ-ÖØ-öø-ɏ]*")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The byte-level pre-tokenizer's cuts, for such texts.
_CUT = rf" ?[{_LETTER}]++|'(?:[sdmt]|ll|ve|re)| ?[0-9]++| ?[^\s{_LETTER}0-9]++|\s++$|\s+(?!\S)|\s"


class Ids:
    """Token ids of a byte-level BPE file of the tokenizers library.

    Texts of plain Latin characters without special tokens go through an equal encoder whose
    ranks are the file's ids (merges of this kind of file are in the order of ids, which is
    checked); all others go through the library itself.
    """

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        model = json.loads(self.library.to_str())["model"]
        vocabulary, special = model["vocab"], set(self.special)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.fast = tiktoken.Encoding("plain", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    def of(self, text: str) -> bytes:
        """Little-endian uint32 ids of a text."""
        if self.fast and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_own: dict[str, Ids] = {}


def pieces(df: DataFrame, tokenizer_file: str, room: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the tokens of each text and a separator, cut to at most `room`.

    The first piece of a longer document is the shorter one. ids are little-endian uint32.
    """
    end = np.array([separator], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _own.get(tokenizer_file) or _own.setdefault(tokenizer_file, Ids(tokenizer_file))
        for batch in text_chunks(batches):
            docs, number, starts, sizes, sums, parts = [], [], [], [], [], []
            for doc, x in zip(batch[0].to_pylist(), batch[1], strict=True):
                raw = ids.of(x.as_py() or "") + end
                n = len(raw) // 4
                cuts = [0, *range(n % room or room, n + 1, room)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    docs.append(doc)
                    number.append(k)
                    starts.append(a)
                    sizes.append(b - a)
                    sums.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        parts.append(raw[4 * a : 4 * b])
            columns = [pa.array(docs, pa.int64()), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, sizes, sums))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(parts, pa.binary())] * with_ids], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 of the least |a x - b|, by an active set."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-7 * max(1.0, float(np.abs(b).max())):
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if z.min() > 1e-12:
                x[:] = 0
                x[own] = z
                break
            down = z <= 1e-12
            step = np.min(x[own][down] / np.maximum(x[own][down] - z[down], 1e-300))
            x[own] += step * (z - x[own])
            free[own[x[own] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                return x
    return x


def patterns(bins: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Up to three bins (1 to `bins`, none absent) that sum to `bins`, largest first."""
    out = [(bins,)] if present[bins] else []
    for i in range(bins - 1, 0, -1):
        if not present[i]:
            continue
        for j in range(min(i, bins - i), 0, -1):
            rest = bins - i - j
            if present[j] and rest <= j and (not rest or present[rest]):
                out.append((i, j, rest) if rest else (i, j))
    return out


class Plan:
    """Which ranks of each length go where: rows (length, first rank, ranks a sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], room: int):
        self.room, self.left = room, {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        #: Open room -> ranges of sequences (first, count).
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self._patterns()
        self._residuals()

    def _put(self, length: int, first: int, count: int, each: int, offset: int) -> None:
        """The next each * count pieces of a length into `count` sequences from `first` on."""
        self.rows.append((length, self.rank[length], each, first, offset))
        self.rank[length] += each * count
        self.left[length] -= each * count
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def _leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((first, count))

    def _longest(self, most: int) -> int:
        at = bisect.bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0

    def _patterns(self) -> None:
        width = max(1, self.room // 128)
        bins = -(-self.room // width)
        histogram = np.zeros(bins + 1)
        for n, c in self.left.items():
            histogram[-(-n // width)] += c
        found = patterns(bins, histogram > 0)
        if not found:
            return
        matrix = np.zeros((bins + 1, len(found)))
        for k, p in enumerate(found):
            for b in p:
                matrix[b, k] += 1
        # Long pieces are the hard ones to place: misses count by their length.
        weight = np.arange(bins + 1)[:, None] / bins
        repeats = np.floor(nnls(matrix * weight, histogram * weight[:, 0]) + 0.5).astype(np.int64)
        for k in sorted(np.flatnonzero(repeats), key=lambda k: found[k], reverse=True):
            self._repeat(found[k], int(repeats[k]), width)

    def _repeat(self, pattern: tuple[int, ...], times: int, width: int) -> None:
        while times:
            taken: list[int] = []
            for i, b in enumerate(pattern):
                last = i == len(pattern) - 1
                most = self.room - sum(taken) if last else min(b * width, self.room - sum(taken))
                n = self._longest(most)
                while n and n in taken and self.left[n] <= taken.count(n):
                    at = bisect.bisect_left(self.lengths, n)
                    n = self.lengths[at - 1] if at else 0
                if n <= (b - 1) * width:
                    return
                taken.append(n)
            count = min([times, *(self.left[n] // taken.count(n) for n in set(taken))])
            first, offset = self.sequences, 0
            self.sequences += count
            for n in taken:
                self._put(n, first, count, 1, offset)
                offset += n
            self._leave(self.room - offset, first, count)
            times -= count

    def _residuals(self) -> None:
        while self.lengths:
            n = self.lengths[-1]
            while n in self.left:
                at = bisect.bisect_left(self.rooms, n)
                if at == len(self.rooms):
                    each = min(self.room // n, self.left[n])
                    count = self.left[n] // each
                    first, room = self.sequences, self.room
                    self.sequences += count
                else:
                    room = self.rooms[at]
                    first, many = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room]
                        self.rooms.pop(at)
                    each = min(room // n, self.left[n])
                    count = min(many, self.left[n] // each)
                    self._leave(room, first + count, many - count)
                self._put(n, first, count, each, self.room - room)
                self._leave(room - each * n, first, count)


def pack(pieces_: DataFrame, room: int = 2048, id_col: str = "doc_id", per_bucket: int = 20_000) -> DataFrame:
    """The columns of `pieces_` (id, piece, length and any others) and sequence_id, offset, which replace columns of these names.

    `pieces_` is read twice: pass a written table. Rows that are alike in id, piece and length are
    placed one by one; a length above `room` is an error. No pieces give no rows.
    """
    pieces_ = pieces_.select(*[F.col(f"`{c}`") for c in pieces_.columns if c.lower() not in ("sequence_id", "offset")])
    bucket, rank, earlier = (free_name(pieces_, c) for c in ("_bucket", "_rank", "_before"))
    counts = {int(r["length"]): int(r["count"]) for r in pieces_.groupBy("length").count().collect()}
    if any(not 0 < n <= room for n in counts):
        raise ValueError("piece lengths must be between 1 and the room of a sequence")
    plan = Plan(counts, room)
    buckets = max(1, sum(counts.values()) // per_bucket)
    bucketed = pieces_.withColumn(bucket, F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int"))
    own = Window.partitionBy("length", bucket).orderBy(id_col, "piece")
    each = bucketed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(earlier))
    before = each.withColumn(earlier, F.sum(earlier).over(Window.partitionBy("length").orderBy(bucket)) - F.col(earlier))
    ranked = bucketed.withColumn(rank, F.row_number().over(own) - 1).join(before, ["length", bucket]).withColumn(rank, F.col(rank) + F.col(earlier)).drop(bucket, earlier)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    keys = (rows[:, 0] << 44) + rows[:, 1]
    kept = [c for c in pieces_.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place_ = (np.asarray(batch[c]).astype(np.int64) for c in ("length", rank))
            own = rows[np.searchsorted(keys, (length << 44) + place_, side="right") - 1] if len(place_) else rows[:0]
            within = place_ - own[:, 1]
            sequence = own[:, 3] + within // np.maximum(own[:, 2], 1)
            offset = own[:, 4] + within % np.maximum(own[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = T.StructType([*pieces_.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*[F.col(f"`{c}`") for c in kept], F.col(rank).cast("long")).mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer_file: str, room: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all documents; tokens are counted once and written."""
    return pack(materialize(pieces(df, tokenizer_file, room, separator, id_col, text_col, with_ids=False)), room, id_col)
