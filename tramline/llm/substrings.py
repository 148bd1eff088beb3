"""Exact dedup of byte strings: suffixes put in groups through `length` bytes only, digit by digit.

Two equal strings of `length` bytes have their smallest anchor (a piece of `anchor` bytes, by a
hash) at one place, so only suffixes at anchors are dealt, about one in (length - anchor) / 2
bytes. A run is what consecutive strings with one anchor cover together. The passes go from the
most significant digit on, and what is alone in its group leaves:

1. by anchor: anchors that occur once leave;
2. by the bytes of the run: of runs that occur again, every string repeats;
3. runs that are alone though their anchor isn't are taken apart into strings of `length` bytes, one copy of
   each other run of the anchor beside them: by last bytes, first bytes, and all of them. Equal groups of these are
   exactly the repeated strings.

Groups are those of digests: 64 bits for anchors, which only saves work, and 128 bits for runs and strings. In passes 1 and 2
they come from partial aggregation, and what belongs to them is found by joins. In pass 3 the bytes of an
anchor's runs come together in one task, up to `most` runs; with more of them, strings are dealt out by their digests. So a passage
that a third of all documents hold is never gathered in one task.

A null or empty text has no bytes. Every row is a document: those with equal ids and texts repeat
each other, those with equal ids and other texts are told apart by a hash of 19 bits, those without an id
by one of 64. A text has up to 2^32 bytes, as Arrow allows. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_chunks

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(21).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bits of a run's place for its number of strings, and for where it starts.
_SIZE, _START = 12, 32
#: Code units for one task's arrays.
_CHUNK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(raw: np.ndarray, length: int, anchor: int, block: int) -> tuple[np.ndarray, ...]:
    """(start, strings, anchor's place) of each run of a text's bytes: strings start at start, start + 1, ...

    Long texts are taken in blocks of strings. A run that a block's end cuts is taken for another run of its
    anchor, so its strings are compared one by one.
    """
    parts = [_runs(raw[i : i + block + length - 1], length, anchor) for i in range(0, max(1, len(raw) - length + 1), block)]
    starts = np.repeat(np.arange(len(parts)) * block, [len(p[0]) for p in parts])
    start, strings, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    return start + starts, strings, place + starts


def _runs(raw: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    # The hash only picks places; any function of the anchor's bytes would do.
    summed = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), dtype=_U)])
    hashed = _mixed((summed[anchor:] - summed[:-anchor]) * _powers(_INVERSE, len(summed) - anchor))
    place = np.arange(len(hashed), dtype=_U)
    least = _sliding_min((hashed & ~_U(0xFFFF)) | (place & _U(0xFFFF)), length - anchor + 1) & _U(0xFFFF)
    at = np.arange(n) + (least.astype(np.int64) - np.arange(n)) % (1 << 16)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [n]])), at[first]


def _bytes(column: pa.Array) -> list[memoryview]:
    """Each text's UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x.as_buffer() if x.is_valid else b"" for x in column.cast(kind)]


def _digests(raw, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit digest of each piece."""
    view = memoryview(raw)
    found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts, ends, strict=True)]), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _key(id_col: Column, text_col: Column) -> tuple[Column, Column]:
    """What a row is known by: its id (or, without one, a hash of its text), and 19 bits of another hash."""
    return F.coalesce(id_col.cast("long"), F.xxhash64(text_col)), F.xxhash64(text_col, F.lit(1)).bitwiseAND((1 << 19) - 1)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own, tag = _key(F.col(id_col), F.col(text_col))
    return df.select(own.alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))


def occurrences(rows: DataFrame, length: int, anchor: int, block: int) -> DataFrame:
    """(digit, low, high, id, at): digests of each run's anchor and of its bytes, and where it is; at has tag, start and strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, max_bytes=_CHUNK):
            columns = [[np.zeros(0, np.int64)] for _ in range(5)]
            for raw, own, tag in zip(_bytes(batch["text"]), batch["id"].to_pylist(), batch["tag"].to_pylist(), strict=True):
                start, size, place = runs(np.frombuffer(raw, np.uint8), length, anchor, block)
                if not len(start):
                    continue
                view, starts = memoryview(raw), start.tolist()
                digit = np.fromiter((xxhash.xxh3_64_intdigest(view[p : p + anchor]) for p in place.tolist()), np.uint64, len(place)).view(np.int64)
                low, high = _digests(raw, starts, (start + size + length - 1).tolist())
                for held, x in zip(columns, (digit, low, high, np.full(len(start), own), (tag << _START + _SIZE) + (start << _SIZE) + size), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["digit", "low", "high", "id", "at"])

    return rows.mapInArrow(run, "digit long, low long, high long, id long, at long")


def _tag_of(at: str) -> Column:
    return F.shiftrightunsigned(at, _START + _SIZE)


def repeats(df: DataFrame, length: int = 200, anchor: int = 64, most: int = 2048, block: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at): runs of strings that occur again, by the key of their row; at has tag, start and number of strings."""
    if not 0 < anchor <= length or length - anchor >= 1 << _SIZE:
        raise ValueError(f"the anchor must be at most the length, which must be below the anchor and {1 << _SIZE}")
    rows = _rows(df, id_col, text_col)
    found = occurrences(rows, length, anchor, block)
    # First digit: what is alone leaves.
    again = materialize(found.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digit"))
    found = materialize(found.join(again, "digit"))
    # The other digits of a run at once.
    own = materialize(found.groupBy("digit", "low", "high").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("first")))
    whole = found.join(own.where("n > 1").select("digit", "low", "high"), ["digit", "low", "high"]).select("id", "at")
    mixed = own.groupBy("digit").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least")).where("runs > 1 and least = 1")
    asked = own.join(mixed.select("digit", (F.col("runs") > most).alias("wide")), "digit")
    asked = asked.select(F.col("first.id").alias("id"), _tag_of("first.at").alias("tag"), F.struct("digit", "first.at", (F.col("n") == 1).alias("alone"), "wide").alias("run"))
    asked = asked.groupBy("id", "tag").agg(F.collect_list("run").alias("asked"))
    # Of rows that share id and text one would do: their strings repeat anyhow.
    held = materialize(rows.join(asked, ["id", "tag"]).select("id", "text", "asked").mapInArrow(_with_bytes(length), "digit long, id long, at long, alone boolean, wide boolean, own binary"))
    # Last passes: anchors with few runs each in one task, of the others string by string.
    near = held.where("not wide").repartition("digit").sortWithinPartitions("digit").mapInArrow(_equal_strings(length), "id long, at long")
    strings = held.where("wide").mapInArrow(_taken_apart(length), "low long, high long, id long, at long")
    if held.where("wide").isEmpty():
        return materialize(whole.unionByName(near))
    strings = materialize(strings, release=False)
    equal = strings.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low", "high")
    single = strings.where("at > 0").join(equal, ["low", "high"]).select("id", "at")
    return materialize(whole.unionByName(near).unionByName(single))


def _with_bytes(length: int):
    """Rows (id, text, asked) to one row for each run asked for, with the bytes of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, max_bytes=_CHUNK):
            asked = batch["asked"]
            columns = [pc.struct_field(asked.flatten(), k) for k in range(4)]
            ids = np.repeat(np.asarray(batch["id"]), np.asarray(asked.value_lengths()))
            at = np.asarray(columns[1])
            start = at >> _SIZE & ((1 << _START) - 1)
            ends = (start + (at & ((1 << _SIZE) - 1)) + length - 1).tolist()
            pieces, k = [], 0
            for raw, n in zip(_bytes(batch["text"]), asked.value_lengths().to_pylist(), strict=True):
                view = memoryview(raw)
                pieces += [bytes(view[a:b]) for a, b in zip(start[k : k + n].tolist(), ends[k : k + n], strict=True)]
                k += n
            # Slices of bounded size, since a text's runs may be many.
            for i in range(0, len(pieces), 4096):
                part = slice(i, i + 4096)
                arrays = [columns[0][part], pa.array(ids[part]), columns[1][part], columns[2][part], columns[3][part], pa.array(pieces[part], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["digit", "id", "at", "alone", "wide", "own"])

    return run


class _Strings:
    """All strings of the runs of a batch: where each starts in the runs' bytes, which run it is of, and its place in that."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        self.raw = b"".join(batch["own"].to_pylist())
        sizes = np.asarray(pc.binary_length(batch["own"])).astype(np.int64)
        many = sizes - length + 1
        self.run = np.repeat(np.arange(len(sizes)), many)
        self.place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start = (np.cumsum(sizes) - sizes)[self.run] + self.place
        self.at = np.asarray(batch["at"])[self.run]
        self.alone = np.asarray(batch["alone"].cast(pa.int8()))[self.run] == 1
        self.id = np.asarray(batch["id"])[self.run]

    def places(self, which: np.ndarray) -> np.ndarray:
        """Tag and start of strings, and 1 for their number."""
        at = self.at[which]
        start = (at >> _SIZE & ((1 << _START) - 1)) + self.place[which]
        return (at >> _START + _SIZE << _START + _SIZE) + (start << _SIZE) + 1


def _shared(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows have the keys of another row."""
    order = np.lexsort(keys)
    same = np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0)
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _equal_strings(length: int):
    """(id, at) of the strings of runs that are alone but have an equal string in another run of their anchor."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _Strings(batch, length)
        digit = np.asarray(batch["digit"])[own.run]
        raw = np.frombuffer(own.raw, np.uint8)
        wide = min(8, length)
        # Bytes at the end, then at the start, then all of them; what is alone leaves each time.
        rest = np.arange(len(digit))
        for offset in (length - wide, 0):
            word = np.zeros((len(rest), 8), np.uint8)
            word[:, :wide] = raw[(own.start[rest] + offset)[:, None] + np.arange(wide)]
            word = word.view(np.int64)[:, 0]
            rest = rest[_shared((word, digit[rest]))]
        low, high = _digests(own.raw, own.start[rest].tolist(), (own.start[rest] + length).tolist())
        rest = rest[_shared((high, low, digit[rest]))]
        rest = rest[own.alone[rest]]
        return pa.RecordBatch.from_arrays([pa.array(own.id[rest]), pa.array(own.places(rest))], names=["id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            digit = np.asarray(batch["digit"])
            # Whole anchors only; cut behind the last change once enough rows are there.
            for cut in [*(np.flatnonzero(digit[1:] != digit[:-1]) + 1).tolist(), batch.num_rows]:
                if size + cut - start >= 4096 and (cut < batch.num_rows):
                    held.append(batch.slice(start, cut - start))
                    yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size, start = [], 0, cut
            if start < batch.num_rows:
                held.append(batch.slice(start))
                size += batch.num_rows - start
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _taken_apart(length: int):
    """(low, high, id, at) of every string of the runs; at is 0 in runs that aren't alone, whose places don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                own = _Strings(whole.slice(start, 1024), length)
                low, high = _digests(own.raw, own.start.tolist(), (own.start + length).tolist())
                at = np.where(own.alone, own.places(np.arange(len(low))), 0)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.where(own.alone, own.id, 0)), pa.array(at)], names=["low", "high", "id", "at"])

    return run


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the strings of the runs cover."""
    change = np.zeros(n + 1, np.int32)
    start = at >> _SIZE & ((1 << _START) - 1)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(n, start + (at & ((1 << _SIZE) - 1)) + length - 1), -1)
    return np.cumsum(change)[:n] > 0


def dedup(df: DataFrame, length: int = 200, anchor: int = 64, most: int = 2048, block: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): kept bytes as binary, since cuts may split a code point. One row per row of `df`."""
    found = repeats(df, length, anchor, most, block, id_col, text_col)
    lists = found.groupBy(F.col("id").alias("key"), _tag_of("at").alias("tag")).agg(F.collect_list("at").alias("runs"))
    key, tag = _key(F.col("id"), F.col("text"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumns({"key": key, "tag": tag})
    rows = rows.join(lists, ["key", "tag"], "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            made = []
            for raw, own in zip(_bytes(batch["text"]), batch["runs"], strict=True):
                if not own.is_valid:
                    made.append((len(raw), 0, 0, bytes(raw)))
                    continue
                values = np.frombuffer(raw, np.uint8)
                gone = _covered(len(values), np.asarray(own.values), length)
                made.append((len(values), int(gone.sum()), int(gone[0]) + int((gone[1:] > gone[:-1]).sum()), values[~gone].tobytes()))
            columns = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(x, t) for x, t in zip(columns, (pa.int64(),) * 3 + (pa.binary(),), strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
