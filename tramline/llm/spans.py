"""Substring dedup by compaction of a sparse de Bruijn graph of word k-mers.

Nodes are word k-mers that are minimal in some window of `window` words; an edge is a path: a
run of consecutive windows with one minimal k-mer at one place, known by the hash of its
words. Equal windows have equal minimal k-mers at equal places, so:

1. k-mers that occur once, and those with a single path (nonbranching), need no windows at
   all: of equal paths every one but the first repeats as a whole;
2. where a k-mer has several paths (branching), each path's first copy is taken apart into
   windows, and of equal windows every one but the first repeats.

First means smallest (document, start). Minima come from partial aggregation, and what is not
first is found by an anti-join on coordinates, so a passage in a third of all documents is
never gathered anywhere. Words have a digest of 128 bits; k-mers are known by one half of it, paths by the other,
windows by both. So no two runs of words are taken for equal unless 128 bits of digests collide.

A null or empty text has no words. Rows that share an id are one document to which either
text belongs: equal rows of one id both stay whole, since each is the first, and what is cut from
one is cut at the same words of the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, free_name, materialize, text_chunks

_WORD = re.compile(WORD)
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Words:
    """Words of the texts of a batch: text number, place in it, and 64-bit hashes, all by array operations."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        inside = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        first = inside & (np.concatenate([[True], ~inside[:-1]])[: len(raw)] | edge[:-1])
        last = inside & (np.concatenate([~inside[1:], [True]])[: len(raw)] | edge[1:])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        counts = np.bincount(self.row, minlength=len(column))
        self.base = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts
        self.offsets, self.raw = offsets, raw

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word: the halves of its 128-bit digest."""
        whole = self.raw.tobytes()
        numbers = [_DIGESTS[w] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()) for w in whole[a:b].split()]
        found = np.frombuffer(b"".join(numbers), _U).reshape(-1, 2)
        return np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])


class _Digests(dict):
    """Word -> digest, for as many words as fit."""

    def __missing__(self, word: bytes) -> bytes:
        out = xxhash.xxh3_128_digest(word)
        if len(word) < 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = out
        return out


_DIGESTS = _Digests()


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values."""
    out, have, done = np.zeros(0, _U), 0, h
    size = 1
    while n:
        if n & 1:
            out = done.copy() if not have else _mix(out[: len(done) - have] * _BASE + done[have:] if len(done) > have else out[:0])
            have += size
        n >>= 1
        if n:
            done = _mix(done[:-size] * _BASE + (done[size:] ^ _U(size))) if len(done) > size else done[:0]
            size *= 2
    return out


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _paths(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, k-mer hash, path hash) of each path of the batch."""
    n = len(words.row) - window + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    if n <= 0:
        return none
    one, two = words.hashes()
    kmer, whole = _joined(one, k), _joined(two, window)
    place = np.arange(len(kmer), dtype=_U)
    # The leftmost of the smallest: places are the low bits.
    low = _sliding_min((_mix(kmer) & ~_U(0xFFFFFF)) | (place & _U(0xFFFFFF)), window - k + 1)
    at = np.arange(n) + ((low & _U(0xFFFFFF)).astype(np.int64) - np.arange(n)) % (1 << 24)
    fits = words.row[:n] == words.row[window - 1 :]
    at, index = at[fits], np.flatnonzero(fits)
    if not len(index):
        return none
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (index[1:] != index[:-1] + 1)])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(index)]]))
    start = index[first]
    row = words.row[start]
    path = _mix(whole[start] * _BASE + _mix(whole[start + size - 1] ^ _mix(size.astype(_U) << _U(32) | (at[first] - start).astype(_U))))
    return row, start - words.base[row], size, kmer[at[first]], path


def paths(df: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(kmer, path, id, at): at is the start of the path's first window * 256 + its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, max_bytes=1 << 20):
            row, start, size, kmer, path = _paths(Words(batch[1]), window, k)
            ids = np.asarray(batch[0])[row].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), pa.array(path.view(np.int64)), pa.array(ids), pa.array(start * 256 + size)], names=["kmer", "path", "id", "at"])

    return _rows(df, id_col, text_col).mapInArrow(run, "kmer long, path long, id long, at long")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def repeats(df: DataFrame, window: int = 20, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, windows): runs of windows whose words start earlier as well; starts are word numbers."""
    if not 0 < k <= window or window - k > 200:
        raise ValueError("k must be at most the window, and the window at most k + 200")
    occurrences = paths(df, window, k, id_col, text_col)
    nodes = occurrences.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("a"), F.max("path").alias("b"))
    nodes = materialize(nodes.where(F.col("n") > 1).select("kmer", (F.col("a") != F.col("b")).alias("branching")))
    repeated = materialize(occurrences.join(nodes, "kmer"))
    firsts = materialize(repeated.groupBy("kmer", "path").agg(F.min(F.struct("id", "at")).alias("f"), F.max("branching").alias("branching")).select("f.*", "branching"))
    whole = repeated.join(firsts, ["id", "at"], "left_anti").select("id", F.shiftright("at", 8).alias("start"), F.col("at").bitwiseAND(255).alias("windows"))
    asked = firsts.where("branching").groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("asked"))

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, max_bytes=1 << 20):
            words = Words(batch[1])
            one, two = (_joined(h, window) for h in words.hashes())
            lists = batch[2].combine_chunks() if isinstance(batch[2], pa.ChunkedArray) else batch[2]
            at = np.asarray(lists.flatten()).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))
            size = at & 255
            start = np.repeat(at >> 8, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            own = np.repeat(row, size)
            where = words.base[own] + start
            ids = np.asarray(batch[0])[own].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(one[where].view(np.int64)), pa.array(two[where].view(np.int64)), pa.array(ids), pa.array(start)], names=["one", "two", "id", "start"])

    windows = _rows(df, id_col, text_col).join(asked, "id").mapInArrow(take_apart, "one long, two long, id long, start long")
    windows = materialize(windows)
    earliest = windows.groupBy("one", "two").agg(F.min(F.struct("id", "start")).alias("f")).select("f.*")
    single = windows.join(earliest, ["id", "start"], "left_anti").select("id", "start", F.lit(1).cast("long").alias("windows"))
    return materialize(whole.unionByName(single))


def _removed(n: int, runs: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows of the runs (start * 256 + windows) cover."""
    if not len(runs):
        return np.zeros(n, bool)
    change = np.zeros(n + 1, np.int64)
    start = runs >> 8
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(n, start + (runs & 255) + window - 1), -1)
    return np.cumsum(change)[:n] > 0


def _with_runs(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """`df` and, as its last column, each row's runs (start * 256 + windows)."""
    key, runs = free_name(df, "_id"), free_name(df, "_runs")
    own = found.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.shiftleft("start", 8) + F.col("windows")).alias(runs))
    return df.join(own, F.col(id_col).cast("long") == F.col(key), "left").select(*[F.col(f"`{c}`") for c in df.columns], runs)


def dedup(df: DataFrame, window: int = 20, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): kept words joined by one space. One row per row of `df`."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed = [], []

            def kept() -> Iterator[str]:
                for text, runs in zip(batch[1], batch[2], strict=True):
                    words = _WORD.findall(text.as_py() or "")
                    gone = np.zeros(0, bool)
                    if runs.is_valid and len(runs):
                        gone = _removed(len(words), np.asarray(runs.values).astype(np.int64), window)
                    total.append(len(words))
                    removed.append(int(gone.sum()))
                    yield " ".join(words if not removed[-1] else [words[i] for i in np.flatnonzero(~gone)])

            texts = pa.array(kept(), pa.string(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), texts], names=["id", "n_words", "n_removed", "kept"])

    found = _with_runs(rows, repeats(df, window, k, id_col, text_col), "id")
    return found.mapInArrow(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def cut_repeats(df: DataFrame, window: int = 20, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with repeated words cut from its texts; what lies between kept words stays, other texts don't change."""
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch[at].to_pylist(), batch[len(names)], strict=True):
                if text and runs.is_valid and len(runs):
                    spans = [m.span() for m in _WORD.finditer(text)]
                    gone = _removed(len(spans), np.asarray(runs.values).astype(np.int64), window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    done, parts = 0, []
                    for a, b in zip(edges[::2], edges[1::2]):
                        parts.append(text[done : spans[a][0]])
                        done = spans[b][0] if b < len(spans) else len(text)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_runs(df, repeats(df, window, k, id_col, text_col), id_col).mapInArrow(run, df.schema)
