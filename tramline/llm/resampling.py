"""Importance resampling towards a target distribution of hashed word n-grams.

Texts are put into a normal form: A-Z in lower case, words of digits, a-z and code points from
U+0080 on, one space between words. The normal form is scanned once, and the CRC-32 of every
prefix that ends at a word's start or end is kept. CRC-32 is linear over GF(2): the checksum of
a piece is that of the prefix up to its end, with the prefix up to its start, shifted by the
piece's length, cancelled out. So no n-gram is put together or scanned: its checksum
modulo `buckets` is its bucket.

Bucket counts are summed within each task first; `buckets` rows leave a task, and `buckets`
gains are sent to the tasks, whatever the corpus holds. Ranks come from counts of scores:
rows above a score are counted from a histogram in two levels, and only rows of one score are
ordered among themselves, so nothing is sorted in one task.

A null or empty text, or one without words, has no features, the weight 0 and is not drawn. Rows
without an id have no score, do not count among those to draw from and are not drawn. Rows that share an id count each by
itself; ties of score and id take successive ranks. An empty table gives an empty result, an
empty target equal counts for all buckets. Further columns are left out, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, text_chunks, texts

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: A-Z to lower case, what separates words to spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Lengths up to this one have a table each; longer ones are shifted by powers of two.
_SHORT = 64
#: Bytes of texts whose n-grams are held at once.
_CHUNK = 1 << 19
_LANES = np.arange(0, 32, 8, dtype=np.uint32)


@functools.cache
def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """(short, long): short[n, lane, byte] is that byte of a checksum moved on by n zero bytes, long[j] for 64 * 2^j of them."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), step >> np.uint32(1)).astype(np.uint32)
    short = np.zeros((_SHORT, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32) << _LANES[:, None]
    for n in range(1, _SHORT):
        short[n] = step[short[n - 1] & 255] ^ (short[n - 1] >> np.uint32(8))
    last = short[_SHORT - 1]
    long = [step[last & 255] ^ (last >> np.uint32(8))]
    while len(long) < 26:
        long.append(_applied(long[-1], long[-1]))
    return short, long


def _applied(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> np.uint32(8) & 255] ^ table[2][c >> np.uint32(16) & 255] ^ table[3][c >> np.uint32(24)]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums `c` (uint32) moved on by `n` bytes each."""
    short, long = _shift_tables()
    low = n & (_SHORT - 1)
    out = short[low, 0, c & 255] ^ short[low, 1, c >> np.uint32(8) & 255] ^ short[low, 2, c >> np.uint32(16) & 255] ^ short[low, 3, c >> np.uint32(24)]
    rest, j = n >> 6, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _applied(long[j], out[at])
        rest, j = rest >> 1, j + 1
    return out


def prefixes(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, sizes, counts): CRCs of the normal form up to each word's start and end, bytes of words, words of texts."""
    starts, ends, sizes, counts = [], [], [], []
    for text in own:
        raw = text.encode().translate(_NORMAL)
        c, at, n = 0, 0, 0
        while at < len(raw):
            # Long texts piece by piece, cut between words.
            cut = raw.find(b" ", at + _CHUNK)
            end = cut if cut >= 0 else len(raw)
            words = raw[at:end].split()
            first, last = [], []
            for w in words:
                first.append(c)
                c = crc32(w, c)
                last.append(c)
                c = crc32(b" ", c)
            starts.append(np.array(first, np.uint32))
            ends.append(np.array(last, np.uint32))
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            n, at = n + len(words), end
        counts.append(n)
    joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return joined(starts, np.uint32), joined(ends, np.uint32), joined(sizes, np.int64), np.array(counts, np.int64)


def buckets_of(own: list[str], size: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n up to `size`: (bucket, text) of all runs of n words."""
    starts, ends, sizes, counts = prefixes(own)
    text = np.repeat(np.arange(len(own)), counts)
    moved = shifted(starts, sizes)
    for n in range(1, size + 1):
        if n > 1:
            moved = shifted(moved[:-1], sizes[n - 1 :] + 1)
        whole = text[: len(moved)] == text[n - 1 :]
        yield ((ends[n - 1 :] ^ moved)[whole] % np.uint32(buckets)).astype(np.int64), text[: len(moved)][whole]
        if len(moved) < 2:
            return


def bucket_counts(df: DataFrame, size: int = 3, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n): n-grams of all texts by bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_chunks(batches, max_bytes=_CHUNK):
            for own, _ in buckets_of(texts(batch), size, buckets):
                total += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """What a feature of each bucket adds to a weight, from both tables of counts; `buckets` rows each at most."""
    counts = []
    for own in (corpus, target):
        n = np.zeros(buckets, np.int64)
        for r in own.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n.tolist())
    s, t = counts
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * all_s) / (float(a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    names = ["id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, max_bytes=_CHUNK):
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for k, (own, text) in enumerate(buckets_of(texts(batch), size, len(gain))):
                many = np.bincount(text, minlength=n)
                features += many
                if not k:
                    words = many
                # Texts are in order, so each one's gains lie side by side.
                total = np.concatenate([[0], np.cumsum(gain[own])])
                end = np.cumsum(many)
                weight += total[end] - total[end - many]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(words), pa.array(features), pa.array(weight)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def scored(found: DataFrame, seed: int = 42) -> DataFrame:
    """With `score`: the weight and Gumbel noise drawn from the hash of seed and id; highest scores are a sample without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, among, percent: int = 5, cells: int = 4096) -> DataFrame:
    """`rows` (id, score, ...; written, for they are read several times) with `rank`: 1, 2, 3 for the highest scores.

    Of the rows where `among` holds, `percent` in a hundred (rounded down) have a rank; ties go to the smaller id.
    """
    own = rows.where(among & F.col("score").isNotNull())
    by_score = materialize(own.groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    total, low, high = by_score.agg(F.sum("n"), F.min("score"), F.max("score")).first()
    drawn = (total or 0) * percent // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    by_score = by_score.withColumn("cell", F.floor((F.lit(high) - F.col("score")) / ((high - low) // cells + 1)))
    # At most `cells` + 1 rows, in one window.
    above = by_score.groupBy("cell").agg(F.sum("n").alias("n"))
    above = above.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("above"))
    inner = F.sum("n").over(Window.partitionBy("cell").orderBy(F.desc("score"))) - F.col("n")
    start = by_score.join(F.broadcast(above), "cell").select("score", (F.col("above") + inner).alias("above"))
    start = materialize(start.where(F.col("above") < drawn))
    least = start.agg(F.min("score")).first()[0]
    picked = among & (F.col("score") >= least)
    order = Window.partitionBy("score").orderBy("id", *[c for c in rows.columns if c not in ("id", "score")])
    first = rows.where(picked).join(start, "score").withColumn("rank", (F.col("above") + F.row_number().over(order)).cast("long"))
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rows.columns, "rank")
    return first.unionByName(rows.where(~F.coalesce(picked, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, size: int = 3, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): every row's importance, and the draw's order."""
    gain = gains(bucket_counts(df, size, buckets, text_col), bucket_counts(target, size, buckets, text_col), buckets)
    rows = materialize(scored(weights(df, gain, size, id_col, text_col), seed))
    return ranked(rows, F.col("n_words") >= least_words, percent).withColumnRenamed("id", id_col)
