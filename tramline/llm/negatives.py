"""Hard negatives by rotated one-bit codes whose error has a proven bound.

A vector is rotated at random and coded by the signs of its components; its alignment with the
code (a cosine) is stored, and what the code leaves over is rotated and coded again, `levels`
times. An anchor's rotated components are cut to `planes` bits; the counts of common bits of
planes and codes estimate the inner product. What the last code leaves over is orthogonal to
that code, so by Cauchy and Schwarz the true value lies within its length times the length of
the anchor's part orthogonal to that code; cutting to planes adds a known error. Pairs
whose interval can't reach the result are left out, all others are scored in whole numbers. So
the result is exact.

Anchors are dealt out in blocks, and so are rows; every block of anchors meets every block of rows in
one task, which streams the rows and keeps `top` rows for each anchor. Rows travel with their
codes and whole-number vectors, since those pairs that survive would be more rows than that. Cells of the
grid are equal in size whatever labels or vectors repeat. Two passes: positives first, then the rows
between shares of each positive's score.

Rows without an id, with a null label or vector, or any null or non-finite component take no part. Of rows that share
an id, the one of the smallest label, then vector, counts. Components are floor(scale * x); from 2^27 on, they
are taken as 2^27. Missing components of shorter vectors are 0. Ties go to the smaller id. Empty tables give empty results. Further
columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Largest magnitude of a component.
LARGEST = 1 << 27
#: Anchors and rows whose intervals are computed at once.
TILE, STRIP = 128, 2048
#: Pairs that are scored at once.
PAIRS = 1 << 15
#: Below any score.
NONE = np.iinfo(np.int64).min


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of `x` turned by a random rotation: signs and Hadamard transforms, three times. Their size is a power of two."""
    n, size = x.shape
    for signs in np.random.default_rng(seed).integers(0, 2, (3, size)) * 2.0 - 1:
        x, half = x * signs, 1
        while half < size:
            x = x.reshape(n, size // (2 * half), 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            half *= 2
        x = x.reshape(n, size) / np.sqrt(size)
    return x


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, norm): codes are (n, levels, words of 64 bits)."""
    n, size = x.shape
    norm = np.linalg.norm(x, axis=1)
    codes, aligned, rest = np.zeros((n, levels, size // 64), np.uint64), np.zeros((n, levels)), x.astype(np.float64)
    for level in range(levels):
        left = np.linalg.norm(rest, axis=1)
        turned = rotated(rest, level)
        signs = np.where(turned >= 0, 1.0, -1.0)
        codes[:, level] = _packed(turned >= 0)
        aligned[:, level] = np.abs(turned).sum(axis=1) / np.maximum(left, 1e-300) / np.sqrt(size)
        # The rest, turned; every level turns it further.
        rest = turned - (aligned[:, level] * left / np.sqrt(size))[:, None] * signs
    return codes, aligned, norm


@dataclass
class Rows:
    """Coded rows, in the order of labels: what is known of each, and the vector."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    aligned: np.ndarray
    norm: np.ndarray

    def __post_init__(self):
        size, levels = self.vectors.shape[1], self.aligned.shape[1]
        left = self.norm.copy()
        #: Factors of the signs of each level, and the length of what is left in the end.
        self.factors = np.zeros((len(self.ids), levels))
        for level in range(levels):
            self.factors[:, level] = self.aligned[:, level] * left / np.sqrt(size)
            left = left * np.sqrt(np.maximum(0, 1 - self.aligned[:, level] ** 2))
        self.left = left
        self.ones = np.bitwise_count(self.codes).sum(axis=2, dtype=np.int64)
        self._typed = {}

    def typed(self, kind: type) -> np.ndarray:
        """The vectors with components of a type."""
        if kind not in self._typed:
            self._typed[kind] = self.vectors.astype(kind)
        return self._typed[kind]


class Anchors:
    """Anchors' components cut to bit planes in the rotations of every level."""

    def __init__(self, vectors: np.ndarray, levels: int, planes: int):
        self.vectors, self.norm, turned = vectors, np.linalg.norm(vectors, axis=1), vectors.astype(np.float64)
        self.low, self.step, self.summed, self.error = (np.zeros((len(vectors), levels)) for _ in range(4))
        self.planes = np.zeros((len(vectors), levels, planes, vectors.shape[1] // 64), np.uint64)
        for level in range(levels):
            turned = rotated(turned, level)
            low = turned.min(axis=1, keepdims=True)
            step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << planes) - 1), 1e-12)
            cut = np.clip(np.rint((turned - low) / step), 0, (1 << planes) - 1).astype(np.int64)
            self.low[:, level], self.step[:, level], self.summed[:, level] = low[:, 0], step[:, 0], cut.sum(axis=1)
            self.error[:, level] = np.abs(turned - low - step * cut).sum(axis=1)
            for j in range(planes):
                self.planes[:, level, j] = _packed(cut >> j & 1)

    def intervals(self, at: slice, rows: Rows, strip: slice) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, radii) of the inner products of anchors `at` and rows `strip`."""
        size = self.vectors.shape[1]
        levels, planes, words = self.planes.shape[1:]
        estimate = radius = 0.0
        shape = len(self.norm[at]), len(rows.ids[strip])
        both, ones = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
        common = np.empty(shape, np.uint16 if size << planes < 1 << 16 else np.uint32)
        for level in range(levels):
            common[:] = 0
            for j in reversed(range(planes)):
                np.left_shift(common, 1, out=common)
                for w in range(words):
                    np.bitwise_and(self.planes[at, level, j, w][:, None], rows.codes[strip, level, w], out=both)
                    common += np.bitwise_count(both, out=ones)
            signed = self.low[at, level, None] * (2.0 * rows.ones[strip, level] - size) + self.step[at, level, None] * (2.0 * common - self.summed[at, level, None])
            estimate = estimate + rows.factors[strip, level] * signed
            radius = radius + rows.factors[strip, level] * self.error[at, level, None]
        # The anchor's part orthogonal to the last code.
        along = np.maximum(0, np.abs(signed) - self.error[at, -1, None])
        apart = np.sqrt(np.maximum(0, self.norm[at, None] ** 2 - along**2 / size))
        # Sums of doubles err far less than this.
        return estimate, radius + rows.left[strip] * apart + 1e-9 * self.norm[at, None] * rows.norm[strip] + 1e-6


def _scores(a: Rows, b: Rows, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products, in whole numbers, of rows `one` of a and `two` of b.

    No sum of products exceeds the product of the lengths, so up to 2^24 single and up to 2^53 double precision is exact.
    """
    bound = a.norm.max(initial=0) * b.norm.max(initial=0) * 1.001
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    step = max(1, PAIRS * 64 // max(1, a.vectors.shape[1]))
    left, right = a.typed(kind), b.typed(kind)
    parts = [np.einsum("ij,ij->i", left[one[i : i + step]], right[two[i : i + step]]).astype(np.int64) for i in range(0, len(one), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


class Best:
    """The `top` rows of the highest scores, then smallest ids, of each of n slots."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: A row of a lower score can't enter the slot any more.
        self.least = np.full(n, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot, side="left")
        place = np.arange(len(slot)) - first
        kept = place < self.top
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = place[kept] == self.top - 1
        self.least[self.slot[full]] = self.score[full]


def _bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole scores x with low * score <= 100 * x <= high * score, without overflow."""
    whole, rest = score // 100, score % 100
    return low * whole - (-low * rest) // 100, high * whole + (high * rest) // 100


def prepared(df: DataFrame, scale: int = 256, levels: int = 3, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, vector, code, known): whole-number vectors of one size with their codes, alignments and norms."""
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * scale))).cast("int"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine).select("id", F.struct("label", whole.alias("vector")).alias("own"))
    rows = materialize(rows.groupBy("id").agg(F.min("own").alias("own")).select("id", "own.*"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    size = 64
    while size < longest:
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STRIP):
                batch = whole.slice(start, STRIP)
                x = np.zeros((batch.num_rows, size), np.int32)
                many = np.asarray(batch["vector"].value_lengths()).astype(np.int64)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                x[np.repeat(np.arange(len(many)), many), place] = np.asarray(batch["vector"].flatten())
                codes, aligned, norm = encode(x, levels)
                known = np.concatenate([aligned, norm[:, None]], axis=1)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], *(pa.array([y.tobytes() for y in z], pa.binary()) for z in (x, codes, known))], names=["id", "label", "vector", "code", "known"])

    return materialize(rows.mapInArrow(run, "id long, label long, vector binary, code binary, known binary"))


def _table(batch: pa.RecordBatch, levels: int) -> Rows:
    batch = batch.take(pa.array(np.argsort(np.asarray(batch["label"]), kind="stable")))

    def of(name: str, kind: type, shape: tuple) -> np.ndarray:
        return np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(batch.num_rows, *shape)

    vectors = of("vector", np.int32, (-1,)).astype(np.int64)
    known = of("known", np.float64, (levels + 1,))
    return Rows(np.asarray(batch["id"]), np.asarray(batch["label"]), vectors, of("code", np.uint64, (levels, -1)), known[:, :levels], known[:, levels])


def _tiles(anchors: Rows, rows: Rows, alike: bool) -> Iterator[tuple[slice, slice]]:
    """Parts of both to be compared, those of one label if `alike`; both are in the order of labels."""
    parts = [(0, len(anchors.ids), 0, len(rows.ids))]
    if alike:
        ends = [(np.searchsorted(x.labels, y, "left"), np.searchsorted(x.labels, y, "right")) for y in np.unique(anchors.labels) for x in (anchors, rows)]
        parts = [(*x, *y) for x, y in zip(ends[::2], ends[1::2])]
    for a_from, a_to, b_from, b_to in parts:
        for a in range(a_from, a_to, TILE):
            for b in range(b_from, b_to, STRIP):
                yield slice(a, min(a_to, a + TILE)), slice(b, min(b_to, b + STRIP))


def _leading(estimate: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
    """Of what fits, the n highest estimates of each anchor: scored first, they raise what others must reach."""
    own = np.where(fits, estimate, -np.inf)
    first = np.zeros_like(fits)
    if own.shape[1] > n:
        np.put_along_axis(first, np.argpartition(own, own.shape[1] - n, axis=1)[:, -n:], True, axis=1)
        return first & fits
    return fits


def _positives(anchors: Rows, coded: Anchors, rows: Rows, best: Best) -> None:
    """Offer rows of the anchors' labels."""
    for at, strip in _tiles(anchors, rows, True):
        fits = anchors.ids[at, None] != rows.ids[strip]
        estimate, radius = coded.intervals(at, rows, strip)
        first = _leading(estimate, fits, 2 * best.top)
        for group in (first, fits & ~first):
            one, two = np.nonzero(group & (estimate + radius >= best.least[at, None]))
            one, two = one + at.start, two + strip.start
            best.add(one, _scores(anchors, rows, one, two), rows.ids[two])


def _negatives(anchors: Rows, coded: Anchors, rows: Rows, best: Best, low: np.ndarray, high: np.ndarray) -> None:
    """Offer rows of other labels between the bounds of each positive; slots are anchor * places + place."""
    places = low.shape[1]
    some = low <= high
    for at, strip in _tiles(anchors, rows, False):
        ceiling = np.where(some[at], high[at], NONE).max(axis=1)
        estimate, radius = coded.intervals(at, rows, strip)
        fits = (anchors.labels[at, None] != rows.labels[strip]) & (estimate - radius <= ceiling[:, None])
        first = _leading(estimate, fits & (estimate <= ceiling[:, None]), 4 * best.top * places)
        for group in (first, fits & ~first):
            # The least that any of an anchor's positives still takes.
            floor = np.where(some[at], np.maximum(low[at], best.least.reshape(-1, places)[at]), np.iinfo(np.int64).max).min(axis=1)
            one, two = np.nonzero(group & (estimate + radius >= floor[:, None]))
            one, two = one + at.start, two + strip.start
            score = _scores(anchors, rows, one, two)
            pair, place = np.nonzero((score[:, None] >= np.maximum(low[one], best.least.reshape(-1, places)[one])) & (score[:, None] <= high[one]))
            best.add(one[pair] * places + place, score[pair], rows.ids[two[pair]])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut where the cell of the grid or the kind of row changes."""
    for batch in batches:
        if batch.num_rows:
            key = np.stack([np.asarray(batch[c]) for c in ("i", "j", "kind")])
            cuts = [0, *(np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


def _grid(rows: DataFrame, anchors: DataFrame, anchor_block: int, row_block: int) -> DataFrame:
    """Anchors (kind 0, with `places`), then rows (kind 1), of each cell (i, j) of the grid, sorted."""
    i_all, j_all = (-(-max(1, x.count()) // n) for x, n in ((anchors, anchor_block), (rows, row_block)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["id", "label", "vector", "code", "known", "places"]
    one = anchors.select(*names, dealt(i_all).alias("i"), each(j_all).alias("j"), F.lit(0).alias("kind"))
    two = rows.select(*names[:-1], F.lit(None).cast("array<bigint>").alias("places"), each(i_all).alias("i"), dealt(j_all).alias("j"), F.lit(1).alias("kind"))
    return one.unionByName(two).repartition("i", "j").sortWithinPartitions("i", "j", "kind")


def _best(grid: DataFrame, work: str, top: int, levels: int, planes: int, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor, place, score, id): the best of each cell for each anchor (and place among its positives)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, anchors = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if anchors is not None:
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[best.slot // places]), pa.array(best.slot % places), pa.array(best.score), pa.array(best.id)], names=["anchor", "place", "score", "id"])

        for batch in _cells(batches):
            at = batch["i"][0].as_py(), batch["j"][0].as_py()
            if at != cell:
                yield from done()
                cell, held, anchors = at, [], None
            if batch["kind"][0].as_py() == 0:
                held.append(batch)
                continue
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                anchors, held = _table(whole, levels), []
                coded = Anchors(anchors.vectors, levels, planes)
                places_of = dict(zip(whole["id"].to_pylist(), whole["places"].to_pylist(), strict=True))
                given = [places_of[i] for i in anchors.ids.tolist()]
                places = max(1, *(len(x) for x in given)) if work == "negatives" else 1
                best = Best(len(given) * places, top)
                if work == "negatives":
                    # A place that isn't there: bounds that nothing lies between.
                    floor, ceiling = np.ones((len(given), places), np.int64), np.zeros((len(given), places), np.int64)
                    for n, x in enumerate(given):
                        floor[n, : len(x)], ceiling[n, : len(x)] = _bounds(np.array(x, np.int64), low, high)
            if anchors is not None:
                rows = _table(batch, levels)
                if work == "negatives":
                    _negatives(anchors, coded, rows, best, floor, ceiling)
                else:
                    _positives(anchors, coded, rows, best)
        yield from done()

    return grid.mapInArrow(run, "anchor long, place long, score long, id long")


def _first(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The `top` of each key over all cells, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, levels: int = 3, planes: int = 6,
    anchor_block: int = 2048, row_block: int | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition on `id`. An anchor's positives are the first `positives` other rows of its
    label; for each, the first `negatives` rows of other labels with scores from `low` to `high` hundredths of its own are returned.
    """
    rows = prepared(df, scale, levels, id_col, label_col, vector_col)
    n = rows.count()
    # Sixteen blocks or more where there are rows enough, so that the grid has cells for many tasks.
    row_block = row_block or min(1 << 16, max(1024, n // 32))
    anchors = materialize(rows.where(is_anchor))
    none = F.array().cast("array<bigint>")
    near = _best(_grid(rows, anchors.withColumn("places", none), anchor_block, row_block), "positives", positives, levels, planes)
    near = materialize(_first(near, ["anchor"], positives))
    places = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found")).select(F.col("anchor").alias("id"), F.col("found.score").alias("places"))
    asked = materialize(anchors.join(places, "id"))
    far = _best(_grid(rows, asked, anchor_block, row_block), "negatives", negatives, levels, planes, low, high)
    far = _first(far, ["anchor", "place"], negatives)
    named = near.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
