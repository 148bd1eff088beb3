"""Language identification by language-bitmask n-gram filters.

All languages share one Bloom filter of `slots` words for each 64 languages; bit l of a word
belongs to language l (a bit-sliced filter). One probe of an n-gram, the AND of its words, gives
every language that holds it. A document's votes are popcounts per language, corrected for each language's rate
of false positives. The largest corrected share of n-grams decides; ties go to the language
that is first in order of name.

n-grams are of letters in lower case, runs of other characters being one space, of sizes 2, 3
and 4. A language holds an n-gram if its share there is at least `keep` of the largest share
in any language. Null texts and texts without a letter are `und`, with score 0. Rows are
judged one by one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, text_chunks, texts

SIZES = (2, 3, 4)
#: Characters that are taken apart at once; a block needs some 200 bytes a character.
BLOCK = 1 << 17
_CLASSES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _CLASSES:
        _CLASSES.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _CLASSES[0]


def _normal(text: str, ends_in_space: bool) -> np.ndarray:
    """Code points of a lower-case text, each run of other characters than letters as one space."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kept = _letters()[codes]
    # Of a run of other characters the first one stays, as a space.
    stays = kept.copy()
    stays[1:] |= kept[:-1]
    if len(codes):
        stays[0] |= not ends_in_space
    return np.where(kept, codes, 32)[stays]


def _blocks(many: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, text numbers, code points carried over) of blocks of about BLOCK characters.

    Short texts share a block; a long one is cut into several, each of which begins with the
    last code points of the one before, so that no n-gram is lost or counted twice.
    """
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, int]:
        return np.concatenate(held), np.repeat(np.array(rows, np.int32), [len(x) for x in held]), 0

    for i, text in enumerate(many):
        low = " " + text.lower() + " "
        if len(low) > BLOCK:
            carried = np.zeros(0, np.uint32)
            for start in range(0, len(low), BLOCK):
                own = _normal(low[start : start + BLOCK], bool(len(carried)) and carried[-1] == 32)
                codes = np.concatenate([carried, own])
                yield codes, np.full(len(codes), i, np.int32), len(carried)
                carried = codes[-(max(SIZES) - 1) :]
            continue
        if size + len(low) > BLOCK and held:
            yield joined()
            held, rows, size = [], [], 0
        held.append(_normal(low, False))
        rows.append(i)
        size += len(low)
    if held:
        yield joined()


def ngrams(many: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, 64-bit hashes) of the n-grams of the texts, by blocks and sizes, so that memory is bounded."""
    for codes, row, carried in _blocks(many):
        chars = codes.astype(np.uint64)
        value = chars * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(SIZES) + 1):
            value = (value[:-1] ^ (value[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + chars[n - 1 :] * np.uint64(0x94D049BB133111EB)
            if n in SIZES:
                own = row[: len(value)]
                same = own == row[n - 1 :]
                # Those that lie in what was carried over are counted already.
                same[: max(0, carried - n + 1)] = False
                yield own[same], value[same] ^ (value[same] >> np.uint64(32))


@dataclass
class Filters:
    """Language names in order, the words of the filter (a row for each 64 languages), each language's rate of false positives, and the least score of a known language."""

    names: list[str]
    words: np.ndarray
    wrong: np.ndarray
    least: float = 0.0

    @classmethod
    def build(cls, held: dict[str, np.ndarray], slots: int = 1 << 18) -> Filters:
        """Filters of `slots` words at least, and of eight for each n-gram of the language that has the most."""
        names = sorted(held)
        slots = max([slots, *(1 << int(8 * len(x) - 1).bit_length() for x in held.values())])
        words = np.zeros((-(-len(names) // 64), slots), np.uint64)
        for i, name in enumerate(names):
            for at in cls.places(held[name], slots):
                words[i // 64, at] |= np.uint64(1 << i % 64)
        full = np.array([((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
        return cls(names, words, full**3)

    @staticmethod
    def places(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
        """Three places of each hash."""
        a, b = hashes * np.uint64(0xD6E8FEB86659FD93), hashes * np.uint64(0xC2B2AE3D27D4EB4F)
        return [((a + np.uint64(k) * (b | np.uint64(1))) >> np.uint64(24)) % np.uint64(slots) for k in range(3)]

    def shares(self, many: list[str]) -> np.ndarray:
        """Corrected share of each text's n-grams that each language holds."""
        votes, total = np.zeros((len(self.names), len(many))), np.ones(len(many))
        if not many or not self.names:
            return votes.T
        total[:] = 0
        for row, hashes in ngrams(many):
            total += np.bincount(row, minlength=len(many))
            one, two, three = self.places(hashes, self.words.shape[1])
            for k, words in enumerate(self.words):
                mask = words[one] & words[two] & words[three]
                for i in range(64 * k, min(64 * k + 64, len(self.names))):
                    votes[i] += np.bincount(row[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(many))
        share = votes / np.maximum(total, 1)
        return np.clip((share.T - self.wrong) / (1 - self.wrong), 0, 1)


def fit(
    df: DataFrame, max_per_language: int = 1500, keep: float = 0.35, slots: int = 1 << 18, recall: float = 0.998, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Filters:
    """Filters learned from whole texts with a language, at most `max_per_language` documents a language.

    The documents are those of the smallest hashes of the id, chosen by language and id alone, so
    texts don't move; they are counted on the executors. Of each six of them one isn't learned
    from but calibrates `least`: midway between the score that `recall` of those texts reach and
    the one that 99 % of them stay below with their own language left out, as unknown languages
    would. Rows without a text aren't learned from. What the driver gets is one row for each
    language, held n-gram or held-out text.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = rows.select("lang", "id", F.xxhash64(F.col("id").cast("string")).alias("key"))
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    none = Filters([], np.zeros((0, slots), np.uint64), np.zeros(0))
    if not sizes:
        return none
    # Hashes below twice the share that is needed: some 2 * max_per_language ids a language, however many it has.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * max_per_language / n))])
    near = ids.where(F.col("key") / F.lit(2.0**64) + 0.5 <= share[F.col("lang")])
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id"))).where(F.col("n") <= max_per_language)
    # At most max_per_language ids a language. Of repeated ids all rows are taken.
    chosen = F.broadcast(materialize(first.groupBy("id").agg((F.min("n") % 6 == 0).alias("held"))))
    sample = rows.join(chosen, "id").where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            langs, many = np.array(batch["lang"].to_pylist(), object), texts(batch)
            for lang in sorted(set(langs)):
                for _, hashes in ngrams(x for x, own in zip(many, langs, strict=True) if own == lang):
                    own, n = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.where(~F.col("held")).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return none
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])
    share = counts.withColumn("share", F.col("n") / total[F.col("lang")])
    best = share.groupBy("gram").agg(F.max("share").alias("best"), F.sum("n").alias("all"))
    held = share.join(best, "gram").where((F.col("all") >= 5) & (F.col("share") >= keep * F.col("best")))
    found = held.select("lang", "gram").toPandas()
    out = Filters.build({lang: own["gram"].to_numpy().view(np.uint64) for lang, own in found.groupby("lang")}, slots)

    def held_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            shares = out.shares(texts(batch))
            own = np.array([[x == name for name in out.names] for x in batch["lang"].to_pylist()]).reshape(shares.shape)
            both = shares.max(axis=1), np.where(own, 0.0, shares).max(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in both], names=["own", "foreign"])

    if out.names:
        scores = sample.where(F.col("held") & F.col("text").rlike(r"\p{L}")).select("lang", "text").mapInArrow(held_scores, "own double, foreign double").toPandas()
        if len(scores):
            reached, foreign = scores["own"].quantile(1 - recall, "lower"), scores["foreign"].quantile(0.99, "higher")
            out.least = float((reached + min(reached, foreign)) / 2)
    return out


def predict(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; nothing but the text is looked at."""
    names = [*filters.names, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            many = texts(batch)
            shares = filters.shares(many) if filters.names else np.zeros((len(many), 1))
            some = np.array([any(map(str.isalpha, x)) for x in many]) & bool(filters.names)
            best = np.where(some, shares.argmax(axis=1), len(names) - 1)
            score = np.where(some, shares.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, filters: Filters, min_score: float | None = None, text_col: str = "text") -> DataFrame:
    """Rows of `df` whose text has a language: not `und`, score at least `min_score` (the filters' `least`). Columns stay as they are.

    Filters that learned nothing reject texts without a letter only.
    """
    at, min_score = df.columns.index(text_col), filters.least if min_score is None else min_score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            many = [x or "" for x in batch[at].to_pylist()]
            some = np.array([any(map(str.isalpha, x)) for x in many])
            if filters.names:
                some &= filters.shares(many).max(axis=1) >= min_score
            yield batch.filter(pa.array(some))

    return df.mapInArrow(run, df.schema)
