"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what sets toxic text
apart (words whose start more toxic texts have than ordinary ones would let expect, by a number of standard
deviations). Either one ends with all its words, the most frequent last; telling words are in the toxic one only.
The words of a window of text are compressed after either one, and the lengths are added up; a window's
distance is the ordinary length less the toxic one, and a text's is that of its farthest
window. Differences of a word below `least` bytes, which chance makes, are left out.
The threshold is calibrated on labelled texts that the dictionaries weren't trained on: each quarter of them by
dictionaries of the others. Those that are kept are trained on all.

Words are in lower case before a marker that both dictionaries hold, so that even a
short match shows in the length (the compressor doesn't search the last bytes of its input). Null and empty texts
have the distance 0, the lowest score. Texts to learn from are taken in the order of a hash of their id, then id and text,
so neither their order in the table nor its partitions count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, smallest, text_chunks, texts

MARKER = bytes(range(128, 160))
CACHE = 300_000
_BLANK = re.compile(r"\s")
#: Bytes of the trained part of either dictionary.
TRAINED = 65536


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    whole = zstandard.ZstdCompressionDict(content + MARKER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    asked = zstandard.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    whole.precompute_compress(compression_params=asked)
    return zstandard.ZstdCompressor(dict_data=whole, compression_params=asked)


class Distances(dict):
    """Word -> ordinary length less toxic length; as a dictionary a cache of bounded size."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)

    def __missing__(self, word: str) -> int:
        own = b" " + word.encode() + b" " + MARKER
        out = len(self.ordinary.compress(own)) - len(self.toxic.compress(own))
        if len(self) >= CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out


@dataclass
class Model:
    """The contents of both dictionaries, the calibrated threshold and the slope of scores about it; words of a window, and the least difference of a word."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    slope: float = 0.9
    window: int = 32
    least: int = 2
    _own: Distances | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_own": None}

    def distance(self, text: str) -> int:
        """Largest distance of a window of the text, 0 at least."""
        if self._own is None:
            self._own = Distances(self.ordinary, self.toxic)
        best, before = 0, np.zeros(0, np.int64)
        for part in _parts(text):
            words = part.lower().split()
            own = np.fromiter(map(self._own.__getitem__, words), np.int64, len(words))
            own = np.concatenate([before, np.where(own >= self.least, own, 0)])
            total = np.concatenate([[0], np.cumsum(own)])
            if len(own):
                best = max(best, int((total[np.minimum(np.arange(len(own)) + self.window, len(own))] - total[:-1]).max()))
            before = own[len(own) - self.window + 1 :] if len(own) >= self.window else own
        return best

    def score(self, distance: float) -> float:
        """0.7 where the distance is the threshold."""
        return 1 / (1 + math.exp(-math.log(0.7 / 0.3) - self.slope * (distance - self.threshold)))


def _plain(text: str) -> str:
    return " " + " ".join(text.lower().split()) + " "


def _parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text cut between words into parts of about `size` characters."""
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def starts(texts_: list[str], short: int = 4, long: int = 12) -> Counter:
    """How many texts have words with each start of `short` to `long` characters."""
    return Counter(p for x in texts_ for p in {w[:k] for w in set(x.split()) for k in range(short, min(len(w), long) + 1)})


def telling(many: Counter, few: Counter, toxic: int, ordinary: int, deviations: float = 7, least: int = 4) -> set[str]:
    """Starts of words in at least `least` toxic texts and far more than ordinary texts let expect; counts, and how many texts there are."""
    expected = lambda p: (few[p] + 0.5) / max(1, ordinary) * toxic
    return {p for p, n in many.items() if n >= least and n - expected(p) >= deviations * math.sqrt(expected(p) + 0.25)}


def _words(own: list[str], size: int) -> bytes:
    """The words, first ones last, where offsets are shortest."""
    return " ".join(["", *reversed(own), ""]).encode()[-size:]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; where the samples are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(df: DataFrame, labels: DataFrame | None = None, max_toxic: int = 600, max_ordinary: int = 2400, max_chars: int = 50_000, toxic_size: int = 1 << 20, ordinary_size: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most `max_toxic` + `max_ordinary` labelled texts, those of up to `max_chars` characters.

    `labels` (id, label) may come apart from the texts. The rows are those of the smallest hashes
    of the id, chosen by id alone, so texts neither move nor meet.
    """
    known = (df if labels is None else labels).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("toxic")).withColumn("key", F.xxhash64(F.col("id").cast("string")))
    known = materialize(known)
    first = [smallest(known.where(F.col("toxic") == t), "key", n).orderBy("key", "id").limit(n) for t, n in ((True, max_toxic), (False, max_ordinary))]
    # At most max_toxic + max_ordinary ids.
    chosen = F.broadcast(materialize(first[0].union(first[1])))
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").where(F.length("text") <= max_chars).collect()
    found.sort(key=lambda r: (r["key"], r["id"], r["text"]))
    own = {t: [r["text"] for r in found if r["toxic"] == t] for t in (True, False)}
    return train(own[True], own[False], toxic_size, ordinary_size)


def _dictionaries(bad: list[str], good: list[str], told: set[str], toxic_size: int, ordinary_size: int) -> Model:
    known: dict[str, bool] = {}

    def tells(w: str) -> bool:
        if w not in known:
            known[w] = any(w[:k] in told for k in range(1, len(w) + 1))
        return known[w]

    counted = lambda own, want: [w for w, _ in sorted(Counter(w for x in own for w in set(x.split()) if tells(w) == want).items(), key=lambda x: (-x[1], x[0]))]
    samples = [f" {w} ".encode() for x in bad for w in x.split() if tells(w)]
    words = [w.join("  ").encode() for x in good for w in x.split() if not tells(w)]
    step = max(1, len(words) // 20_000)
    lines = [b"".join(words[i : i + 4]) for i in range(0, len(words), 4 * step)]
    content = (_dictionary(samples, TRAINED) if samples else b"") + _words(counted(bad, True), toxic_size)
    return Model((_dictionary(lines, TRAINED) if lines else b"") + _words(counted(good, False), ordinary_size), content, 1.0)


def train(toxic: list[str], ordinary: list[str], toxic_size: int = 1 << 20, ordinary_size: int = 1 << 20, parts: int = 4) -> Model:
    """A model of labelled texts."""
    bad, good = [_plain(x) for x in toxic], [_plain(x) for x in ordinary]
    # Dealt by a hash, so that equal texts are in one part.
    dealt = [[[x for x in own if xxhash.xxh64_intdigest(x) % parts == k] for k in range(parts)] for own in (bad, good)]
    counts = [(starts(x), starts(y)) for x, y in zip(*dealt, strict=True)]

    def of(left_out: int | None) -> Model:
        many, few = Counter(), Counter()
        for k, (x, y) in enumerate(counts):
            if k != left_out:
                many.update(x)
                few.update(y)
        own = [[x for k, part in enumerate(kind) if k != left_out for x in part] for kind in dealt]
        return _dictionaries(*own, telling(many, few, len(own[0]), len(own[1])), toxic_size, ordinary_size)

    held = []
    for k in range(parts):
        rest = of(k)
        held += [(rest.distance(x), y) for kind, y in zip(dealt, (1, 0), strict=True) for x in kind[k]]
    model = of(None)
    # The threshold of the best F1, from 2 bytes up; the middle of equal ones.
    f1 = {}
    for at in range(2, 100):
        hit, wrong = sum(y for d, y in held if d >= at), sum(1 - y for d, y in held if d >= at)
        f1[at] = 2 * hit / max(1, hit + wrong + len(bad))
    best = [at for at, x in f1.items() if x == max(f1.values())]
    model.threshold = float(best[(len(best) - 1) // 2]) if f1[best[0]] > 0 else 100.0
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, distance, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = np.array([model.distance(x) for x in texts(batch)], np.int64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found), pa.array([model.score(d) for d in found], pa.float64())], names=["id", "distance", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, distance long, score double").withColumnRenamed("id", id_col)
