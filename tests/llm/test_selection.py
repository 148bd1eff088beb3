"""Resampling, substrings and negatives against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import negatives, queries, resampling, substrings

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    awkward = [None, "", " .,;", "A", "Ünï ÇÖDÉ 漢字 😀", "x" * 5000, "ab" * 400, "y" * 199, "y" * 200, "word " * 30_000, "w" * 70_000 + " end of it", PASSAGE, "lead " + PASSAGE, PASSAGE + " trail", f"é{PASSAGE}漢", PASSAGE[7:] + PASSAGE, PASSAGE, PASSAGE[:300] + "#" + PASSAGE[300:]]
    drawn = [" ".join(rng.choices([f"W{i}" for i in range(50)], k=rng.randint(0, 90))) for _ in range(60)]
    return awkward + drawn


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, x, f"n{i}") for i, x in enumerate(texts)] + [(3, "", "again"), (33, PASSAGE, "again"), (42, "another text of that id", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({"n": F.lit(1), "key": F.lit("k"), "score": F.lit("s"), "runs": F.lit(2), "tag": F.lit(0), "rank": F.lit(9)}).repartition(5)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def features(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, percent):
    s, t = (Counter(b for x in own for b in features(x)) for own in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    out = []
    for doc, x in rows:
        own = features(x)
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(words_of(x)), len(own), weight, score, None])
    order = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(order[: len(order) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling(spark, docs, percent):
    rows = docs.unionByName(spark.createDataFrame([(None, PASSAGE)], "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([("w1 w2 w3 w4 shared1",), (None,), ("word word Word",)], "text string")
    got = resampling.resample(rows, target, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == resampled([(r["doc_id"], r["text"]) for r in rows.collect()], [r[0] for r in target.collect()], percent)


def test_resampling_empty(spark, docs):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), target).count() == 0
    got = resampling.resample(docs, target, 50).collect()
    assert len(got) == docs.count() and sum(r["rank"] is not None for r in got) == sum(r["n_words"] >= 20 for r in got) // 2


def test_ranks_of_ties(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([5, 5, 5, 10**12, -3, rng.randrange(10**6)]), rng.random() < 0.7) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score long, fits boolean")
    got = {r["id"]: r["rank"] for r in resampling.ranked(df, F.col("fits"), 70, cells=16).collect()}
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
    assert got == {r[0]: None for r in rows} | {r[0]: k + 1 for k, r in enumerate(order[: len(order) * 70 // 100])}


def test_prefixes_of_a_long_text():
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    starts, ends, sizes, counts = resampling.prefixes([text, "", "a b"])
    assert counts.tolist() == [200_000, 0, 2] and sizes[:200_000].tolist() == [len(w) for w in text.split()]
    assert int(ends[199_999]) == zlib.crc32(text.encode()) and int(starts[199_999]) == zlib.crc32(text[: text.rindex(" ") + 1].encode()) and starts[200_000] == 0
    found = [own for own, _ in resampling.buckets_of([text], 3, 10_000)]
    words = text.split()
    for at in (0, 70_000, 150_123, 199_997):
        assert [int(own[at]) for own in found] == [zlib.crc32(" ".join(words[at : at + n]).encode()) % 10_000 for n in (1, 2, 3)]


def test_crc_of_long_pieces():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 4095, 100_000):
        head, tail = rng.randbytes(9), rng.randbytes(n)
        moved = resampling.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(head + tail) == zlib.crc32(tail)


def cut(own, length):
    """(bytes, removed, spans, kept) of every text."""
    raw = [(x or "").encode() for x in own]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[0]) + int((gone[1:] > gone[:-1]).sum())
        out.append((len(x), int(gone.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])))
    return out


@pytest.mark.parametrize("length, anchor, most", [(200, 64, 2048), (200, 200, 0), (40, 8, 3), (20, 1, 2048), (5, 2, 0)])
def test_substrings(spark, docs, length, anchor, most):
    rows = docs.where("length(text) < 20000 or text is null").unionByName(spark.createDataFrame([(None, PASSAGE), (None, None)], "doc_id long, text string"), allowMissingColumns=True)
    own = [(r["doc_id"], r["text"]) for r in rows.collect()]
    got = substrings.dedup(rows, length, anchor, most).collect()
    assert sorted(((r[0], *r[1:4], bytes(r[4])) for r in got), key=str) == sorted(((d, *c) for (d, _), c in zip(own, cut([x for _, x in own], length), strict=True)), key=str)


def test_substrings_random(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choices("ab", k=60)) for _ in range(6)]
    own = [(i, "".join(rng.choice(pool)[rng.randrange(30) :] for _ in range(rng.randint(1, 8)))) for i in range(120)]
    got = substrings.dedup(spark.createDataFrame(own, "doc_id long, text string"), 48, 12, 9).orderBy("doc_id").collect()
    assert [(*r[1:4], bytes(r[4])) for r in got] == cut([x for _, x in own], 48)
    # The same in blocks of a few strings, as long texts are taken.
    got = substrings.dedup(spark.createDataFrame(own, "doc_id long, text string"), 48, 12, 9, block=70).orderBy("doc_id").collect()
    assert [(*r[1:4], bytes(r[4])) for r in got] == cut([x for _, x in own], 48)


def test_substrings_long_and_empty(spark, docs):
    got = {r["doc_id"]: r for r in substrings.dedup(docs).collect()}
    assert got[27]["n_removed"] == 150_000 and got[27]["n_spans"] == 1 and got[30]["n_removed"] == 70_000 and bytes(got[30]["kept"]) == b" end of it"
    assert substrings.dedup(docs.limit(0)).count() == 0


def mined(rows, positives=5, negatives_=3, low=50, high=95, every=50):
    best = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            own = (label, [max(-(1 << 27), min(1 << 27, math.floor(256 * v))) for v in x])
            best[i] = min(best.get(i, own), own)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (label, x) in best.items():
        if a % every == 0:
            scores = sorted((-dot(x, y), b, other) for b, (other, y) in best.items() if b != a)
            for s, b, _ in [r for r in scores if r[2] == label][:positives]:
                fits = [(c, -t) for t, c, other in scores if other != label and low * -s <= 100 * -t <= high * -s]
                out += [(a, b, k + 1, c, -s, t) for k, (c, t) in enumerate(fits[:negatives_])]
    return sorted(out)


def vectors(n, size, seed, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, int(rng.integers(labels)), v.tolist()) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit("x"), "score": F.lit(1), "vector": F.lit("v"), "code": F.lit(0), "known": F.lit(0)})


def found(df, **more):
    return sorted(map(tuple, negatives.mine(df, F.col("id") % 50 == 0, **more).collect()))


@pytest.mark.parametrize("more", [{}, {"anchor_block": 2, "row_block": 37}, {"levels": 1, "planes": 2}])
def test_negatives(spark, more):
    rows = vectors(420, 64, 2)
    rows += [(1000, None, [0.1] * 64), (1050, 1, None), (1100, 1, [float("nan")] * 64), (1150, 1, [float("inf")] * 64), (1200, 1, [None] + [0.1] * 63), (None, 1, [0.2] * 64), (50, 3, [0.1] * 64), (51, *rows[51][1:]), (2000, 1, []), (2050, 2, [0.0] * 64), (2100, 1, [0.5, 0.25]), (2150, 2, [1e30, 1.0])]
    # Many copies of one vector, with ties of score.
    rows += [(3000 + i, i % 3, [0.125] * 64) for i in range(120)]
    assert found(frame(spark, rows), **more) == mined(rows)


def test_negatives_long_vectors_and_empty(spark):
    rows = vectors(260, 150, 5, 2)
    df = frame(spark, rows)
    assert found(df, low=10, positives=2, negatives=4) == mined(rows, 2, 4, 10)
    assert found(df.limit(0)) == [] and found(df.where("vec_id % 50 <> 0")) == [] and found(df.where("vec_id = 0")) == []


def test_negatives_bounds_hold():
    x = np.floor(256 * np.array([v for _, _, v in vectors(900, 64, 9)])).astype(np.int64)
    x[::7] *= 40
    codes, aligned, norm = negatives.encode(x, 3)
    rows = negatives.Rows(np.arange(900), np.zeros(900, int), x, codes, aligned, norm)
    estimate, radius = negatives.Anchors(x[:90], 3, 6).intervals(slice(0, 90), rows, slice(0, 900))
    true = x[:90] @ x.T
    assert (np.abs(estimate - true) <= radius).all() and np.median(radius / np.outer(norm[:90], norm)) < 0.3
    score = np.array([-301, -1, 0, 1, 99, 12345678901])
    low, high = negatives._bounds(score, 50, 95)
    assert low.tolist() == [-((-50 * s) // 100) for s in score.tolist()] and high.tolist() == [95 * s // 100 for s in score.tolist()]


def test_queries(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    target = [r[0] for r in spark.read.parquet(f"{at}/benchmark.parquet").select("text").collect()]
    got = queries.op11_resampling(spark, at).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=str) == sorted(((r[0], *r[2:]) for r in resampled(docs, target, 5)), key=str)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_substrings(spark, at).collect()}
    assert got == {d: (*c[:3], hashlib.sha256(c[3]).hexdigest()) for (d, _), c in zip(docs, cut([x for _, x in docs], 200), strict=True)}
    rows = [(r[0], (r[1] + 1) % 10 if r[0] % 7 == 0 else r[1], r[2]) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(map(tuple, queries.op13_negatives(spark, at).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows)
