"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

Each paragraph (a line that isn't empty) has a wide vector: eight numbers modulo 2^32 hashed
from the paragraph, and 256 counters modulo 2^31 of its sentences, one for each bit of their
hashes, with their number modulo 2^62. A document's fingerprint is the sum of its paragraphs'
vectors: equal for equal multisets of paragraphs in any order, and changed by a paragraph's
vector when one is inserted or deleted (`add`, `subtract`).

Two documents' likeness comes from the counters. Each gives a sum of random signs over the
sentences; of two documents, the mean product of these sums estimates how many pairs of equal
sentences they have, and the mean squares how many each has with itself. The likeness is twice
the one by the sum of the others: the share of common sentences, where none is repeated. With
256 counters its error is about 0.06 (one standard deviation).

A null text is an empty one: the zero vector, alike (1.0) to another zero vector only. Rows
are taken one by one but for `with_next`, which says what it does with ties and missing ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Hashes of 64 bits a sentence; sentences that fields of 15 bits and a sign hold.
LANES, CHUNK = 4, (1 << 15) - 1
#: Rows that a bucket of neighbouring ids may have.
MOST = 4096
_LOW = 0x7FFFFFFF


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _counted(hashes: Column) -> Column:
    """64 counters in 32 pairs: how many of the hashes have each bit. Four at a time in fields of 16 bits, then widened."""
    fields = F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), 16), lambda t, h: F.transform(t, lambda v, i: v + F.call_function("shiftrightunsigned", h, i).bitwiseAND(0x0001000100010001)))
    wide = lambda v, at: F.shiftright(v, at).bitwiseAND(0xFFFF) + F.shiftleft(F.shiftright(v, at + 16).bitwiseAND(0xFFFF), 32)
    return _let(fields, lambda t: F.concat(F.transform(t, lambda v: wide(v, 0)), F.transform(t, lambda v: wide(v, 32))))


def _sketch(hashes: Column) -> Column:
    """All lanes' counters of the sentences."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / CHUNK).cast("int"))
    lane = lambda k, own: _counted(F.transform(own, lambda h: F.xxhash64(k, h)))
    whole = lambda k: F.aggregate(chunks, F.array_repeat(F.lit(0).cast("long"), 32), lambda t, c: _sum(t, lane(k, F.slice(hashes, c * CHUNK + 1, CHUNK))))
    some = F.flatten(F.transform(F.array(*[F.lit(k) for k in range(LANES)]), whole))
    return F.when(F.size(hashes) > 0, some).otherwise(F.array_repeat(F.lit(0).cast("long"), 32 * LANES))


def vector(text: Column) -> Column:
    """struct(paragraphs array<long> of 8, sentences array<long> of 128 pairs of counters, n long)."""

    def made(lines: Column) -> Column:
        own = F.aggregate(
            F.transform(lines, lambda x: F.xxhash64(x)), F.array_repeat(F.lit(0).cast("long"), 8),
            lambda total, line: F.transform(total, lambda v, i: (v + F.xxhash64(i, line).bitwiseAND(0xFFFFFFFF)).bitwiseAND(0xFFFFFFFF)),
        )
        # Each paragraph by itself, so that blanks at its start stay wherever it stands.
        sentences = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"[.!?]+\s*"))), lambda x: x != "")
        return _let(F.transform(sentences, lambda x: F.xxhash64(x)), lambda h: F.struct(own.alias("paragraphs"), _sketch(h).alias("sentences"), F.size(h).cast("long").alias("n")))

    return _let(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != ""), made)


def _both(a: Column, b: Column, f) -> Column:
    """f(a, b) with both computed once."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: f(p["a"], p["b"]))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    made = lambda a, b: F.struct(
        F.zip_with(a["paragraphs"], b["paragraphs"], lambda x, y: (x + y).bitwiseAND(0xFFFFFFFF)).alias("paragraphs"),
        F.zip_with(a["sentences"], b["sentences"], lambda x, y: F.struct((x.bitwiseAND(_LOW) + y.bitwiseAND(_LOW)).bitwiseAND(_LOW).alias("low"), (F.shiftright(x, 32) + F.shiftright(y, 32)).bitwiseAND(_LOW).alias("high"))).alias("sentences"),
        (a["n"] + b["n"]).bitwiseAND((1 << 62) - 1).alias("n"),
    )
    return _packed(_both(a, b, made))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's multiset without b's, which must be contained in it."""
    made = lambda a, b: F.struct(
        F.zip_with(a["paragraphs"], b["paragraphs"], lambda x, y: (x - y).bitwiseAND(0xFFFFFFFF)).alias("paragraphs"),
        F.zip_with(a["sentences"], b["sentences"], lambda x, y: F.struct((x.bitwiseAND(_LOW) - y.bitwiseAND(_LOW)).bitwiseAND(_LOW).alias("low"), (F.shiftright(x, 32) - F.shiftright(y, 32)).bitwiseAND(_LOW).alias("high"))).alias("sentences"),
        (a["n"] - b["n"]).bitwiseAND((1 << 62) - 1).alias("n"),
    )
    return _packed(_both(a, b, made))


def _packed(v: Column) -> Column:
    return _let(v, lambda v: F.struct(v["paragraphs"].alias("paragraphs"), F.transform(v["sentences"], lambda x: x["low"] + F.shiftleft(x["high"], 32)).alias("sentences"), v["n"].alias("n")))


def text_of(v: Column) -> Column:
    """The fingerprint as hexadecimal digits: 8 a paragraph number, 16 a pair of counters, 16 for the number of sentences."""
    wide = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return _let(v, lambda v: F.concat(F.array_join(F.transform(v["paragraphs"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.array_join(F.transform(v["sentences"], wide), ""), wide(v["n"])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: an estimate of the share of sentences that both have; 1 for equal fingerprints."""
    return _both(a, b, _likeness)


def _likeness(a: Column, b: Column) -> Column:
    n, m = a["n"].cast("double"), b["n"].cast("double")

    def products(x: Column, y: Column) -> Column:
        """(of both, of each with themselves) of both counters of a pair; sums of signs are twice a counter less their number."""
        u, v = (2.0 * x.bitwiseAND(_LOW) - n, 2.0 * F.shiftright(x, 32) - n), (2.0 * y.bitwiseAND(_LOW) - m, 2.0 * F.shiftright(y, 32) - m)
        return F.struct((u[0] * v[0] + u[1] * v[1]).alias("both"), (u[0] * u[0] + u[1] * u[1] + v[0] * v[0] + v[1] * v[1]).alias("own"))

    zero = F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("own"))
    total = F.aggregate(F.zip_with(a["sentences"], b["sentences"], products), zero, lambda t, p: F.struct((t["both"] + p["both"]).alias("both"), (t["own"] + p["own"]).alias("own")))
    share = _let(total, lambda t: F.try_divide(2.0 * t["both"], t["own"]))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint vector) of every row."""
    return df.select(F.col(id_col).cast("long").alias(id_col), vector(F.col(text_col)).alias("vector"))


def _shift(ids: DataFrame) -> int:
    """How many low bits of ids make a bucket: as many as keep every bucket at MOST rows or fewer, 8 at least."""
    fine = ids.groupBy(F.shiftright("id", 8).alias("b")).count()
    shifts = F.explode(F.array(*[F.lit(n) for n in range(0, 56, 4)])).alias("s")
    coarse = fine.select("b", "count", shifts).groupBy("s", F.expr("shiftright(b, s)")).agg(F.sum("count").alias("n"))
    fits = [r["s"] for r in coarse.groupBy("s").agg(F.max("n").alias("n")).collect() if r["n"] <= MOST]
    return 8 + max(fits, default=0)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, vector, next_text, next_vector): next in descending order of id, then ascending text; after the last the first.

    Rows without an id are left out; of rows with one id the texts decide, equal rows are next to
    each other. Texts move once, to buckets of neighbouring ids, whose width follows how densely
    ids lie; each bucket's first row is then looked up for the bucket before. The order of buckets
    comes from ranges of them, of which there are as many as partitions.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shift = _shift(rows.select("id"))
    bucket = F.shiftright("id", shift).alias("bucket")
    heads = rows.select("id", bucket).groupBy("bucket").agg(F.max("id").alias("head"))
    # Written, so that a range's number and the order of ranges come from one dealing.
    ranged = materialize(heads.repartitionByRange(F.desc("bucket")).withColumn("range", F.spark_partition_id()))
    tops = ranged.groupBy("range").agg(F.max("bucket").alias("top"), F.min("bucket").alias("last"))
    whole = Window.orderBy("range")
    around = tops.select("top", F.coalesce(F.lag("last").over(whole), F.min("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before_top"))
    within = ranged.withColumn("before", F.lag("bucket").over(Window.partitionBy("range").orderBy(F.desc("bucket"))))
    # Written, so that the size of this table of ids, one in some thousand, decides whether texts move for it.
    firsts = materialize(within.join(F.broadcast(around), within["bucket"] == around["top"], "left").select("head", F.coalesce("before", "before_top").alias("before")))
    heads_ = rows.join(firsts, F.col("id") == F.col("head")).groupBy("before").agg(F.min("text").alias("head_text"))
    heads_ = materialize(heads_.withColumn("head_vector", vector(F.col("head_text"))))
    near = rows.select("id", "text", bucket).repartition("bucket").sortWithinPartitions("bucket", F.desc("id"), "text").withColumn("vector", vector(F.col("text")))
    near = near.withColumn("next", F.lead(F.struct("text", "vector")).over(Window.partitionBy("bucket").orderBy(F.desc("id"), "text")))
    last = F.col("next").isNull()
    return near.join(heads_, F.col("bucket") == F.col("before"), "left").select(
        F.col("id").alias(id_col), "text", "vector",
        F.when(last, F.col("head_text")).otherwise(F.col("next.text")).alias("next_text"),
        F.when(last, F.col("head_vector")).otherwise(F.col("next.vector")).alias("next_vector"),
    )


def half_replaced(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of another."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
