"""URL filters on a sorted digest array.

Keys `host + path prefix` are hashed by xxhash64 and sorted; each Python worker memory-maps
the array and probes it by binary search for all candidate keys of a batch at once. A hit
counts only if the stored full string equals the candidate, so equal digests do no harm.

A key fits its host and all subdomains, if the url's path starts with the key's path. Among
fitting rules the longest wins; where no rule fits, a listed key blocks. A null url, or one
without `://`, has an empty host and path, fits nothing and is allowed. Rows are judged one by
one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_chunks

#: The key list is sent to the workers up to this many characters; a longer one is joined instead.
MAX_SENT_CHARS = 64_000_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted 64-bit digests, memory-mapped, and the strings in the same order."""

    def __init__(self, keys: Iterable[str]):
        strings = sorted(set(keys), key=lambda k: (xxhash.xxh64_intdigest(k), k))
        self.strings = np.array(strings, object)
        #: Sizes of the keys' paths, and the longest host among them.
        self.sizes = sorted({len(k) - k.index("/") for k in strings})
        self.longest = max((k.index("/") for k in strings), default=0)
        digests = np.array([xxhash.xxh64_intdigest(k) for k in strings], np.uint64)
        self.file = tempfile.TemporaryFile()
        self.file.write(digests.tobytes() or bytes(8))
        self.file.flush()
        self.digests = np.memmap(self.file, np.uint64, "r", shape=(max(1, len(digests)),))[: len(digests)]

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Whether each string is a key."""
        if not len(keys) or not len(self.strings):
            return np.zeros(len(keys), bool)
        probe = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at, hit = np.searchsorted(self.digests, probe), np.zeros(len(keys), bool)
        while len(todo := np.flatnonzero((at < len(self.digests)) & ~hit)):
            todo = todo[self.digests[at[todo]] == probe[todo]]
            if not len(todo):
                break
            hit[todo] = self.strings[at[todo]] == keys[todo]
            left = todo[~hit[todo]]
            at = np.where(np.isin(np.arange(len(at)), left), at + 1, len(self.digests))
        return hit


def candidates(host: str, path: str, sizes: Sequence[int], longest: int) -> list[str]:
    """Each suffix of the host from a label's start, `longest` characters at most, with each prefix of the path of a listed size."""
    ends, at = [host] if len(host) <= longest else [], max(0, len(host) - longest - 1)
    while (at := host.find(".", at) + 1) > 0:
        ends.append(host[at:])
    starts = [path[:n] for n in sizes if 0 < n <= len(path)]
    return [e + s for e in ends for s in starts]


_arrays: dict[tuple[int, str], DigestArray] = {}


def array(keys: Sequence[str]) -> DigestArray:
    """The digest array of these keys in this Python worker; one list is held at a time."""
    name = len(keys), xxhash.xxh3_128_hexdigest("\n".join(keys))
    if name not in _arrays:
        _arrays.clear()
        _arrays[name] = DigestArray(keys)
    return _arrays[name]


def judge(df: DataFrame, rules: dict[str, str], blocked: Sequence[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) for every row.

    `rules`: key -> 'allow' or 'block'; `blocked`: further keys. A key is host + path, with a slash.
    """
    if sum(map(len, [*rules, *blocked])) > MAX_SENT_CHARS:
        raise ValueError("the list is too long to send: use judge_joined with a table of keys")
    order = {k: (len(k), k) for k in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = array([*rules, *blocked])
        for batch in text_chunks(batches, "path"):
            probes = [candidates(h, p, own.sizes, own.longest) for h, p in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True)]
            flat = np.array([k for keys in probes for k in keys], object)
            row = np.repeat(np.arange(batch.num_rows), [len(keys) for keys in probes])
            hit = own.found(flat)
            best: list[str | None] = [None] * batch.num_rows
            listed: list[str | None] = [None] * batch.num_rows
            for i, key in zip(row[hit].tolist(), flat[hit].tolist(), strict=True):
                if key in rules and (best[i] is None or order[key] > order[best[i]]):
                    best[i] = key
                elif key not in rules and (listed[i] is None or (len(key), key) > (len(listed[i]), listed[i])):
                    listed[i] = key
            verdict = [rules[b] if b else "block" if x else "allow" for b, x in zip(best, listed, strict=True)]
            columns = [batch[0], batch[1], batch[2], pa.array(best, pa.string()), pa.array(verdict, pa.string()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "host", "path", "rule", "verdict", "listed"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    out = rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string, listed string")
    return out.withColumnRenamed("id", id_col)


def judge_joined(df: DataFrame, keys: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As `judge`, for a table (key, verdict, is_rule) of any size: candidates join on digest and string.

    (id, url) identify a row; repeated rows give one result row.
    """
    at = F.instr("key", "/")
    sizes = F.broadcast(keys.agg(F.collect_set(F.length("key") - at + 1).alias("sizes"), F.max(at - 1).alias("longest")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Only the end of a host that a key can reach is cut at its dots, with what stands before it.
    end = F.right("host", (F.col("longest") + 1).cast("int"))
    dots = F.filter(F.sequence(F.lit(0), F.length(end)), lambda i: ((i == 0) & (F.length("host") <= F.col("longest"))) | ((i > 0) & (F.substring(end, i, F.lit(1)) == ".")))
    ends = F.transform(dots, lambda i: F.substring(end, i + 1, F.length(end)))
    probes = (
        rows.crossJoin(sizes)
        .select("id", "url", "host", "path", F.explode(ends).alias("end"), "sizes")
        .select("id", "url", "host", "path", "end", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
        .withColumn("key", F.concat("end", F.substring("path", F.lit(1), F.col("n"))))
        .withColumn("digest", F.xxhash64("key"))
    )
    hits = probes.join(keys.withColumn("digest", F.xxhash64("key")), ["digest", "key"])
    best = hits.groupBy("id", "url").agg(
        F.max(F.when(F.col("is_rule"), F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("r"),
        F.max(F.when(~F.col("is_rule"), F.struct(F.length("key").alias("n"), "key"))).alias("l"),
    )
    best = best.select(F.col("id").alias("_id"), F.col("url").alias("_url"), "r", "l")
    out = rows.distinct().join(best, F.col("id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")), "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("l").isNotNull(), "block"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("r.key").alias("rule"), verdict.alias("verdict"), F.col("l.key").alias("listed"))
