"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a temporary folder is used on a single machine; on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tramline-")
    return f"{base.rstrip('/')}/tramline-{uuid.uuid4().hex}"


def materialize(df: DataFrame, release: bool = True) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the lineage ends here.

    With `release`, shuffle files of plans that nothing refers to any more are let go.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    schema = df.schema
    del df
    if release:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def smallest(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of `df` with the `most` smallest keys, and about as many more; keys are hashes, as signed longs.

    Keys are counted by how far they lie above the least long, in powers of two; so neither the driver nor one task
    gets `most` rows of every partition.
    """
    level = F.ceil(F.log2(F.col(key).cast("double") + float(1 << 63) + 1))
    counts = sorted((r["level"], r["count"]) for r in df.groupBy(level.alias("level")).count().collect())
    total = 0
    for at, n in counts:
        total += n
        if total >= most:
            return df.where(level <= at)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_, name__ and so on that isn't a column of `df` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts have about `max_bytes` together (a longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings, null as empty."""
    return [x or "" for x in batch[name].to_pylist()]
