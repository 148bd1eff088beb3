"""Exact medians of keys of any size.

Percentile aggregates hold a key's values in one task. Keys of more than `most` rows are taken apart instead: a
round counts a key's values in `cells` cells between the least and the largest that are left, and
goes on with the one cell that holds the middle. Counts are summed within tasks first. A round
leaves about 1 / cells of a key's rows, so one or two of them do; what is left then is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


LARGEST = 1.7976931348623157e308


def _cell(value: Column, low: Column, high: Column, cells: int) -> Column:
    """Cells of equal width from low to high; differences of halves don't overflow."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.lit(cells - 1), F.floor(share * cells))).otherwise(0)


def median(df: DataFrame, keys: list[str], value: str, most: int = 1_000_000, cells: int = 4096) -> DataFrame:
    """(keys, median): the middle value, or the mean of the two middle ones, of each key's values but nulls; NaN is none.

    Infinite values are taken as the largest doubles. A key that is null is a key. Of an empty table the result is empty; keys without a value have none.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)).alias("_v"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # As many rows as there are keys of more than `most` values: few beside the table.
    hot = written(counts.where(F.col("_n") > most).withColumn("_before", F.lit(0).cast("bigint")), "keys")
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(F.median("_v").alias("median"))
    same = lambda other: [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
    found = rows.alias("r").join(F.broadcast(hot.alias("h")), same("h"), "left_anti").groupBy(*keys).agg(F.median("_v").alias("median"))
    done, state = None, hot
    while True:
        # The two middle places of a key, counted from the least value that is left.
        places = state.withColumns({"_a": F.floor((F.col("_n") - 1) / 2) - F.col("_before"), "_b": F.floor(F.col("_n") / 2) - F.col("_before")})
        held = rows.alias("r").join(F.broadcast(places.alias("s")), same("s")).where("_v BETWEEN _low AND _high")
        cell = _cell(F.col("_v"), F.col("_low"), F.col("_high"), cells).alias("_cell")
        each = held.select(*[F.col(f"s.{k}").alias(k) for k in keys], "_v", "_n", "_before", "_a", "_b", cell)
        own = each.groupBy(*keys, "_n", "_before", "_a", "_b", "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell"))
        own = own.withColumn("_upto", upto).where("(_a < _upto AND _a >= _upto - _c) OR (_b < _upto AND _b >= _upto - _c)")
        # One cell with both middle places goes on; of two cells the ends are the middle values.
        next_ = own.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_cells"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_high").alias("_left"), F.max("_low").alias("_right"), F.min(F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"), F.sum("_c").alias("_c"))
        next_ = written(next_, "cells")
        ready = next_.where("_cells = 2 OR _low = _high").select(*keys, F.when(F.col("_cells") == 2, F.col("_left") / 2 + F.col("_right") / 2).otherwise(F.col("_low")).alias("median"))
        done = ready if done is None else done.unionByName(ready)
        state = next_.where("_cells = 1 AND _low < _high").select(*keys, "_n", "_low", "_high", "_before")
        if state.isEmpty():
            return found.unionByName(done)
