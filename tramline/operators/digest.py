"""Content digests that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(x: Column) -> Column:
    """A JSON string in ASCII: other characters as lower-case \\uXXXX, in pairs above U+FFFF."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("bigint"))), 4, "0"))

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F.when((code >= 32) & (code < 127) & ~c.isin('"', "\\"), c)
        for plain, escaped in short.items():
            out = out.when(c == plain, escaped)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
        return out.when(code > 0xFFFF, F.concat(unit(high), unit(low))).otherwise(unit(code))

    # Most ids have plain characters only and need no look at each of them.
    chars = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: shown(F.substring(x, i, F.lit(1))))
    own = F.when((x == "") | x.rlike(r"^[ !#-\[\]-~]*$"), x).otherwise(F.array_join(chars, ""))
    return F.concat(F.lit('"'), own, F.lit('"'))


def session_digest(df: DataFrame) -> DataFrame:
    """(session_count, session_id_digest): SHA-256 of the sorted distinct ids as a compact JSON array in ASCII.

    The ids of all sessions meet in one row, as the format of this digest asks; dataset_digest scales.
    """
    ids = df.where("session_id IS NOT NULL").agg(F.sort_array(F.collect_set("session_id")).alias("ids"))
    text = F.concat(F.lit("["), F.array_join(F.transform("ids", json_text), ","), F.lit("]"))
    return ids.select(F.size("ids").cast("bigint").alias("session_count"), F.sha2(text, 256).alias("session_id_digest"))


def dataset_digest(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, digest): 36 hex digits from the count, sum and exclusive or of row hashes; types count too."""
    kinds = dict(df.dtypes)
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    sums = df.select(*by, h.alias("h")).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))
    head = ",".join(f"{c}:{kinds[c]}" for c in columns)
    return sums.select(*by, "rows", F.substring(F.sha2(F.concat_ws("|", F.lit(head), F.col("rows").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256), 1, 36).alias("digest"))
