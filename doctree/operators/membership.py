"""A bitmap of keys that is broadcast, to drop rows that no key can match before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of one row of a bitmap, as Spark's bitmap functions have them, and the most rows: 16 MB in all.
ROW_BITS, MOST_ROWS = 1 << 15, 1 << 12
#: Bits for each key, as long as MOST_ROWS allows: a key that is not there passes with a chance of one in so many.
BITS_A_KEY = 64


def bitmap_rows(n: int) -> int:
    """Rows of a bitmap for n keys: a power of 2. 0 if they are so many that even the largest bitmap would let most keys pass."""
    most = ROW_BITS * MOST_ROWS
    return 0 if n > most else 1 << (max(-(-n * BITS_A_KEY // ROW_BITS), 1) - 1).bit_length() if n * BITS_A_KEY < most else MOST_ROWS


def _place(columns: list[str], rows: int):
    # bitmap functions count from 1, and turn negative numbers into positive ones.
    return F.pmod(F.xxhash64(*columns), F.lit(rows * ROW_BITS)) + 1


def bitmap(keys: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """(bucket, bits): the bitmap of keys' columns, built on executors; each row is 4 KB and there are `rows` at most."""
    place = _place(columns, rows)
    return keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("_at")).groupBy("bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def _marked(df: DataFrame, keys: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """df with _likely: whether the bitmap of keys has the bit of its columns. df is not shuffled."""
    place = _place(columns, rows)
    placed = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place)})
    joined = placed.join(F.broadcast(bitmap(keys, columns, rows)), F.col("_bucket") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.select(*df.columns, F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)).alias("_likely"))


def likely_members(df: DataFrame, keys: DataFrame, columns: list[str], n: int) -> DataFrame:
    """df without most rows whose columns no row of keys has; none that one has is dropped. n: about how many keys there are.

    The bitmap's size is bounded, so it can be broadcast at any scale, and df is not shuffled. For more keys than it
    has bits, df comes back as it is.
    """
    rows = bitmap_rows(n)
    return _marked(df, keys, columns, rows).filter("_likely").drop("_likely") if rows else df


def parted_by_members(df: DataFrame, keys: DataFrame, columns: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(likely members, rows that surely are none) of df; see likely_members."""
    if not (rows := bitmap_rows(n)):
        return df, df.limit(0)
    marked = _marked(df, keys, columns, rows)
    return marked.filter("_likely").drop("_likely"), marked.filter("not _likely").drop("_likely")
