"""A bitmap of fixed size that keeps rows from being shuffled for a join that they can't take part in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 4 KB (32,768 bits each) of the bitmap: 1,024 make 4 MB to be broadcast, whatever the number of keys.
WORDS = 1_024
BITS = 32_768


def _place(c: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(words * BITS))


def keep_possible(df: DataFrame, key: str, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of df whose key may be among the keys: every row that is, and few others as long as there are far fewer keys than bits.

    The join that follows decides. With many more keys than bits nothing is kept out and the result is the same. Null keys stay out.
    """
    at = keys.where(F.col(keys.columns[0]).isNotNull()).select(_place(F.col(keys.columns[0]), words).alias("_p"))
    at = at.select(F.floor(F.col("_p") / BITS).alias("_word"), F.pmod("_p", F.lit(BITS)).alias("_bit"))
    bitmap = at.groupBy("_word").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = _place(F.col(key), words)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.pmod(place, F.lit(BITS)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("_word", F.floor(place / BITS)).join(F.broadcast(bitmap), "_word")  # at most `words` rows of 4 KB
    return joined.where(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*df.columns)
