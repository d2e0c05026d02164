"""Reports over texts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T


def token_report(docs: DataFrame, key: str, text: str, ordered: bool = False) -> DataFrame:
    """key, tokens, chars, ratio; null texts count as empty. If ordered, most tokens first, then by key."""
    t = docs.select(key, F.coalesce(text, F.lit("")).alias("_t"))
    t = t.select(key, T.basic_tokens(F.col("_t")).alias("tokens"), F.length("_t").alias("chars"))
    t = t.withColumn("ratio", T.ratio(F.col("tokens"), F.col("chars")))
    return t.orderBy(F.desc("tokens"), key) if ordered else t


def with_total(report: DataFrame, key: str) -> DataFrame:
    """A row for each key and one for all (null key): tokens, chars, files, ratio."""
    r = report.rollup(key).agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n_files"), F.grouping(key).cast("int").alias("is_total"))
    return r.withColumn("ratio", T.ratio(F.col("tokens"), F.col("chars")))


def size_report(files: DataFrame, key: str, content: str, ordered: bool = False) -> DataFrame:
    """key, bytes, megabytes. If ordered, the largest first, then by key."""
    r = files.select(key, F.octet_length(F.coalesce(content, F.lit(""))).alias("bytes")).withColumn("megabytes", T.megabytes(F.col("bytes")))
    return r.orderBy(F.desc("bytes"), key) if ordered else r


def numbered_batches(df: DataFrame, within: str, order: str, size: int) -> DataFrame:
    """Adds n (from 1) and batch (from 0) within each group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(within).orderBy(order))).withColumn("batch", F.floor((F.col("n") - 1) / size))


def adjacent_distinct(df: DataFrame, within: str, order: str, text: str) -> DataFrame:
    """Rows whose normalised text isn't empty and differs from the row before that isn't empty."""
    t = df.withColumn(text, T.normalize_space(F.col(text))).where(F.col(text) != "")
    before = F.lag(text).over(Window.partitionBy(within).orderBy(order))
    return t.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(text))).drop("_b")


def joined_text(df: DataFrame, within: str, order: str, text: str, separator: str) -> DataFrame:
    """One text for each group, in order."""
    return df.groupBy(within).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator).alias(text))


def skip_existing(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def failures(df: DataFrame, failed: Column) -> DataFrame:
    """n, n_failed, exit_code."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed")).withColumn("exit_code", F.when(F.col("n_failed") > 0, 1).otherwise(0))
