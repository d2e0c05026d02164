"""Samples, tracks, pixels and transcripts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import signal as S
from quillmill.functions import text as T


def bounding_box(pixels: DataFrame, image: str = "img", background: tuple[int, int, int] = (255, 255, 255), threshold: float = 10.0) -> DataFrame:
    """image, left, top, right, bottom of the pixels that aren't background; nulls where all are. pixels: image, x, y, r, g, b, a."""
    c = S.is_content(*[F.col(k) for k in "rgba"], background, threshold)
    some = lambda k: F.when(c, F.col(k))
    return pixels.groupBy(image).agg(F.min(some("x")).alias("left"), F.min(some("y")).alias("top"), (F.max(some("x")) + 1).alias("right"), (F.max(some("y")) + 1).alias("bottom"))


def mix(tracks: DataFrame, group: str = "mix") -> DataFrame:
    """group, sample_idx, value: tracks with gain overlaid, saturating, as long as the first track (track_no 0).

    tracks: group, track_no, volume_db, sample_idx, value. One shuffle: the first track's reach comes out of the same aggregation.
    """
    t = tracks.withColumn("_v", S.gain(F.col("value"), F.coalesce("volume_db", F.lit(0.0))))
    m = t.groupBy(group, "sample_idx").agg(F.sum("_v").alias("v"), F.max(F.when(F.col("track_no") == 0, True)).alias("first"))
    return m.where("first").select(group, "sample_idx", F.greatest(F.least("v", F.lit(32767)), F.lit(-32768)).cast("int").alias("value"))


def transcript(segments: DataFrame, audio: str = "audio", timestamps: bool = True) -> DataFrame:
    """audio, text: segments in order, blank ones dropped; a line each with its time, or all in one line. start in centiseconds."""
    s = segments.withColumn("_t", T.strip(F.col("text"))).where("_t <> ''")
    line = F.concat_ws(" ", T.timestamp_mark(F.col("start")), "_t") if timestamps else F.col("_t")
    return s.withColumn("_l", line).groupBy(audio).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "_l"))), lambda x: x["_l"]), "\n" if timestamps else " ").alias("text"))


def offsets(buffers: DataFrame, stream: str, order: str, length: str) -> DataFrame:
    """Adds offset: the lengths of all buffers before."""
    before = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return buffers.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def synthesis_metrics(chunks: DataFrame, by: str, batch: int = 2) -> DataFrame:
    """by, n_chunks, n_batches, audio_seconds, realtime_factor, chunks_per_second. chunks: by, audio_seconds, elapsed."""
    m = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("audio_seconds").alias("audio_seconds"), F.max("elapsed").alias("elapsed"))
    return m.select(by, "n_chunks", S.batches(F.col("n_chunks"), batch).alias("n_batches"), "audio_seconds", S.realtime_factor(F.col("audio_seconds"), F.col("elapsed")).alias("realtime_factor"), S.realtime_factor(F.col("n_chunks"), F.col("elapsed")).alias("chunks_per_second"))
