"""Column expressions over samples, pixels and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(samples: Column) -> Column:
    """Root of the mean square; null for an empty array."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(F.try_divide(total, F.size(samples)))


def duration(n_samples: Column, rate: Column) -> Column:
    """Seconds; 0 where the rate is 0."""
    return F.coalesce(F.try_divide(n_samples, rate), F.lit(0.0))


def realtime_factor(audio_seconds: Column, elapsed: Column) -> Column:
    return F.coalesce(F.try_divide(audio_seconds, elapsed), F.lit(0.0))


def inverted_if_dark(pixels: Column) -> Column:
    """255 - x for all pixels of an image whose mean is below 128."""
    mean = F.try_divide(F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x), F.size(pixels))
    return F.when(mean < 128, F.transform(pixels, lambda x: 255 - x)).otherwise(pixels)


def is_content(r: Column, g: Column, b: Column, a: Column, background: tuple[int, int, int], threshold: float) -> Column:
    """Whether a pixel is opaque and further from the background than the threshold."""
    square = sum(((c - F.lit(v)) * (c - F.lit(v)) for c, v in zip((r, g, b), background)), F.lit(0))
    return (F.sqrt(square.cast("double")) > threshold) & (a > 128)


def crop_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, padding: int) -> Column:
    """A box with padding, kept within the image; the whole image where there is no box."""
    none = left.isNull()
    return F.struct(
        F.when(none, 0).otherwise(F.greatest(left - padding, F.lit(0))).alias("left"), F.when(none, 0).otherwise(F.greatest(top - padding, F.lit(0))).alias("top"),
        F.when(none, width).otherwise(F.least(right + padding, width)).alias("right"), F.when(none, height).otherwise(F.least(bottom + padding, height)).alias("bottom"),
    )


def removed_percent(width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    return 100 * (1 - F.try_divide(new_width * new_height, width * height))


def gain(sample: Column, db: Column) -> Column:
    """A 16-bit sample with a gain in dB, saturating."""
    return F.when(db == 0, sample.cast("int")).otherwise(F.greatest(F.least(F.floor(sample * F.pow(F.lit(10.0), db / 20)), F.lit(32767)), F.lit(-32768)).cast("int"))


def progress(end: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(end, total) * 100, F.lit(0.0)))


def batches(n: Column, size: int) -> Column:
    return F.ceil(n / size)
