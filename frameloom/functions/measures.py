"""Column functions on rates, times and quality measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate_parts(rate: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a rate written ``num/den``, or ``num`` alone; null unless both are over zero."""
    shape = r"^\s*(\d{1,9})(?:/(\d{1,9}))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(rate, shape, i), F.lit("")).cast("bigint")
    num = part(1)
    den = F.when(rate.rlike(shape), F.coalesce(part(2), F.lit(1)))
    sound = (num > 0) & (den > 0)
    return F.when(sound, num), F.when(sound, den)


def frames_per_second(rate: Column) -> Column:
    num, den = rate_parts(rate)
    return num / den


def rounded_ms(seconds: Column) -> Column:
    """Seconds as text in whole milliseconds, halves away from zero; null if negative or no finite number."""
    value = F.when(seconds.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.trim(seconds).cast("double"))
    return F.when(value >= 0, F.round(value * 1000).cast("bigint"))


def quality_score(sharpness: Column, width: Column, height: Column, under: Column, over: Column, low_information: Column) -> Column:
    """The score by which a representative is chosen; unmeasured images are under every measured one."""
    pixels = width.cast("double") * height.cast("double")
    score = 3 * F.log(sharpness + 1) + 0.25 * F.log(pixels + 1) - 10 * (under + over) - 4 * low_information
    return F.coalesce(score, F.lit(float("-inf")))


def analysis_height(width: Column, height: Column, target: int = 160) -> Column:
    """The height of a frame scaled to a width for analysis: in proportion, at least 2, and even; null for sizes under 1."""
    scaled = F.greatest(F.round(height.cast("double") * target / width).cast("int"), F.lit(2))
    return F.when((width > 0) & (height > 0), scaled + scaled % 2)


def low_information(entropy: Column, deviation: Column) -> Column:
    """1 minus the weighted shares of entropy (of 8 bits) and deviation (of 64 levels), each at most 1."""
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return 1 - (0.7 * share(entropy / 8) + 0.3 * share(deviation / 64))


def aspect_ratio(width: Column, height: Column) -> Column:
    return width / F.greatest(height, F.lit(1))


def reflected_index(value: Column, length: Column) -> Column:
    """An index mirrored into 0 .. length - 1 without repeating the edge."""
    period = 2 * length - 2
    at = F.when(length <= 1, F.lit(0)).otherwise(F.pmod(value, F.greatest(period, F.lit(1))))
    return F.when(at >= length, period - at).otherwise(at)


def clamped_index(value: Column, length: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, length - 1))
