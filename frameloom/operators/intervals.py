"""Continuous periods and gaps of half-open intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import plain_key

#: Width of the start buckets. One bucket of one entity holds at most so many distinct starts.
BUCKET = 1 << 16


def merge_intervals(
    intervals: DataFrame,
    key: str = "source_id",
    start: str = "start_ms",
    end: str = "end_ms",
    bucket: int = BUCKET,
) -> DataFrame:
    """Merge the intervals of each entity into periods and list the gaps between them.

    Method: sort by start, compare each start with the running maximum of the previous ends, label islands
    cumulatively, aggregate the periods, derive the gaps. An entity that holds a large part of all rows is
    not sorted in one task: rows are first reduced to one per (entity, start) with a map-side maximum, and
    sorted within (entity, start bucket), which bounds a sort group by ``bucket`` rows whatever the input.
    What crosses a bucket border (the running maximum coming in, the next start after it) is computed over
    one row per non-empty bucket and joined back.

    Result: one row (key, kind ``period`` or ``gap``, start, end) each; touching intervals join.
    Rows with a null or blank key, a null bound, a negative start or end <= start are no intervals and are
    left out. Repeated rows count once; an empty table gives an empty result; other columns are ignored.
    """
    rows = (
        intervals.select(
            plain_key(F.col(key).cast("string")).alias("k"),
            F.col(start).cast("bigint").alias("s"),
            F.col(end).cast("bigint").alias("e"),
        )
        .where(F.col("k").isNotNull() & (F.col("s") >= 0) & (F.col("e") > F.col("s")))
        .withColumn("b", F.expr(f"s div {bucket}"))
        .groupBy("k", "b", "s")
        .agg(F.max("e").alias("e"))
    )
    in_bucket = Window.partitionBy("k", "b").orderBy("s")
    before = F.max("e").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        rows.withColumn("before", before)
        .withColumn("opens", F.when(F.col("before") >= F.col("s"), 0).otherwise(1))
        .withColumn("island", F.sum("opens").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "b", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )

    of_entity = Window.partitionBy("k").orderBy("b")
    borders = (
        islands.groupBy("k", "b")
        .agg(F.max("e").alias("top"))
        .withColumn("carried", F.max("top").over(of_entity.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("last_end", F.max("top").over(Window.partitionBy("k")))
        .drop("top")
    )
    opening = (
        islands.join(borders, ["k", "b"])
        .withColumn("before", F.greatest("carried", F.lag("e").over(in_bucket)))
        .where(F.col("before").isNull() | (F.col("s") > F.col("before")))
        .select("k", "b", "s", "before", "last_end", F.lead("before").over(in_bucket).alias("closes"))
    )
    after = (
        opening.groupBy("k", "b")
        .agg(F.min_by("before", "s").alias("first_before"))
        .select("k", "b", F.lead("first_before").over(of_entity).alias("closes_later"))
    )
    found = F.array(
        F.struct(
            F.lit("period").alias("kind"),
            F.col("s").alias("start"),
            F.coalesce("closes", "closes_later", "last_end").alias("end"),
        ),
        F.when(
            F.col("before").isNotNull(),
            F.struct(F.lit("gap").alias("kind"), F.col("before").alias("start"), F.col("s").alias("end")),
        ),
    )
    return (
        opening.join(after, ["k", "b"])
        .select("k", F.explode(F.array_compact(found)).alias("f"))
        .select(
            F.col("k").alias(key), "f.kind", F.col("f.start").alias(start), F.col("f.end").alias(end)
        )
    )
