"""Joins of points with half-open ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges up to this many buckets long are met by an equi-join on the bucket; longer ones are cut into levels.
WIDTH = 1 << 14


def contained_in(points: DataFrame, ranges: DataFrame, entity: str, point: str, start: str, end: str, name: str) -> DataFrame:
    """Add a boolean ``name``: whether some range of the entity holds the point (start <= point < end).

    An interval join by equality: a range is cut into aligned pieces of 2**0, 2**1, ... times ``WIDTH`` (at most two
    of each size, whatever its length), a point looks up the piece of each size around it, and the bounds are checked
    on what meets. So neither long ranges nor many of them blow up the join. Points without an entity are in no range.
    """
    top = 40
    r = ranges.select(F.col(entity).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).where("k is not null and s >= 0 and e > s").distinct()
    # The level at which a range spans at most two aligned pieces.
    level = F.least(F.lit(top), F.greatest(F.lit(0), F.ceil(F.log2(((F.col("e") - F.col("s")) / WIDTH))).cast("int")))
    r = r.withColumn("level", level)
    size = F.lit(WIDTH) * F.pow(F.lit(2.0), F.col("level"))
    pieces = F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))
    r = r.select("k", "s", "e", "level", F.explode(pieces).alias("piece"))
    levels = sorted(row["level"] for row in r.select("level").distinct().collect())  # at most top + 1
    looked_up = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")
    p = points.select(entity, point).dropna().distinct().select("*", looked_up)
    p = p.withColumn("piece", F.floor(F.col(point) / (F.lit(WIDTH) * F.pow(F.lit(2.0), F.col("level")))))
    q = p.select(F.col(entity).alias("k"), F.col(point).alias("p"), "level", "piece")
    hit = q.join(r, ["k", "level", "piece"]).where("s <= p and p < e").select(F.col("k").alias(entity), F.col("p").alias(point)).distinct().withColumn(name, F.lit(True))
    return points.join(hit, [entity, point], "left").withColumn(name, F.coalesce(name, F.lit(False)))
