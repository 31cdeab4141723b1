"""Time plans: at which milliseconds of a video frames are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.measures import rate_parts
from frameloom.operators.replay import replay

#: A plan of one source with more points than this is refused with an error, where it is to be one array.
LARGEST_PLAN = 100_000

_NONE = "cast(array() as array<bigint>)"


def _div(a: Column, b: Column | int) -> Column:
    """The whole part of a quotient of non-negative integers under 2**53, exactly."""
    return ((a - a % b) / b).cast("bigint")


def _upto(count: Column) -> Column:
    """0 .. count - 1; empty for counts under one, an error for more than the largest plan."""
    safe = F.when(count.between(1, LARGEST_PLAN), count)
    refused = F.raise_error(F.format_string(f"a plan of %d points is over the limit of {LARGEST_PLAN}", count.cast("bigint"))).cast("array<bigint>")
    return F.when(count < 1, F.expr(_NONE)).when(safe.isNotNull(), F.sequence(F.lit(0).cast("bigint"), safe - 1)).when(count.isNotNull(), refused)


def fixed_interval(duration: Column, step: int) -> Column:
    """0, step, 2 step ... under the duration."""
    if step <= 0:
        raise ValueError("the interval must be positive")
    return F.transform(_upto(F.ceil(duration / step)), lambda i: i * step)


def frame_interval(duration: Column, rate: Column, every: int) -> Column:
    """The times of frames 0, every, 2 every ... of a constant rate, in whole milliseconds, under the duration.

    Frame n is at (n * den * 1000 + num div 2) div num, in exact integers; equal neighbours count once.
    """
    if every <= 0:
        raise ValueError("the frame interval must be positive")
    num, _ = rate_parts(rate)
    times = F.transform(_upto(frame_counts(duration, rate, every)), lambda i: frame_time(rate, i, every))
    return F.array_distinct(F.when(num.isNotNull(), times))


def target_count(duration: Column, count: int) -> Column:
    """``count`` times evenly from 0 to the last millisecond; a single one is in the middle."""
    if not 0 < count <= LARGEST_PLAN:
        raise ValueError(f"the count must be from 1 to {LARGEST_PLAN}")
    if count == 1:
        times = F.array(_div(duration, 2))
    else:
        steps = F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))
        times = F.transform(steps, lambda i: _div(i * (duration - 1), count - 1))
    return F.when(duration > 0, F.array_distinct(times)).when(duration <= 0, F.expr(_NONE))


def every_nth_frame(timeline: Column, every: int) -> Column:
    """Every n-th time of an explicit, sorted timeline."""
    return F.filter(timeline, lambda _, i: i % every == 0)


def range_times(start: Column, end: Column, step: int) -> Column:
    """start, start + step ... under the end of a half-open range."""
    return F.transform(_upto(F.ceil((end - start) / step)), lambda i: start + i * step)


def explode_counted(rows: DataFrame, count: Column, outer: bool = False) -> DataFrame:
    """Add ``i``: a row for each of 0 .. count - 1, in pieces of at most the largest plan, so that counts have no limit.

    Rows whose count is null or under one have none; with ``outer``, one with a null.
    """
    explode = F.explode_outer if outer else F.explode
    counted = rows.withColumn("_n", count.cast("bigint"))
    starts = F.when(F.col("_n") >= 1, F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("_n"), F.lit(1)) - 1, F.lit(LARGEST_PLAN).cast("bigint")))
    pieces = counted.select("*", explode(starts).alias("_first"))
    return pieces.select(*rows.columns, explode(F.sequence("_first", F.least(F.col("_first") + LARGEST_PLAN, F.col("_n")) - 1)).alias("i"))


def frame_counts(duration: Column, rate: Column, every: int) -> Column:
    """How many frames 0, every, 2 every ... have a time under the duration; null without a rate.

    Frame n is under it if n * den * 1000 + num div 2 < duration * num: exact integers decide.
    """
    num, den = rate_parts(rate)
    room = duration.cast("decimal(18,0)") * num.cast("decimal(10,0)") - _div(num, 2).cast("decimal(10,0)")
    each = den.cast("decimal(10,0)") * F.lit(1000 * every).cast("decimal(13,0)")
    return F.when(num.isNotNull(), F.when(room > 0, F.call_function("div", room + each - 1, each)).otherwise(0).cast("bigint"))


def frame_at(num: Column, den: Column, i: Column, every: int) -> Column:
    """The time of frame i * every of the rate num / den, in whole milliseconds."""
    return _div(i * every * den * 1000 + _div(num, 2), num)


def frame_time(rate: Column, i: Column, every: int) -> Column:
    """The time of frame i * every of a constant rate; where i was exploded, take the rate apart before and ``frame_at``."""
    return frame_at(*rate_parts(rate), i, every)


#: A stretch of an entity's times within which they are sorted together.
STRETCH = 600_000


def snap_to_frames(times: DataFrame, frames: DataFrame, entity: str, time: str, frame: str, stretch: int = STRETCH) -> DataFrame:
    """Add ``snapped``: the nearest frame time of the entity, the earlier of two equally near; null without frames.

    An as-of join in both directions over sorted unions of the stretches of an entity; what lies nearest outside a
    stretch comes from the extremes of the others, of which there is one row each. No entity is sorted whole, and the
    frames are never collected. Columns of ``times`` are kept; rows without an entity or a time keep a null.
    """
    names = times.columns
    cell = F.floor(F.col("t") / stretch)
    left = times.select(F.struct(*names).alias("row"), F.col(entity).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("f"))
    right = frames.select(F.col(entity).alias("k"), F.col(frame).alias("t")).dropna().distinct()
    # The last frame before each stretch that has times or frames, and the first one after it.
    ends = right.groupBy("k", cell.alias("c")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    asked = left.select("k", cell.alias("c")).dropna().distinct().unionByName(ends.select("k", "c")).distinct().join(ends, ["k", "c"], "left")
    order = Window.partitionBy("k").orderBy("c")
    around = asked.select("k", "c", F.last("hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("last_before"), F.first("lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("first_after"))
    right = right.select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), "k", "t", F.lit(0).alias("side"), F.col("t").alias("f"))
    both = left.unionByName(right).withColumn("c", cell)
    before = Window.partitionBy("k", "c").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("k", "c").orderBy(F.desc("t"), "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("down", F.last("f", ignorenulls=True).over(before)).withColumn("up", F.last("f", ignorenulls=True).over(after))
    joined = both.where("side = 1").join(around, ["k", "c"], "left")
    down, up = F.coalesce("down", "last_before"), F.coalesce("up", "first_after")
    near = F.when(F.col("k").isNull() | F.col("t").isNull(), None).when(up.isNull() | (F.col("t") - down <= up - F.col("t")), down).otherwise(up)
    return joined.select("row.*", near.alias("snapped"))


def nearest_within(planned: DataFrame, existing: DataFrame, entity: str, time: str, tolerance: int = 1) -> DataFrame:
    """Add ``nearest``: the time in ``existing`` of the same entity within the tolerance, nearest first, then the
    smaller; null if there is none. Each planned time asks for its 2 * tolerance + 1 neighbours by an equi-join."""
    there = existing.select(F.col(entity).alias("_k"), F.col(time).alias("_at")).dropna().distinct()
    offsets = F.array(*[F.lit(d).cast("bigint") for d in range(-tolerance, tolerance + 1)])
    asked = planned.select(F.col(entity).alias("_e"), F.col(time).alias("_t")).dropna().distinct().select("*", F.explode(offsets).alias("_d"))
    hits = asked.join(there, (F.col("_e") == F.col("_k")) & (F.col("_t") + F.col("_d") == F.col("_at")))
    best = hits.groupBy("_e", "_t").agg(F.min(F.struct(F.abs("_d").alias("far"), F.col("_at").alias("at"))).alias("best"))
    best = best.select(F.col("_e").alias(entity), F.col("_t").alias(time), F.col("best.at").alias("nearest"))
    return planned.drop("nearest").join(best, [entity, time], "left")


def interval_hits(existing: DataFrame, entity: str, time: str, step: int, tolerance: int = 1) -> DataFrame:
    """(entity, time), distinct: the times of the endless plan 0, step, 2 step ... that have an existing time of the entity
    within the tolerance. An existing time is that near to one planned time at most, so no plan is made to be joined."""
    if tolerance < 0 or step <= 2 * tolerance:
        raise ValueError("the interval must be over twice the tolerance, which is not negative")
    past = F.pmod(F.col(time), F.lit(step).cast("bigint"))
    near = existing.where(F.col(entity).isNotNull() & ((past <= tolerance) | (past >= step - tolerance)))
    at = F.when(past <= tolerance, F.col(time) - past).otherwise(F.col(time) + (step - past))
    return near.select(F.col(entity).alias(entity), at.alias(time)).where(F.col(time) >= 0).distinct()


def change_selection(points: DataFrame, entity: str, time: str, score: str, threshold: float, least: int, most: int) -> DataFrame:
    """The times at which frames are taken from a change curve, per entity.

    The first point is taken; a later one if ``most`` milliseconds have passed since the last taken, or if its score
    reaches the threshold and ``least`` have passed. The state, the time last taken, runs along the sorted curve, which
    streams through one task for each entity. Points without an entity or a time are left out; one without a score
    is taken by time alone; points of one time stand in ascending order of score.
    """
    if not 0 <= threshold <= 1 or least <= 0 or most < least:
        raise ValueError("threshold in [0, 1] and 0 < least <= most")
    curve = points.select(F.col(entity).alias(entity), F.col(time).cast("bigint").alias("t"), F.col(score).cast("double").alias("s")).where("t is not null")

    def step(state: dict, row: tuple) -> list[tuple]:
        t, s = row
        last = state.get("last")
        if last is None or t - last >= most or (s >= threshold and t - last >= least):
            state["last"] = t
            return [(t,)]
        return []

    kind = curve.schema[entity].dataType.simpleString()
    return replay(curve, [entity], ["t", "s"], ["t", "s"], dict, step, f"{entity} {kind}, {time} bigint")
