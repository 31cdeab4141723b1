"""Queries that plan frame times, match them with existing frames and roll them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.measures import rate_parts
from frameloom.operators.ranges import contained_in
from frameloom.plans import sampling
from frameloom.queries import views
from frameloom.sources.tables import read_table

STEP_MS, EVERY, COUNT, RANGE_STEP_MS = 60_000, 1800, 16, 5000


def _exploded(rows: DataFrame, plan) -> DataFrame:
    return rows.select("source", F.explode(plan).alias("t_ms"))


def plan_fixed_interval(spark: SparkSession, folder: str) -> DataFrame:
    """A frame a minute of every video."""
    rows = sampling.explode_counted(views.videos(spark, folder), F.ceil(F.col("duration_ms") / STEP_MS))
    return rows.select("source", (F.col("i") * STEP_MS).alias("t_ms"))


def plan_frame_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Every 1800th frame of every video with a rate."""
    num, den = rate_parts(F.col("frame_rate"))
    videos = views.videos(spark, folder).withColumns({"num": num, "den": den})
    rows = sampling.explode_counted(videos, sampling.frame_counts(F.col("duration_ms"), F.col("frame_rate"), EVERY))
    at = lambda i: sampling.frame_at(F.col("num"), F.col("den"), i, EVERY)
    timed = rows.select("source", "i", at(F.col("i")).alias("t_ms"), at(F.col("i") - 1).alias("before"))
    return timed.where("i = 0 or t_ms > before").select("source", "t_ms")


def plan_target_count(spark: SparkSession, folder: str) -> DataFrame:
    """16 frames of every video, evenly spread."""
    return _exploded(views.videos(spark, folder), sampling.target_count(F.col("duration_ms"), COUNT))


def plan_valid_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A frame every 5 seconds of every selection; overlaps count once."""
    rows = sampling.explode_counted(views.selections(spark, folder), F.ceil((F.col("end_ms") - F.col("start_ms")) / RANGE_STEP_MS))
    return rows.select("source", (F.col("start_ms") + F.col("i") * RANGE_STEP_MS).alias("t_ms")).distinct()


def plan_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many frames a plan of 20 ms steps has, and which plans are over the limit."""
    n = F.ceil(F.col("duration_ms") / 20)
    return views.videos(spark, folder).select("source", F.when(n <= sampling.LARGEST_PLAN, n).alias("n_planned"), n.alias("n_wanted"))


def every_nth_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """Every third distinct candidate time of a source."""
    times = views.candidates(spark, folder).groupBy("source").agg(F.array_sort(F.collect_set("video_offset_ms")).alias("times"))
    return _exploded(times, sampling.every_nth_frame(F.col("times"), 3))


def nearest_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """For times planned 0 to 3 ms off the candidates: the existing candidate within 1 ms."""
    there = views.candidates(spark, folder).select("source", "video_offset_ms").distinct()
    planned = there.select("source", (F.col("video_offset_ms") + F.col("video_offset_ms") % 4).alias("t_ms")).distinct()
    return sampling.nearest_within(planned, there.withColumnRenamed("video_offset_ms", "t_ms"), "source", "t_ms")


def snap_nearest_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate nearest to the start of every selection of a source with candidates."""
    starts = views.selections(spark, folder).select("source", F.col("start_ms").alias("t_ms")).distinct()
    frames = views.candidates(spark, folder).select("source", "video_offset_ms")
    return sampling.snap_to_frames(starts, frames, "source", "t_ms", "video_offset_ms").where("snapped is not null")


def protected_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a candidate lies in a protected selection of its source."""
    points = views.candidates(spark, folder).select("id", "source", "video_offset_ms").distinct()
    ranges = views.selections(spark, folder).where("protected").select("source", "start_ms", "end_ms")
    return contained_in(points, ranges, "source", "video_offset_ms", "start_ms", "end_ms", "in_protected").select("id", "video_offset_ms", "in_protected")


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_valid_ranges(spark, folder)
    there = views.candidates(spark, folder).select("source", F.col("video_offset_ms").alias("t_ms"))
    return sampling.nearest_within(planned, there, "source", "t_ms")


def sampling_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Planned, existing and new frames of the selection plan, per source."""
    return _matched(spark, folder).groupBy("source").agg(F.count("*").alias("n_planned"), F.count("nearest").alias("n_existing"), F.count_if(F.col("nearest").isNull()).alias("n_new"))


def new_times(spark: SparkSession, folder: str) -> DataFrame:
    """Planned times of the selection plan without an existing frame."""
    return _matched(spark, folder).where("nearest is null").select("source", "t_ms")


def group_sampling_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The estimate of the fixed plan rolled up per source group; sources without a plan count as sources only.

    The plan is counted, not made: a source has as many times as its duration gives, and what exists of them is looked up
    from the candidates. So what is joined grows with the candidates and not with the durations.
    """
    videos = views.videos(spark, folder).select("source", "source_group", "duration_ms")
    named = F.col("source").isNotNull().cast("bigint")
    n_planned = F.when(F.col("duration_ms") > 0, named * (F.call_function("div", F.col("duration_ms") - 1, F.lit(STEP_MS)) + 1)).otherwise(0)
    sources = videos.select("source_group", named.alias("n_sources"), n_planned.alias("n_planned"), F.lit(0).cast("bigint").alias("n_existing"))
    hits = sampling.interval_hits(views.candidate_times(spark, folder), "source", "t_ms", STEP_MS)
    # Both sides may be far larger than the planner takes them to be, from compressed files.
    found = hits.join(videos.hint("merge"), "source").where("t_ms < duration_ms")
    found = found.select("source_group", *[F.lit(n).cast("bigint").alias(c) for c, n in (("n_sources", 0), ("n_planned", 0), ("n_existing", 1))])
    return sources.unionByName(found).groupBy("source_group").agg(*[F.sum(c).alias(c) for c in ("n_sources", "n_planned", "n_existing")])


def manual_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Requested times (here the ends of selections) held under the duration of their video."""
    ends = views.selections(spark, folder).select("source", "end_ms").distinct()
    held = ends.join(views.videos(spark, folder), "source")
    return held.select("source", "end_ms", F.greatest(F.lit(0), F.least("end_ms", F.col("duration_ms") - 1)).alias("t_ms"))


def selection_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The ordinal that names each selection of a source."""
    w = Window.partitionBy("source").orderBy("created_at", "id", "start_ms", "end_ms")
    return views.selections(spark, folder).select("source", "id", F.row_number().over(w).alias("ordinal"))


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    rows = read_table(spark, folder, "events").select(F.col("user_id").alias("source"), at.alias("t_ms"), (F.col("value") / 500).alias("score"))
    return rows.groupBy("source", "t_ms").agg(F.max("score").alias("score"))


def change_triggered(spark: SparkSession, folder: str) -> DataFrame:
    """The points taken from each change curve: at least an hour apart, at most two days, or on a score of 0.6."""
    return sampling.change_selection(_curve(spark, folder), "source", "t_ms", "score", 0.6, 3_600_000, 172_800_000)


QUERIES = {f.__name__: f for f in (plan_fixed_interval, plan_frame_interval, plan_target_count, plan_valid_ranges, plan_sizes, every_nth_candidate, nearest_candidate, snap_nearest_frame, protected_candidates, sampling_estimate, new_times, group_sampling_rollup, manual_captures, selection_labels, change_triggered)}

_V = f"WITH {views.VIDEOS}"
_S, _C = views.SELECTIONS, views.CANDIDATES
_RANGES = f"{_S}, planned AS (SELECT DISTINCT source, unnest(generate_series(start_ms, end_ms - 1, {RANGE_STEP_MS})) AS t_ms FROM selections)"
_MATCH = f"""WITH {_RANGES}, {_C}, hit AS (SELECT p.source, p.t_ms, bool_or(c.source IS NOT NULL) AS hit FROM planned p
  LEFT JOIN (SELECT DISTINCT source, video_offset_ms AS at FROM candidates) c ON c.source = p.source AND c.at IN (p.t_ms - 1, p.t_ms, p.t_ms + 1) GROUP BY ALL)"""

ORACLES = {
    "plan_fixed_interval": _V + f" SELECT source, unnest(generate_series(0, duration_ms - 1, {STEP_MS})) AS t_ms FROM videos",
    "plan_frame_interval": _V + f""", r AS (SELECT *, split_part(frame_rate, '/', 1)::HUGEINT AS num, coalesce(nullif(split_part(frame_rate, '/', 2), ''), '1')::HUGEINT AS den FROM videos),
        n AS (SELECT *, unnest(generate_series(0, (duration_ms * num // (den * 1000 * {EVERY}))::BIGINT + 1)) AS i FROM r WHERE num > 0 AND den > 0),
        t AS (SELECT source, duration_ms, ((i * {EVERY} * den * 1000 + num // 2) // num)::BIGINT AS t_ms FROM n)
        SELECT DISTINCT source, t_ms FROM t WHERE t_ms < duration_ms""",
    "plan_target_count": _V + f" SELECT DISTINCT source, i * (duration_ms - 1) // {COUNT - 1} AS t_ms FROM videos, generate_series(0, {COUNT - 1}) g(i) WHERE duration_ms > 0",
    "plan_valid_ranges": f"WITH {_RANGES} SELECT source, t_ms FROM planned",
    "plan_sizes": _V + " SELECT source, CASE WHEN (duration_ms + 19) // 20 <= 100000 THEN (duration_ms + 19) // 20 END AS n_planned, (duration_ms + 19) // 20 AS n_wanted FROM videos",
    "every_nth_candidate": f"WITH {_C}, n AS (SELECT source, video_offset_ms AS t_ms, row_number() OVER (PARTITION BY source ORDER BY video_offset_ms) AS n FROM (SELECT DISTINCT source, video_offset_ms FROM candidates)) SELECT source, t_ms FROM n WHERE (n - 1) % 3 = 0",
    "nearest_candidate": f"""WITH {_C}, there AS (SELECT DISTINCT source, video_offset_ms AS c FROM candidates),
        planned AS (SELECT DISTINCT source, c + c % 4 AS t_ms FROM there)
        SELECT p.source, p.t_ms, arg_min(c, (abs(c - t_ms), c)) AS nearest FROM planned p LEFT JOIN there t ON t.source = p.source AND abs(c - t_ms) <= 1 GROUP BY ALL""",
    "snap_nearest_frame": f"""WITH {_S}, {_C}, starts AS (SELECT DISTINCT source, start_ms AS t_ms FROM selections), frames AS (SELECT DISTINCT source, video_offset_ms AS c FROM candidates)
        SELECT source, t_ms, arg_min(c, (abs(c - t_ms), c)) AS snapped FROM starts JOIN frames USING (source) GROUP BY ALL""",
    "protected_candidates": f"""WITH {_S}, {_C} SELECT DISTINCT id, video_offset_ms, EXISTS (SELECT 1 FROM selections s WHERE s.protected AND s.source = c.source
        AND s.start_ms <= c.video_offset_ms AND c.video_offset_ms < s.end_ms) AS in_protected FROM (SELECT DISTINCT id, source, video_offset_ms FROM candidates) c""",
    "sampling_estimate": _MATCH + " SELECT source, count(*) AS n_planned, count(*) FILTER (hit) AS n_existing, count(*) FILTER (NOT hit) AS n_new FROM hit GROUP BY source",
    "new_times": _MATCH + " SELECT source, t_ms FROM hit WHERE NOT hit",
    "group_sampling_rollup": f"""WITH {views.VIDEOS}, {_C}, planned AS (SELECT source, unnest(generate_series(0, duration_ms - 1, {STEP_MS})) AS t_ms FROM videos WHERE duration_ms > 0),
        hit AS (SELECT p.source, p.t_ms, bool_or(c.source IS NOT NULL) AS hit FROM planned p LEFT JOIN (SELECT DISTINCT source, video_offset_ms AS at FROM candidates) c
          ON c.source = p.source AND c.at IN (p.t_ms - 1, p.t_ms, p.t_ms + 1) GROUP BY ALL)
        SELECT source_group, count(DISTINCT v.source) AS n_sources, count(t_ms) AS n_planned, count(*) FILTER (hit) AS n_existing FROM videos v LEFT JOIN hit USING (source) GROUP BY source_group""",
    "manual_captures": f"WITH {views.VIDEOS}, {_S} SELECT DISTINCT source, end_ms, greatest(0, least(end_ms, duration_ms - 1)) AS t_ms FROM selections JOIN videos USING (source)",
    "selection_labels": f"WITH {_S} SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY created_at, id, start_ms, end_ms) AS ordinal FROM selections",
    "change_triggered": """WITH RECURSIVE c AS (SELECT user_id AS source, epoch_us(ts) // 1000 AS t, max(value / 500) AS s FROM events GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS i FROM c),
        f AS (SELECT source, i, t AS last, true AS taken FROM n WHERE i = 1
          UNION ALL SELECT n.source, n.i, CASE WHEN n.t - f.last >= 172800000 OR (n.s >= 0.6 AND n.t - f.last >= 3600000) THEN n.t ELSE f.last END,
            n.t - f.last >= 172800000 OR (n.s >= 0.6 AND n.t - f.last >= 3600000) FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1)
        SELECT source, last AS t_ms FROM f WHERE taken""",
}
