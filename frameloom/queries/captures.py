"""Queries that carry sampling plans out: dispatch by mode, chosen ranges, custom times, and the candidates they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.measures import rate_parts
from frameloom.operators import store
from frameloom.operators.ranges import contained_in
from frameloom.plans import sampling
from frameloom.queries import views
from frameloom.queries.sampling import COUNT, EVERY, RANGE_STEP_MS, STEP_MS

# The modes of sampling, here given to videos by the last digit of their id.
MODES = ("fixed_interval", "frame_interval", "target_count", "valid_ranges", "change_triggered")


def _mode() -> Column:
    return F.array(*map(F.lit, MODES))[(F.conv(F.substring("source", -1, 1), 16, 10).cast("int") % len(MODES))]


def online_videos(spark: SparkSession, folder: str) -> DataFrame:
    """The videos that may be sampled, and why others may not."""
    rows = views.assets(spark, folder).select(F.col("id").alias("source"), "kind", "status", "duration_ms")
    reason = F.when(F.col("kind") != "video", "no video").when(F.col("status") != "online", "not online").when(F.coalesce("duration_ms", F.lit(0)) <= 0, "no frames")
    return rows.select("source", reason.isNull().alias("accepted"), reason.alias("reason"))


def plan_chosen_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A frame every 5 seconds of the chosen selections of a source (here those whose id begins with a digit); a source
    for which none is chosen takes all of its own."""
    rows = views.selections(spark, folder)
    chosen = rows.where(F.substring("id", 1, 1) < "a").select("id").distinct()
    picked = rows.join(chosen, "id", "left_semi")
    others = rows.join(picked.select("source").distinct(), "source", "left_anti")
    kept = picked.unionByName(others)
    counted = sampling.explode_counted(kept, F.ceil((F.col("end_ms") - F.col("start_ms")) / RANGE_STEP_MS))
    return counted.select("source", (F.col("start_ms") + F.col("i") * RANGE_STEP_MS).alias("t_ms")).distinct()


def plan_custom_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times that the caller gives (here the ends of selections), as they are: without regard to the duration, each once."""
    return views.selections(spark, folder).select("source", F.col("end_ms").alias("t_ms")).distinct()


def _plans(spark: SparkSession, folder: str) -> DataFrame:
    """Every online video's plan by its own mode: (source, mode, t_ms, frame)."""
    videos = views.videos(spark, folder).where("status = 'online' and duration_ms > 0").withColumn("mode", _mode())
    of = lambda mode: videos.where(F.col("mode") == mode)
    none = F.lit(None).cast("bigint").alias("frame")
    num, den = rate_parts(F.col("frame_rate"))
    fixed = sampling.explode_counted(of("fixed_interval"), F.ceil(F.col("duration_ms") / STEP_MS)).select("source", "mode", (F.col("i") * STEP_MS).alias("t_ms"), none)
    rated = of("frame_interval").withColumns({"num": num, "den": den})
    framed = sampling.explode_counted(rated, sampling.frame_counts(F.col("duration_ms"), F.col("frame_rate"), EVERY)).select(
        "source", "mode", sampling.frame_at(F.col("num"), F.col("den"), F.col("i"), EVERY).alias("t_ms"), (F.col("i") * EVERY).alias("frame")
    )
    counted = of("target_count").select("source", "mode", F.explode(sampling.target_count(F.col("duration_ms"), COUNT)).alias("t_ms"), none)
    ranged = of("valid_ranges").select("source", "mode").join(plan_chosen_ranges(spark, folder), "source").select("source", "mode", "t_ms", none)
    custom = of("change_triggered").select("source", "mode").join(plan_custom_times(spark, folder), "source").select("source", "mode", "t_ms", none)
    every = fixed.unionByName(framed).unionByName(counted).unionByName(ranged).unionByName(custom)
    return every.groupBy("source", "mode", "t_ms").agg(F.min("frame").alias("frame"))


def plan_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The plan of every online video by its own mode."""
    return _plans(spark, folder)


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    planned = _plans(spark, folder)
    ranges = views.selections(spark, folder).where("protected").select("source", "start_ms", "end_ms")
    pinned = contained_in(planned, ranges, "source", "t_ms", "start_ms", "end_ms", "wants_pin")
    there = views.candidates(spark, folder).groupBy("source", F.col("video_offset_ms").alias("t_ms")).agg(F.bool_or("pinned").alias("was_pinned"))
    hits = sampling.nearest_within(pinned, there.select("source", "t_ms"), "source", "t_ms")
    return hits.join(there.select("source", F.col("t_ms").alias("nearest"), "was_pinned"), ["source", "nearest"], "left")


def candidates_made(spark: SparkSession, folder: str) -> DataFrame:
    """What carrying the plans out makes: a new candidate with its frame number and pin, or an existing one within a
    millisecond, pinned where the plan wants it and it wasn't."""
    outcome = F.when(F.col("nearest").isNull(), "created").when(F.col("wants_pin") & ~F.col("was_pinned"), "pinned").otherwise("existing")
    rows = _outcomes(spark, folder)
    return rows.select("source", "mode", "t_ms", "frame", F.coalesce("nearest", "t_ms").alias("video_offset_ms"), (F.col("wants_pin") | F.coalesce("was_pinned", F.lit(False))).alias("pinned"), outcome.alias("outcome"))


def sampling_results(spark: SparkSession, folder: str) -> DataFrame:
    """Planned, created and existing frames of every mode, over all its sources."""
    rows = candidates_made(spark, folder)
    return rows.groupBy("mode").agg(
        F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_planned"), F.count_if(F.col("outcome") == "created").alias("n_created"), F.count_if(F.col("outcome") != "created").alias("n_existing")
    )


def manual_capture_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Captures by hand (here at the ends of selections, held under the duration) put into the candidates: pinned; one
    within a millisecond of an existing candidate pins that."""
    ends = views.selections(spark, folder).select("source", "end_ms").distinct().join(views.videos(spark, folder), "source")
    asked = ends.select("source", F.greatest(F.lit(0), F.least("end_ms", F.col("duration_ms") - 1)).alias("t_ms")).distinct()
    there = views.candidates(spark, folder).groupBy("source", "video_offset_ms").agg(F.bool_or("pinned").alias("pinned"))
    near = sampling.nearest_within(asked, there.select("source", F.col("video_offset_ms").alias("t_ms")), "source", "t_ms")
    new = near.select("source", F.coalesce("nearest", "t_ms").alias("video_offset_ms"), F.lit(True).alias("pinned")).distinct()
    return store.upsert(there, new, ["source", "video_offset_ms"], {"pinned": store.GREATEST})


QUERIES = {f.__name__: f for f in (online_videos, plan_chosen_ranges, plan_custom_times, plan_by_mode, candidates_made, sampling_results, manual_capture_upsert)}

_V = f"{views.VIDEOS}, {views.SELECTIONS}, {views.CANDIDATES}"
_CHOSEN = f"""chosen AS (SELECT DISTINCT source, unnest(generate_series(start_ms, end_ms - 1, {RANGE_STEP_MS})) AS t_ms FROM selections s
  WHERE left(id, 1) < 'a' OR NOT EXISTS (SELECT 1 FROM selections o WHERE o.source = s.source AND left(o.id, 1) < 'a'))"""
_PLAN = f"""WITH {_V}, {_CHOSEN}, v AS (SELECT *, {list(MODES)}[('0x' || right(source, 1))::INT % {len(MODES)} + 1] AS mode, split_part(frame_rate, '/', 1)::HUGEINT AS num, coalesce(nullif(split_part(frame_rate, '/', 2), ''), '1')::HUGEINT AS den
    FROM videos WHERE status = 'online' AND duration_ms > 0),
  f AS (SELECT *, unnest(generate_series(0, (duration_ms * num // (den * 1000 * {EVERY}))::BIGINT + 1)) AS i FROM v WHERE mode = 'frame_interval' AND num > 0 AND den > 0),
  plan AS (SELECT source, mode, unnest(generate_series(0, duration_ms - 1, {STEP_MS})) AS t_ms, NULL::BIGINT AS frame FROM v WHERE mode = 'fixed_interval'
    UNION ALL SELECT source, mode, ((i * {EVERY} * den * 1000 + num // 2) // num)::BIGINT AS t, min(i * {EVERY})::BIGINT FROM f WHERE (i * {EVERY} * den * 1000 + num // 2) // num < duration_ms GROUP BY ALL
    UNION ALL SELECT DISTINCT source, mode, i * (duration_ms - 1) // {COUNT - 1}, NULL::BIGINT FROM v, generate_series(0, {COUNT - 1}) g(i) WHERE mode = 'target_count'
    UNION ALL SELECT source, mode, t_ms, NULL::BIGINT FROM v JOIN chosen USING (source) WHERE mode = 'valid_ranges'
    UNION ALL SELECT DISTINCT source, mode, end_ms, NULL::BIGINT FROM v JOIN selections USING (source) WHERE mode = 'change_triggered'),
  there AS (SELECT source, video_offset_ms AS c, bool_or(pinned) AS was FROM candidates GROUP BY ALL),
  hit AS (SELECT p.source, mode, t_ms, frame, arg_min(c, (abs(c - t_ms), c)) AS nearest FROM plan p LEFT JOIN there t ON t.source = p.source AND t.c IN (t_ms - 1, t_ms, t_ms + 1) GROUP BY ALL),
  made AS (SELECT h.*, coalesce(was, false) AS was, EXISTS (SELECT 1 FROM selections s WHERE s.protected AND s.source = h.source AND s.start_ms <= t_ms AND t_ms < s.end_ms) AS wants FROM hit h LEFT JOIN there t ON t.source = h.source AND t.c = h.nearest),
  outcomes AS (SELECT source, mode, t_ms, frame, coalesce(nearest, t_ms) AS video_offset_ms, wants OR was AS pinned, CASE WHEN nearest IS NULL THEN 'created' WHEN wants AND NOT was THEN 'pinned' ELSE 'existing' END AS outcome FROM made)"""

ORACLES = {
    "online_videos": f"""WITH {views.ASSETS}, r AS (SELECT id AS source, CASE WHEN kind <> 'video' THEN 'no video' WHEN status <> 'online' THEN 'not online' WHEN coalesce(duration_ms, 0) <= 0 THEN 'no frames' END AS reason FROM assets)
        SELECT source, reason IS NULL AS accepted, reason FROM r""",
    "plan_chosen_ranges": f"WITH {_V}, {_CHOSEN} SELECT source, t_ms FROM chosen",
    "plan_custom_times": f"WITH {_V} SELECT DISTINCT source, end_ms AS t_ms FROM selections",
    "plan_by_mode": _PLAN + " SELECT source, mode, t_ms, frame FROM plan",
    "candidates_made": _PLAN + " SELECT * FROM outcomes",
    "sampling_results": _PLAN + " SELECT mode, count(DISTINCT source) AS n_sources, count(*) AS n_planned, count(*) FILTER (outcome = 'created') AS n_created, count(*) FILTER (outcome <> 'created') AS n_existing FROM outcomes GROUP BY mode",
    "manual_capture_upsert": f"""WITH {_V}, asked AS (SELECT DISTINCT source, greatest(0, least(end_ms, duration_ms - 1)) AS t FROM selections JOIN videos USING (source)),
        there AS (SELECT source, video_offset_ms AS c, bool_or(pinned) AS p FROM candidates GROUP BY ALL),
        n AS (SELECT DISTINCT source, coalesce((SELECT arg_min(c, (abs(c - t), c)) FROM there x WHERE x.source = a.source AND abs(c - t) <= 1), t) AS c FROM asked a)
        SELECT coalesce(t.source, n.source) AS source, coalesce(t.c, n.c) AS video_offset_ms, n.c IS NOT NULL OR p AS pinned, t.c IS NOT NULL AS existed FROM there t FULL JOIN n ON n.source = t.source AND n.c = t.c""",
}
