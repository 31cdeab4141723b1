"""Queries that assemble the review table: items with names, status, order and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.names import clock_text
from frameloom.queries import quality, views
from frameloom.sources.tables import read_table

SEPARATOR = " · "


def _items(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.metrics(spark, folder).withColumn("n_reasons", F.size(quality.reasons()))
    rows = rows.select("asset_key", F.lower(F.btrim("source_id")).alias("source"), "candidate_id", "video_offset_ms", "pinned", "n_reasons")
    sources = views.assets(spark, folder).select(F.lower("id").alias("source"), "source_group", "source_identifier", "file_name", "absolute_path")
    frames = views.candidates(spark, folder).groupBy("id").agg(F.min("image_path").alias("frame_path"), F.min("selection_method").alias("selection_method"))
    # The source is an inner join: an item whose source is gone has nothing to show.
    return rows.join(sources, "source").join(frames, F.col("candidate_id") == F.col("id"), "left")


def review_workspace(spark: SparkSession, folder: str) -> DataFrame:
    """Every analysed asset with its source and candidate: display name, picture and how it was chosen."""
    at = F.when(F.col("video_offset_ms").isNotNull(), F.concat(F.lit(SEPARATOR), clock_text(F.col("video_offset_ms"))))
    return _items(spark, folder).select(
        "asset_key", "source_group", F.concat("file_name", F.coalesce(at, F.lit(""))).alias("display_name"), F.coalesce("frame_path", "absolute_path").alias("image_path"),
        F.coalesce("selection_method", F.lit("source_image")).alias("selection_method"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )


def review_thumbnails(spark: SparkSession, folder: str) -> DataFrame:
    """The small picture of every analysed asset: the candidate's, else the source's, else the source itself."""
    small = read_table(spark, folder, "candidate_images").groupBy(F.col("id").alias("candidate_id")).agg(F.min("thumbnail_path").alias("candidate_thumbnail"))
    own = views.assets(spark, folder).select(F.lower("id").alias("source"), "thumbnail_path")
    rows = _items(spark, folder).select("asset_key", "source", "candidate_id", "absolute_path").join(small, "candidate_id", "left").join(own, "source")
    return rows.select("asset_key", F.coalesce("candidate_thumbnail", "thumbnail_path", "absolute_path").alias("thumbnail"))


def review_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 items in review order: group, camera, time with images first, key."""
    order = [F.col("source_group"), F.col("source_identifier"), F.asc_nulls_first("video_offset_ms"), F.col("asset_key")]
    return _items(spark, folder).orderBy(*order).limit(100).select("asset_key", "source_group", "source_identifier", "video_offset_ms")


def review_status(spark: SparkSession, folder: str) -> DataFrame:
    """What the measures suggest for every asset; one that was never read comes out as error."""
    measured = views.metrics(spark, folder).select("asset_key", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.size(quality.reasons()).alias("n"))
    every = read_table(spark, folder, "review_inputs").where("asset_key is not null").select("asset_key").distinct()
    status = F.when(F.col("n").isNull(), "error").when(F.col("n") == 0, "keep").when(F.col("pinned"), "warning").otherwise("suggest_exclude")
    return every.join(measured, "asset_key", "left").select("asset_key", status.alias("status"))


def review_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The number of assets of each status, in one pass."""
    counts = {"n_keep": "keep", "n_suggested": "suggest_exclude", "n_warning": "warning", "n_failed": "error"}
    rows = review_status(spark, folder)
    return rows.agg(F.count("*").alias("n_total"), *[F.count_if(F.col("status") == v).alias(k) for k, v in counts.items()])


def review_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Items of one status in the groups of a name, per group."""
    items = _items(spark, folder).select("asset_key", "source_group").join(review_status(spark, folder), "asset_key")
    kept = items.where((F.col("status") != "keep") & F.lower("source_group").contains("o"))
    return kept.groupBy("source_group", "status").agg(F.count("*").alias("n_items"))


QUERIES = {f.__name__: f for f in (review_workspace, review_thumbnails, review_page, review_status, review_summary, review_filtered)}

_I = f"""WITH {views.ASSETS}, {views.METRICS}, {views.CANDIDATES}, f AS (SELECT id, min(image_path) AS frame_path, min(selection_method) AS selection_method FROM candidates GROUP BY id),
  i AS (SELECT m.asset_key, a.source_group, a.source_identifier, a.file_name, a.absolute_path, m.video_offset_ms, m.pinned, f.frame_path, f.selection_method
    FROM metrics m JOIN assets a ON lower(a.id) = lower(trim(m.source_id)) LEFT JOIN f ON f.id = m.candidate_id),
  st AS (SELECT k.asset_key, CASE WHEN m.asset_key IS NULL THEN 'error' WHEN len({quality._REASONS}) = 0 THEN 'keep' WHEN coalesce(pinned, false) THEN 'warning' ELSE 'suggest_exclude' END AS status
    FROM (SELECT DISTINCT asset_key FROM review_inputs WHERE asset_key IS NOT NULL) k LEFT JOIN metrics m USING (asset_key))"""
ORACLES = {
    "review_workspace": _I + """ SELECT asset_key, source_group, file_name || CASE WHEN video_offset_ms IS NULL THEN '' ELSE printf(' · %02d:%02d:%02d.%03d', video_offset_ms // 3600000, video_offset_ms // 60000 % 60, video_offset_ms // 1000 % 60, video_offset_ms % 1000) END AS display_name,
        coalesce(frame_path, absolute_path) AS image_path, coalesce(selection_method, 'source_image') AS selection_method, coalesce(pinned, false) AS pinned FROM i""",
    "review_thumbnails": f"""WITH {views.ASSETS}, {views.METRICS}, c AS (SELECT id, min(thumbnail_path) AS t FROM candidate_images GROUP BY id)
        SELECT asset_key, coalesce(t, thumbnail_path, absolute_path) AS thumbnail FROM metrics m JOIN assets a ON lower(a.id) = lower(trim(m.source_id)) LEFT JOIN c ON c.id = m.candidate_id""",
    "review_page": _I + " SELECT asset_key, source_group, source_identifier, video_offset_ms FROM i ORDER BY source_group, source_identifier, video_offset_ms NULLS FIRST, asset_key LIMIT 100",
    "review_status": _I + " SELECT asset_key, status FROM st",
    "review_summary": _I + " SELECT count(*) AS n_total, count(*) FILTER (status = 'keep') AS n_keep, count(*) FILTER (status = 'suggest_exclude') AS n_suggested, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'error') AS n_failed FROM st",
    "review_filtered": _I + " SELECT source_group, status, count(*) AS n_items FROM i JOIN st USING (asset_key) WHERE status <> 'keep' AND contains(lower(source_group), 'o') GROUP BY ALL",
}
