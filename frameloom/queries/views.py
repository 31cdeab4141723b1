"""Views of the project's tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import plain_key
from frameloom.operators.similarity import first_of
from frameloom.sources.tables import read_table


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """The current state of every asset: its newest check; exact copies and older re-checks are gone."""
    order = [F.desc("last_checked_at"), F.desc("imported_at"), F.col("absolute_path"), F.col("status"), F.coalesce("error", F.lit(""))]
    return first_of(read_table(spark, folder, "source_assets"), ["id"], order)


ASSETS = """assets AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY last_checked_at DESC, imported_at DESC, absolute_path, status, coalesce(error, '')) AS rn FROM source_assets) WHERE rn = 1)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate frames without exact copies, with the plain form of their source."""
    columns = ["id", "source_id", "video_offset_ms", "source_frame_number", "selection_method", "pinned", "width", "height", "image_path", "created_at"]
    rows = read_table(spark, folder, "candidate_images").select(*columns).distinct()
    return rows.withColumn("source", plain_key(F.col("source_id"))).where("source is not null")


def candidate_times(spark: SparkSession, folder: str) -> DataFrame:
    """(source, t_ms) of every candidate, copies included: for what takes distinct times, so that no whole rows are compared."""
    rows = read_table(spark, folder, "candidate_images").select(plain_key(F.col("source_id")).alias("source"), F.col("video_offset_ms").alias("t_ms"))
    return rows.where("source is not null")


_BLANK = r"'^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$'"
PLAIN = f"nullif(lower(regexp_replace(source_id, {_BLANK}, '', 'g')), '')"
CANDIDATES = f"""candidates AS (
  SELECT * FROM (SELECT DISTINCT id, source_id, video_offset_ms, source_frame_number, selection_method, pinned, width, height, image_path, created_at,
    {PLAIN} AS source FROM candidate_images) WHERE source IS NOT NULL)"""


def selections(spark: SparkSession, folder: str) -> DataFrame:
    """The selections that describe an interval of a source, without exact copies."""
    rows = read_table(spark, folder, "video_selections").select("id", "source_id", "start_ms", "end_ms", "protected", "created_at").distinct()
    return rows.withColumn("source", plain_key(F.col("source_id"))).where("source is not null and start_ms >= 0 and end_ms > start_ms")


SELECTIONS = f"""selections AS (
  SELECT * FROM (SELECT DISTINCT id, source_id, start_ms, end_ms, protected, created_at, {PLAIN} AS source FROM video_selections)
  WHERE source IS NOT NULL AND start_ms >= 0 AND end_ms > start_ms)"""


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """The current videos with a duration."""
    return assets(spark, folder).where("kind = 'video' and duration_ms is not null").select(F.col("id").alias("source"), "source_group", "status", "duration_ms", "frame_rate")


VIDEOS = ASSETS + ", videos AS (SELECT id AS source, source_group, status, duration_ms, frame_rate FROM assets WHERE kind = 'video' AND duration_ms IS NOT NULL)"


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The newest readable analysis of every asset."""
    rows = read_table(spark, folder, "review_inputs").where("decode_error is null and asset_key is not null")
    order = [F.desc("analyzed_at"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("content_sha256", "perceptual_hash", "sharpness", "entropy", "pinned")]]
    return first_of(rows, ["asset_key"], order)


def sound(column: str) -> F.Column:
    """A measure that is one: null for NaN and negative numbers."""
    return F.when(~F.isnan(column) & (F.col(column) >= 0), F.col(column))


METRICS = """metrics AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY analyzed_at DESC, coalesce(content_sha256, ''),
    coalesce(perceptual_hash, ''), coalesce(sharpness::VARCHAR, ''), coalesce(entropy::VARCHAR, ''), coalesce(pinned::VARCHAR, '')) AS rn
    FROM review_inputs WHERE decode_error IS NULL AND asset_key IS NOT NULL) WHERE rn = 1)"""


def sound_sql(column: str) -> str:
    return f"CASE WHEN NOT isnan({column}) AND {column} >= 0 THEN {column} END"
