"""Queries over source assets: classification, search, order, counts, joins of imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import names
from frameloom.functions.measures import analysis_height, frames_per_second, rate_parts
from frameloom.functions.text import ascii_lower
from frameloom.operators.similarity import first_of
from frameloom.queries import views
from frameloom.sources.tables import read_table


def src_kind_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Extension and kind of every path, and whether the table agrees."""
    rows = read_table(spark, folder, "source_assets").select("absolute_path", "kind").distinct()
    path = F.col("absolute_path")
    return rows.select("absolute_path", names.extension(path).alias("extension"), names.file_kind(path).alias("detected_kind"), (names.file_kind(path) == F.col("kind")).alias("agrees"))


def src_path_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of every path, whatever its case."""
    rows = read_table(spark, folder, "source_assets").withColumn("low_path", ascii_lower(F.col("absolute_path")))
    order = [F.col("imported_at"), F.col("last_checked_at"), F.col("id"), F.col("status")]
    return first_of(rows, ["low_path"], order).select("low_path", "id", "imported_at", "status")


def src_group_identifier(spark: SparkSession, folder: str) -> DataFrame:
    """Group and camera as the relative folder gives them."""
    rel, root = F.col("relative_folder"), F.lit("capture")
    rows = views.assets(spark, folder)
    return rows.select("id", names.group_of(rel, root).alias("derived_group"), names.identifier_of(rel, root).alias("derived_identifier"), names.stem(F.col("file_name")).alias("stem"))


def src_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Assets and those not online, over all."""
    return views.assets(spark, folder).agg(F.count("*").alias("n_sources"), F.count_if(F.col("status") != "online").alias("n_not_online"))


def src_status_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Between which checks an asset's status or error changed."""
    rows = read_table(spark, folder, "source_assets").select("id", "last_checked_at", "status", "error").distinct()
    w = Window.partitionBy("id").orderBy("last_checked_at", "status", F.coalesce("error", F.lit("")))
    seen = rows.withColumn("before", F.lag(F.struct("status", "error")).over(w))
    changed = ~F.col("before").eqNullSafe(F.struct("status", "error"))
    return seen.where(F.col("before").isNotNull() & changed).select("id", "last_checked_at", F.col("before.status").alias("old_status"), F.col("status").alias("new_status"))


def src_fingerprint_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, size and quick fingerprint that several rows share: copies, re-checks and re-imports."""
    keys = ["kind", "size_bytes", "quick_fingerprint"]
    grouped = read_table(spark, folder, "source_assets").groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"))
    return grouped.where("n_rows > 1")


def src_rename_match(spark: SparkSession, folder: str) -> DataFrame:
    """Files online that are, by content, exactly one file that is not: renamed ones. Each is claimed once."""
    keys = ["kind", "size_bytes", "quick_fingerprint"]
    rows = read_table(spark, folder, "source_assets").select(*keys, "status", "id").distinct()
    gone = rows.where("status <> 'online'").groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("existing_id")).where("n = 1")
    incoming = rows.where("status = 'online'").groupBy(*keys).agg(F.min("id").alias("incoming_id"))
    return incoming.join(gone, keys).select("incoming_id", "existing_id")


def src_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of assets in display order: 50 after the first 100."""
    rows = views.assets(spark, folder)
    order = [F.col("source_group"), F.col("source_identifier"), ascii_lower(F.col("file_name")), F.col("id")]
    return rows.orderBy(*order).select("id", "source_group", "source_identifier", "file_name").offset(100).limit(50)


def src_pending_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Online images that have no digest yet."""
    return views.assets(spark, folder).where("kind = 'image' and sha256 is null and status = 'online'").select("id", "absolute_path")


def src_search(spark: SparkSession, folder: str) -> DataFrame:
    """Assets whose file, group or camera holds a text."""
    found = names.contains_text("DOCK", F.col("file_name"), F.col("source_group"), F.col("source_identifier"))
    return views.assets(spark, folder).where(found).select("id", "file_name", "source_group")


def src_options(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct groups and cameras, with how many assets they have."""
    rows = views.assets(spark, folder)
    both = F.explode(F.array(F.struct(F.lit("group").alias("option"), F.col("source_group").alias("value")), F.struct(F.lit("camera").alias("option"), F.col("source_identifier").alias("value")))).alias("o")
    return rows.select(both).groupBy("o.option", "o.value").agg(F.count("*").alias("n_assets"))


def src_frame_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Frames per second and the number of frames of every video."""
    rate = F.col("frame_rate")
    num, den = rate_parts(rate)
    frames = F.round(F.col("duration_ms") * num / (den * 1000.0)).cast("bigint")
    return views.videos(spark, folder).select("source", F.round(frames_per_second(rate), 6).alias("fps"), frames.alias("n_frames"))


def src_analysis_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The size to which each video's frames are scaled for the analysis of changes, and the time of its tenth frame at
    four frames a second."""
    rows = views.assets(spark, folder).where("kind = 'video'")
    return rows.select("id", F.lit(160).alias("width"), analysis_height(F.col("width"), F.col("height")).alias("height"), F.lit(round(9 * 1000 / 4.0)).cast("bigint").alias("tenth_ms"))


def src_playable(spark: SparkSession, folder: str) -> DataFrame:
    """Videos that play as they are, per codec and extension."""
    rows = views.assets(spark, folder).where("kind = 'video'")
    plays = names.plays_directly(F.col("codec"), F.col("absolute_path"))
    return rows.groupBy("codec", names.extension(F.col("absolute_path")).alias("extension"), plays.alias("plays")).agg(F.count("*").alias("n_videos"))


def src_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers in the JSON parameters of candidates, by method."""
    rows = read_table(spark, folder, "candidate_images").select("id", "selection_method", "parameters_json").distinct()
    p = F.from_json("parameters_json", "intervalMs bigint, count bigint, threshold double, minGapMs bigint")
    return rows.withColumn("p", p).groupBy("selection_method").agg(F.count("*").alias("n"), F.count("p.intervalMs").alias("n_interval"), F.sum("p.intervalMs").alias("sum_interval"), F.sum("p.count").alias("sum_count"), F.round(F.avg("p.threshold"), 6).alias("avg_threshold"))


def src_display(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and durations as text."""
    rows = views.assets(spark, folder)
    return rows.select("id", names.size_text(F.col("size_bytes")).alias("size_text"), names.clock_text(F.col("duration_ms")).alias("duration_text"), names.clock_ms(names.clock_text(F.col("duration_ms"))).alias("duration_back"))


QUERIES = {f.__name__: f for f in (src_kind_classifier, src_path_distinct, src_group_identifier, src_status_counts, src_status_changes, src_fingerprint_groups, src_rename_match, src_page, src_pending_hash, src_search, src_options, src_frame_rates, src_analysis_sizes, src_playable, src_parameters, src_display)}

_EXT = r"lower(regexp_extract(absolute_path, '[^/\\]\.([^./\\]*)$', 1))"
_KIND = f"CASE WHEN {_EXT} IN ('jpg','jpeg','png','bmp','tif','tiff','webp') THEN 'image' WHEN {_EXT} IN ('mp4','mov','mkv','avi','webm','m4v','mts','m2ts') THEN 'video' ELSE 'unsupported' END"
_A = f"WITH {views.ASSETS} "

ORACLES = {
    "src_kind_classifier": f"SELECT DISTINCT absolute_path, {_EXT} AS extension, {_KIND} AS detected_kind, {_KIND} = kind AS agrees FROM source_assets",
    "src_path_distinct": """SELECT low_path, id, imported_at, status FROM (SELECT *, lower(absolute_path) AS low_path, row_number() OVER (PARTITION BY lower(absolute_path)
        ORDER BY imported_at, last_checked_at, id, status) AS rn FROM source_assets) WHERE rn = 1""",
    "src_group_identifier": _A + r"""SELECT id, coalesce(nullif(split_part(replace(relative_folder, '\', '/'), '/', 1), ''), 'capture') AS derived_group,
        coalesce(nullif(split_part(replace(relative_folder, '\', '/'), '/', -1), ''), 'capture') AS derived_identifier,
        regexp_replace(file_name, '(.)\.[^./]*$', '\1') AS stem FROM assets""",
    "src_status_counts": _A + "SELECT count(*) AS n_sources, count(*) FILTER (status <> 'online') AS n_not_online FROM assets",
    "src_status_changes": """SELECT id, last_checked_at, old_status, status AS new_status FROM (SELECT *, lag(status) OVER w AS old_status, lag(error) OVER w AS old_error
        FROM (SELECT DISTINCT id, last_checked_at, status, error FROM source_assets) WINDOW w AS (PARTITION BY id ORDER BY last_checked_at, status, coalesce(error, '')))
        WHERE old_status IS NOT NULL AND (old_status <> status OR old_error IS DISTINCT FROM error)""",
    "src_fingerprint_groups": "SELECT kind, size_bytes, quick_fingerprint, count(*) AS n_rows, min(id) AS first_id FROM source_assets GROUP BY ALL HAVING count(*) > 1",
    "src_rename_match": """WITH assets AS (SELECT DISTINCT kind, size_bytes, quick_fingerprint, status, id FROM source_assets) SELECT i.id AS incoming_id, g.id AS existing_id FROM
        (SELECT kind, size_bytes, quick_fingerprint, min(id) AS id FROM assets WHERE status <> 'online' GROUP BY ALL HAVING count(*) = 1) g
        JOIN (SELECT kind, size_bytes, quick_fingerprint, min(id) AS id FROM assets WHERE status = 'online' GROUP BY ALL) i USING (kind, size_bytes, quick_fingerprint)""",
    "src_page": _A + "SELECT id, source_group, source_identifier, file_name FROM assets ORDER BY source_group, source_identifier, lower(file_name), id LIMIT 50 OFFSET 100",
    "src_pending_hash": _A + "SELECT id, absolute_path FROM assets WHERE kind = 'image' AND sha256 IS NULL AND status = 'online'",
    "src_search": _A + "SELECT id, file_name, source_group FROM assets WHERE contains(lower(concat_ws(' ', file_name, source_group, source_identifier)), 'dock')",
    "src_options": _A + "SELECT 'group' AS option, source_group AS value, count(*) AS n_assets FROM assets GROUP BY ALL UNION ALL SELECT 'camera', source_identifier, count(*) FROM assets GROUP BY ALL",
    "src_frame_rates": f"""WITH {views.VIDEOS}, r AS (SELECT *, split_part(frame_rate, '/', 1)::BIGINT AS num, split_part(frame_rate, '/', 2)::BIGINT AS den FROM videos)
        SELECT source, CASE WHEN num > 0 AND den > 0 THEN round(num / den, 6) END AS fps,
        CASE WHEN num > 0 AND den > 0 THEN round(duration_ms * num / (den * 1000.0))::BIGINT END AS n_frames FROM r""",
    "src_analysis_sizes": _A + """SELECT id, 160 AS width, CASE WHEN width > 0 AND height > 0 THEN greatest(round(height * 160.0 / width)::INT, 2) + greatest(round(height * 160.0 / width)::INT, 2) % 2 END AS height,
        2250::BIGINT AS tenth_ms FROM assets WHERE kind = 'video'""",
    "src_playable": _A + f"""SELECT codec, {_EXT} AS extension, coalesce((codec = 'h264' AND {_EXT} IN ('mp4','m4v','mov')) OR (codec = 'av1' AND {_EXT} IN ('mp4','webm'))
        OR (codec IN ('vp8','vp9') AND {_EXT} = 'webm'), false) AS plays, count(*) AS n_videos FROM assets WHERE kind = 'video' GROUP BY ALL""",
    "src_parameters": """SELECT selection_method, count(*) AS n, count(i) AS n_interval, sum(i)::BIGINT AS sum_interval, sum(c)::BIGINT AS sum_count, round(avg(t), 6) AS avg_threshold FROM (
        SELECT selection_method, (parameters_json->>'intervalMs')::BIGINT AS i, (parameters_json->>'count')::BIGINT AS c, (parameters_json->>'threshold')::DOUBLE AS t
        FROM (SELECT DISTINCT id, selection_method, parameters_json FROM candidate_images)) GROUP BY ALL""",
    "src_display": _A + """SELECT id, CASE WHEN size_bytes < 1024 THEN printf('%d B', size_bytes) WHEN size_bytes < 1048576 THEN printf('%.1f KB', round(size_bytes / 1024.0, 1))
        WHEN size_bytes < 1073741824 THEN printf('%.1f MB', round(size_bytes / 1048576.0, 1)) ELSE printf('%.1f GB', size_bytes / 1073741824.0) END AS size_text,
        CASE WHEN duration_ms IS NOT NULL THEN printf('%02d:%02d:%02d.%03d', duration_ms // 3600000, duration_ms // 60000 % 60, duration_ms // 1000 % 60, duration_ms % 1000) END AS duration_text,
        duration_ms AS duration_back FROM assets""",
}
