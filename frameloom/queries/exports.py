"""Queries that plan exports: inputs, names, conflicts, totals and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.hashing import item_hash, little_endian
from frameloom.functions.names import sanitized_stem, stem
from frameloom.plans.export import file_names, manifest, render_template
from frameloom.plans.tiles import plan_tiles
from frameloom.queries import tiles, views

TEMPLATE = "{source}_{timestamp_ms}_{roi}_{row}x{col}_{width}-{height}"


_INPUT = ["source_id", "candidate_id", "video_offset_ms"]


def _images(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.assets(spark, folder).where("kind = 'image' and status = 'online'")
    return rows.select(F.col("id").alias("source_id"), F.lit(None).cast("string").alias("candidate_id"), F.lit(None).cast("bigint").alias("video_offset_ms"), "width", "height")


def export_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """What an export reads: every image as it is, every candidate of a video."""
    rows = views.assets(spark, folder).where("status = 'online'")
    frames = views.candidates(spark, folder).select("source", F.col("id").alias("candidate_id"), "video_offset_ms", "width", "height").dropDuplicates(["source", "candidate_id"])
    of_videos = rows.where("kind = 'video'").select(F.col("id").alias("source_id"), F.lower("id").alias("source")).join(frames, "source")
    return _images(spark, folder).unionByName(of_videos.drop("source"))


def _tiles(spark: SparkSession, folder: str, inputs: DataFrame) -> DataFrame:
    """The tiles of inputs by the profiles that hold for their source, placed inside the picture."""
    names = ["x", "y", "width", "height", "tile_width", "tile_height", "overlap_x", "overlap_y", "edge_strategy"]
    shapes = tiles.profiles(spark, folder).select(F.col("id").alias("profile_id"), "name", *names).dropDuplicates(["profile_id"])
    holds = tiles.roi_effective_profiles(spark, folder).select("source_id", "profile_id")
    sized = inputs.withColumnsRenamed({"width": "w", "height": "h"})
    fitting = sized.join(holds, "source_id").join(shapes, "profile_id").where("x + width <= w and y + height <= h")
    return plan_tiles(fitting).select(*_INPUT, "profile_id", "name", "tile_row", "tile_column", "source_x", "source_y", "source_width", "source_height", "tile_width", "tile_height", "padded")


def export_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of every image by the profile that holds for it, placed inside the picture."""
    return _tiles(spark, folder, _images(spark, folder)).drop("candidate_id", "video_offset_ms")


def export_tiles_all(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of every image and of every candidate of a video."""
    return _tiles(spark, folder, export_inputs(spark, folder))


def export_index(spark: SparkSession, folder: str) -> DataFrame:
    """The running number of every tile of an image within its profile, from 1, by source, row and column."""
    w = Window.partitionBy("profile_id").orderBy("source_id", "tile_row", "tile_column")
    return export_tiles(spark, folder).select("profile_id", "source_id", "tile_row", "tile_column", F.row_number().over(w).alias("export_index"))


def export_index_all(spark: SparkSession, folder: str) -> DataFrame:
    """The running number of every tile within its profile, from 1, by source, time, candidate, row and column."""
    w = Window.partitionBy("profile_id").orderBy("source_id", "video_offset_ms", "candidate_id", "tile_row", "tile_column")
    return export_tiles_all(spark, folder).select("profile_id", *_INPUT, "tile_row", "tile_column", F.row_number().over(w).alias("export_index"))


def _totals(rows: DataFrame) -> DataFrame:
    size = F.col("tile_width").cast("bigint") * F.col("tile_height") * 3
    return rows.groupBy("profile_id").agg(F.count("*").alias("n_items"), F.sum(size).alias("estimated_bytes"))


def export_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Items and estimated bytes per profile, of images."""
    return _totals(export_tiles(spark, folder))


def export_totals_all(spark: SparkSession, folder: str) -> DataFrame:
    """Items and estimated bytes per profile, of images and candidates."""
    return _totals(export_tiles_all(spark, folder))


def _rendered(spark: SparkSession, folder: str, rows: DataFrame, time: Column, keys: list[str]) -> DataFrame:
    files = views.assets(spark, folder).select(F.col("id").alias("source_id"), "file_name", "source_group", "source_identifier")
    fields = {
        "source": stem(F.col("file_name")), "source_group": F.col("source_group"), "source_identifier": F.col("source_identifier"), "timestamp_ms": time,
        "roi": F.col("name"), "row": F.col("tile_row") + 1, "col": F.col("tile_column") + 1, "width": F.col("tile_width"), "height": F.col("tile_height"), "index": F.lit(1),
    }
    name = render_template(TEMPLATE, fields)
    return rows.join(files, "source_id").select(*keys, "profile_id", "tile_row", "tile_column", name.alias("raw_name"), sanitized_stem(name).alias("safe_name"))


def render_names(spark: SparkSession, folder: str) -> DataFrame:
    """The name that a template gives to every tile of an image, and its sanitized form."""
    return _rendered(spark, folder, export_tiles(spark, folder), F.lit(0), ["source_id"])


def render_names_all(spark: SparkSession, folder: str) -> DataFrame:
    """The name that a template gives to every tile, with the time of its candidate, and its sanitized form."""
    return _rendered(spark, folder, export_tiles_all(spark, folder), F.coalesce("video_offset_ms", F.lit(0)), _INPUT)


def sanitize_names(spark: SparkSession, folder: str) -> DataFrame:
    """Profile and group names made fit for file systems."""
    rows = tiles.profiles(spark, folder).select(F.col("id").alias("profile_id"), F.concat_ws(": ", "name", F.lit("CON."), "scope_value").alias("text"))
    return rows.select("profile_id", "text", sanitized_stem(F.col("text")).alias("safe"))


def name_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """File names of the candidates by source only, numbered where they meet."""
    rows = views.candidates(spark, folder).select("id", F.col("source").alias("stem")).dropDuplicates(["id"])
    occupied = rows.groupBy("stem").agg(F.max("id").alias("last")).where("last >= 'c'").select(F.concat(F.upper("stem"), F.lit(".JPG")).alias("name"))
    return file_names(rows, "stem", ".JPG", "id", occupied).select("id", "file_name")


def item_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of every export item of images."""
    rows = export_index(spark, folder)
    none = F.lit(None).cast("string")
    return rows.select("profile_id", "export_index", item_hash(F.col("source_id"), none, "tiles", F.col("profile_id"), F.col("tile_row"), F.col("tile_column"), F.col("export_index")).alias("item_hash"))


def item_hashes_all(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of every export item of images and candidates."""
    rows = export_index_all(spark, folder)
    digest = item_hash(F.col("source_id"), F.col("candidate_id"), "tiles", F.col("profile_id"), F.col("tile_row"), F.col("tile_column"), F.col("export_index"))
    return rows.select("profile_id", "export_index", *_INPUT, digest.alias("item_hash"))


def size_bytes_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of every asset's size written as eight bytes, lowest first."""
    return views.assets(spark, folder).select("id", F.sha2(little_endian(F.col("size_bytes")), 256).alias("size_digest"))


def manifest_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the tile export of images, one JSON document per file."""
    none = F.lit(None).cast("string")
    items = export_tiles(spark, folder).withColumnRenamed("profile_id", "roi_profile_id").withColumn("candidate_id", none).withColumn("video_offset_ms", none.cast("bigint"))
    name = F.format_string("%s-%s-r%04d-c%04d.png", "source_id", "roi_profile_id", "tile_row", "tile_column")
    return manifest(items.withColumn("file_name", name), "export-1")


def manifest_lines_all(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the tile export of images and candidates; a candidate's id stands in its file names."""
    tile = F.format_string("-r%04d-c%04d.png", "tile_row", "tile_column")
    name = F.concat(F.concat_ws("-", "source_id", "candidate_id", "profile_id"), tile)
    items = export_tiles_all(spark, folder).withColumn("file_name", name).withColumnRenamed("profile_id", "roi_profile_id")
    return manifest(items, "export-1")


QUERIES = {f.__name__: f for f in (export_inputs, export_tiles, export_index, export_totals, render_names, sanitize_names, name_conflicts, item_hashes, size_bytes_hash, manifest_lines)}
QUERIES |= {f.__name__: f for f in (export_tiles_all, export_index_all, export_totals_all, render_names_all, item_hashes_all, manifest_lines_all)}

_EFFECTIVE = tiles.ORACLES["roi_effective_profiles"]
_T = f"""WITH eff AS ({_EFFECTIVE}), {tiles._tiles('edge_strategy')}, {views.ASSETS},
  t AS (SELECT eff.source_id, profile_id, name, tile_row, tile_column, source_x::INT AS source_x, source_y::INT AS source_y, source_width::INT AS source_width, source_height::INT AS source_height, tile_width, tile_height,
    source_width < tile_width OR source_height < tile_height AS padded FROM eff JOIN tiles USING (profile_id) JOIN assets a ON a.id = eff.source_id
    WHERE a.kind = 'image' AND a.status = 'online' AND x + tiles.width <= a.width AND y + tiles.height <= a.height),
  ti AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY source_id, tile_row, tile_column) AS export_index FROM t)"""


def _safe(text: str) -> str:
    clean = rf"""regexp_replace(trim(regexp_replace({text}, '[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', '_', 'g')), '[. ]+$', '')"""
    return rf"""nullif(CASE WHEN regexp_full_match(upper(split_part({clean}, '.', 1)), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN '_' ELSE '' END || {clean}, '')"""


_RAW = r"regexp_replace(file_name, '(.)\.[^./]*$', '\1') || '_0_' || name || '_' || (tile_row + 1) || 'x' || (tile_column + 1) || '_' || tile_width || '-' || tile_height"


def _le(value: str, width: int) -> str:
    """A number as hexadecimal text of so many bytes, the lowest first."""
    return " || ".join(f"printf('%02x', ({value} >> {8 * i}) & 255)" for i in range(width))


ORACLES = {
    "export_inputs": f"""WITH {views.ASSETS}, {views.CANDIDATES} SELECT id AS source_id, NULL::VARCHAR AS candidate_id, NULL::BIGINT AS video_offset_ms, width, height FROM assets WHERE kind = 'image' AND status = 'online'
        UNION ALL SELECT a.id, c.id, any_value(c.video_offset_ms), any_value(c.width), any_value(c.height) FROM assets a JOIN candidates c ON lower(a.id) = c.source WHERE a.kind = 'video' AND a.status = 'online' GROUP BY a.id, c.id""",
    "export_tiles": _T + " SELECT * FROM t",
    "export_index": _T + " SELECT profile_id, source_id, tile_row, tile_column, export_index FROM ti",
    "export_totals": _T + " SELECT profile_id, count(*) AS n_items, sum(tile_width::BIGINT * tile_height * 3)::BIGINT AS estimated_bytes FROM t GROUP BY profile_id",
    "render_names": _T + f", n AS (SELECT source_id, profile_id, tile_row, tile_column, {_RAW} AS raw_name FROM t JOIN assets a ON a.id = t.source_id) SELECT *, {_safe('raw_name')} AS safe_name FROM n",
    "sanitize_names": f"WITH {tiles._PROFILES}, n AS (SELECT profile_id, concat_ws(': ', name, 'CON.', scope_value) AS text FROM profiles) SELECT profile_id, text, {_safe('text')} AS safe FROM n",
    "name_conflicts": f"""WITH {views.CANDIDATES}, r AS (SELECT DISTINCT id, replace(source, ':', '_') AS source, contains(source, ':') AS odd FROM candidates),
        o AS (SELECT source, max(id) >= 'c' AND NOT bool_or(odd) AS taken FROM r GROUP BY source),
        n AS (SELECT r.id, source, row_number() OVER (PARTITION BY source ORDER BY r.id) + CASE WHEN taken THEN 1 ELSE 0 END AS n FROM r JOIN o USING (source))
        SELECT id, CASE WHEN n = 1 THEN source || '.jpg' ELSE source || '_' || printf('%04d', n) || '.jpg' END AS file_name FROM n""",
    "item_hashes": _T + f""" SELECT profile_id, export_index, sha256(encode(source_id || 'source' || 'tiles' || profile_id) || unhex({_le('tile_row', 4)} || {_le('tile_column', 4)} || {_le('export_index', 8)})) AS item_hash FROM ti""",
    "size_bytes_hash": f"WITH {views.ASSETS} SELECT id, sha256(unhex({_le('size_bytes', 8)})) AS size_digest FROM assets",
    "manifest_lines": _T + """ SELECT source_id || '-' || profile_id || printf('-r%04d-c%04d.png', tile_row, tile_column) AS file_name,
        to_json({'schemaVersion': 1, 'exportId': 'export-1', 'fileName': source_id || '-' || profile_id || printf('-r%04d-c%04d.png', tile_row, tile_column), 'sourceId': source_id, 'candidateId': NULL, 'videoOffsetMs': NULL,
          'roiProfileId': profile_id, 'tile': {'tile_row': tile_row, 'tile_column': tile_column, 'source_x': source_x, 'source_y': source_y, 'source_width': source_width, 'source_height': source_height, 'padded': padded}})::VARCHAR AS record FROM t""",
}

_TA = f"""WITH eff AS ({_EFFECTIVE}), {tiles._tiles('edge_strategy')}, inputs AS ({ORACLES['export_inputs']}),
  t AS (SELECT i.source_id, i.candidate_id, i.video_offset_ms, profile_id, name, tile_row, tile_column, source_x::INT AS source_x, source_y::INT AS source_y, source_width::INT AS source_width, source_height::INT AS source_height, tile_width, tile_height,
    source_width < tile_width OR source_height < tile_height AS padded FROM eff JOIN tiles USING (profile_id) JOIN inputs i ON i.source_id = eff.source_id
    WHERE x + tiles.width <= i.width AND y + tiles.height <= i.height),
  ti AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY source_id, video_offset_ms NULLS FIRST, candidate_id NULLS FIRST, tile_row, tile_column) AS export_index FROM t)"""
_FILE = "source_id || coalesce('-' || candidate_id, '') || '-' || profile_id || printf('-r%04d-c%04d.png', tile_row, tile_column)"

ORACLES |= {
    "export_tiles_all": _TA + " SELECT * FROM t",
    "export_index_all": _TA + " SELECT profile_id, source_id, candidate_id, video_offset_ms, tile_row, tile_column, export_index FROM ti",
    "export_totals_all": _TA + " SELECT profile_id, count(*) AS n_items, sum(tile_width::BIGINT * tile_height * 3)::BIGINT AS estimated_bytes FROM t GROUP BY profile_id",
    "render_names_all": f"""{_TA}, {views.ASSETS}, n AS (SELECT source_id, candidate_id, video_offset_ms, profile_id, tile_row, tile_column, {_RAW.replace("'_0_'", "'_' || coalesce(video_offset_ms, 0) || '_'")} AS raw_name FROM t JOIN assets a ON a.id = t.source_id)
        SELECT *, {_safe('raw_name')} AS safe_name FROM n""",
    "item_hashes_all": f"""{_TA} SELECT profile_id, export_index, source_id, candidate_id, video_offset_ms,
        sha256(encode(source_id || coalesce(candidate_id, 'source') || 'tiles' || profile_id) || unhex({_le('tile_row', 4)} || {_le('tile_column', 4)} || {_le('export_index', 8)})) AS item_hash FROM ti""",
    "manifest_lines_all": f"""{_TA} SELECT {_FILE} AS file_name,
        to_json({{'schemaVersion': 1, 'exportId': 'export-1', 'fileName': {_FILE}, 'sourceId': source_id, 'candidateId': candidate_id, 'videoOffsetMs': video_offset_ms,
          'roiProfileId': profile_id, 'tile': {{'tile_row': tile_row, 'tile_column': tile_column, 'source_x': source_x, 'source_y': source_y, 'source_width': source_width, 'source_height': source_height, 'padded': padded}}}})::VARCHAR AS record FROM t""",
}
