"""Queries that plan whole exports: what is left out, running numbers, names by every strategy, totals, full manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.hashing import item_hash
from frameloom.plans.export import full_manifest, render_template, running_index, unnumbered_names
from frameloom.plans.tiles import plan_tiles
from frameloom.queries import exports, tiles, views
from frameloom.queries.history import _DECIDED, decided
from frameloom.sources.tables import read_table

TEMPLATE = "{source_identifier}_{roi}_{timestamp_ms}"

#: Half an hour of a video, within which rows are sorted for their running number.
_SPAN_MS = 1_800_000


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("candidate:"), "candidate_id"), F.concat(F.lit("source:"), "source_id"))


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    """Export inputs with whether the reviewer excluded them; what the analysis suggests leaves nothing out."""
    return exports.export_inputs(spark, folder).withColumn("excluded", decided(_key()).eqNullSafe("exclude"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    fine = [F.col("source_id"), F.coalesce(F.floor(F.col("video_offset_ms") / _SPAN_MS), F.lit(-1))]
    return running_index(rows, F.substring("source_id", 1, 3), fine, [F.asc_nulls_first(c) for c in order], "export_index")


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    rows = _wanted(spark, folder).where("not excluded").drop("excluded")
    files = views.assets(spark, folder).select(F.col("id").alias("source_id"), "file_name", "source_group", "source_identifier", "absolute_path", "sha256")
    numbered = _numbered(rows, ["source_id", "video_offset_ms", "candidate_id"]).join(files.withColumnRenamed("file_name", "source_file"), "source_id")
    none = F.lit(None).cast("string")
    fields = {
        "source": F.col("source_file"), "source_group": F.col("source_group"), "source_identifier": F.col("source_identifier"), "timestamp_ms": F.coalesce("video_offset_ms", F.lit(0)),
        "roi": F.lit("frame"), "row": F.lit(1), "col": F.lit(1), "width": F.col("width"), "height": F.col("height"), "index": F.col("export_index"),
    }
    digest = item_hash(F.col("source_id"), F.col("candidate_id"), "frames", none, F.lit(0), F.lit(0), F.col("export_index"))
    return numbered.withColumn("stem", render_template(TEMPLATE, fields)).withColumn("digest", digest)


def export_frames_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole frames with their running number; a name that is taken leaves its frame out."""
    rows = unnumbered_names(_frames(spark, folder), "stem", "jpg", "export_index", "skip")
    return rows.select("source_id", "candidate_id", "export_index", "file_name")


def export_frames_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Whole frames with their running number; a name that is taken gets the frame's hash."""
    rows = unnumbered_names(_frames(spark, folder), "stem", "jpg", "export_index", "hash", digest="digest")
    return rows.select("source_id", "candidate_id", "export_index", "file_name")


def export_frames_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Planned frames, those left out by name or by the reviewer, and estimated bytes."""
    planned = unnumbered_names(_frames(spark, folder), "stem", "jpg", "export_index", "skip")
    kept = F.col("file_name").isNotNull()
    size = F.when(kept, F.col("width").cast("bigint") * F.col("height") * 3)
    none = F.lit(0).cast("bigint")
    by_name = planned.agg(F.count_if(kept).alias("n_items"), F.count_if(~kept).alias("n_skipped"), F.coalesce(F.sum(size), F.lit(0)).alias("estimated_bytes"))
    by_reviewer = _wanted(spark, folder).agg(none.alias("n_items"), F.count_if("excluded").alias("n_skipped"), none.alias("estimated_bytes"))
    return by_name.unionByName(by_reviewer).agg(*[F.sum(c).alias(c) for c in by_name.columns])


_TILE = ["source_id", "candidate_id", "profile_id", "tile_row", "tile_column"]


def _tile_rows(spark: SparkSession, folder: str) -> DataFrame:
    return exports._tiles(spark, folder, exports.export_inputs(spark, folder)).withColumn("excluded", decided(_key()).eqNullSafe("exclude"))


def _excluded_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles that are left out one by one; here the first tile of every second profile in the images and frames whose source ends with a digit under 4."""
    rows = _tile_rows(spark, folder).where("tile_row = 0 and tile_column = 0")
    return rows.where((F.substring("source_id", -1, 1) < "4") & (F.substring("profile_id", -1, 1) < "8")).select(*_TILE).distinct()


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    a, b = rows.alias("a"), gone.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _TILE]
    return a.join(b, same, "left_anti")


def export_tiles_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of an export with their running number, which goes on over excluded tiles but not over excluded inputs."""
    rows = _tile_rows(spark, folder).where("not excluded")
    numbered = _numbered(rows, ["source_id", "video_offset_ms", "candidate_id", "profile_id", "tile_row", "tile_column"])
    return _without(numbered, _excluded_tiles(spark, folder)).select(*_TILE, "export_index")


def export_tiles_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Planned tiles, those left out one by one or with their input, and estimated bytes."""
    gone = _excluded_tiles(spark, folder).withColumn("gone", F.lit(True))
    a, b = _tile_rows(spark, folder).alias("a"), gone.alias("b")
    rows = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _TILE], "left")
    kept = ~F.col("excluded") & F.col("gone").isNull()
    size = F.when(kept, F.col("tile_width").cast("bigint") * F.col("tile_height") * 3)
    return rows.agg(F.count_if(kept).alias("n_items"), F.count_if(~kept).alias("n_skipped"), F.coalesce(F.sum(size), F.lit(0)).alias("estimated_bytes"))


def export_scope(spark: SparkSession, folder: str) -> DataFrame:
    """The assets of an export of a whole group: those of the kind and group of the selected one (here the smallest id)."""
    rows = views.assets(spark, folder).select("id", "kind", "source_group")
    chosen = rows.agg(F.min_by(F.struct("kind", "source_group"), "id").alias("c")).select("c.*")
    return rows.join(F.broadcast(chosen), ["kind", "source_group"], "left_semi").select("id", "kind", "source_group")


def export_one_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of exports of one candidate for each video (here its smallest id), and of images as they are."""
    rows = exports.export_inputs(spark, folder)
    chosen = rows.where("candidate_id is not null").groupBy("source_id").agg(F.min("candidate_id").alias("candidate_id"))
    return rows.where("candidate_id is null").unionByName(rows.join(chosen, ["source_id", "candidate_id"], "left_semi"))


def preview_input(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown of each asset: an image itself; of a video the wanted candidate (here one whose id ends with 7), else
    its first; a video without candidates has nothing to show."""
    rows = exports.export_inputs(spark, folder)
    frames = rows.where("candidate_id is not null")
    wanted = F.min(F.when(F.substring("candidate_id", -1, 1) == "7", F.col("candidate_id")))
    first = F.min(F.struct("video_offset_ms", "candidate_id"))["candidate_id"]
    shown = frames.groupBy("source_id").agg(F.coalesce(wanted, first).alias("candidate_id"))
    return rows.where("candidate_id is null").select("source_id", "candidate_id").unionByName(shown)


def manifest_full(spark: SparkSession, folder: str) -> DataFrame:
    """The full manifest of an export of frames and of one of tiles; the content's digest is known where a frame is passed
    through unchanged, which is so for images."""
    none = lambda kind: F.lit(None).cast(kind)
    planned = unnumbered_names(_frames(spark, folder), "stem", "jpg", "export_index", "hash", digest="digest")
    frames = planned.where("candidate_id is null").select(
        "file_name", F.col("sha256").alias("content_sha256"), "source_id", F.col("absolute_path").alias("source_path"), "candidate_id", "video_offset_ms", F.lit("frames").alias("export_content"),
        none("string").alias("roi_profile_id"), none("string").alias("roi_name"), none("struct<x: int, y: int, width: int, height: int>").alias("roi"),
        none("struct<row: int, column: int, sourceX: int, sourceY: int, sourceWidth: int, sourceHeight: int, padded: boolean>").alias("tile"), none("struct<tileWidth: int, tileHeight: int, padding: string>").alias("render_config"),
    )
    regions = tiles.profiles(spark, folder).select(F.col("id").alias("profile_id"), "x", "y", "width", "height", "padding").dropDuplicates(["profile_id"])
    paths = views.assets(spark, folder).select(F.col("id").alias("source_id"), F.col("absolute_path").alias("source_path"))
    rows = exports.export_tiles(spark, folder).join(regions, "profile_id").join(paths, "source_id")
    name = F.format_string("%s-%s-r%04d-c%04d.png", "source_id", "profile_id", "tile_row", "tile_column")
    cut_out = rows.select(
        name.alias("file_name"), none("string").alias("content_sha256"), "source_id", "source_path", none("string").alias("candidate_id"), none("bigint").alias("video_offset_ms"), F.lit("tiles").alias("export_content"),
        F.col("profile_id").alias("roi_profile_id"), F.col("name").alias("roi_name"), F.struct("x", "y", "width", "height").alias("roi"),
        F.struct(
            F.col("tile_row").alias("row"), F.col("tile_column").alias("column"), F.col("source_x").alias("sourceX"), F.col("source_y").alias("sourceY"),
            F.col("source_width").alias("sourceWidth"), F.col("source_height").alias("sourceHeight"), "padded",
        ).alias("tile"),
        F.struct(F.col("tile_width").alias("tileWidth"), F.col("tile_height").alias("tileHeight"), "padding").alias("render_config"),
    )
    return full_manifest(frames.unionByName(cut_out), "export-1")


def full_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The placement of a whole frame of every input: one tile of the picture's own size; none where that isn't known."""
    rows = exports.export_inputs(spark, folder).select("source_id", "candidate_id", F.lit(0).alias("x"), F.lit(0).alias("y"), "width", "height")
    whole = {"tile_width": F.col("width"), "tile_height": F.col("height"), "overlap_x": F.lit(0), "overlap_y": F.lit(0), "edge_strategy": F.lit("pad")}
    return plan_tiles(rows.withColumns(whole)).select("source_id", "candidate_id", "tile_row", "tile_column", "source_width", "source_height", "padded")


def existing_names(spark: SparkSession, folder: str) -> DataFrame:
    """The file names of the folder of every camera without regard to case, as an export finds them occupied."""
    rows = read_table(spark, folder, "source_assets").select("source_identifier", F.lower("file_name").alias("name"))
    return rows.distinct()


QUERIES = {
    f.__name__: f
    for f in (
        export_frames_skip, export_frames_hash, export_frames_totals, export_tiles_plan, export_tiles_totals, export_scope, export_one_candidate, preview_input,
        manifest_full, full_frames, existing_names,
    )
}

_IN = exports.ORACLES["export_inputs"]
_KEYED = "coalesce('candidate:' || candidate_id, 'source:' || source_id)"
_GONE = f"coalesce({_DECIDED.replace('asset_key', _KEYED)} = 'exclude', false)"
_F = rf"""WITH {views.ASSETS}, i AS ({_IN}), k AS (SELECT *, {_GONE} AS excluded FROM i),
  n AS (SELECT k.*, row_number() OVER (ORDER BY source_id, video_offset_ms NULLS FIRST, candidate_id NULLS FIRST) AS export_index FROM k WHERE NOT excluded),
  raw AS (SELECT n.*, a.absolute_path, a.sha256, a.source_identifier || '_frame_' || coalesce(video_offset_ms, 0) AS text FROM n JOIN assets a ON a.id = n.source_id),
  safe AS (SELECT *, {exports._safe('text')} AS base FROM raw),
  nth AS (SELECT *, row_number() OVER (PARTITION BY {"translate(base, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} ORDER BY export_index) AS nth FROM safe),
  named AS (SELECT *, left(sha256(encode(source_id || coalesce(candidate_id, 'source') || 'frames' || 'full-frame') || unhex(repeat('00', 8) || {exports._le('export_index', 8)})), 8) AS h8 FROM nth)"""
_TT = f"""{exports._TA}, k AS (SELECT *, {_GONE} AS excluded, tile_row = 0 AND tile_column = 0 AND right(source_id, 1) < '4' AND right(profile_id, 1) < '8' AS gone FROM t),
  m AS (SELECT *, row_number() OVER (ORDER BY source_id, video_offset_ms NULLS FIRST, candidate_id NULLS FIRST, profile_id, tile_row, tile_column) AS export_index FROM k WHERE NOT excluded)"""
_PNG = "source_id || '-' || t.profile_id || printf('-r%04d-c%04d.png', tile_row, tile_column)"

ORACLES = {
    "export_frames_skip": _F + " SELECT source_id, candidate_id, export_index, CASE WHEN nth = 1 THEN base || '.jpg' END AS file_name FROM named",
    "export_frames_hash": _F + " SELECT source_id, candidate_id, export_index, base || CASE WHEN nth = 1 THEN '' ELSE '_' || h8 END || '.jpg' AS file_name FROM named",
    "export_frames_totals": _F + """ SELECT count(*) FILTER (nth = 1) AS n_items, count(*) FILTER (nth > 1) + (SELECT count(*) FROM k WHERE excluded) AS n_skipped,
        coalesce(sum(width::BIGINT * height * 3) FILTER (nth = 1), 0)::BIGINT AS estimated_bytes FROM named""",
    "export_tiles_plan": _TT + " SELECT source_id, candidate_id, profile_id, tile_row, tile_column, export_index FROM m WHERE NOT gone",
    "export_tiles_totals": _TT + """ SELECT count(*) FILTER (NOT excluded AND NOT gone) AS n_items, count(*) FILTER (excluded OR gone) AS n_skipped,
        coalesce(sum(tile_width::BIGINT * tile_height * 3) FILTER (NOT excluded AND NOT gone), 0)::BIGINT AS estimated_bytes FROM k""",
    "export_scope": f"WITH {views.ASSETS} SELECT id, kind, source_group FROM assets WHERE (kind, source_group) = (SELECT (kind, source_group) FROM assets ORDER BY id LIMIT 1)",
    "export_one_candidate": f"WITH i AS ({_IN}) SELECT * FROM i WHERE candidate_id IS NULL OR candidate_id = (SELECT min(candidate_id) FROM i j WHERE j.source_id = i.source_id)",
    "preview_input": f"""WITH i AS ({_IN}) SELECT source_id, NULL::VARCHAR AS candidate_id FROM i WHERE candidate_id IS NULL UNION ALL
        SELECT source_id, coalesce(min(candidate_id) FILTER (right(candidate_id, 1) = '7'), arg_min(candidate_id, (video_offset_ms, candidate_id))) FROM i WHERE candidate_id IS NOT NULL GROUP BY source_id""",
    "manifest_full": f"""{_F}, tiled AS ({exports.ORACLES['export_tiles']}), profiles AS (SELECT DISTINCT id AS profile_id, x, y, width, height, render_config_json::JSON->>'padding' AS padding FROM roi_profiles)
        SELECT base || CASE WHEN nth = 1 THEN '' ELSE '_' || h8 END || '.jpg' AS file_name, to_json({{'schemaVersion': 1, 'exportId': 'export-1', 'fileName': base || CASE WHEN nth = 1 THEN '' ELSE '_' || h8 END || '.jpg', 'contentSha256': sha256,
          'sourceId': source_id, 'sourcePath': absolute_path, 'candidateId': candidate_id, 'videoOffsetMs': video_offset_ms, 'exportContent': 'frames', 'roiProfileId': NULL, 'roiName': NULL, 'roi': NULL, 'tile': NULL, 'renderConfig': NULL}})::VARCHAR AS record
        FROM named WHERE candidate_id IS NULL
        UNION ALL SELECT {_PNG}, to_json({{'schemaVersion': 1, 'exportId': 'export-1', 'fileName': {_PNG}, 'contentSha256': NULL, 'sourceId': source_id, 'sourcePath': a.absolute_path, 'candidateId': NULL, 'videoOffsetMs': NULL,
          'exportContent': 'tiles', 'roiProfileId': t.profile_id, 'roiName': t.name, 'roi': {{'x': p.x, 'y': p.y, 'width': p.width, 'height': p.height}},
          'tile': {{'row': tile_row, 'column': tile_column, 'sourceX': source_x, 'sourceY': source_y, 'sourceWidth': source_width, 'sourceHeight': source_height, 'padded': padded}},
          'renderConfig': {{'tileWidth': tile_width, 'tileHeight': tile_height, 'padding': p.padding}}}})::VARCHAR FROM tiled t JOIN profiles p ON p.profile_id = t.profile_id JOIN assets a ON a.id = t.source_id""",
    "full_frames": f"SELECT source_id, candidate_id, 0 AS tile_row, 0 AS tile_column, width AS source_width, height AS source_height, false AS padded FROM ({_IN}) WHERE width IS NOT NULL AND height IS NOT NULL",
    "existing_names": "SELECT DISTINCT source_identifier, lower(file_name) AS name FROM source_assets",
}
