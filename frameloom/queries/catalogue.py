"""Queries of the catalogue's store: lookups, pages, ordered lists, changes by key, checks of names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import measures, names
from frameloom.functions.text import ascii_lower, plain_key
from frameloom.operators import store
from frameloom.queries import quality, similarity, tiles, views
from frameloom.sources.tables import read_table


def stable_id(*parts: Column) -> Column:
    """An id in UUID form that the same parts always have: no row's id depends on when or where it is made."""
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))


def source_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Single assets by id and by path, whatever its case (here the smallest id and the greatest path)."""
    rows = views.assets(spark, folder).select("id", "absolute_path", "status")
    asked = rows.agg(F.min("id").alias("by_id"), F.max(ascii_lower(F.col("absolute_path"))).alias("by_path"))
    found = rows.join(F.broadcast(asked), (F.col("id") == F.col("by_id")) | (ascii_lower(F.col("absolute_path")) == F.col("by_path")))
    return found.select("id", "absolute_path", "status", (F.col("id") == F.col("by_id")).alias("by_id"))


def candidate_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of one source at one time (here the smallest source and its last time)."""
    rows = views.candidates(spark, folder).select("id", "source", "video_offset_ms")
    asked = rows.agg(F.min_by(F.struct("source", "video_offset_ms"), F.struct("source", -F.col("video_offset_ms"))).alias("k")).select("k.*")
    return rows.join(F.broadcast(asked), ["source", "video_offset_ms"], "left_semi").select("id", "source", "video_offset_ms")


def fingerprint_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The assets of one kind, size and fingerprint (here those of the smallest fingerprint)."""
    rows = views.assets(spark, folder).select("id", "kind", "size_bytes", "quick_fingerprint")
    asked = rows.agg(F.min_by(F.struct("kind", "size_bytes", "quick_fingerprint"), F.struct("quick_fingerprint", "kind", "size_bytes")).alias("k")).select("k.*")
    return rows.join(F.broadcast(asked), ["kind", "size_bytes", "quick_fingerprint"], "left_semi").select("id", "kind", "size_bytes", "quick_fingerprint")


def candidate_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the candidates of the source that has most of them: 50 after the first 100, by time."""
    rows = views.candidates(spark, folder).select("id", "source", "video_offset_ms")
    most = rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "source"))["source"].alias("source"))
    return rows.join(F.broadcast(most), "source", "left_semi").orderBy("video_offset_ms", "id").offset(100).limit(50).select("id", "source", "video_offset_ms")


def candidate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates every source has."""
    return views.candidates(spark, folder).groupBy("source").agg(F.count("*").alias("n_candidates"))


def _placed(rows: DataFrame, part: str, order: list[Column], columns: list[str]) -> DataFrame:
    return rows.select(*columns, F.row_number().over(Window.partitionBy(part).orderBy(*order)).alias("place"))


def selection_list(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every selection in its source's list, by start and end."""
    return _placed(views.selections(spark, folder), "source", [F.col(c) for c in ("start_ms", "end_ms", "id")], ["source", "id"])


def roi_list(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every profile in its scope's list, by name and id."""
    rows = tiles.profiles(spark, folder).withColumn("scope", plain_key(F.col("scope_value"))).where("scope is not null")
    return _placed(rows, "scope", [F.col("name"), F.col("id")], ["scope", "id", "name"])


def metric_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every asset of a source by a metric, ascending, those without it last."""
    rows = views.metrics(spark, folder).select("source_id", "asset_key", views.sound("sharpness").alias("value"))
    return _placed(rows.where("source_id is not null"), "source_id", [F.asc_nulls_last("value"), F.col("asset_key")], ["source_id", "asset_key"])


def load_more(spark: SparkSession, folder: str) -> DataFrame:
    """The first two pages of 400 review items by metric."""
    rows = views.metrics(spark, folder).select("asset_key", views.sound("sharpness").alias("value"))
    return rows.orderBy(F.asc_nulls_last("value"), "asset_key").limit(800)


def tile_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles that a preview shows: the first thousand of a profile."""
    rows = tiles.tile_plan(spark, folder).withColumn("place", F.row_number().over(Window.partitionBy("profile_id").orderBy("tile_row", "tile_column")))
    return rows.where("place <= 1000").select("profile_id", "tile_row", "tile_column", "place")


def hash_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """The next 256 images whose digest is to be made."""
    rows = views.assets(spark, folder).where("kind = 'image' and sha256 is null and status = 'online'")
    return rows.orderBy("id").limit(256).select("id", "absolute_path")


def parent_folders(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct folders that hold assets."""
    return views.assets(spark, folder).select(F.regexp_replace("absolute_path", r"[/\\][^/\\]*$", "").alias("folder")).distinct()


def group_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Source groups in the order in which they were first imported, with how many assets they show."""
    rows = views.assets(spark, folder).groupBy("source_group").agg(F.min(F.struct("imported_at", "id")).alias("first"), F.count("*").alias("n_assets"))
    return rows.select("source_group", "n_assets", F.col("first.id").alias("first_id"))


def same_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    """For every asset, how many of its kind are in its group: what an action on the group would reach."""
    rows = views.assets(spark, folder).select("id", "kind", "source_group")
    counts = rows.groupBy("kind", "source_group").agg(F.count("*").alias("n_same"))
    return rows.join(counts, ["kind", "source_group"]).select("id", "n_same")


def components_ready(spark: SparkSession, folder: str) -> DataFrame:
    """Whether nothing of a group is blocked: every asset of it online."""
    return views.assets(spark, folder).groupBy("source_group").agg(F.bool_and(F.col("status") == "online").alias("ready"))


def asset_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The review key of every input of an analysis: of images and of candidates."""
    images = views.assets(spark, folder).where("kind = 'image'").select(F.concat(F.lit("source:"), "id").alias("asset_key"))
    return images.unionByName(views.candidates(spark, folder).select(F.concat(F.lit("candidate:"), "id").alias("asset_key"))).distinct()


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of new candidates: the same source and time always have the same id."""
    rows = views.candidates(spark, folder).select("source", "video_offset_ms").distinct()
    return rows.select("source", "video_offset_ms", stable_id(F.col("source"), F.col("video_offset_ms").cast("string")).alias("new_id"))


def candidates_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of the candidates and analyses of every source when the chosen ones go (here those whose id ends with 0),
    and how many go."""
    rows = read_table(spark, folder, "candidate_images").select("id").distinct()
    gone = rows.where(F.substring("id", -1, 1) == "0").select(F.concat(F.lit("candidate:"), "id").alias("asset_key"))
    kept, lost = store.cascade(
        {"candidate_images": (rows.select(F.concat(F.lit("candidate:"), "id").alias("asset_key")), "asset_key"), "review_inputs": (read_table(spark, folder, "review_inputs").select("asset_key"), "asset_key")}, gone, "asset_key"
    )
    left = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_kept")) for name, df in kept.items()]
    return lost.join(left[0].unionByName(left[1]), "table_name")


def selections_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """Which wishes to delete a selection removed one; half of them name none."""
    rows = views.selections(spark, folder).select("id").distinct()
    wishes = rows.where(F.substring("id", -1, 1) < "4").select("id").unionByName(rows.where(F.substring("id", -1, 1) < "4").select(F.concat("id", F.lit("-x")).alias("id")))
    return store.delete_by_key(rows, wishes, "id")[1]


def selections_inserted(spark: SparkSession, folder: str) -> DataFrame:
    """Which selections may be put in: a start before the end, and the end within the video where its duration is known."""
    rows = read_table(spark, folder, "video_selections").select("id", plain_key(F.col("source_id")).alias("source"), "start_ms", "end_ms").distinct()
    videos = views.videos(spark, folder).select("source", "duration_ms")
    sound = F.coalesce((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms")) & (F.col("duration_ms").isNull() | (F.col("end_ms") <= F.col("duration_ms"))), F.lit(False))
    w = Window.partitionBy("source", "accepted").orderBy("start_ms", "end_ms", "id")
    judged = rows.join(videos, "source", "left").withColumn("accepted", sound)
    return judged.select("id", "source", "start_ms", "end_ms", "accepted", F.when(F.col("accepted"), F.concat(F.lit("有效片段 "), F.row_number().over(w).cast("string"))).alias("label"))


def roi_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Which profiles may be saved: scope and name not blank, tiles that fit their overlap, a region inside its picture."""
    rows = tiles.profiles(spark, folder).withColumn("scope", plain_key(F.col("scope_value")))
    sizes = views.assets(spark, folder).select(F.lower("id").alias("scope"), F.col("width").alias("w"), F.col("height").alias("h"), F.lit(True).alias("there"))
    own = F.col("scope_kind") == "source"
    joined = rows.join(sizes, "scope", "left")
    tiled = (F.col("tile_width") > 0) & (F.col("tile_height") > 0) & (F.col("overlap_x") < F.col("tile_width")) & (F.col("overlap_y") < F.col("tile_height"))
    region = (F.col("width") > 0) & (F.col("height") > 0)
    inside = (F.col("x").cast("bigint") + F.col("width") <= F.col("w")) & (F.col("y").cast("bigint") + F.col("height") <= F.col("h"))
    reason = (
        F.when(F.col("scope").isNull() | (F.trim("name") == ""), "blank").when(~tiled | ~region, "invalid").when(own & F.col("there").isNull(), "unknown source")
        .when(own & (F.col("w").isNull() | F.col("h").isNull()), "size unknown").when(own & ~inside, "outside")
    )
    return joined.select(F.col("id").alias("profile_id"), reason.isNull().alias("accepted"), reason.alias("reason"))


def meta_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Project facts put over older ones by key: counts of the tables over placeholders."""
    count = lambda name: read_table(spark, folder, name).agg(F.lit(name).alias("key"), F.count("*").cast("string").alias("value"))
    old = spark.createDataFrame([("schema", "5"), ("source_assets", "0"), ("owner", "local")], "key string, value string")
    return store.upsert(old, count("source_assets").unionByName(count("video_selections")), ["key"], {})


def quality_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of a second run put in the place of those of the first, whole rows by key."""
    rows = read_table(spark, folder, "review_inputs").where("asset_key is not null and decode_error is null").select("asset_key", "analyzed_at", views.sound("sharpness").alias("sharpness"), views.sound("entropy").alias("entropy")).distinct()
    order = ["analyzed_at", "sharpness", "entropy"]
    old, new = (store.fold_versions(rows.where(f"analyzed_at {op} '2025-07-01'"), ["asset_key"], order) for op in ("<", ">="))
    return store.upsert(old, new, ["asset_key"], {}).select("asset_key", "sharpness", "entropy", "existed")


def cache_files(spark: SparkSession, folder: str) -> DataFrame:
    """Which files of candidates may be deleted with them: only those under the cache."""
    rows = read_table(spark, folder, "candidate_images").select("id", "image_path").distinct()
    path = F.translate("image_path", "\\", "/")
    return rows.select("id", (F.startswith(path, F.lit("cache/")) & ~path.rlike(r"(^|/)\.\.(/|$)")).alias("deletable"))


def chart_points(spark: SparkSession, folder: str) -> DataFrame:
    """The events' values as points of a chart of 640 by 120, per user and in order of time."""
    rows = read_table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    span = rows.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("value").alias("top"))
    scaled = lambda x, lo, hi, size: F.when(hi > lo, (x - lo) / (hi - lo) * size).otherwise(F.lit(0.0))
    joined = rows.join(span, "user_id")
    return joined.select("user_id", "event_id", F.round(scaled(F.col("t"), F.col("t0"), F.col("t1"), 640), 4).alias("x"), F.round(120 - scaled(F.col("value"), F.lit(0.0), F.col("top"), 120), 4).alias("y"))


def aspect_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Width by height of every asset; a height of zero counts as one."""
    return views.assets(spark, folder).select("id", F.round(measures.aspect_ratio(F.col("width"), F.col("height")), 6).alias("aspect"))


def path_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Paths with the prefix of extended paths put on and taken off again."""
    path = F.col("absolute_path")
    written = F.when(F.substring("id", -1, 1) < "8", F.concat(F.lit("\\\\?\\"), path)).otherwise(F.concat(F.lit("\\\\?\\UNC\\"), F.substring(path, 4, 1000)))
    return views.assets(spark, folder).select("id", names.without_extended_prefix(written).alias("plain_path"))


def colours(spark: SparkSession, folder: str) -> DataFrame:
    """Colours of profiles, here from their ids, as numbers and back as text."""
    hexed = F.concat(F.lit("#"), F.substring("id", 1, 6))
    rows = tiles.profiles(spark, folder).select("id").distinct()
    return rows.select("id", F.array_join(names.rgba_of_hex(hexed), ",").alias("rgba"), names.hex_of_rgba(names.rgba_of_hex(hexed)).alias("hex"))


def project_names(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the names of profiles and groups, some with a character that isn't allowed, may name a project."""
    rows = tiles.profiles(spark, folder).select("id", F.concat("name", F.when(F.substring("id", -1, 1) < "3", F.lit(". ")).when(F.substring("id", -1, 1) < "6", F.lit("?")).otherwise(F.lit(""))).alias("name"))
    return rows.select("id", "name", names.valid_project_name(F.col("name")).alias("valid"))


def change_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Which settings of change selection are sound: a threshold in [0, 1], 0 < shortest <= longest pause; from the events."""
    rows = read_table(spark, folder, "events").select("event_id", (F.col("value") / 300).alias("threshold"), (F.col("user_id") % 5).alias("least"), (F.col("event_id") % 4).alias("most"))
    return rows.select("event_id", (F.col("threshold").between(0, 1) & (F.col("least") > 0) & (F.col("most") >= F.col("least"))).alias("sound"))


def reasons_json(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons as a JSON text and how many are in it when it is read back."""
    text = F.to_json(quality.reasons())
    return views.metrics(spark, folder).select("asset_key", text.alias("reasons_json"), F.size(F.from_json(text, "array<string>")).alias("n_read"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as JSON snapshots, read back field by field."""
    fields = ["id", "kind", "status", "size_bytes", "sha256"]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    back = F.from_json(text, "id string, kind string, status string, size_bytes bigint, sha256 string")
    return views.assets(spark, folder).select(text.alias("snapshot"), back["id"].alias("id"), back["size_bytes"].alias("size_bytes"), back["sha256"].alias("sha256"))


def project_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown when a project is opened: its assets, those not online, its candidates and selections."""
    names = ("n_sources", "n_not_online", "n_candidates", "n_selections")

    def counted(rows: DataFrame, **counts: Column) -> DataFrame:
        return rows.agg(*[counts.get(n, F.lit(0).cast("bigint")).alias(n) for n in names])

    sources = counted(views.assets(spark, folder), n_sources=F.count("*"), n_not_online=F.count_if(F.col("status") != "online"))
    frames = counted(views.candidates(spark, folder), n_candidates=F.count("*"))
    parts = counted(views.selections(spark, folder), n_selections=F.count("*"))
    return sources.unionByName(frames).unionByName(parts).agg(*[F.sum(n).alias(n) for n in names])


def comparison_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many comparisons near copies in each source group would take, without making them: pairs of the group, less
    those of one digest and those of one video further apart than the window."""
    rows = similarity.review_assets(spark, folder).where("source_group is not null").select("source_group", "source_id", "asset_key", "offset_ms", "digest")
    pairs = lambda n: (n * (n - 1) / 2).cast("bigint")
    total = rows.groupBy("source_group").agg(F.count("*").alias("n")).select("source_group", pairs(F.col("n")).alias("total"))
    copies = rows.where("digest is not null").groupBy("source_group", "digest").agg(F.count("*").alias("n")).groupBy("source_group").agg(F.sum(pairs(F.col("n"))).alias("copies"))

    def far(keys: list[str], name: str) -> DataFrame:
        timed = rows.where("offset_ms is not null" + (" and digest is not null" if "digest" in keys else ""))
        near = Window.partitionBy(*keys).orderBy("offset_ms").rangeBetween(Window.currentRow, 30_000)
        later = Window.partitionBy(*keys).orderBy("offset_ms").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        beyond = timed.select("source_group", (F.count("*").over(later) - F.count("*").over(near)).alias("n"))
        return beyond.groupBy("source_group").agg(F.sum("n").alias(name))

    joined = total.join(copies, "source_group", "left").join(far(["source_group", "source_id"], "far"), "source_group", "left").join(far(["source_group", "source_id", "digest"], "both"), "source_group", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("source_group", (F.col("total") - zero("copies") - zero("far") + zero("both")).alias("n_comparisons"))


QUERIES = {
    f.__name__: f
    for f in (
        source_lookups, candidate_lookup, fingerprint_lookup, candidate_page, candidate_counts, selection_list, roi_list, metric_order, load_more, tile_preview, hash_backfill,
        parent_folders, group_lists, same_kind_counts, components_ready, asset_keys, stable_ids, candidates_deleted, selections_deleted, selections_inserted, roi_saved,
        meta_upsert, quality_upsert, cache_files, chart_points, aspect_ratios, path_prefixes, colours, project_names, change_settings, reasons_json, snapshots, project_summary,
        comparison_counts,
    )
}

_A, _C, _S, _M = views.ASSETS, views.CANDIDATES, views.SELECTIONS, views.METRICS
_sharp = views.sound_sql("sharpness")

ORACLES = {
    "source_lookups": f"WITH {_A} SELECT id, absolute_path, status, id = (SELECT min(id) FROM assets) AS by_id FROM assets WHERE id = (SELECT min(id) FROM assets) OR lower(absolute_path) = (SELECT max(lower(absolute_path)) FROM assets)",
    "candidate_lookup": f"WITH {_C}, k AS (SELECT source, video_offset_ms FROM candidates ORDER BY source, video_offset_ms DESC LIMIT 1) SELECT id, source, video_offset_ms FROM candidates JOIN k USING (source, video_offset_ms)",
    "fingerprint_lookup": f"WITH {_A}, k AS (SELECT kind, size_bytes, quick_fingerprint FROM assets ORDER BY 3, 1, 2 LIMIT 1) SELECT id, kind, size_bytes, quick_fingerprint FROM assets JOIN k USING (kind, size_bytes, quick_fingerprint)",
    "candidate_page": f"WITH {_C}, k AS (SELECT source FROM candidates GROUP BY source ORDER BY count(*) DESC, source DESC LIMIT 1) SELECT id, source, video_offset_ms FROM candidates JOIN k USING (source) ORDER BY video_offset_ms, id LIMIT 50 OFFSET 100",
    "candidate_counts": f"WITH {_C} SELECT source, count(*) AS n_candidates FROM candidates GROUP BY source",
    "selection_list": f"WITH {_S} SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY start_ms, end_ms, id) AS place FROM selections",
    "roi_list": f"WITH {tiles._PROFILES}, p AS (SELECT {tiles._SCOPE} AS scope, profile_id AS id, name FROM profiles) SELECT scope, id, name, row_number() OVER (PARTITION BY scope ORDER BY name, id) AS place FROM p WHERE scope IS NOT NULL",
    "metric_order": f"WITH {_M} SELECT source_id, asset_key, row_number() OVER (PARTITION BY source_id ORDER BY {_sharp} NULLS LAST, asset_key) AS place FROM metrics WHERE source_id IS NOT NULL",
    "load_more": f"WITH {_M} SELECT asset_key, {_sharp} AS value FROM metrics ORDER BY 2 NULLS LAST, 1 LIMIT 800",
    "tile_preview": f"WITH t AS ({tiles.ORACLES['tile_plan']}), n AS (SELECT profile_id, tile_row, tile_column, row_number() OVER (PARTITION BY profile_id ORDER BY tile_row, tile_column) AS place FROM t) SELECT * FROM n WHERE place <= 1000",
    "hash_backfill": f"WITH {_A} SELECT id, absolute_path FROM assets WHERE kind = 'image' AND sha256 IS NULL AND status = 'online' ORDER BY id LIMIT 256",
    "parent_folders": f"WITH {_A} " + r"SELECT DISTINCT regexp_replace(absolute_path, '[/\\][^/\\]*$', '') AS folder FROM assets",
    "group_lists": f"WITH {_A} SELECT source_group, count(*) AS n_assets, arg_min(id, (imported_at, id)) AS first_id FROM assets GROUP BY source_group",
    "same_kind_counts": f"WITH {_A} SELECT id, count(*) OVER (PARTITION BY kind, source_group) AS n_same FROM assets",
    "components_ready": f"WITH {_A} SELECT source_group, bool_and(status = 'online') AS ready FROM assets GROUP BY source_group",
    "asset_keys": f"WITH {_A}, {_C} SELECT 'source:' || id AS asset_key FROM assets WHERE kind = 'image' UNION SELECT 'candidate:' || id FROM candidates",
    "stable_ids": f"""WITH {_C}, d AS (SELECT DISTINCT source, video_offset_ms, sha256(source || chr(31) || video_offset_ms) AS s FROM candidates)
        SELECT source, video_offset_ms, concat_ws('-', s[1:8], s[9:12], '4' || s[14:16], '8' || s[18:20], s[21:32]) AS new_id FROM d""",
    "candidates_deleted": """WITH c AS (SELECT DISTINCT id FROM candidate_images) SELECT 'candidate_images' AS table_name, count(*) FILTER (right(id, 1) = '0') AS n_deleted, count(*) FILTER (right(id, 1) <> '0') AS n_kept FROM c
        UNION ALL SELECT 'review_inputs', count(*) FILTER (c.id IS NOT NULL), count(*) FILTER (c.id IS NULL) FROM review_inputs r LEFT JOIN (SELECT * FROM c WHERE right(id, 1) = '0') c ON r.asset_key = 'candidate:' || c.id""",
    "selections_deleted": f"WITH {_S}, d AS (SELECT DISTINCT id FROM selections WHERE right(id, 1) < '4') SELECT id, true AS removed FROM d UNION ALL SELECT id || '-x', false FROM d",
    "selections_inserted": f"""WITH {views.VIDEOS}, r AS (SELECT DISTINCT id, {views.PLAIN} AS source, start_ms, end_ms FROM video_selections),
        j AS (SELECT r.*, coalesce(start_ms >= 0 AND start_ms < end_ms AND (duration_ms IS NULL OR end_ms <= duration_ms), false) AS accepted FROM r LEFT JOIN videos USING (source))
        SELECT *, CASE WHEN accepted THEN '有效片段 ' || row_number() OVER (PARTITION BY source, accepted ORDER BY start_ms NULLS FIRST, end_ms NULLS FIRST, id) END AS label FROM j""",
    "roi_saved": f"""WITH {_A}, {tiles._PROFILES}, p AS (SELECT profiles.*, {tiles._SCOPE} AS scope FROM profiles), j AS (SELECT p.*, a.id AS there, a.width AS w, a.height AS h FROM p LEFT JOIN assets a ON lower(a.id) = scope),
        r AS (SELECT profile_id, CASE WHEN scope IS NULL OR trim(name) = '' THEN 'blank' WHEN NOT (tile_width > 0 AND tile_height > 0 AND overlap_x < tile_width AND overlap_y < tile_height) OR NOT (width > 0 AND height > 0) THEN 'invalid'
          WHEN scope_kind = 'source' AND there IS NULL THEN 'unknown source' WHEN scope_kind = 'source' AND (w IS NULL OR h IS NULL) THEN 'size unknown' WHEN scope_kind = 'source' AND NOT (x + width <= w AND y + height <= h) THEN 'outside' END AS reason FROM j)
        SELECT profile_id, reason IS NULL AS accepted, reason FROM r""",
    "meta_upsert": """SELECT 'schema' AS key, '5' AS value, true AS existed UNION ALL SELECT 'owner', 'local', true UNION ALL SELECT 'source_assets', count(*)::VARCHAR, true FROM source_assets
        UNION ALL SELECT 'video_selections', count(*)::VARCHAR, false FROM video_selections""",
    "quality_upsert": f"""WITH r AS (SELECT DISTINCT asset_key, analyzed_at, {_sharp} AS sharpness, {views.sound_sql('entropy')} AS entropy FROM review_inputs WHERE asset_key IS NOT NULL AND decode_error IS NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY asset_key ORDER BY analyzed_at DESC, sharpness DESC NULLS LAST, entropy DESC NULLS LAST) AS rn FROM r)
        SELECT asset_key, sharpness, entropy, asset_key IN (SELECT asset_key FROM r WHERE analyzed_at < '2025-07-01') AS existed FROM n WHERE rn = 1""",
    "cache_files": "SELECT DISTINCT id, starts_with(replace(image_path, '\\', '/'), 'cache/') AND NOT regexp_matches(replace(image_path, '\\', '/'), '(^|/)\\.\\.(/|$)') AS deletable FROM candidate_images",
    "chart_points": """WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, min(epoch_us(ts)) OVER w AS t0, max(epoch_us(ts)) OVER w AS t1, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id))
        SELECT user_id, event_id, round(CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) * 640 ELSE 0 END, 4) AS x, round(120 - CASE WHEN top > 0 THEN value / top * 120 ELSE 0 END, 4) AS y FROM r""",
    "aspect_ratios": f"WITH {_A} SELECT id, round(width / greatest(height, 1), 6) AS aspect FROM assets",
    "path_prefixes": f"WITH {_A} " + r"SELECT id, CASE WHEN right(id, 1) < '8' THEN absolute_path ELSE '\\' || substring(absolute_path, 4) END AS plain_path FROM assets",
    "colours": "SELECT DISTINCT id, concat_ws(',', ('0x' || id[1:2])::INT, ('0x' || id[3:4])::INT, ('0x' || id[5:6])::INT, 255) AS rgba, '#' || id[1:6] AS hex FROM roi_profiles",
    "project_names": f"""WITH {tiles._PROFILES}, n AS (SELECT profile_id AS id, name || CASE WHEN right(profile_id, 1) < '3' THEN '. ' WHEN right(profile_id, 1) < '6' THEN '?' ELSE '' END AS name FROM profiles)
        SELECT id, name, trim(name) <> '' AND NOT regexp_matches(name, '[<>:"/\\\\|?*]') AND NOT regexp_matches(name, '[. ]$') AS valid FROM n""",
    "change_settings": "SELECT event_id, value / 300 BETWEEN 0 AND 1 AND user_id % 5 > 0 AND event_id % 4 >= user_id % 5 AS sound FROM events",
    "reasons_json": f"WITH {_M} SELECT asset_key, to_json({quality._REASONS})::VARCHAR AS reasons_json, len({quality._REASONS})::INT AS n_read FROM metrics",
    "snapshots": f"WITH {_A} SELECT to_json({{'id': id, 'kind': kind, 'status': status, 'size_bytes': size_bytes, 'sha256': sha256}})::VARCHAR AS snapshot, id, size_bytes, sha256 FROM assets",
    "project_summary": f"""WITH {_A}, {_C}, {_S} SELECT (SELECT count(*) FROM assets) AS n_sources, (SELECT count(*) FROM assets WHERE status <> 'online') AS n_not_online, (SELECT count(*) FROM candidates) AS n_candidates,
        (SELECT count(*) FROM selections) AS n_selections""",
    "comparison_counts": f"""WITH {similarity._R}, g AS (SELECT DISTINCT source_group FROM r WHERE source_group IS NOT NULL), p AS (SELECT a.source_group FROM r a JOIN r b ON a.source_group = b.source_group AND a.asset_key < b.asset_key
        WHERE NOT coalesce(a.digest = b.digest, false) AND NOT coalesce(a.source_id = b.source_id AND abs(a.offset_ms - b.offset_ms) > 30000, false))
        SELECT source_group, count(p.source_group) AS n_comparisons FROM g LEFT JOIN p USING (source_group) GROUP BY source_group""",
}
