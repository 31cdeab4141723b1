"""Queries that change tables, read probe documents, and run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions.hashing import quick_fingerprint
from frameloom.functions.text import plain_key
from frameloom.operators import store
from frameloom.queries import quality, sampling, tiles, views
from frameloom.sources.probe import frame_times, video_facts
from frameloom.sources.tables import read_table
from frameloom.streaming import events


def candidate_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Manual captures put into the planned candidates: pins win, paths and sizes stay, frame numbers fill up."""
    columns = ["source", "video_offset_ms", "source_frame_number", "selection_method", "pinned", "image_path", "created_at", "id"]
    rows = views.candidates(spark, folder).select(*columns)
    order = ["created_at", "id", "selection_method", "pinned"]
    one = lambda df: store.fold_versions(df, ["source", "video_offset_ms"], order)
    old, new = one(rows.where("selection_method <> 'manual'")), one(rows.where("selection_method = 'manual'"))
    method = lambda o, n, row: F.when(row["pinned"], n).otherwise(o)
    rules = {"source_frame_number": store.OLD_FIRST, "selection_method": method, "pinned": store.GREATEST}
    return store.upsert(old, new, ["source", "video_offset_ms"], rules, default=store.KEEP_OLD)


def source_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Every asset after all its imports and checks: the first import time, the last known digest, else the newest."""
    columns = ["id", "status", "size_bytes", "sha256", "imported_at", "last_checked_at"]
    rows = read_table(spark, folder, "source_assets").select(*columns).distinct()
    return store.fold_versions(rows, ["id"], ["last_checked_at", "imported_at", "status"], first=["imported_at"], last_known=["sha256"])


def roi_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per scope and name: the newest version's id and region, the oldest one's creation time."""
    rows = tiles.profiles(spark, folder).withColumn("scope", plain_key(F.col("scope_value"))).where("scope is not null")
    kept = rows.select("scope_kind", "scope", "name", "id", "x", "y", "width", "height", "created_at", "updated_at")
    return store.fold_versions(kept, ["scope_kind", "scope", "name"], ["updated_at", "id"], first=["created_at"])


def _of_sources(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    plain = lambda name: read_table(spark, folder, name).withColumn("source_key", plain_key(F.col("source_id")))
    profiles = tiles.profiles(spark, folder).where("scope_kind = 'source'").withColumn("source_key", plain_key(F.col("scope_value")))
    frames = {"candidate_images": plain("candidate_images"), "video_selections": plain("video_selections"), "review_inputs": plain("review_inputs"), "roi_profiles": profiles}
    removed = read_table(spark, folder, "source_removals").select(plain_key(F.col("source_id")).alias("k"))
    return store.cascade({n: (df, "source_key") for n, df in frames.items()}, removed, "k")


def cascade_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each table go with the removed sources."""
    return _of_sources(spark, folder)[1]


def cascade_kept_selections(spark: SparkSession, folder: str) -> DataFrame:
    """The selections that stay when the removed sources are gone."""
    return _of_sources(spark, folder)[0]["video_selections"].select("id", "start_ms", "end_ms").distinct()


def _actions(spark: SparkSession, folder: str) -> DataFrame:
    names = {"view": "keep", "error": "exclude", "click": "restore", "signup": "lock", "purchase": "unlock"}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return read_table(spark, folder, "events").select("user_id", "event_id", lookup[F.col("event_type")].alias("action"))


def review_state(spark: SparkSession, folder: str) -> DataFrame:
    """The decision and lock that a log of actions leaves on every entity."""
    return store.event_state(_actions(spark, folder), "user_id", "event_id", "action")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """Events done so far, day by day."""
    days = read_table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", "n", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("done"))


def probe_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Probe documents of all assets, read back as columns; images have no video stream and no facts."""
    stream = F.struct(
        F.lit(0).alias("index"), F.col("kind").alias("codec_type"), F.col("codec").alias("codec_name"), "width", "height", F.col("frame_rate").alias("avg_frame_rate"),
        F.create_map(F.lit("creation_time"), F.col("capture_time")).alias("tags"),
    )
    sound = F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"))
    form = F.struct(F.col("file_name").alias("filename"), F.format_string("%.4f", F.col("duration_ms") / 1000).alias("duration"))
    merged = F.concat(F.lit('{"streams":['), F.to_json(sound), F.lit(","), F.to_json(stream), F.lit('],"format":'), F.to_json(form), F.lit("}"))
    return views.assets(spark, folder).select("id", video_facts(merged).alias("v")).select("id", "v.codec", "v.width", "v.frame_rate", "v.duration_ms", "v.creation_time")


def frame_timelines(spark: SparkSession, folder: str) -> DataFrame:
    """The timeline of every source's candidates, through a frame document."""
    frame = F.to_json(F.struct(F.format_string("%.3f", F.col("video_offset_ms") / 1000).alias("best_effort_timestamp_time")))
    docs = views.candidates(spark, folder).groupBy("source").agg(F.concat(F.lit('{"frames":['), F.array_join(F.collect_list(frame), ","), F.lit("]}")).alias("doc"))
    times = docs.select("source", frame_times(F.col("doc")).alias("times"))
    return times.select("source", F.size("times").alias("n_frames"), F.array_min("times").alias("first_ms"), F.array_max("times").alias("last_ms"))


def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and kind, counted by a stream with a watermark."""
    path = f"{folder}/events.parquet"
    counted = events.run_to_table(events.window_counts(events.read_stream(spark, path), "ts", "event_type"), "update")
    last = counted.groupBy("window_start", "event_type").agg(F.max_by("n_events", "batch").alias("n_events"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events")


def stream_change_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The change selection, by a stream that keeps the last taken time of every source."""
    stream = events.read_stream(spark, f"{folder}/events.parquet")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    points = stream.select(F.col("user_id").alias("source"), at.alias("t_ms"), (F.col("value") / 500).alias("score"))
    chosen = events.select_changes(points, "source", "t_ms", "score", 0.6, 3_600_000, 172_800_000)
    return events.run_to_table(chosen, "append").select("source", "t_ms")


def stream_frame_change(spark: SparkSession, folder: str) -> DataFrame:
    """The difference of every raster from the one before it, by a stream that keeps the last raster of every series."""
    stream = events.read_stream(spark, f"{folder}/embeddings.parquet")
    level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.lit(128.0) + F.lit(255.0) * e.cast("double")).cast("int")))
    frames = stream.where(F.size("embedding") == 64).select("label", "vec_id", F.transform("embedding", level).alias("px"))
    scored = events.run_to_table(events.frame_changes(frames, "label", "vec_id", "px"), "append")
    return scored.select("label", "frame", F.round("score", 6).alias("score"))


def stream_import(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue as an import in batches of 64 files leaves it: every batch is folded into what came before."""
    stream = events.read_stream(spark, f"{folder}/source_assets.parquet").select("id", "status", "last_checked_at", "imported_at")
    rows = events.run_to_table(stream, "append").drop("batch").distinct()
    return store.fold_versions(rows, ["id"], ["last_checked_at", "imported_at", "status"], first=["imported_at"])


def text_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of the whole content and the quick fingerprint of size and edges, of texts as files."""
    content = F.encode("text", "utf-8")
    rows = read_table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(content, 256).alias("sha256"), quick_fingerprint(content).alias("quick_fingerprint"))


def event_page(spark: SparkSession, folder: str) -> DataFrame:
    """The last page of 50 events by id, taken from the end: nothing before it is sorted or gathered."""
    rows = read_table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return rows.orderBy(F.desc("event_id")).limit(50)


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of events of one user with pauses under six hours."""
    rows = read_table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n_events"))
    return sessions.select("user_id", F.unix_micros("w.start").alias("start_us"), "n_events")


QUERIES = {f.__name__: f for f in (candidate_upsert, source_upsert, roi_upsert, cascade_counts, cascade_kept_selections, review_state, progress, probe_documents, frame_timelines, stream_event_windows, stream_change_selection, stream_frame_change, stream_import, text_fingerprints, event_page, event_sessions)}

_GONE = "gone AS (SELECT DISTINCT " + views.PLAIN + " AS k FROM source_removals)"
_KEY = views.PLAIN

ORACLES = {
    "candidate_upsert": f"""WITH {views.CANDIDATES}, n AS (SELECT *, selection_method = 'manual' AS new, row_number() OVER (PARTITION BY source, video_offset_ms, selection_method = 'manual' ORDER BY created_at DESC, id DESC, selection_method DESC, pinned DESC) AS rn FROM candidates),
        o AS (SELECT * FROM n WHERE rn = 1 AND NOT new), m AS (SELECT * FROM n WHERE rn = 1 AND new)
        SELECT coalesce(o.source, m.source) AS source, coalesce(o.video_offset_ms, m.video_offset_ms) AS video_offset_ms, coalesce(o.source_frame_number, m.source_frame_number) AS source_frame_number,
          CASE WHEN o.id IS NULL OR m.pinned THEN m.selection_method ELSE o.selection_method END AS selection_method, coalesce(greatest(o.pinned, m.pinned), o.pinned, m.pinned) AS pinned,
          CASE WHEN o.id IS NULL THEN m.image_path ELSE o.image_path END AS image_path, CASE WHEN o.id IS NULL THEN m.created_at ELSE o.created_at END AS created_at, coalesce(o.id, m.id) AS id, o.id IS NOT NULL AS existed
        FROM o FULL JOIN m ON o.source = m.source AND o.video_offset_ms = m.video_offset_ms""",
    "source_upsert": """SELECT id, arg_max(status, (last_checked_at, imported_at, status)) AS status, arg_max(size_bytes, (last_checked_at, imported_at, status)) AS size_bytes,
        arg_max(sha256, (last_checked_at, imported_at, status)) FILTER (sha256 IS NOT NULL) AS sha256, arg_min(imported_at, (last_checked_at, imported_at, status)) AS imported_at, max(last_checked_at) AS last_checked_at FROM source_assets GROUP BY id""",
    "roi_upsert": f"""WITH {tiles._PROFILES}, p AS (SELECT *, {tiles._SCOPE} AS scope FROM profiles)
        SELECT scope_kind, scope, name, arg_max(profile_id, (updated_at, profile_id)) AS id, arg_max(x, (updated_at, profile_id)) AS x, arg_max(y, (updated_at, profile_id)) AS y, arg_max(width, (updated_at, profile_id)) AS width,
        arg_max(height, (updated_at, profile_id)) AS height, arg_min(created_at, (updated_at, profile_id)) AS created_at, max(updated_at) AS updated_at FROM p WHERE scope IS NOT NULL GROUP BY ALL""",
    "cascade_counts": f"WITH {_GONE}, {tiles._PROFILES} " + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_deleted FROM {src} WHERE {k} IN (SELECT k FROM gone)" for t, src, k in (
            ("candidate_images", "candidate_images", _KEY), ("video_selections", "video_selections", _KEY), ("review_inputs", "review_inputs", _KEY),
            ("roi_profiles", "(SELECT * FROM profiles WHERE scope_kind = 'source')", tiles._SCOPE))),
    "cascade_kept_selections": f"WITH {_GONE} SELECT DISTINCT id, start_ms, end_ms FROM video_selections WHERE {_KEY} IS NULL OR {_KEY} NOT IN (SELECT k FROM gone WHERE k IS NOT NULL)",
    "review_state": """SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'exclude' WHEN event_type IN ('view', 'signup') THEN 'keep' ELSE 'none' END, event_id) FILTER (event_type <> 'purchase') AS d,
        arg_max(event_type = 'signup', event_id) FILTER (event_type IN ('signup', 'purchase')) AS l FROM events GROUP BY user_id""",
    "progress": "SELECT ts::DATE AS day, count(*) AS n, sum(count(*)) OVER (ORDER BY ts::DATE)::BIGINT AS done FROM events GROUP BY 1",
    "probe_documents": f"WITH {views.ASSETS} SELECT id, CASE WHEN kind = 'video' THEN codec END AS codec, CASE WHEN kind = 'video' THEN width END AS width, CASE WHEN kind = 'video' THEN frame_rate END AS frame_rate, CASE WHEN kind = 'video' THEN duration_ms END AS duration_ms, CASE WHEN kind = 'video' THEN capture_time END AS creation_time FROM assets",
    "frame_timelines": f"WITH {views.CANDIDATES} SELECT source, count(DISTINCT video_offset_ms)::INT AS n_frames, min(video_offset_ms) AS first_ms, max(video_offset_ms) AS last_ms FROM candidates GROUP BY source",
    "stream_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL",
    "stream_change_selection": sampling.ORACLES["change_triggered"],
    "stream_frame_change": quality.ORACLES["frame_change_score"],
    "stream_import": """SELECT id, arg_max(status, (last_checked_at, imported_at, status)) AS status, max(last_checked_at) AS last_checked_at, arg_min(imported_at, (last_checked_at, imported_at, status)) AS imported_at FROM source_assets GROUP BY id""",
    "text_fingerprints": f"""SELECT doc_id, sha256(b) AS sha256, sha256(unhex({' || '.join(f"printf('%02x', (octet_length(b) >> {8 * i}) & 255)" for i in range(8))}) || unhex(left(hex(b), 131072)) || CASE WHEN octet_length(b) > 65536 THEN unhex(right(hex(b), 131072)) ELSE ''::BLOB END) AS quick_fingerprint
        FROM (SELECT doc_id, encode(text) AS b FROM documents WHERE text IS NOT NULL)""",
    "event_page": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "event_sessions": """SELECT user_id, min(us) AS start_us, count(*) AS n_events FROM (SELECT user_id, us, sum(CASE WHEN us - before < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s""",
}
ORACLES["review_state"] = f"SELECT user_id, nullif(d, 'none') AS decision, coalesce(l, false) AS locked FROM ({ORACLES['review_state']})"
