"""Queries that import scans of files into the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import imports, store
from frameloom.queries import views


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """A scan made from the catalogue: by the last digit of their id files were renamed (0), spelled in capitals (1),
    touched (2), replaced by new ones (3), emptied (4), given an extension that isn't supported (5), or taken away (6)."""
    d = F.substring("id", -1, 1)
    path = F.col("absolute_path")
    renamed = lambda mark: F.regexp_replace(path, r"\.([^.\\]*)$", f"_{mark}.$1")
    now = F.when(d == "0", renamed("moved")).when(d == "1", F.upper(path)).when(d == "3", renamed("new")).when(d == "5", F.concat(path, F.lit(".txt"))).otherwise(path)
    fingerprint = F.when(d == "3", F.concat(F.lit("new"), "quick_fingerprint")).otherwise(F.col("quick_fingerprint"))
    rows = views.assets(spark, folder).where(d != "6")
    return rows.select(
        now.alias("path"), F.when(d == "4", 0).otherwise(F.col("size_bytes")).alias("size_bytes"),
        (F.col("modified_unix_ms") + F.when(d == "2", 1000).otherwise(0)).alias("modified_unix_ms"), fingerprint.alias("quick_fingerprint"),
    )


def _rescanned(spark: SparkSession, folder: str) -> DataFrame:
    known = views.assets(spark, folder).select("id", "kind", "absolute_path", "size_bytes", "modified_unix_ms", "quick_fingerprint", "status", "error")
    return imports.rescan_status(known, _scan(spark, folder))


def source_rescan(spark: SparkSession, folder: str) -> DataFrame:
    """The status of every asset after a scan, and whether it changed."""
    rows = _rescanned(spark, folder)
    return rows.select("id", "new_status", "new_error", (~F.col("new_status").eqNullSafe(F.col("status"))).alias("changed"))


def source_rescan_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many assets a scan found, lost and changed."""
    rows = source_rescan(spark, folder)
    return rows.agg(F.count("*").alias("n_sources"), F.count_if(F.col("new_status") == "offline").alias("n_offline"), F.count_if("changed").alias("n_changed"))


def source_status_written(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue with the statuses of a scan written into it."""
    rows = _rescanned(spark, folder)
    changes = rows.select("id", F.col("new_status").alias("status"))
    return store.update_by_key(rows.select("id", "kind", "status"), changes, ["id"], ["status"])


def source_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The refreshed row of one asset (here the smallest id): the scan is asked for its path alone."""
    known = views.assets(spark, folder).select("id", "kind", "absolute_path", "size_bytes", "modified_unix_ms", "quick_fingerprint", "status", "error")
    one = known.join(F.broadcast(known.agg(F.min("id").alias("id"))), "id", "left_semi")
    return imports.rescan_status(one, _scan(spark, folder)).select("id", "absolute_path", F.col("new_status").alias("status"), F.col("new_error").alias("error"))


def import_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What an import makes of every file of a scan."""
    known = _rescanned(spark, folder).withColumn("online", F.col("new_status") == "online")
    return imports.match_imports(_scan(spark, folder), known)


def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The result of an import: files discovered, imported, updated, unsupported and failed."""
    count = lambda *v: F.count_if(F.col("action").isin(*v))
    return import_actions(spark, folder).agg(
        F.count("*").alias("n_discovered"), count("imported").alias("n_imported"), count("updated", "unchanged").alias("n_updated"), count("unsupported").alias("n_unsupported"),
        count("failed").alias("n_failed"), count("unchanged").alias("n_unchanged"),
    )


def import_again(spark: SparkSession, folder: str) -> DataFrame:
    """The actions of a second import of the files that the first one took: none is imported again."""
    scan = _scan(spark, folder)
    taken = import_actions(spark, folder).where("action in ('imported', 'updated', 'unchanged')")
    files = scan.join(taken.select("path", "existing_id"), "path")
    known = files.select(
        F.coalesce("existing_id", F.concat(F.lit("new:"), "path")).alias("id"), F.col("path").alias("absolute_path"), F.lit(None).cast("string").alias("kind"),
        "size_bytes", "modified_unix_ms", "quick_fingerprint", F.lit(True).alias("online"),
    )
    return imports.match_imports(files, known).groupBy("action").agg(F.count("*").alias("n_files"))


def source_relink(spark: SparkSession, folder: str) -> DataFrame:
    """Wishes for another path: the renamed file where there is one, and wrong ones by the last digit of the id."""
    d = F.substring("id", -1, 1)
    wrong = F.when(d == "3", F.lit("D:\\x\\note.txt")).otherwise(F.concat("absolute_path", F.lit(".mp4")))
    rows = views.assets(spark, folder).where(d.isin("0", "3", "5", "7"))
    wishes = rows.select(F.when(d == "5", F.lit("nobody")).otherwise(F.col("id")).alias("id"), wrong.alias("new_path"), F.when(d == "7", "other").otherwise(F.col("quick_fingerprint")).alias("new_fingerprint")).distinct()
    return imports.relink(views.assets(spark, folder), wishes)


QUERIES = {f.__name__: f for f in (source_rescan, source_refresh, source_rescan_counts, source_status_written, import_actions, import_counts, import_again, source_relink)}

_EXT = r"lower(regexp_extract({}, '[^/\\]\.([^./\\]*)$', 1))"


def _kind(path: str) -> str:
    ext = _EXT.format(path)
    return f"CASE WHEN {ext} IN ('jpg','jpeg','png','bmp','tif','tiff','webp') THEN 'image' WHEN {ext} IN ('mp4','mov','mkv','avi','webm','m4v','mts','m2ts') THEN 'video' ELSE 'unsupported' END"


# Case is folded for A..Z alone: paths hold other letters too.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_W = rf"""WITH {views.ASSETS}, b AS (SELECT *, right(id, 1) AS d FROM assets), scan AS (
  SELECT CASE d WHEN '0' THEN regexp_replace(absolute_path, '\.([^.\\]*)$', '_moved.\1') WHEN '1' THEN upper(absolute_path) WHEN '3' THEN regexp_replace(absolute_path, '\.([^.\\]*)$', '_new.\1')
      WHEN '5' THEN absolute_path || '.txt' ELSE absolute_path END AS path, CASE d WHEN '4' THEN 0 ELSE size_bytes END AS size, modified_unix_ms + CASE d WHEN '2' THEN 1000 ELSE 0 END AS m,
    CASE d WHEN '3' THEN 'new' || quick_fingerprint ELSE quick_fingerprint END AS fp FROM b WHERE d <> '6'),
  known AS (SELECT *, EXISTS (SELECT 1 FROM scan WHERE {_LOW.format('scan.path')} = {_LOW.format('b.absolute_path')}) AS there,
    EXISTS (SELECT 1 FROM scan WHERE {_LOW.format('scan.path')} = {_LOW.format('b.absolute_path')} AND scan.fp = b.quick_fingerprint) AS fits FROM b),
  files AS (SELECT *, {_LOW.format('path')} AS low, {_kind('path')} AS kind FROM scan QUALIFY row_number() OVER (PARTITION BY {_LOW.format('path')} ORDER BY path, size, m, fp) = 1),
  p AS (SELECT files.*, (SELECT max(id) FROM known WHERE {_LOW.format('absolute_path')} = low) AS path_id FROM files),
  free AS (SELECT kind, size_bytes AS size, quick_fingerprint AS fp, min(id) AS id FROM known WHERE NOT fits AND id NOT IN (SELECT path_id FROM p WHERE path_id IS NOT NULL AND kind <> 'unsupported' AND size > 0) GROUP BY ALL HAVING count(*) = 1),
  q AS (SELECT p.*, CASE WHEN p.kind <> 'unsupported' AND p.size > 0 THEN coalesce(path_id, CASE WHEN low = min(low) FILTER (path_id IS NULL AND p.kind <> 'unsupported' AND p.size > 0) OVER (PARTITION BY p.kind, p.size, p.fp) THEN free.id END) END AS existing_id FROM p LEFT JOIN free USING (kind, size, fp)),
  actions AS (SELECT path, existing_id, CASE WHEN q.kind = 'unsupported' THEN 'unsupported' WHEN size = 0 THEN 'failed' WHEN path_id IS NOT NULL AND size = k.size_bytes AND m = k.modified_unix_ms THEN 'unchanged'
    WHEN existing_id IS NOT NULL THEN 'updated' ELSE 'imported' END AS action FROM q LEFT JOIN known k ON k.id = q.path_id),
  status AS (SELECT id, kind, CASE WHEN fits THEN 'online' ELSE 'offline' END AS new_status, CASE WHEN NOT there THEN 'missing' WHEN NOT fits THEN 'content changed' END AS new_error, status AS old FROM known)"""

ORACLES = {
    "source_rescan": _W + " SELECT id, new_status, new_error, new_status <> old AS changed FROM status",
    "source_refresh": _W + " SELECT id, (SELECT absolute_path FROM known k WHERE k.id = status.id) AS absolute_path, new_status AS status, new_error AS error FROM status WHERE id = (SELECT min(id) FROM status)",
    "source_rescan_counts": _W + " SELECT count(*) AS n_sources, count(*) FILTER (new_status = 'offline') AS n_offline, count(*) FILTER (new_status <> old) AS n_changed FROM status",
    "source_status_written": _W + " SELECT id, kind, new_status AS status FROM status",
    "import_actions": _W + " SELECT path, existing_id, action FROM actions",
    "import_counts": _W + """ SELECT count(*) AS n_discovered, count(*) FILTER (action = 'imported') AS n_imported, count(*) FILTER (action IN ('updated', 'unchanged')) AS n_updated,
        count(*) FILTER (action = 'unsupported') AS n_unsupported, count(*) FILTER (action = 'failed') AS n_failed, count(*) FILTER (action = 'unchanged') AS n_unchanged FROM actions""",
    "import_again": _W + " SELECT 'unchanged' AS action, count(*) AS n_files FROM actions WHERE action IN ('imported', 'updated', 'unchanged')",
    "source_relink": rf"""WITH {views.ASSETS}, b AS (SELECT *, right(id, 1) AS d FROM assets), w AS (SELECT DISTINCT CASE d WHEN '5' THEN 'nobody' ELSE id END AS id, CASE d WHEN '3' THEN 'D:\x\note.txt' ELSE absolute_path || '.mp4' END AS new_path,
        d, CASE d WHEN '7' THEN 'other' ELSE quick_fingerprint END AS fp FROM b WHERE d IN ('0', '3', '5', '7')),
        r AS (SELECT DISTINCT w.id, new_path, w.fp, CASE WHEN a.id IS NULL THEN 'unknown asset' WHEN w.d = '3' OR a.kind <> 'video' THEN 'another kind' WHEN fp <> a.quick_fingerprint THEN 'another content' END AS reason FROM w LEFT JOIN assets a ON a.id = w.id)
        SELECT id, new_path, reason IS NULL AS accepted, reason FROM r""",
}
