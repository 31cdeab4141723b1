"""Scans of files against the catalogue: what is there, what is new, what was renamed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.names import file_kind
from frameloom.functions.text import ascii_lower

_CONTENT = ["kind", "size_bytes", "quick_fingerprint"]


def rescan_status(known: DataFrame, scan: DataFrame) -> DataFrame:
    """Known assets (id, absolute_path, quick_fingerprint, ...) with what a scan (path, quick_fingerprint) says of them:
    ``new_status`` and ``new_error``. Missing files and files with another content are offline; paths compare without
    regard to the case of A..Z, and a path that comes several times is there if any of its files fits."""
    seen = scan.select(ascii_lower(F.col("path")).alias("_low"), F.col("quick_fingerprint").alias("_seen")).dropna(subset=["_low"]).distinct()
    asked = known.select("id", ascii_lower(F.col("absolute_path")).alias("_low"), F.col("quick_fingerprint").alias("_wanted"))
    found = asked.join(seen, "_low").groupBy("id").agg(F.max(F.coalesce(F.col("_seen") == F.col("_wanted"), F.lit(False))).alias("_fits"))
    rows = known.join(found, "id", "left")
    error = F.when(F.col("_fits").isNull(), "missing").when(~F.col("_fits"), "content changed")
    return rows.withColumn("new_status", F.when(error.isNull(), "online").otherwise("offline")).withColumn("new_error", error).drop("_fits")


def match_imports(scan: DataFrame, known: DataFrame) -> DataFrame:
    """What an import makes of each scanned file: (path, existing_id, action).

    ``scan`` has path, size_bytes, modified_unix_ms, quick_fingerprint; ``known`` also id, kind and online. A path that
    comes several times, but for the case of A..Z, counts once, by its first spelling. A file is the asset that has its
    path; otherwise, if exactly one asset of its kind, size and fingerprint is not online and claimed by no path, the
    first such file by path is that asset, renamed. Actions: ``unsupported`` by extension, ``failed`` (an empty file),
    ``unchanged`` (same path, size and time), ``updated``, ``imported``. Two equi-joins; claims are minima.
    """
    files = scan.groupBy(ascii_lower(F.col("path")).alias("low")).agg(F.min(F.struct("path", "size_bytes", "modified_unix_ms", "quick_fingerprint")).alias("f"))
    files = files.where("low is not null").select("low", "f.*").withColumn("kind", file_kind(F.col("path")))
    refused = F.when(F.col("kind") == "unsupported", "unsupported").when(F.col("size_bytes") == 0, "failed")
    by_path = known.groupBy(ascii_lower(F.col("absolute_path")).alias("low")).agg(F.max(F.struct("id", F.col("size_bytes").alias("s"), F.col("modified_unix_ms").alias("m"))).alias("known"))
    rows = files.withColumn("refused", refused).join(by_path, "low", "left")
    claimed = rows.where("refused is null and known is not null").select(F.col("known.id").alias("id"))
    free = known.where("not online").join(claimed, "id", "left_anti").groupBy(*_CONTENT).agg(F.count("*").alias("n"), F.min("id").alias("renamed_id")).where("n = 1").drop("n")
    first = rows.where("refused is null and known is null").groupBy(*_CONTENT).agg(F.min("low").alias("low"))
    renamed = first.join(free, _CONTENT).select("low", "renamed_id")
    same = (F.col("known.s") == F.col("size_bytes")) & (F.col("known.m") == F.col("modified_unix_ms"))
    existing = F.when(F.col("refused").isNull(), F.coalesce(F.col("known.id"), F.col("renamed_id")))
    action = F.coalesce(F.col("refused"), F.when(same, "unchanged"), F.when(existing.isNotNull(), "updated"), F.lit("imported"))
    return rows.join(renamed, "low", "left").select("path", existing.alias("existing_id"), action.alias("action"))


def relink(known: DataFrame, wishes: DataFrame) -> DataFrame:
    """Wishes (id, new_path, new_fingerprint) for another path of known assets: (id, new_path, accepted, reason).

    A file takes an asset's place only if kind and fingerprint are the same; wishes for unknown assets are refused.
    """
    rows = wishes.join(known.select("id", "kind", F.col("quick_fingerprint").alias("_old")), "id", "left")
    reason = F.when(F.col("kind").isNull(), "unknown asset").when(file_kind(F.col("new_path")) != F.col("kind"), "another kind").when(~F.col("new_fingerprint").eqNullSafe(F.col("_old")), "another content")
    return rows.select("id", "new_path", reason.isNull().alias("accepted"), reason.alias("reason"))
