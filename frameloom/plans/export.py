"""Export plans: names from templates, conflicts, totals and the manifest."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.names import sanitized_stem
from frameloom.functions.text import ascii_lower

# The fields of a naming template.
FIELDS = ("source", "source_group", "source_identifier", "timestamp_ms", "roi", "row", "col", "width", "height", "index")


def parse_template(template: str) -> list[tuple[str, str]]:
    """The parts of a naming template: (``text`` or ``field``, value)."""
    if not template.strip():
        raise ValueError("the naming template is blank")
    parts: list[tuple[str, str]] = []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        if not brace:
            if "}" in before:
                raise ValueError("a } without {")
            parts.append(("text", before))
            break
        if before:
            parts.append(("text", before))
        name, closing, rest = after.partition("}")
        if not closing:
            raise ValueError("a { without }")
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        parts.append(("field", name))
    return parts


def render_template(template: str, fields: Mapping[str, Column]) -> Column:
    """The name a template gives for the columns of its fields; null fields are empty, an empty name is null."""
    parts = [F.lit(v) if kind == "text" else F.coalesce(fields[v].cast("string"), F.lit("")) for kind, v in parse_template(template)]
    return F.nullif(F.concat(*parts), F.lit(""))


def _packed(items: DataFrame, stem: str, order: str, digest: str | None = None) -> DataFrame:
    """Items as one column, beside what names are made of: no other column of theirs can clash."""
    more = [F.col(f"`{digest}`").alias("digest")] if digest else []
    return items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns if c != "file_name"]).alias("row"), sanitized_stem(F.col(f"`{stem}`")).alias("base"), F.col(f"`{order}`").alias("place"), *more)


#: What becomes of a file name that is taken: a number or the item's hash is appended, the item is skipped, or all fails.
STRATEGIES = ("sequence", "hash", "skip", "fail")


def unnumbered_names(items: DataFrame, stem: str, extension: str, order: str, strategy: str, occupied: DataFrame | None = None, digest: str | None = None) -> DataFrame:
    """Add ``file_name`` by a strategy without numbers: the first item (by ``order``) of a name gets it if it isn't in
    ``occupied``; for the others ``skip`` gives null, ``hash`` appends 8 hexadecimal digits of the column ``digest``, and
    ``fail`` raises an error, as ``hash`` does where its name is taken too. Natural names come before appended ones,
    whatever the order. Names are compared without regard to the case of A..Z; stems with nothing left raise an error.
    """
    if strategy not in STRATEGIES[1:] or (strategy == "hash") != (digest is not None):
        raise ValueError("strategy must be hash (with a digest), skip or fail")
    if not re.fullmatch(r"\.*[A-Za-z0-9]+", extension):
        raise ValueError("an extension has letters and digits only")
    dotted = F.lit("." + extension.lstrip(".").lower())
    rows = _packed(items, stem, order, digest)
    rows = rows.withColumn("base", F.coalesce("base", F.raise_error(F.lit("a name of nothing")).cast("string"))).withColumn("low", ascii_lower(F.concat("base", dotted)))
    held = None if occupied is None else occupied.select(ascii_lower(F.col(occupied.columns[0])).alias("low")).distinct().withColumn("used", F.lit(1))
    rows = rows.withColumn("used", F.lit(0)) if held is None else rows.join(held, "low", "left")
    nth = F.row_number().over(Window.partitionBy("low").orderBy("place")) + F.coalesce("used", F.lit(0))
    rows = rows.withColumn("nth", nth)
    natural = F.concat("base", dotted)
    conflict = F.raise_error(F.concat(F.lit("the file name is taken: "), natural)).cast("string")
    if strategy != "hash":
        other = F.lit(None).cast("string") if strategy == "skip" else conflict
        return rows.withColumn("file_name", F.when(F.col("nth") == 1, natural).otherwise(other)).select("row.*", "file_name")
    rows = rows.withColumn("appended", F.when(F.col("nth") > 1, F.concat("base", F.lit("_"), F.substring("digest", 1, 8), dotted))).withColumn("low_appended", ascii_lower(F.col("appended")))
    names = rows.select(F.col("low").alias("low_appended")).distinct()
    names = (names if held is None else names.union(held.select("low")).distinct()).withColumn("there", F.lit(True))
    again = F.row_number().over(Window.partitionBy("low_appended").orderBy("place")) > 1
    rows = rows.join(names, "low_appended", "left").withColumn("again", again)
    appended = F.when(F.col("there").isNotNull() | F.col("again"), conflict).otherwise(F.col("appended"))
    return rows.withColumn("file_name", F.when(F.col("nth") == 1, natural).otherwise(appended)).select("row.*", "file_name")


def running_index(rows: DataFrame, coarse: Column, fine: list[Column], order: list[Column], name: str) -> DataFrame:
    """Add the place of each row, from 1, in an order over all rows, without sorting all of them in one task.

    ``coarse`` has few values and doesn't decrease along the order; neither do ``fine`` ones within it. Rows are sorted
    within a fine bucket, buckets are added up within a coarse one, and only the coarse ones over all.
    """
    keys = [f"_k{i}" for i in range(len(fine))]
    keyed = rows.withColumns({"_c": coarse, **dict(zip(keys, fine, strict=True))})
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy("_c", *keys).agg(F.count("*").alias("n"))
    tops = counts.groupBy("_c").agg(F.sum("n").alias("n"))
    tops = tops.select(F.col("_c").alias("_t"), before(Window.orderBy("_c")).alias("_top"))
    inner = counts.withColumn("_in", before(Window.partitionBy("_c").orderBy(*keys)))
    offsets = inner.join(tops, F.col("_c").eqNullSafe(F.col("_t"))).select(F.col("_c").alias("_t"), *[F.col(k).alias(f"_o{k}") for k in keys], (F.col("_in") + F.col("_top")).alias("_offset"))
    on = F.col("_c").eqNullSafe(F.col("_t"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o{k}"))
    place = F.row_number().over(Window.partitionBy("_c", *keys).orderBy(*order))
    return keyed.withColumn("_place", place).join(offsets, on).select(*rows.columns, (F.col("_place") + F.col("_offset")).alias(name))


def file_names(items: DataFrame, stem: str, extension: str, order: str, occupied: DataFrame | None = None) -> DataFrame:
    """Add ``file_name``: the sanitized stem with its extension, and ``_0002``, ``_0003`` ... on conflicts.

    Names are compared without regard to the case of A..Z. The first item (by ``order``) of a name gets it, the next ones get sequence
    numbers from 2, unless the name is in ``occupied`` (one column of file names), when all get numbers. A numbered
    name that other items or files hold by nature is left out of the sequence: the numbers that are free are counted
    off in order. Items are numbered within their own name only; no plan is gathered in one task beyond the items
    of one name, which a window sorts with spilling.
    """
    if not re.fullmatch(r"\.*[A-Za-z0-9]+", extension):
        raise ValueError("an extension has letters and digits only")
    dot_ext = "." + extension.lstrip(".").lower()
    clean = _packed(items, stem, order).withColumn("low", ascii_lower(F.col("base")))
    none = items.sparkSession.createDataFrame([], "low_name string")
    taken = none if occupied is None else occupied.select(ascii_lower(F.col(occupied.columns[0])).alias("low_name")).distinct()
    dotted = F.lit(dot_ext)
    held = taken.where(F.endswith("low_name", dotted)).select(F.expr(f"left(low_name, length(low_name) - {len(dot_ext)})").alias("low"))
    # Natural names that look like a numbered one make that number unavailable for the stem before it. A longer number
    # with zeros before it is never given, and one of over nine digits never reached.
    pattern = r"^(.*)_(\d{4}|[1-9]\d{4,8})$"
    natural = clean.select("low").union(held).distinct().where(F.col("low").rlike(pattern))
    blocked = natural.select(F.regexp_extract("low", pattern, 1).alias("low"), F.regexp_extract("low", pattern, 2).cast("int").alias("number")).groupBy("low").agg(F.array_sort(F.collect_set("number")).alias("blocked"))
    used = held.distinct().withColumn("used", F.lit(1))
    w = Window.partitionBy("low").orderBy("place")
    ranked = clean.join(used, "low", "left").join(blocked, "low", "left").withColumn("nth", F.row_number().over(w) + F.coalesce("used", F.lit(0)))
    # The nth name is number n, moved on by every blocked number at or under it.
    moved = F.aggregate(F.coalesce("blocked", F.array().cast("array<int>")), F.col("nth"), lambda n, b: F.when((b >= 2) & (b <= n), n + 1).otherwise(n))
    number = F.when(F.col("nth") == 1, 1).otherwise(moved)
    name = F.when(number == 1, F.concat("base", dotted)).otherwise(F.concat("base", F.lit("_"), F.format_string("%04d", number), dotted))
    return ranked.withColumn("file_name", name).select("row.*", "file_name")


def manifest(items: DataFrame, export_id: str) -> DataFrame:
    """One JSON document per exported file, nulls written out: the lines of the provenance manifest."""
    record = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit(export_id).alias("exportId"), F.col("file_name").alias("fileName"),
        F.col("source_id").alias("sourceId"), F.col("candidate_id").alias("candidateId"), F.col("video_offset_ms").alias("videoOffsetMs"),
        F.col("roi_profile_id").alias("roiProfileId"),
        F.struct("tile_row", "tile_column", "source_x", "source_y", "source_width", "source_height", "padded").alias("tile"),
    )
    return items.select("file_name", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def full_manifest(items: DataFrame, export_id: str) -> DataFrame:
    """One JSON document per exported file with all that tells where it comes from, nulls written out.

    ``items`` has file_name, content_sha256, source_id, source_path, candidate_id, video_offset_ms, export_content, and,
    null for whole frames, roi_profile_id, roi_name, roi (struct), tile (struct) and render_config (struct).
    """
    record = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit(export_id).alias("exportId"), F.col("file_name").alias("fileName"), F.col("content_sha256").alias("contentSha256"),
        F.col("source_id").alias("sourceId"), F.col("source_path").alias("sourcePath"), F.col("candidate_id").alias("candidateId"), F.col("video_offset_ms").alias("videoOffsetMs"),
        F.col("export_content").alias("exportContent"), F.col("roi_profile_id").alias("roiProfileId"), F.col("roi_name").alias("roiName"), F.col("roi"), F.col("tile"),
        F.col("render_config").alias("renderConfig"),
    )
    return items.select("file_name", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def write_manifest(lines: DataFrame, path: str) -> None:
    """Write the records of a manifest as lines of text; a folder that is there already is an error, and nothing of an
    attempt that failed stays visible (the committer renames finished tasks' files)."""
    lines.select("record").write.mode("errorifexists").text(path)
