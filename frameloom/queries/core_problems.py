"""Queries of the general data problems: dangling references, capture times, selection intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import plain_key
from frameloom.operators.intervals import merge_intervals
from frameloom.operators.references import orphan_references
from frameloom.operators.timestamps import ABBREVIATIONS, DAY_FIRST, SMOOTHING, normalise_timestamps
from frameloom.sources.tables import read_table


def project_references(spark: SparkSession, folder: str) -> DataFrame:
    """All references of the project in one shape: a composite key with partial nulls.

    A reference to an asset has ref_id, one to a group has ref_group; the other column is null.
    """
    none = F.lit(None).cast("string")

    def of(name: str, ref_id, ref_group):
        return read_table(spark, folder, name).select(
            F.lit(name).alias("table_name"),
            F.col("id").alias("row_id"),
            F.date_format("created_at", "yyyy-MM").alias("month_utc"),
            F.col("created_at"),
            ref_id.alias("ref_id"),
            ref_group.alias("ref_group"),
        )

    scope = plain_key(F.col("scope_value"))
    return (
        of("candidate_images", plain_key(F.col("source_id")), none)
        .unionByName(of("video_selections", plain_key(F.col("source_id")), none))
        .unionByName(
            of(
                "roi_profiles",
                F.when(F.col("scope_kind") == "source", scope),
                F.when(F.col("scope_kind") == "source_group", scope),
            )
        )
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference without a target in time: table, row, month of creation and cause."""
    targets = read_table(spark, folder, "source_assets").select(
        plain_key(F.col("id")).alias("ref_id"), plain_key(F.col("source_group")).alias("ref_group"), "imported_at"
    )
    removed = read_table(spark, folder, "source_removals").select(
        plain_key(F.col("source_id")).alias("ref_id"), plain_key(F.col("source_group")).alias("ref_group")
    )
    found = orphan_references(
        project_references(spark, folder), targets, removed, ["ref_id", "ref_group"], "created_at", "imported_at"
    )
    return found.select("table_name", "row_id", "month_utc", "cause").distinct()


def p2_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """The orphan references counted per table, month and cause."""
    return p2_found(spark, folder).groupBy("table_name", "month_utc", "cause").agg(F.count("*").alias("n_rows"))


def _capture_times(spark: SparkSession, folder: str, priors=None) -> DataFrame:
    sites = (
        read_table(spark, folder, "camera_sites").groupBy("source_identifier").agg(F.min("site_zone").alias("site_zone"))
    )
    assets = read_table(spark, folder, "source_assets").select(
        "id", "source_identifier", "capture_time", "capture_time_source"
    )
    return normalise_timestamps(
        assets.join(sites, "source_identifier", "left"), "id", "capture_time", "capture_time_source", "site_zone",
        priors=priors,
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC instant of every asset whose capture time can be read.

    The problem declares that dates in digits begin with the day or the year: that is the prior of the mixture, and what
    can only be read with the month first is no case.
    """
    return (
        _capture_times(spark, folder, DAY_FIRST)
        .where(F.col("utc_us").isNotNull() & (F.col("format") != "mdy"))
        .select(F.col("id").alias("source_id"), F.col("utc_us").alias("capture_utc_us"))
        .distinct()
    )


def p3_interpretations(spark: SparkSession, folder: str) -> DataFrame:
    """How the capture times are read if each source's mixture of formats alone decides: assets per format and status."""
    return (
        _capture_times(spark, folder)
        .groupBy(F.coalesce("format", F.lit("none")).alias("format"), "status", "ambiguity")
        .agg(F.countDistinct("id").alias("n_assets"))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous selected periods and the gaps between them, per source."""
    return merge_intervals(read_table(spark, folder, "video_selections"))


QUERIES = {
    "p2_found": p2_found,
    "p2_orphans_by_period": p2_orphans_by_period,
    "p3_found": p3_found,
    "p3_interpretations": p3_interpretations,
    "p5_found": p5_found,
}

_BLANK = r"'^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$'"


def _plain(column: str) -> str:
    return f"nullif(lower(regexp_replace({column}, {_BLANK}, '', 'g')), '')"


_P2 = f"""
WITH refs AS (
  SELECT 'candidate_images' AS table_name, id AS row_id, created_at, 'id' AS kind, {_plain('source_id')} AS k FROM candidate_images
  UNION ALL SELECT 'video_selections', id, created_at, 'id', {_plain('source_id')} FROM video_selections
  UNION ALL SELECT 'roi_profiles', id, created_at, CASE scope_kind WHEN 'source' THEN 'id' WHEN 'source_group' THEN 'group' END,
    {_plain('scope_value')} FROM roi_profiles
), t AS (
  SELECT kind, k, min(imported_at) AS came FROM (
    SELECT 'id' AS kind, {_plain('id')} AS k, imported_at FROM source_assets
    UNION ALL SELECT 'group', {_plain('source_group')}, imported_at FROM source_assets) GROUP BY ALL
), r AS (
  SELECT DISTINCT 'id' AS kind, {_plain('source_id')} AS k FROM source_removals
  UNION SELECT DISTINCT 'group', {_plain('source_group')} FROM source_removals
), found AS (
  SELECT DISTINCT table_name, row_id, strftime(created_at, '%Y-%m') AS month_utc,
    CASE WHEN t.k IS NOT NULL THEN 'late' WHEN r.k IS NOT NULL THEN 'removed' ELSE 'missing' END AS cause
  FROM refs LEFT JOIN t USING (kind, k) LEFT JOIN r USING (kind, k)
  WHERE refs.k IS NOT NULL AND refs.kind IS NOT NULL AND (t.k IS NULL OR t.came > created_at)
)
"""

_A = r"'^(\d{4})[-:/年](\d{1,2})[-:/月](\d{1,2})日?[T ](\d{1,2})[:时](\d\d)(?:[:分](\d\d)秒?(?:[.,](\d+))?)?(?: ?([AaPp])[Mm])?$'"
_B = r"'^(\d{1,2})[. ](\d\d|[A-Z][a-z]+)[. ](\d{4}),? (\d{1,2}):(\d\d)(?::(\d\d))?(?: ?([ap])m)?$'"
_C = r"'^(\d{4})(\d\d)(\d\d)[T_]?(\d\d)(\d\d)(\d\d)(?:_(\d+))?$'"
_ABBREVIATED = "CASE x " + " ".join(f"WHEN '{k.upper()}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"


def _part(a: int, b: int, c: int) -> str:
    """A group of whichever shape matches; 0 for none."""
    pick = lambda pattern, i: f"regexp_extract(core, {pattern}, {i})" if i else "''"
    return f"CASE WHEN regexp_matches(core, {_A}) THEN {pick(_A, a)} WHEN regexp_matches(core, {_B}) THEN {pick(_B, b)} WHEN regexp_matches(core, {_C}) THEN {pick(_C, c)} ELSE '' END"


def _shift(us: str) -> str:
    """The offset of a zone from UTC at an instant, in microseconds."""
    return f"(epoch_us(timezone(zone, make_timestamptz({us}))) - ({us}))"


_P3 = rf"""
WITH v AS (
  SELECT DISTINCT id, regexp_replace(capture_time, {_BLANK}, '', 'g') AS v, lower(regexp_replace(capture_time_source, {_BLANK}, '', 'g')) AS src, site_zone
  FROM source_assets LEFT JOIN camera_sites USING (source_identifier) WHERE capture_time IS NOT NULL
), z AS (
  SELECT *, regexp_full_match(v, '\d{{10}}|\d{{13}}|\d{{16}}') AS counted, regexp_extract(v, '\d ?(Z|UTC|GMT|EST|EDT|PST|PDT|CET|CEST)$', 1) AS x,
    regexp_extract(v, '[T:]\d[\d:.]* ?([+-]\d\d:?\d\d)$', 1) AS o, coalesce(nullif(regexp_extract(v, '\[([^\]]+)\]$', 1), ''), nullif(regexp_extract(v, ' ([A-Z]\w+/\w+)$', 1), '')) AS named,
    regexp_replace(regexp_replace(v, '^(UTC |[A-Z][a-z][a-z], )', ''), '( ?\[.*\]| [A-Z]\w+/\w+| ?(Z|UTC|GMT|EST|EDT|PST|PDT|CET|CEST)| ?[+-]\d\d:?\d\d)$', '') AS core FROM v
), f AS (
  SELECT *, CASE WHEN v LIKE 'UTC %' THEN 0 WHEN x <> '' THEN {_ABBREVIATED}
      WHEN o <> '' THEN (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (o[2:3]::INT * 60 + o[-2:]::INT) END AS minutes,
    {_part(1, 3, 1)} AS y, {_part(2, 2, 2)} AS mo, {_part(3, 1, 3)} AS d, {_part(4, 4, 4)} AS h, {_part(5, 5, 5)} AS mi, {_part(6, 6, 6)} AS s, {_part(7, 0, 7)} AS fr, lower({_part(8, 7, 0)}) AS ap
  FROM z WHERE NOT counted
), n AS (
  SELECT *, CASE WHEN mo ~ '^[A-Z]' THEN (strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(mo[1:3])) + 2) // 3 ELSE mo::INT END AS m,
    CASE WHEN ap = '' THEN h::INT WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE WHEN ap = 'p' THEN 12 ELSE 0 END ELSE 99 END AS hh FROM f WHERE y <> ''
), l AS (
  SELECT *, epoch_us(TRY_CAST(printf('%s-%02d-%02d', y, m, d::INT) AS TIMESTAMP)) + ((hh * 60 + mi::BIGINT) * 60 + coalesce(nullif(s, '')::BIGINT, 0)) * 1000000 + rpad(fr[1:6], 6, '0')::BIGINT AS us,
    coalesce(named, CASE WHEN coalesce(src, '') <> 'embedded' THEN site_zone END, 'UTC') AS zone
  FROM n WHERE hh < 24 AND mi::INT < 60 AND coalesce(nullif(s, '')::INT, 0) < 60
), t AS (
  SELECT *, us - {_shift('us - 86400000000')} AS before, us - {_shift('us + 86400000000')} AS later FROM l WHERE us IS NOT NULL
)
SELECT id AS source_id, CASE WHEN minutes IS NOT NULL THEN us - minutes::BIGINT * 60000000
    WHEN before + {_shift('before')} <> us AND later + {_shift('later')} = us THEN later ELSE before END AS capture_utc_us FROM t
UNION SELECT id, v::BIGINT * CASE length(v) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END FROM z WHERE counted
"""

# Each source's mixture in closed form: values with one reading decide, and those with two follow their smoothed proportion.
_P3_READ = rf"""
WITH v AS (
  SELECT id, regexp_replace(capture_time, {_BLANK}, '', 'g') AS v, coalesce(lower(regexp_replace(capture_time_source, {_BLANK}, '', 'g')), '') AS src, site_zone
  FROM source_assets LEFT JOIN camera_sites USING (source_identifier)
{_P3[_P3.index('), z AS ('):_P3.index(', l AS (')]}, w AS (
  SELECT *, hh < 24 AND mi::INT < 60 AND coalesce(nullif(s, '')::INT, 0) < 60 AS timed, regexp_matches(core, {_B}) AND mo !~ '^[A-Z]' AS numeric_ FROM n
), r AS (
  SELECT *, timed AND TRY_CAST(printf('%s-%02d-%02d', y, m, d::INT) AS TIMESTAMP) IS NOT NULL AS first_,
    timed AND numeric_ AND TRY_CAST(printf('%s-%02d-%02d', y, d::INT, m) AS TIMESTAMP) IS NOT NULL AS turned FROM w
), share AS (
  SELECT src, count(*) FILTER (first_ AND NOT turned) AS a, count(*) FILTER (turned AND NOT first_) AS b FROM r WHERE numeric_ GROUP BY src
), c AS (
  SELECT r.*, CASE WHEN first_ AND turned THEN (greatest(a, b) + {SMOOTHING}) / (a + b + 2 * {SMOOTHING}) ELSE 1.0 END AS posterior,
    CASE WHEN first_ AND (NOT turned OR a >= b) THEN CASE WHEN numeric_ THEN 'dmy' WHEN mo ~ '^[A-Z]' THEN 'day_month_name' WHEN regexp_matches(core, {_A}) THEN 'ymd' ELSE 'compact' END WHEN turned THEN 'mdy' END AS format
  FROM r LEFT JOIN share USING (src) WHERE first_ OR turned
), l AS (
  SELECT *, epoch_us(CASE WHEN format = 'mdy' THEN printf('%s-%02d-%02d', y, d::INT, m) ELSE printf('%s-%02d-%02d', y, m, d::INT) END::TIMESTAMP) + ((hh * 60 + mi::BIGINT) * 60 + coalesce(nullif(s, '')::BIGINT, 0)) * 1000000 AS us,
    coalesce(named, CASE WHEN src <> 'embedded' THEN site_zone END, 'UTC') AS zone FROM c
), t AS (
  SELECT *, us - {_shift('us - 86400000000')} AS before, us - {_shift('us + 86400000000')} AS later FROM l
), o AS (
  SELECT id, format, posterior, minutes IS NULL AND later > before AND before + {_shift('before')} = us AND later + {_shift('later')} = us AS twice FROM t
  UNION ALL SELECT id, CASE length(v) WHEN 10 THEN 'epoch_s' WHEN 13 THEN 'epoch_ms' ELSE 'epoch_us' END, 1.0, false FROM z WHERE counted
), every AS (
  SELECT id, format, CASE WHEN posterior >= 0.95 AND NOT twice THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN posterior < 0.95 THEN 'format' WHEN twice THEN 'zone' END AS ambiguity FROM o
  UNION ALL SELECT id, 'none', 'unreadable', NULL FROM (SELECT id, capture_time, capture_time_source, source_identifier FROM source_assets
    WHERE capture_time IS NULL OR (id, regexp_replace(capture_time, {_BLANK}, '', 'g')) NOT IN (SELECT (id, v) FROM c UNION ALL SELECT (id, v) FROM z WHERE counted))
)
SELECT format, status, ambiguity, count(DISTINCT id) AS n_assets FROM every GROUP BY ALL
"""

ORACLES = {
    "p3_found": _P3,
    "p3_interpretations": _P3_READ,
    "p2_found": _P2 + "SELECT table_name, row_id, month_utc, cause FROM found",
    "p2_orphans_by_period": _P2 + "SELECT table_name, month_utc, cause, count(*) AS n_rows FROM found GROUP BY ALL",
    "p5_found": f"""
WITH v AS (
  SELECT DISTINCT {_plain('source_id')} AS source_id, start_ms AS s, end_ms AS e FROM video_selections
  WHERE start_ms >= 0 AND end_ms > start_ms
), o AS (
  SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM v WHERE source_id IS NOT NULL
), i AS (
  SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM o
), p AS (SELECT source_id, n, min(s) AS s, max(e) AS e FROM i GROUP BY source_id, n),
g AS (SELECT source_id, e AS s, lead(s) OVER (PARTITION BY source_id ORDER BY n) AS e FROM p)
SELECT source_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT source_id, 'gap', s, e FROM g WHERE e IS NOT NULL
""",
}
