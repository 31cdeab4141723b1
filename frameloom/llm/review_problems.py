"""Queries over review inputs: near-duplicate frames and the representative of each look-alike group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import plain
from frameloom.llm.neardup import similar_fingerprints
from frameloom.llm.truth import discover_truth
from frameloom.operators.components import connected_components
from frameloom.session import cut
from frameloom.sources.tables import read_table


def _hash_value() -> F.Column:
    """A perceptual hash as a number: hexadecimal text with or without 0x, zeros or blanks; null if it is none."""
    digits = F.regexp_extract(plain(F.col("perceptual_hash")), "^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    # 16 digits may be over 63 bits, and then negative here: those are no perceptual hash.
    value = F.conv(F.nullif(digits, F.lit("")), 16, -10).cast("bigint")
    return F.when(value >= 0, value)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "review_inputs").where(F.col("decode_error").isNull() & F.col("asset_key").isNotNull())


def asset_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(asset_key, h): the hash of every asset, from its newest row that holds one."""
    rows = _rows(spark, folder).select("asset_key", "analyzed_at", _hash_value().alias("h")).where("h is not null")
    return rows.groupBy("asset_key").agg(F.max(F.struct("analyzed_at", "h")).alias("v")).select("asset_key", "v.h")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of different assets whose hashes differ in at most 8 bits."""
    assets = cut(asset_hashes(spark, folder))
    pairs = similar_fingerprints(assets, "h")
    left = assets.select(F.col("h").alias("a"), F.col("asset_key").alias("x"))
    right = assets.select(F.col("h").alias("b"), F.col("asset_key").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where("a <> b or x < y")
    return both.select(F.least("x", "y").alias("asset_key_a"), F.greatest("x", "y").alias("asset_key_b"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every asset with a hash: its class (the smallest key of the same hash), how many assets the class has, and how
    many assets of any class are near copies of it; copies are counted and not expanded into pairs."""
    assets = cut(asset_hashes(spark, folder))
    classes = assets.groupBy("h").agg(F.min("asset_key").alias("class_key"), F.count("*").alias("n_copies"))
    pairs = similar_fingerprints(assets, "h").where("a <> b")
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = sides.join(classes.select(F.col("h").alias("b"), "n_copies"), "b").groupBy(F.col("a").alias("h")).agg(F.sum("n_copies").alias("n_near"))
    counted = classes.join(links, "h", "left").select("h", "class_key", "n_copies", (F.col("n_copies") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_links"))
    return assets.join(counted, "h").select("asset_key", "class_key", "n_copies", "n_links")


def look_alike_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(asset_key, root): the assets connected by near copies, directly or over others; root names the group."""
    assets = cut(asset_hashes(spark, folder))
    roots = connected_components(similar_fingerprints(assets, "h")).select(F.col("node").alias("h"), "root")
    return assets.join(roots, "h", "left").select("asset_key", F.coalesce("root", "h").alias("root"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """What the runs say of pinned, sharpness and entropy of an asset; the run is the source."""
    measure = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c).cast("string"))
    fields = F.array(
        F.struct(F.lit("pinned").alias("field"), F.col("pinned").cast("string").alias("value")),
        F.struct(F.lit("sharpness").alias("field"), measure("sharpness").alias("value")),
        F.struct(F.lit("entropy").alias("field"), measure("entropy").alias("value")),
    )
    return (
        _rows(spark, folder)
        .select(F.col("asset_key").alias("entity"), F.col("analyzed_at").cast("string").alias("source"), F.col("analyzed_at").alias("made_at"), F.explode(fields).alias("f"))
        .select("entity", "f.field", "f.value", "source", "made_at")
        .where("value is not null")
    )


def _plain_number(value: F.Column) -> F.Column:
    """Numbers with six decimals; other values as they are."""
    number = F.expr("try_cast(value as double)")
    return F.when(number.isNotNull(), F.format_string("%.6f", number)).otherwise(value)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The representative of every look-alike group of two or more assets.

    The value of each field of an asset is found by truth discovery with recency as the prior of the votes: the problem
    asks for the newest value, and where newest rows of an asset contradict each other, the runs that made its other
    rows decide between their values by votes, weighed by how often they agree with what is found elsewhere. The
    group then prefers pinned true, greater sharpness, greater entropy, smaller key.
    """
    values = (
        discover_truth(_claims(spark, folder), newest_first=True)
        .groupBy(F.col("entity").alias("asset_key"))
        .agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("pinned", "sharpness", "entropy")])
    )
    members = look_alike_groups(spark, folder).join(values, "asset_key", "left")
    # A missing value is under every other one; the smallest of these structs is the best asset.
    worth = F.struct(
        F.when(F.col("pinned") == "true", 0).otherwise(1).alias("o"),
        *[-F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in ("sharpness", "entropy")],
        F.col("asset_key").alias("key"),
    )
    return (
        members.groupBy("root")
        .agg(F.min("asset_key").alias("group_key"), F.min(worth).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("group_key", F.col("best.key").alias("survivor_key"))
    )


def p4_golden_values(spark: SparkSession, folder: str) -> DataFrame:
    """The record built for every look-alike group, field by field: the value with the highest support, where the
    runs vote by their reliability over all members."""
    groups = look_alike_groups(spark, folder)
    names = groups.groupBy("root").agg(F.min("asset_key").alias("group_key"), F.count("*").alias("n")).where("n > 1")
    members = groups.join(names, "root").select(F.col("asset_key").alias("entity"), "group_key")
    claims = _claims(spark, folder).join(members, "entity").drop("entity").withColumnRenamed("group_key", "entity")
    found = discover_truth(claims.withColumn("value", _plain_number(F.col("value"))))
    return found.select(F.col("entity").alias("group_key"), "field", "value", "support", "disputed", "converged")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p4_found": p4_found, "p4_golden_values": p4_golden_values}

_VALUES = r"""
WITH RECURSIVE rows AS (
  SELECT * FROM review_inputs WHERE decode_error IS NULL
), parsed AS (
  SELECT asset_key, analyzed_at, regexp_extract(lower(trim(perceptual_hash, E' \t\n\r')), '^(0x)?([0-9a-f]+)$', 2) AS x FROM rows
), hashes AS (
  SELECT asset_key, arg_max(('0x' || x)::UBIGINT, analyzed_at) AS h FROM parsed WHERE x <> '' GROUP BY asset_key
), distinct_hashes AS (SELECT DISTINCT h FROM hashes),
hash_pairs AS (
  SELECT a.h AS a, b.h AS b FROM distinct_hashes a JOIN distinct_hashes b ON a.h < b.h AND bit_count(xor(a.h, b.h)::BIGINT) <= 8
), pairs AS (
  SELECT least(x.asset_key, y.asset_key) AS asset_key_a, greatest(x.asset_key, y.asset_key) AS asset_key_b
  FROM hash_pairs p JOIN hashes x ON x.h = p.a JOIN hashes y ON y.h = p.b
  UNION ALL SELECT x.asset_key, y.asset_key FROM hashes x JOIN hashes y ON x.h = y.h AND x.asset_key < y.asset_key
)
"""

_GROUPS = """, links AS (SELECT a, b FROM hash_pairs UNION ALL SELECT b, a FROM hash_pairs UNION ALL SELECT h, h FROM distinct_hashes),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS h, min(b) AS root FROM reach GROUP BY a)"""


def _golden(rounds: int = 24) -> str:
    """Truth discovery with its rounds written out, one after the other; more rounds than these data need."""
    parts = [_VALUES + _GROUPS + """,
members AS (SELECT asset_key, min(asset_key) OVER (PARTITION BY root) AS group_key, count(*) OVER (PARTITION BY root) AS n FROM hashes JOIN roots USING (h)),
raw AS (SELECT group_key AS entity, analyzed_at::VARCHAR AS source, analyzed_at AS "at", unnest(['pinned', 'sharpness', 'entropy']) AS field,
  unnest([pinned::VARCHAR, CASE WHEN sharpness >= 0 AND NOT isnan(sharpness) THEN printf('%.6f', sharpness) END, CASE WHEN entropy >= 0 AND NOT isnan(entropy) THEN printf('%.6f', entropy) END]) AS value
  FROM rows JOIN members USING (asset_key) WHERE n > 1),
claims AS MATERIALIZED (SELECT entity, field, value, source, max("at") AS "at" FROM raw WHERE value IS NOT NULL GROUP BY ALL),
spread AS MATERIALIZED (SELECT entity, field, min(value) < max(value) AS disputed FROM claims GROUP BY ALL),
sources AS MATERIALIZED (SELECT source, count(*) AS n FROM claims GROUP BY source), r0 AS (SELECT source, 0.5::DOUBLE AS r FROM sources)"""]
    for i in range(rounds):
        parts.append(f"""
s{i} AS MATERIALIZED (SELECT entity, field, value, round(sum(-ln(1 - r)), 9) AS support, max("at") AS "at" FROM claims JOIN r{i} USING (source) GROUP BY ALL),
v{i} AS MATERIALIZED (SELECT entity, field, (max({{'s': support, 'a': "at", 'v': value}})).v AS value, (max({{'s': support, 'a': "at", 'v': value}})).s AS support FROM s{i} GROUP BY ALL),
r{i + 1} AS MATERIALIZED (SELECT source, (count(v.value) + 1) / (count(*) + 2) AS r FROM claims c LEFT JOIN v{i} v USING (entity, field, value) GROUP BY source)""")
    return ",".join(parts) + f" SELECT entity AS group_key, field, value, support, disputed, true AS converged FROM v{rounds - 1} JOIN spread USING (entity, field)"


ORACLES = {
    "p4_golden_values": _golden(),
    "p1_found": _VALUES + "SELECT asset_key_a, asset_key_b FROM pairs",
    "p1_classes": _VALUES + """, linked AS (SELECT asset_key_a AS k FROM pairs UNION ALL SELECT asset_key_b FROM pairs),
n AS (SELECT k, count(*) AS n_links FROM linked GROUP BY k)
SELECT asset_key, min(asset_key) OVER (PARTITION BY h) AS class_key, count(*) OVER (PARTITION BY h) AS n_copies, coalesce(n_links, 0) AS n_links
FROM hashes LEFT JOIN n ON k = asset_key""",
    "p4_found": _VALUES + _GROUPS + """,
pins AS (SELECT asset_key, arg_max(pinned, analyzed_at) AS pinned FROM rows WHERE pinned IS NOT NULL GROUP BY asset_key),
sharp AS (SELECT asset_key, arg_max(sharpness, analyzed_at) AS sharpness FROM rows WHERE sharpness >= 0 AND NOT isnan(sharpness) GROUP BY asset_key),
ent AS (SELECT asset_key, arg_max(entropy, analyzed_at) AS entropy FROM rows WHERE entropy >= 0 AND NOT isnan(entropy) GROUP BY asset_key),
ranked AS (
  SELECT root, asset_key, min(asset_key) OVER (PARTITION BY root) AS group_key, count(*) OVER (PARTITION BY root) AS n,
    row_number() OVER (PARTITION BY root ORDER BY coalesce(pinned, false) DESC, sharpness DESC NULLS LAST, entropy DESC NULLS LAST, asset_key) AS r
  FROM hashes JOIN roots USING (h) LEFT JOIN pins USING (asset_key) LEFT JOIN sharp USING (asset_key) LEFT JOIN ent USING (asset_key)
)
SELECT group_key, asset_key AS survivor_key FROM ranked WHERE r = 1 AND n > 1
""",
}
