"""Queries that find duplicates among review inputs and rasters and choose representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.hashing import hamming, hex16
from frameloom.operators.components import connected_components
from frameloom.operators.replay import group_digests
from frameloom.operators.similarity import exact_edges, group_members, near_pairs, ssim, ssim_sums
from frameloom.queries import quality, views
from frameloom.session import cut
from frameloom.sources.tables import read_table


def review_assets(spark: SparkSession, folder: str) -> DataFrame:
    """The newest analysis of every asset in the shape that the similarity operators take."""
    digits = F.regexp_extract(F.lower(F.btrim("perceptual_hash")), "^(?:0x)?0*([0-9a-f]{1,15}|[0-7][0-9a-f]{15})$", 1)
    groups = views.assets(spark, folder).select(F.lower("id").alias("source_id"), "source_group")
    rows = views.metrics(spark, folder).select(
        "asset_key", F.lower(F.btrim("source_id")).alias("source_id"), F.col("video_offset_ms").alias("offset_ms"), F.col("content_sha256").alias("digest"),
        F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("bigint").alias("hash"), F.coalesce("pinned", F.lit(False)).alias("locked"), quality.score().alias("quality"),
    )
    return rows.join(groups, "source_id", "left")


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of assets with the same digest: id, size, first and last member."""
    rows = review_assets(spark, folder).where("digest is not null and digest <> ''")
    # Digests that one asset has make no group, and needn't be sorted.
    several = rows.groupBy("digest").agg((F.min("asset_key") < F.max("asset_key")).alias("several")).where("several")
    return group_digests(rows.join(several, "digest", "left_semi"), "digest", "asset_key").select("group_id", "n_members", "first_key", "last_key")


def _near(scope: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return near_pairs(review_assets(spark, folder), scope=scope)

    query.__doc__ = f"Pairs of assets with near hashes and different digests in one {scope}, by the comparison window."
    return query


def similarity_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and near duplicates per source group: id, representative and score of every member."""
    assets = cut(review_assets(spark, folder))
    near = near_pairs(assets, scope="source_group")
    bits = assets.select("asset_key", "hash")
    scored = near.join(bits.toDF("a", "ha"), "a").join(bits.toDF("b", "hb"), "b").select("a", "b", F.round(1 - hamming(F.col("ha"), F.col("hb")) / 63, 6).alias("score"))
    edges = cut(exact_edges(assets).unionByName(scored))
    roots = connected_components(edges).toDF("asset_key", "root")
    return group_members(assets.join(roots, "asset_key"), edges)


def asset_hex_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of every asset in its usual spelling."""
    return review_assets(spark, folder).where("hash is not null").select("asset_key", hex16(F.col("hash")).alias("hash16"))


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    """Rasters, their inverted and brightened variants, and a hash of which pixels are over the upper median."""
    base = quality.pixels(spark, folder)
    variants = F.array(
        F.struct((F.col("vec_id") * 10).alias("id"), F.col("px").alias("px")),
        F.when(F.col("vec_id") % 5 == 0, F.struct((F.col("vec_id") * 10 + 1).alias("id"), F.transform("px", lambda v: F.least(F.lit(255), v + 6)).alias("px"))),
        F.when(F.col("vec_id") % 5 <= 1, F.struct((F.col("vec_id") * 10 + 2).alias("id"), F.transform("px", lambda v, i: F.when(i == F.col("vec_id") % 64, 255 - v).otherwise(v)).alias("px"))),
    )
    rows = base.select("label", F.explode(F.array_compact(variants)).alias("r")).select("label", "r.id", "r.px")
    upper = F.array_sort("px")[32]
    bit = lambda v, i: F.when((v > F.col("median")) & (i < 63), F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return rows.withColumn("median", upper).withColumn("hash", F.aggregate(F.transform("px", bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def raster_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of every raster and variant."""
    return _hashed(spark, folder).select("id", "median", "hash")


def raster_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rasters of one label with near hashes, and their structural similarity."""
    rows = cut(_hashed(spark, folder))
    assets = rows.select(F.format_string("%012d", "id").alias("asset_key"), F.lit("x").alias("source_id"), F.col("label").cast("string").alias("source_group"), F.lit(None).cast("bigint").alias("offset_ms"), F.lit(None).cast("string").alias("digest"), "hash")
    pairs = near_pairs(assets, scope="source_group").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    px = rows.select("id", "px", ssim_sums(F.col("px")).alias("sums"))
    both = pairs.join(px.toDF("a", "pa", "ta"), "a").join(px.toDF("b", "pb", "tb"), "b")
    return both.select("a", "b", F.round(ssim(F.col("pa"), F.col("pb"), F.col("ta"), F.col("tb")), 5).alias("ssim"))


def near_raster_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of rasters that both stages take for near copies."""
    return raster_pairs(spark, folder).where("ssim >= 0.94")


def vector_pairs_per_label(spark: SparkSession, folder: str) -> DataFrame:
    """How many vectors and comparisons each label has, to judge a scope before it is compared."""
    counts = read_table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("n_vectors"))
    return counts.select("label", "n_vectors", F.floor(F.col("n_vectors") * (F.col("n_vectors") - 1) / 2).alias("n_pairs"))


QUERIES = {f.__name__: f for f in (exact_duplicates, similarity_groups, asset_hex_hash, raster_hashes, raster_pairs, near_raster_pairs, vector_pairs_per_label)} | {f"near_duplicate_edges_{s}": _near(s) for s in ("source", "source_group", "project")}

_R = f"""{views.ASSETS}, {views.METRICS}, r AS (SELECT asset_key, lower(trim(m.source_id)) AS source_id, a.source_group, video_offset_ms AS offset_ms, content_sha256 AS digest,
  CASE WHEN x <> '' THEN ('0x' || x)::UBIGINT::BIGINT END AS hash, coalesce(pinned, false) AS locked, coalesce({quality.SCORE.replace('width', 'm.width').replace('height', 'm.height')}, '-inf'::DOUBLE) AS quality
  FROM (SELECT *, regexp_extract(lower(trim(perceptual_hash)), '^(0x)?0*([0-9a-f]{{1,15}}|[0-7][0-9a-f]{{15}})$', 2) AS x FROM metrics) m LEFT JOIN assets a ON lower(a.id) = lower(trim(m.source_id)))"""


def _near_sql(part: str) -> str:
    return f"""SELECT least(a.asset_key, b.asset_key) AS a, greatest(a.asset_key, b.asset_key) AS b, bit_count(xor(a.hash, b.hash)) AS d FROM r a JOIN r b ON a.asset_key < b.asset_key AND {part}
      AND NOT coalesce(a.digest = b.digest, false) AND bit_count(xor(a.hash, b.hash)) <= 8 AND NOT coalesce(a.source_id = b.source_id AND abs(a.offset_ms - b.offset_ms) > 30000, false)"""


_ID = "'sim-' || left(sha256('similarity-v1' || array_to_string(keys, '')), 12)"
_H = f"""{quality._PX}, v AS (SELECT vec_id * 10 AS id, label, px FROM px UNION ALL SELECT vec_id * 10 + 1, label, list_transform(px, lambda x: least(255, x + 6)) FROM px WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id * 10 + 2, label, list_transform(px, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN 255 - x ELSE x END) FROM px WHERE vec_id % 5 <= 1),
  h AS (SELECT id, label, px, list_sort(px)[33] AS median FROM v), k AS (SELECT *, list_sum(list_transform(px, lambda x, i: CASE WHEN x > median AND i < 64 THEN 1::BIGINT << (i - 1)::INT ELSE 0 END))::BIGINT AS hash FROM h)"""
_SSIM = f"""WITH {_H}, pr AS (SELECT a.id AS a, b.id AS b, unnest(a.px)::DOUBLE AS x, unnest(b.px)::DOUBLE AS y FROM k a JOIN k b ON a.id < b.id AND a.label = b.label AND bit_count(xor(a.hash, b.hash)) <= 8),
  s AS (SELECT a, b, round((2 * avg(x) * avg(y) + 6.5025) * (2 * covar_samp(x, y) + 58.5225) / ((avg(x) ** 2 + avg(y) ** 2 + 6.5025) * (var_samp(x) + var_samp(y) + 58.5225)), 5) AS ssim FROM pr GROUP BY ALL)"""

ORACLES = {
    "exact_duplicates": f"WITH {_R} SELECT {_ID} AS group_id, len(keys)::INT AS n_members, keys[1] AS first_key, keys[-1] AS last_key FROM (SELECT digest, list_sort(list(DISTINCT asset_key)) AS keys FROM r WHERE digest <> '' GROUP BY digest) WHERE len(keys) > 1",
    "near_duplicate_edges_source": f"WITH {_R} SELECT a, b FROM ({_near_sql('a.source_id = b.source_id')})",
    "near_duplicate_edges_source_group": f"WITH {_R} SELECT a, b FROM ({_near_sql('a.source_group = b.source_group')})",
    "near_duplicate_edges_project": f"WITH {_R} SELECT a, b FROM ({_near_sql('true')})",
    "similarity_groups": f"""WITH RECURSIVE {_R}, e AS (SELECT a, b, round(1 - d / 63, 6) AS score FROM ({_near_sql('a.source_group = b.source_group')})
        UNION ALL SELECT a.asset_key, b.asset_key, 1.0 FROM r a JOIN r b ON a.digest = b.digest AND a.digest <> '' AND a.asset_key < b.asset_key),
        n AS (SELECT a, b, score FROM e UNION ALL SELECT b, a, score FROM e), reach AS (SELECT DISTINCT a, a AS b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b),
        m AS (SELECT a AS asset_key, min(b) AS root FROM reach GROUP BY a), s AS (SELECT a AS asset_key, max(score) AS score FROM n GROUP BY a),
        o AS (SELECT m.asset_key, root, score, locked, row_number() OVER (PARTITION BY root ORDER BY locked DESC, quality DESC, offset_ms NULLS FIRST, m.asset_key) AS rn FROM m JOIN r USING (asset_key) JOIN s USING (asset_key)),
        g AS (SELECT root, list_sort(list(asset_key)) AS keys, count(*) FILTER (locked) > 1 AS locked_conflict FROM o GROUP BY root)
        SELECT asset_key, {_ID} AS group_id, len(keys) AS n_members, locked_conflict, rn = 1 AS representative, CASE WHEN rn = 1 THEN 1.0 ELSE score END::DOUBLE AS similarity_score FROM o JOIN g USING (root)""",
    "asset_hex_hash": f"WITH {_R} SELECT asset_key, printf('%016x', hash) AS hash16 FROM r WHERE hash IS NOT NULL",
    "raster_hashes": f"WITH {_H} SELECT id, median, hash FROM k",
    "raster_pairs": _SSIM + " SELECT a, b, ssim FROM s",
    "near_raster_pairs": _SSIM + " SELECT a, b, ssim FROM s WHERE ssim >= 0.94",
    "vector_pairs_per_label": "SELECT label, count(*) AS n_vectors, count(*) * (count(*) - 1) // 2 AS n_pairs FROM embeddings GROUP BY label",
}


def raster_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of rasters that both stages take for near copies: id, representative (the brightest), and as the score of a
    member its highest structural similarity."""
    hashed = _hashed(spark, folder).select(F.format_string("%012d", "id").alias("asset_key"), F.col("median").cast("double").alias("quality"), (F.col("id") % 10 == 2).alias("locked"), F.lit(None).cast("bigint").alias("offset_ms"))
    key = lambda c: F.format_string("%012d", c).alias(c)
    edges = cut(near_raster_pairs(spark, folder).select(key("a"), key("b"), F.col("ssim").alias("score")))
    roots = connected_components(edges).toDF("asset_key", "root")
    return group_members(hashed.join(roots, "asset_key"), edges)


QUERIES["raster_groups"] = raster_groups
_NEAR = _SSIM.replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["raster_groups"] = f"""{_NEAR}, e AS (SELECT printf('%012d', a) AS a, printf('%012d', b) AS b, ssim FROM s WHERE ssim >= 0.94), n AS (SELECT a, b, ssim FROM e UNION ALL SELECT b, a, ssim FROM e),
  reach AS (SELECT DISTINCT a, a AS b FROM n UNION SELECT reach.a, n.b FROM reach JOIN n ON n.a = reach.b), m AS (SELECT a AS asset_key, min(b) AS root FROM reach GROUP BY a),
  o AS (SELECT m.asset_key, root, id % 10 = 2 AS locked, (SELECT max(ssim) FROM n WHERE n.a = m.asset_key) AS score,
    row_number() OVER (PARTITION BY root ORDER BY id % 10 = 2 DESC, median DESC, m.asset_key) AS rn FROM m JOIN k ON printf('%012d', k.id) = m.asset_key),
  g AS (SELECT root, list_sort(list(asset_key)) AS keys, count(*) FILTER (locked) > 1 AS locked_conflict FROM o GROUP BY root)
  SELECT asset_key, {_ID} AS group_id, len(keys) AS n_members, locked_conflict, rn = 1 AS representative, CASE WHEN rn = 1 THEN 1.0 ELSE score END::DOUBLE AS similarity_score FROM o JOIN g USING (root)"""
