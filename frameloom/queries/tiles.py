"""Queries over regions of interest: effective profiles and tile plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.text import plain_key
from frameloom.operators.similarity import first_of
from frameloom.plans.tiles import STRATEGIES, plan_tiles, tile_file_name
from frameloom.queries import views
from frameloom.sources.tables import read_table

_CONFIG = "tile struct<tile_width: int, tile_height: int, overlap_x: int, overlap_y: int, edge_strategy: string>, padding string"


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The region profiles without exact copies, their configuration unpacked."""
    rows = read_table(spark, folder, "roi_profiles").select("id", "scope_kind", "scope_value", "name", "x", "y", "width", "height", "render_config_json", "created_at", "updated_at").distinct()
    return rows.withColumn("config", F.from_json("render_config_json", _CONFIG)).select("*", "config.tile.*", "config.padding").drop("config", "render_config_json")


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    return profiles(spark, folder).select(F.col("id").alias("profile_id"), "name", "x", "y", "width", "height", "tile_width", "tile_height", "overlap_x", "overlap_y", "edge_strategy")


_TILE = ["profile_id", "tile_row", "tile_column", "source_x", "source_y", "source_width", "source_height", "padded"]


def tile_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of every profile as it is configured."""
    return plan_tiles(_regions(spark, folder)).select(*_TILE)


def _with_strategy(strategy: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plan_tiles(_regions(spark, folder).withColumn("edge_strategy", F.lit(strategy))).select(*_TILE)

    query.__doc__ = f"The tiles of every profile if edges were treated as {strategy}."
    return query


def _kept(tiles: DataFrame) -> DataFrame:
    keys = ["profile_id", "tile_row", "tile_column"]
    excluded = tiles.where("overlap_x > 0 and tile_row = 0").groupBy("profile_id", "tile_row").agg(F.max("tile_column").alias("tile_column"))
    a, b = tiles.alias("a"), excluded.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left_anti").select(*keys)


def tile_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """The tile plan of the profiles whose tiles overlap, without excluded tiles (here the last column of the first row)."""
    return _kept(plan_tiles(_regions(spark, folder)).where("overlap_x > 0"))


def tile_exclusions_all(spark: SparkSession, folder: str) -> DataFrame:
    """The tile plan of every profile without excluded tiles (here the last column of the first row of profiles whose tiles overlap)."""
    return _kept(plan_tiles(_regions(spark, folder)))


def tile_names(spark: SparkSession, folder: str) -> DataFrame:
    """The file name of every preview tile."""
    tiles = plan_tiles(_regions(spark, folder))
    return tiles.select("profile_id", tile_file_name(F.col("profile_id"), F.col("tile_row"), F.col("tile_column")).alias("file_name"))


def tile_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles, padded tiles and covered pixels per edge strategy."""
    return plan_tiles(_regions(spark, folder)).groupBy("edge_strategy").agg(F.count("*").alias("n_tiles"), F.count_if("padded").alias("n_padded"), F.sum(F.col("source_width").cast("bigint") * F.col("source_height")).alias("pixels"))


def roi_effective_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles that hold for every asset: its own shadow those of its group that have the same name."""
    rows = profiles(spark, folder).withColumn("scope", plain_key(F.col("scope_value"))).withColumn("low_name", F.lower("name")).where("scope is not null")
    sources = views.assets(spark, folder).select(F.col("id").alias("source_id"), F.lower("id").alias("own"), plain_key(F.col("source_group")).alias("group_key"))
    picked = ["source_id", "low_name", "id", "updated_at"]
    own = sources.join(rows.where("scope_kind = 'source'"), F.col("own") == F.col("scope")).select(*picked, F.lit(0).alias("inherited"))
    shared = sources.join(rows.where("scope_kind = 'source_group'"), F.col("group_key") == F.col("scope")).select(*picked, F.lit(1).alias("inherited"))
    best = first_of(own.unionByName(shared), ["source_id", "low_name"], [F.col("inherited"), F.desc("updated_at"), F.col("id")])
    return best.select("source_id", "low_name", F.col("id").alias("profile_id"), (F.col("inherited") == 1).alias("inherited"))


def roi_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a profile of an asset lies inside its picture; null sizes can't be judged."""
    rows = profiles(spark, folder).where("scope_kind = 'source'").withColumn("source_key", plain_key(F.col("scope_value")))
    sources = views.assets(spark, folder).select(F.lower("id").alias("source_key"), F.col("width").alias("w"), F.col("height").alias("h"))
    inside = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("x").cast("bigint") + F.col("width") <= F.col("w")) & (F.col("y").cast("bigint") + F.col("height") <= F.col("h"))
    return rows.join(sources, "source_key").select(F.col("id").alias("profile_id"), "source_key", inside.alias("inside"))


QUERIES = {f.__name__: f for f in (tile_plan, tile_exclusions, tile_exclusions_all, tile_names, tile_totals, roi_effective_profiles, roi_validity)} | {f"tile_plan_{s}": _with_strategy(s) for s in STRATEGIES}

_PROFILES = r"""profiles AS (SELECT *, (j->'tile'->>'tile_width')::INT AS tile_width, (j->'tile'->>'tile_height')::INT AS tile_height, (j->'tile'->>'overlap_x')::INT AS overlap_x,
  (j->'tile'->>'overlap_y')::INT AS overlap_y, j->'tile'->>'edge_strategy' AS edge_strategy FROM
  (SELECT DISTINCT id AS profile_id, scope_kind, scope_value, name, x, y, width, height, render_config_json::JSON AS j, created_at, updated_at FROM roi_profiles))"""


def _axis(length: str, tile: str, overlap: str, strategy: str) -> str:
    """Tile starts of one axis, by walking instead of by a closed form."""
    return f"""list_filter(list_distinct(list_transform(generate_series(0, greatest({length} - 1, 0), {tile} - {overlap}), lambda p:
      CASE WHEN {length} <= {tile} THEN CASE WHEN p = 0 AND NOT ({strategy} = 'discard' AND {length} < {tile}) THEN 0 ELSE -1 END
           WHEN {strategy} = 'discard' THEN CASE WHEN p + {tile} <= {length} THEN p ELSE -1 END
           WHEN {strategy} = 'pad' THEN p
           WHEN p + {tile} < {length} THEN p ELSE {length} - {tile} END)), lambda p: p >= 0)"""


def _tiles(strategy: str) -> str:
    return f"""{_PROFILES}, ys AS (SELECT *, {strategy} AS strategy, list_sort({_axis('height', 'tile_height', 'overlap_y', strategy)}) AS ys, list_sort({_axis('width', 'tile_width', 'overlap_x', strategy)}) AS xs FROM profiles),
      r AS (SELECT *, unnest(generate_series(1, len(ys))) AS ri FROM ys WHERE len(ys) > 0), c AS (SELECT *, unnest(generate_series(1, len(xs))) AS ci FROM r WHERE len(xs) > 0),
      tiles AS (SELECT *, (ri - 1)::INT AS tile_row, (ci - 1)::INT AS tile_column, x + xs[ci] AS source_x, y + ys[ri] AS source_y, least(tile_width, width - xs[ci]) AS source_width,
        least(tile_height, height - ys[ri]) AS source_height FROM c)"""


def _tile_rows(strategy: str) -> str:
    return f"WITH {_tiles(strategy)} SELECT profile_id, tile_row, tile_column, source_x, source_y, source_width, source_height, source_width < tile_width OR source_height < tile_height AS padded FROM tiles"


_SCOPE = views.PLAIN.replace("source_id", "scope_value")

ORACLES = {
    "tile_plan": _tile_rows("edge_strategy"),
    **{f"tile_plan_{s}": _tile_rows(f"'{s}'") for s in STRATEGIES},
    "tile_exclusions": f"WITH {_tiles('edge_strategy')}, t AS (SELECT *, max(tile_column) OVER (PARTITION BY profile_id, tile_row) AS last FROM tiles WHERE overlap_x > 0) SELECT profile_id, tile_row, tile_column FROM t WHERE NOT (tile_row = 0 AND tile_column = last)",
    "tile_exclusions_all": f"WITH {_tiles('edge_strategy')}, t AS (SELECT *, max(tile_column) OVER (PARTITION BY profile_id, tile_row) AS last FROM tiles) SELECT profile_id, tile_row, tile_column FROM t WHERE NOT (coalesce(overlap_x > 0, false) AND tile_row = 0 AND tile_column = last)",
    "tile_names": f"WITH {_tiles('edge_strategy')} SELECT profile_id, printf('%s-r%04d-c%04d.jpg', profile_id, tile_row, tile_column) AS file_name FROM tiles",
    "tile_totals": f"WITH {_tiles('edge_strategy')} SELECT edge_strategy, count(*) AS n_tiles, count(*) FILTER (source_width < tile_width OR source_height < tile_height) AS n_padded, sum(source_width::BIGINT * source_height)::BIGINT AS pixels FROM tiles GROUP BY ALL",
    "roi_effective_profiles": f"""WITH {views.ASSETS}, {_PROFILES}, p AS (SELECT *, {_SCOPE} AS scope, lower(name) AS low_name FROM profiles), b AS (
        SELECT a.id AS source_id, low_name, profile_id, updated_at, false AS inherited FROM assets a JOIN p ON scope_kind = 'source' AND scope = lower(a.id)
        UNION ALL SELECT a.id, low_name, profile_id, updated_at, true FROM assets a JOIN p ON scope_kind = 'source_group' AND scope = lower(trim(a.source_group)))
        SELECT source_id, low_name, profile_id, inherited FROM (SELECT *, row_number() OVER (PARTITION BY source_id, low_name ORDER BY inherited, updated_at DESC, profile_id) AS rn FROM b) WHERE rn = 1""",
    "roi_validity": f"""WITH {views.ASSETS}, {_PROFILES} SELECT profile_id, lower(a.id) AS source_key, p.width > 0 AND p.height > 0 AND p.x + p.width <= a.width AND p.y + p.height <= a.height AS inside
        FROM profiles p JOIN assets a ON p.scope_kind = 'source' AND {_SCOPE} = lower(a.id)""",
}
