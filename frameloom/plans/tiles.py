"""Tile plans: grids of equal windows over a region of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("discard", "pad", "shift_to_edge")


def axis_positions(length: Column, tile: Column, overlap: Column, strategy: Column) -> Column:
    """The tile starts along one axis, ascending.

    With a step of tile - overlap: ``discard`` keeps whole tiles only, ``pad`` goes on while a tile starts inside,
    ``shift_to_edge`` moves the last tile back to end at the edge. A length within one tile has one tile at 0, or
    none if it is shorter and tiles that don't fit are discarded. Null for overlaps not under the tile, or sizes
    under 1.
    """
    step = tile - overlap
    valid = (length >= 0) & (tile > 0) & (overlap >= 0) & (step > 0)
    count = (
        F.when(length == 0, 0)
        .when(length <= tile, F.when((strategy == "discard") & (length < tile), 0).otherwise(1))
        .when(strategy == "discard", F.floor((length - tile) / step) + 1)
        .when(strategy == "pad", F.ceil(length / step))
        .when(strategy == "shift_to_edge", F.ceil((length - tile) / step) + 1)
    )
    count = F.when(valid, count).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: i * step)
    shifted = F.transform(starts, lambda p: F.when(length > tile, F.least(p, length - tile)).otherwise(p))
    return F.slice(F.when(strategy == "shift_to_edge", shifted).otherwise(starts), 1, count)


def plan_tiles(regions: DataFrame) -> DataFrame:
    """One row per tile of every region, row by row.

    ``regions`` has x, y, width, height, tile_width, tile_height, overlap_x, overlap_y and edge_strategy; its other
    columns are kept. Added: tile_row, tile_column (from 0), source_x, source_y, source_width, source_height (the part
    of the tile that lies in the region) and padded. Regions with an invalid size or overlap have no tiles.
    """
    names = regions.columns
    c = F.col
    strategy = c("edge_strategy")
    rows = regions.select("*", F.posexplode(axis_positions(c("height"), c("tile_height"), c("overlap_y"), strategy)).alias("tile_row", "top"))
    tiles = rows.select("*", F.posexplode(axis_positions(c("width"), c("tile_width"), c("overlap_x"), strategy)).alias("tile_column", "left_edge"))
    width = F.least(c("tile_width"), c("width") - c("left_edge"))
    height = F.least(c("tile_height"), c("height") - c("top"))
    return tiles.select(
        *names, "tile_row", "tile_column", (c("x") + c("left_edge")).alias("source_x"), (c("y") + c("top")).alias("source_y"),
        width.alias("source_width"), height.alias("source_height"),
        ((width < c("tile_width")) | (height < c("tile_height"))).alias("padded"),
    )


def tile_file_name(profile: Column, row: Column, column: Column) -> Column:
    """The name of a preview tile."""
    return F.format_string("%s-r%04d-c%04d.jpg", profile, row, column)
