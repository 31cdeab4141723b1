"""Queries that run the image kernels over rasters, and read image headers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import kernels
from frameloom.plans.tiles import plan_tiles
from frameloom.queries import quality, similarity, tiles, views
from frameloom.session import ship_package
from frameloom.sources.images import inspect_images

#: Rasters are rows of so many pixels here; the kernels take any size.
WIDTH = 8


def _image(px, width: int = WIDTH) -> np.ndarray:
    return np.asarray(px, np.uint8).reshape(-1, width)


def raster_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Size and quality of every raster by the kernel that measures decoded images."""
    ship_package(spark)
    names = ("width", "height", "sharpness", "underexposed_ratio", "overexposed_ratio", "entropy", "low_information")

    @F.pandas_udf("width int, height int, " + ", ".join(f"{n} double" for n in names[2:]))
    def measure(px: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{n: q[n] for n in names} for q in map(kernels.quality, map(_image, px))], columns=list(names))

    rows = quality.pixels(spark, folder).select("vec_id", measure("px").alias("q"))
    rounded = [F.round(F.col(f"q.{n}") + (1e-7 if n == "sharpness" else 0), 3 if n == "sharpness" else 6).alias(n) for n in names[2:]]
    return rows.select("vec_id", "q.width", "q.height", *rounded)


def raster_turned(spark: SparkSession, folder: str) -> DataFrame:
    """Every raster turned upright by an orientation tag, here its id modulo 9 (0 is no tag): its pixels' digest."""
    ship_package(spark)

    @F.pandas_udf("string")
    def turned(px: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(np.ascontiguousarray(kernels.orient(_image(p), int(t))).tobytes()).hexdigest() for p, t in zip(px, tag, strict=True)])

    return quality.pixels(spark, folder).select("vec_id", (F.col("vec_id") % 9).alias("tag"), turned("px", F.col("vec_id") % 9).alias("digest"))


#: The region and the tiles that are cut out of a raster of 8 by 8: the last ones reach over the edge.
REGION, TILE, OVERLAP = (1, 2, 6, 5), (4, 3), (1, 0)


def raster_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of a region of every raster with each padding, rendered: the digest of their pixels."""
    ship_package(spark)
    whole = {
        "x": REGION[0], "y": REGION[1], "width": REGION[2], "height": REGION[3], "tile_width": TILE[0], "tile_height": TILE[1], "overlap_x": OVERLAP[0], "overlap_y": OVERLAP[1], "edge_strategy": "pad",
    }

    @F.pandas_udf("string")
    def rendered(px: pd.Series, x: pd.Series, y: pd.Series, padding: pd.Series) -> pd.Series:
        made = [kernels.render_tile(_image(p), REGION, (int(i), int(j), *TILE), kind, (7,)) for p, i, j, kind in zip(px, x, y, padding, strict=True)]
        return pd.Series([hashlib.sha256(np.ascontiguousarray(m).tobytes()).hexdigest() for m in made])

    rows = plan_tiles(quality.pixels(spark, folder).withColumns({k: F.lit(v) for k, v in whole.items()}))
    kinds = rows.withColumn("padding", F.explode(F.array(*map(F.lit, ("constant", "edge", "reflect")))))
    return kinds.select("vec_id", "tile_row", "tile_column", "padding", rendered("px", "source_x", "source_y", "padding").alias("digest"))


def raster_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every raster encoded, decoded and measured from its file: whether all pixels come back, and the decode errors of
    files cut short (here those of every fifth raster)."""
    ship_package(spark)

    @F.pandas_udf("binary")
    def encoded(px: pd.Series) -> pd.Series:
        return pd.Series([kernels.encode_png(_image(p)) for p in px])

    @F.pandas_udf("boolean")
    def same(px: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([bool((kernels.decode_png(bytes(d))[:, :, 0] == _image(p)).all()) for p, d in zip(px, data, strict=True)])

    rows = quality.pixels(spark, folder).withColumn("data", encoded("px"))
    cut_short = F.when(F.col("vec_id") % 5 == 0, F.substring("data", 1, 40)).otherwise(F.col("data"))
    return rows.select("vec_id", same("px", "data").alias("same"), kernels.measure_images()(cut_short)["decode_error"].isNotNull().alias("failed"))


def raster_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The perceptual hash of every raster, by resampling and cosine transform."""
    ship_package(spark)

    @F.pandas_udf("bigint")
    def fingerprint(px: pd.Series) -> pd.Series:
        return pd.Series([kernels.perceptual_hash(_image(p)) for p in px])

    return quality.pixels(spark, folder).select("vec_id", fingerprint("px").alias("hash"))


def raster_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """The structural similarity of near rasters as the kernel for images of any two sizes gives it."""
    ship_package(spark)

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kernels.global_ssim(_image(p), _image(q)) for p, q in zip(a, b, strict=True)])

    px = similarity._hashed(spark, folder).select("id", "px")
    pairs = similarity.raster_pairs(spark, folder).select("a", "b")
    both = pairs.join(px.toDF("a", "pa"), "a").join(px.toDF("b", "pb"), "b")
    return both.select("a", "b", F.round(compared("pa", "pb"), 5).alias("ssim"))


def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Size, orientation and capture time out of the headers of image files, written here from the catalogue's rows."""
    ship_package(spark)
    hexed = lambda value, width: F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    time = F.coalesce("capture_time", F.lit(""))
    text = F.concat(F.hex(F.encode(time, "utf-8")), F.lit("00"))
    length = F.octet_length(F.encode(time, "utf-8")) + 1
    # One directory with two tags, both values behind it; texts of up to four bytes would stand in the tag itself.
    padded = F.concat(text, F.lit("0000000000"))
    block = F.concat(
        F.lit("4D4D002A00000008" + "0002" + "01120003" + "00000001"), hexed(F.coalesce("orientation", F.lit(1)), 2), F.lit("0000" + "01320002"), hexed(length + 5, 4), F.lit("00000026" + "00000000"), padded
    )
    app = F.concat(F.lit("457869660000"), block)
    jpeg = F.concat(
        F.lit("FFD8FFE1"), hexed(F.length(app) / 2 + 2, 2), app, F.lit("FFC0000B08"), hexed(F.col("height"), 2), hexed(F.col("width"), 2), F.lit("01011100")
    )
    rows = views.assets(spark, folder).where("kind = 'image' and width is not null and height is not null")
    return rows.select("id", inspect_images()(F.unhex(jpeg)).alias("f")).select("id", "f.width", "f.height", "f.orientation", "f.capture_time", "f.error")


def canvas_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The size of each profile's tiles after each way of fitting them to the output: a canvas has that size before, so
    all ways leave it."""
    modes = F.explode(F.array(*map(F.lit, ("stretch", "fit", "fill", "long_side")))).alias("mode")
    rows = tiles.profiles(spark, folder).select(F.col("id").alias("profile_id"), "tile_width", "tile_height").distinct()
    return rows.select("profile_id", modes, F.col("tile_width").alias("width"), F.col("tile_height").alias("height"))


QUERIES = {f.__name__: f for f in (raster_measures, raster_turned, raster_tiles, raster_files, raster_fingerprints, raster_similarity, image_headers, canvas_modes)}

_P = f"WITH {quality._PX}"
# Where the pixel at row y and column x of an upright picture stands in the stored one of 8 by 8, by orientation tag.
_FROM = {2: "y * 8 + 7 - x", 3: "(7 - y) * 8 + 7 - x", 4: "(7 - y) * 8 + x", 5: "x * 8 + y", 6: "(7 - x) * 8 + y", 7: "(7 - x) * 8 + 7 - y", 8: "x * 8 + 7 - y"}
_AT = "CASE tag " + " ".join(f"WHEN {t} THEN {e}" for t, e in _FROM.items()) + " ELSE y * 8 + x END"
_X0, _Y0, _RW, _RH = REGION


def _mirrored(at: str, first: int, length: int, kind: str) -> str:
    """The place in a region that an index beyond it takes its pixel from, by walking back and forth."""
    if kind == "edge":
        return f"least(greatest({at}, {first}), {first + length - 1})"
    return f"({first} + CASE WHEN ({at} - {first}) % {2 * length - 2} < {length} THEN ({at} - {first}) % {2 * length - 2} ELSE {2 * length - 2} - ({at} - {first}) % {2 * length - 2} END)"


def _pixel(kind: str) -> str:
    inside = f"xx < {_X0 + _RW} AND yy < {_Y0 + _RH}"
    if kind == "constant":
        return f"CASE WHEN {inside} THEN px[least(yy, 7) * 8 + least(xx, 7) + 1] ELSE 7 END"
    return f"px[{_mirrored('yy', _Y0, _RH, kind)} * 8 + {_mirrored('xx', _X0, _RW, kind)} + 1]"


def _hexed(pixel: str) -> str:
    return f"sha256(unhex(string_agg(printf('%02x', {pixel}), '' ORDER BY yy, xx)))"


ORACLES = {
    "raster_measures": f"""WITH q AS ({quality.ORACLES['raster_quality']}) SELECT vec_id, 8 AS width, 8 AS height, sharpness, underexposed_ratio, overexposed_ratio, entropy, low_information FROM q""",
    "raster_turned": f"""{_P}, o AS (SELECT vec_id, vec_id % 9 AS tag, px, unnest(generate_series(0, 63)) AS k FROM px), g AS (SELECT *, k // 8 AS yy, k % 8 AS xx FROM o)
        SELECT vec_id, tag, {_hexed(f"px[({_AT.replace('y', 'yy').replace('x', 'xx')}) + 1]")} AS digest FROM g GROUP BY ALL""",
    "raster_tiles": f"""{_P}, r AS (SELECT vec_id, px, unnest(generate_series(0, {-(-_RH // TILE[1]) - 1})) AS tile_row FROM px), c AS (SELECT *, unnest(generate_series(0, {-(-_RW // (TILE[0] - OVERLAP[0])) - 1})) AS tile_column FROM r),
        k AS (SELECT *, unnest(generate_series(0, {TILE[0] * TILE[1] - 1})) AS k FROM c), g AS (SELECT *, {_Y0} + tile_row * {TILE[1] - OVERLAP[1]} + k // {TILE[0]} AS yy, {_X0} + tile_column * {TILE[0] - OVERLAP[0]} + k % {TILE[0]} AS xx FROM k)
        """ + " UNION ALL ".join(f"SELECT vec_id, tile_row::INT AS tile_row, tile_column::INT AS tile_column, '{kind}' AS padding, {_hexed(_pixel(kind))} AS digest FROM g GROUP BY vec_id, tile_row, tile_column" for kind in ("constant", "edge", "reflect")),
    "raster_files": f"{_P} SELECT vec_id, true AS same, vec_id % 5 = 0 AS failed FROM px",
    "image_headers": f"""WITH {views.ASSETS} SELECT id, CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS width, CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS height,
        CASE WHEN orientation BETWEEN 1 AND 8 THEN orientation ELSE 1 END AS orientation, nullif(regexp_replace(capture_time, {views._BLANK}, '', 'g'), '') AS capture_time, NULL::VARCHAR AS error
        FROM assets WHERE kind = 'image' AND width IS NOT NULL AND height IS NOT NULL""",
    "canvas_modes": f"WITH {tiles._PROFILES} SELECT DISTINCT profile_id, unnest(['stretch', 'fit', 'fill', 'long_side']) AS mode, tile_width AS width, tile_height AS height FROM profiles",
}
