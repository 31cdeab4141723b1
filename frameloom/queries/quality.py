"""Queries over quality measures and small rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.config import ReviewSettings
from frameloom.functions import measures
from frameloom.queries import views
from frameloom.sources.tables import read_table

_DEFAULTS = ReviewSettings()

#: The thresholds below or above which a measure is a reason, in the order of the reasons.
THRESHOLDS = {
    "width": _DEFAULTS.min_width, "height": _DEFAULTS.min_height, "sharpness": _DEFAULTS.min_sharpness, "underexposed_ratio": _DEFAULTS.max_underexposed_ratio,
    "overexposed_ratio": _DEFAULTS.max_overexposed_ratio, "low_information": _DEFAULTS.max_low_information,
}


def reasons() -> Column:
    """The reasons that speak against an image, in a fixed order; measures that are null give none."""
    t = THRESHOLDS
    return F.array_compact(F.array(
        F.when((F.col("width") < t["width"]) | (F.col("height") < t["height"]), "low_resolution"),
        F.when(views.sound("sharpness") < t["sharpness"], "low_sharpness"),
        F.when(views.sound("underexposed_ratio") > t["underexposed_ratio"], "underexposed"),
        F.when(views.sound("overexposed_ratio") > t["overexposed_ratio"], "overexposed"),
        F.when(views.sound("low_information") > t["low_information"], "low_information"),
    ))


def quality_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The reasons against every asset."""
    return views.metrics(spark, folder).select("asset_key", F.array_join(reasons(), ",").alias("reasons"), F.size(reasons()).alias("n_reasons"))


def quality_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many assets each reason speaks against."""
    return views.metrics(spark, folder).select(F.explode(reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_assets"))


def score() -> Column:
    return measures.quality_score(views.sound("sharpness"), F.col("width"), F.col("height"), views.sound("underexposed_ratio"), views.sound("overexposed_ratio"), views.sound("low_information"))


def quality_score_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every measured asset and its rank within its source."""
    rows = views.metrics(spark, folder).select("asset_key", "source_id", F.round(score(), 6).alias("score")).where(F.col("score") > float("-inf"))
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "asset_key")
    return rows.select("asset_key", "score", F.row_number().over(w).alias("rank"))


def _unpivoted(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("sharpness", "entropy", "underexposed_ratio", "overexposed_ratio", "low_information")
    pairs = F.array(*[F.struct(F.lit(f).alias("metric"), views.sound(f).alias("value")) for f in fields], F.struct(F.lit("resolution").alias("metric"), (F.col("width").cast("double") * F.col("height")).alias("value")))
    return views.metrics(spark, folder).select("asset_key", F.explode(pairs).alias("m")).select("asset_key", "m.metric", "m.value").where(F.col("value").isNotNull() & (F.col("value") < float("inf")))


def metric_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve equal bins of every metric between its least and greatest value, empty ones included."""
    values = _unpivoted(spark, folder)
    span = values.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    bin_ = F.least(F.lit(11), F.greatest(F.lit(0), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 12)))
    counts = values.join(span, "metric").groupBy("metric", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = span.select("metric", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("bin"))
    top = F.max("n").over(Window.partitionBy("metric"))
    return frame.join(counts, ["metric", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).select("metric", "bin", "n", F.round(F.col("n") / top, 6).alias("share_of_largest"))


def metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean and extremes of every metric."""
    return _unpivoted(spark, folder).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def threshold_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The four assets whose sharpness is nearest to the threshold."""
    far = F.abs(views.sound("sharpness") - THRESHOLDS["sharpness"])
    return views.metrics(spark, folder).select("asset_key", F.round(far, 6).alias("distance")).where("distance is not null").orderBy("distance", "asset_key").limit(4)


def fails_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Per metric, how many assets its threshold would put out."""
    low = F.when(F.col("metric") == "sharpness", F.col("value") < THRESHOLDS["sharpness"]).when(F.col("metric") == "resolution", F.col("value") < THRESHOLDS["width"] * THRESHOLDS["height"])
    limit = F.when(F.col("metric") == "low_information", THRESHOLDS["low_information"]).otherwise(0.35)
    fails = F.coalesce(low, F.when(F.col("metric") != "entropy", F.col("value") > limit), F.lit(False))
    return _unpivoted(spark, folder).groupBy("metric").agg(F.count_if(fails).alias("n_failing"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Rasters of 8 x 8 gray levels made from the vectors: (vec_id, label, px)."""
    level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.lit(128.0) + F.lit(255.0) * e.cast("double")).cast("int")))
    return read_table(spark, folder, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", F.transform("embedding", level).alias("px"))


def _mean(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(array)


def luma_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How many pixels have each level, over all rasters."""
    return pixels(spark, folder).select(F.explode("px").alias("level")).groupBy("level").agg(F.count("*").alias("n_pixels"))


def raster_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Exposure ratios, entropy, deviation, low information and sharpness of every raster."""
    rows = pixels(spark, folder)
    share = lambda f: F.size(F.filter("px", f)) / 64.0
    counts = F.transform(F.array_distinct("px"), lambda v: F.size(F.filter("px", lambda x: x == v)) / 64.0)
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    mean = _mean(F.col("px"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), _mean(F.transform("px", lambda v: v * v)) - mean * mean))
    inner = F.array(*[F.lit(8 * y + x) for y in range(1, 7) for x in range(1, 7)])
    at = lambda i: F.get("px", i)
    edges = F.transform(inner, lambda i: 4 * at(i) - at(i - 8) - at(i + 8) - at(i - 1) - at(i + 1))
    sharp = _mean(F.transform(edges, lambda v: v * v)) - _mean(edges) * _mean(edges)
    return rows.select(
        "vec_id", share(lambda v: v <= 16).alias("underexposed_ratio"), share(lambda v: v >= 239).alias("overexposed_ratio"), F.round(entropy, 6).alias("entropy"),
        F.round(deviation, 4).alias("deviation"), F.round(measures.low_information(entropy, deviation), 6).alias("low_information"), F.round(sharp + 1e-7, 3).alias("sharpness"),
    )


def frame_change_score(spark: SparkSession, folder: str) -> DataFrame:
    """The mean difference of every raster from the one before it in its series, as a share of the full range."""
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = pixels(spark, folder).withColumn("before", F.lag("px").over(w)).withColumn("frame", F.row_number().over(w) - 1)
    change = _mean(F.zip_with("px", "before", lambda a, b: F.abs(a - b))) / 255
    return rows.select("label", "frame", F.round(F.coalesce(change, F.lit(0.0)), 6).alias("score"))


def augmented(spark: SparkSession, folder: str) -> DataFrame:
    """The mean level of every raster after a brightness offset that its id decides."""
    offset = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 41 - 20
    brighter = F.transform("px", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v + F.col("offset").cast("int"))))
    return pixels(spark, folder).withColumn("offset", offset).select("vec_id", "offset", F.round(_mean(brighter), 6).alias("mean_level"))


QUERIES = {f.__name__: f for f in (quality_reasons, quality_reason_counts, quality_score_rank, metric_histogram, metric_summary, threshold_nearest, fails_threshold, luma_histogram, raster_quality, frame_change_score, augmented)}

_M = f"WITH {views.METRICS}"
_s = views.sound_sql
_REASONS = f"""list_filter([CASE WHEN width < 320 OR height < 240 THEN 'low_resolution' END, CASE WHEN {_s('sharpness')} < 80 THEN 'low_sharpness' END,
  CASE WHEN {_s('underexposed_ratio')} > 0.35 THEN 'underexposed' END, CASE WHEN {_s('overexposed_ratio')} > 0.35 THEN 'overexposed' END,
  CASE WHEN {_s('low_information')} > 0.72 THEN 'low_information' END], lambda x: x IS NOT NULL)"""
SCORE = f"3 * ln({_s('sharpness')} + 1) + 0.25 * ln(width::DOUBLE * height + 1) - 10 * ({_s('underexposed_ratio')} + {_s('overexposed_ratio')}) - 4 * {_s('low_information')}"
_U = _M + ", u AS (" + " UNION ALL ".join(f"SELECT asset_key, '{f}' AS metric, {_s(f)} AS value FROM metrics" for f in ("sharpness", "entropy", "underexposed_ratio", "overexposed_ratio", "low_information")) + " UNION ALL SELECT asset_key, 'resolution', width::DOUBLE * height FROM metrics), v AS (SELECT * FROM u WHERE value IS NOT NULL AND NOT isinf(value))"
_PX = "px AS (SELECT vec_id, label, list_transform(embedding, lambda e: least(255, greatest(0, round(128.0 + 255.0 * e::DOUBLE)::INT))) AS px FROM embeddings WHERE len(embedding) = 64), p AS (SELECT vec_id, label, unnest(px) AS v, unnest(generate_series(0, 63)) AS k FROM px)"

ORACLES = {
    "quality_reasons": _M + f" SELECT asset_key, array_to_string({_REASONS}, ',') AS reasons, len({_REASONS})::INT AS n_reasons FROM metrics",
    "quality_reason_counts": _M + f" SELECT reason, count(*) AS n_assets FROM (SELECT unnest({_REASONS}) AS reason FROM metrics) GROUP BY reason",
    "quality_score_rank": _M + f", s AS (SELECT asset_key, source_id, round({SCORE}, 6) AS score FROM metrics) SELECT asset_key, score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, asset_key) AS rank FROM s WHERE score IS NOT NULL",
    "metric_histogram": _U + """, span AS (SELECT metric, min(value) AS lo, CASE WHEN max(value) = min(value) THEN min(value) + 1 ELSE max(value) END AS hi FROM v GROUP BY metric),
        c AS (SELECT metric, least(11, greatest(0, floor((value - lo) / (hi - lo) * 12)))::INT AS bin, count(*) AS n FROM v JOIN span USING (metric) GROUP BY ALL),
        f AS (SELECT metric, unnest(generate_series(0, 11))::INT AS bin FROM span), r AS (SELECT metric, bin, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (metric, bin))
        SELECT metric, bin, n, round(n / max(n) OVER (PARTITION BY metric), 6) AS share_of_largest FROM r""",
    "metric_summary": _U + " SELECT metric, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS greatest FROM v GROUP BY metric",
    "threshold_nearest": _M + f" SELECT asset_key, round(abs({_s('sharpness')} - 80), 6) AS distance FROM metrics WHERE {_s('sharpness')} IS NOT NULL ORDER BY 2, 1 LIMIT 4",
    "fails_threshold": _U + """ SELECT metric, count(*) FILTER (CASE metric WHEN 'sharpness' THEN value < 80 WHEN 'resolution' THEN value < 320 * 240 WHEN 'entropy' THEN false
        WHEN 'low_information' THEN value > 0.72 ELSE value > 0.35 END) AS n_failing FROM v GROUP BY metric""",
    "luma_histogram": f"WITH {_PX} SELECT v AS level, count(*) AS n_pixels FROM p GROUP BY v",
    "raster_quality": f"""WITH {_PX}, h AS (SELECT vec_id, v, count(*) / 64.0 AS q FROM p GROUP BY ALL), e AS (SELECT vec_id, -sum(q * log2(q)) AS entropy FROM h GROUP BY vec_id),
        m AS (SELECT vec_id, count(*) FILTER (v <= 16) / 64.0 AS underexposed_ratio, count(*) FILTER (v >= 239) / 64.0 AS overexposed_ratio, stddev_pop(v) AS deviation FROM p GROUP BY vec_id),
        l AS (SELECT c.vec_id, 4 * c.v - n.v - s.v - w.v - e.v AS d FROM p c JOIN p n ON n.vec_id = c.vec_id AND n.k = c.k - 8 JOIN p s ON s.vec_id = c.vec_id AND s.k = c.k + 8
          JOIN p w ON w.vec_id = c.vec_id AND w.k = c.k - 1 JOIN p e ON e.vec_id = c.vec_id AND e.k = c.k + 1 WHERE c.k % 8 BETWEEN 1 AND 6 AND c.k // 8 BETWEEN 1 AND 6),
        sh AS (SELECT vec_id, var_pop(d) AS sharpness FROM l GROUP BY vec_id)
        SELECT vec_id, underexposed_ratio::DOUBLE AS underexposed_ratio, overexposed_ratio::DOUBLE AS overexposed_ratio, round(entropy, 6) AS entropy, round(deviation, 4) AS deviation,
          round(1 - (0.7 * least(1.0, entropy / 8) + 0.3 * least(1.0, deviation / 64)), 6) AS low_information, round(sharpness + 1e-7, 3) AS sharpness FROM m JOIN e USING (vec_id) JOIN sh USING (vec_id)""",
    "augmented": f"""WITH {_PX}, o AS (SELECT vec_id, v, ('0x' || left(md5(vec_id::VARCHAR), 8))::BIGINT % 41 - 20 AS o FROM p)
        SELECT vec_id, o AS "offset", round(avg(least(255, greatest(0, v + o))), 6) AS mean_level FROM o GROUP BY ALL""",
    "frame_change_score": f"""WITH {_PX}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM px),
        q AS (SELECT o.label, o.frame, p.k, p.v FROM p JOIN o USING (vec_id)) SELECT a.label, a.frame, round(coalesce(avg(abs(a.v - b.v)) / 255, 0), 6) AS score
        FROM q a LEFT JOIN q b ON b.label = a.label AND b.frame = a.frame - 1 AND b.k = a.k GROUP BY ALL""",
}
