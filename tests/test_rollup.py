"""The rollup of the fixed plan, which counts planned times and makes none of them."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from frameloom.plans import sampling

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize(("step", "tolerance"), [(7, 1), (7, 3), (3, 1), (1, 0)])
def test_hits_of_an_endless_plan(spark, step, tolerance):
    rng = random.Random(5)
    times = [(e, rng.randrange(-10, 90)) for e in "ab" for _ in range(40)] + [("a", -1), ("a", step - 1), ("a", None), (None, 7)]
    got = [tuple(r) for r in sampling.interval_hits(spark.createDataFrame(times, "k string, t bigint"), "k", "t", step, tolerance).collect()]
    want = {(e, p) for e, t in times if e and t is not None for p in range(0, 200, step) if abs(p - t) <= tolerance}
    assert sorted(got) == sorted(want)


def test_steps_that_a_time_is_near_twice_are_refused(spark):
    with pytest.raises(ValueError):
        sampling.interval_hits(spark.range(1).select(F.lit("a").alias("k"), F.col("id").alias("t")), "k", "t", 2)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_durations_cost_nothing(spark, tmp_path):
    # Ten thousand million planned times of each video: none may be made, and none left out of the counts.
    assets = spark.read.parquet(f"{FOLDER}/source_assets.parquet").withColumn("duration_ms", F.when(F.col("duration_ms").isNotNull(), F.lit(600_000_000_000_001).cast("bigint")))
    assets.write.parquet(f"{tmp_path}/source_assets.parquet")
    at = F.when(F.col("video_offset_ms") % 2 == 0, F.lit(600_000_000_000_000)).otherwise(-1).cast("bigint")
    spark.read.parquet(f"{FOLDER}/candidate_images.parquet").withColumn("video_offset_ms", at).write.parquet(f"{tmp_path}/candidate_images.parquet")
    df = entry.queries()["group_sampling_rollup"](spark, str(tmp_path))
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.collect()
    assert rows and all(r["n_planned"] == r["n_sources"] * 10_000_000_001 for r in rows)
    videos = {r["id"] for r in assets.where("kind = 'video' and duration_ms is not null").collect()}
    there = spark.read.parquet(f"{tmp_path}/candidate_images.parquet").select(F.trim(F.lower("source_id")).alias("s"), "video_offset_ms").distinct().collect()
    assert sum(r["n_existing"] for r in rows) == sum(r["s"] in videos for r in there) > 0
