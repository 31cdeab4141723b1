"""Export plans: strategies for names that are taken, running numbers, manifests on disk."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frameloom.plans.export import full_manifest, running_index, unnumbered_names, write_manifest

SCHEMA = "id int, s string, d string, low string, used string"


def named(spark, rows, strategy, occupied=None, **kw):
    df = spark.createDataFrame([(i, s, d, "clash", "clash") for i, s, d in rows], SCHEMA)
    held = None if occupied is None else spark.createDataFrame([(o,) for o in occupied], "name string")
    return {r["id"]: r["file_name"] for r in unnumbered_names(df, "s", ".JPG", "id", strategy, held, **kw).collect()}


ROWS = [(1, "a", "11111111ff"), (2, "A", "22222222ff"), (3, "b", "33333333ff"), (4, "a", "44444444ff"), (5, "c", "55555555ff")]


def test_skip_leaves_later_and_occupied_names_out(spark):
    assert named(spark, ROWS, "skip", ["C.jpg", "x.png"]) == {1: "a.jpg", 2: None, 3: "b.jpg", 4: None, 5: None}


def test_hash_appends_eight_digits(spark):
    assert named(spark, ROWS, "hash", ["c.jpg"], digest="d") == {1: "a.jpg", 2: "A_22222222.jpg", 3: "b.jpg", 4: "a_44444444.jpg", 5: "c_55555555.jpg"}


@pytest.mark.parametrize("more", [[(6, "a_22222222", "66")], [(6, "a", "22222222")]])
def test_hash_fails_where_its_name_is_taken_too(spark, more):
    with pytest.raises(PySparkException, match="taken"):
        named(spark, ROWS + more, "hash", digest="d")


def test_fail(spark):
    assert named(spark, [ROWS[0], ROWS[2]], "fail") == {1: "a.jpg", 3: "b.jpg"}
    for occupied in (None, ["B.JPG"]):
        with pytest.raises(PySparkException, match="taken"):
            named(spark, ROWS if occupied is None else ROWS[2:3], "fail", occupied)
    with pytest.raises(PySparkException, match="nothing"):
        named(spark, [(1, " . ", "x")], "skip")
    with pytest.raises(ValueError, match="strategy"):
        named(spark, ROWS, "hash")


def test_running_index_is_one_order_over_all(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), (F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 11)).alias("t"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    rows = running_index(df, F.substring("k", 1, 1), [F.col("k"), F.coalesce("t", F.lit(-1))], [F.col("k"), F.asc_nulls_first("t"), F.col("n")], "place").collect()
    want = sorted(rows, key=lambda r: (r["k"], -1 if r["t"] is None else r["t"], r["n"]))
    assert [r["place"] for r in want] == list(range(1, 5001))
    assert running_index(df.limit(0), F.col("k"), [F.col("k")], [F.col("n")], "place").count() == 0


def test_manifest_on_disk(spark, tmp_path):
    none = lambda kind: F.lit(None).cast(kind)
    rows = spark.range(3).select(
        F.format_string("f%d.png", "id").alias("file_name"), none("string").alias("content_sha256"), F.lit("s").alias("source_id"), F.lit("D:\\a").alias("source_path"), none("string").alias("candidate_id"),
        none("bigint").alias("video_offset_ms"), F.lit("tiles").alias("export_content"), F.lit("p").alias("roi_profile_id"), F.lit("n").alias("roi_name"), F.struct(F.lit(1).alias("x")).alias("roi"),
        F.struct(F.lit(0).alias("row")).alias("tile"), none("struct<padding: string>").alias("render_config"),
    )
    path = str(tmp_path / "manifest")
    write_manifest(full_manifest(rows, "e1"), path)
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert sorted(x["fileName"] for x in lines) == ["f0.png", "f1.png", "f2.png"]
    assert list(lines[0]) == ["schemaVersion", "exportId", "fileName", "contentSha256", "sourceId", "sourcePath", "candidateId", "videoOffsetMs", "exportContent", "roiProfileId", "roiName", "roi", "tile", "renderConfig"]
    with pytest.raises(PySparkException):
        write_manifest(full_manifest(rows, "e1"), path)
