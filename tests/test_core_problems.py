"""Dangling references, capture times and intervals against brute force and on edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from frameloom.operators.intervals import merge_intervals
from frameloom.operators.references import orphan_references
from frameloom.operators.timestamps import DAY_FIRST, normalise_timestamps

INTERVALS = "source_id string, start_ms bigint, end_ms bigint, k string, s string"


def brute_periods(rows):
    out = set()
    by = {}
    for k, s, e in rows:
        if k is None or not k.strip() or s is None or e is None or s < 0 or e <= s:
            continue
        by.setdefault(k.strip().lower(), []).append((s, e))
    for k, spans in by.items():
        end = None
        start = None
        for s, e in sorted(spans):
            if end is None or s > end:
                if end is not None:
                    out |= {(k, "period", start, end), (k, "gap", end, s)}
                start, end = s, e
            end = max(end, e)
        out.add((k, "period", start, end))
    return out


def test_intervals_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        k = "hot" if rng.random() < 0.4 else rng.choice(["a", " A\t", "b", None, "", "　", "c"])
        s = rng.choice([None, rng.randrange(-50, 400_000)])
        rows.append((k, s, None if s is None else s + rng.randrange(-20, 600)))
    rows += rows[:200] + [("deep", 0, 1_000_000), ("deep", 70_000, 70_001), ("deep", 1_000_000, 1_000_001), ("deep", 9_000_000_000, 9_000_000_001)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], INTERVALS)
    got = [tuple(r) for r in merge_intervals(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_periods(rows)
    assert set(map(tuple, merge_intervals(df, bucket=100).collect())) == set(got)


def test_intervals_of_an_empty_table(spark):
    assert merge_intervals(spark.createDataFrame([], INTERVALS)).count() == 0


def _orphans(spark, semantics):
    t = lambda d: dt.datetime(2025, 1, d)
    schema = "rid int, a string, b string, made timestamp, cause string, came string"
    refs = [(1, "x", "p", t(5), "", ""), (2, "x", None, t(5), "", ""), (3, None, "p", t(1), "", ""), (4, None, None, t(5), "", ""), (5, "z", None, t(5), "", ""), (6, "x", "q", t(5), "", ""), (7, "y", None, None, "", ""), (1, "x", "p", t(5), "", "")]
    targets = spark.createDataFrame([("x", "p", t(3)), ("x", "p", t(9)), ("y", None, t(9)), (None, None, None)], "a string, b string, came timestamp")
    removed = spark.createDataFrame([("z", "w"), ("z", "w")], "a string, b string")
    got = orphan_references(spark.createDataFrame(refs, schema), targets, removed, ["a", "b"], "made", "came", semantics)
    return sorted((r["rid"], r["cause"]) for r in got.collect())


def test_reference_semantics(spark):
    assert _orphans(spark, "partial") == [(3, "late"), (5, "removed"), (6, "missing")]
    assert _orphans(spark, "simple") == [(6, "missing")]
    assert _orphans(spark, "full") == [(2, "missing"), (3, "missing"), (5, "missing"), (6, "missing"), (7, "missing")]


def test_references_without_targets(spark):
    schema = "a string, made timestamp"
    none = spark.createDataFrame([], "a string, came timestamp")
    refs = spark.createDataFrame([("x", None), (None, None)], schema)
    got = orphan_references(refs, none, none, ["a"], "made", "came").collect()
    assert [(r["a"], r["cause"]) for r in got] == [("x", "missing")]
    assert orphan_references(refs.limit(0), none, none, ["a"], "made", "came").count() == 0


CASES = [
    ("2025-06-06T11:43:19Z", "embedded", None, "2025-06-06T11:43:19"),
    (" 2025:06:05 19:44:52 -03:30 ", "EXIF", "Asia/Tokyo", "2025-06-05T23:14:52"),
    ("10.03.2024 00:12:14", "manual", "Asia/Tokyo", "2024-03-09T15:12:14"),
    ("2025-04-25T02:10:16,094999999", "embedded ", "Asia/Tokyo", "2025-04-25T02:10:16.094999"),
    ("2024-10-27 2:10:37 AM", "exif", "Europe/Berlin", "2024-10-27T00:10:37"),
    ("2025-03-30 02:30:00", "exif", "Europe/Berlin", "2025-03-30T01:30:00"),
    ("3 November 2024, 12:45 am", "manual", "Nowhere/None", "2024-11-03T00:45:00"),
    ("Sun, 23 Feb 2025 10:46:10 -0800", "embedded", None, "2025-02-23T18:46:10"),
    ("2025年7月10日 11:11", "exif", "Asia/Shanghai", "2025-07-10T03:11:00"),
    ("2025年05月02日 13时29分14秒", "exif", "Asia/Shanghai", "2025-05-02T05:29:14"),
    ("2025-02-02T20:03:31[Europe/London]", None, None, "2025-02-02T20:03:31"),
    ("2026-01-08 02:30:50 America/New_York", None, "Asia/Tokyo", "2026-01-08T07:30:50"),
    ("2025-01-27 20:11:41 CEST", "manual", None, "2025-01-27T18:11:41"),
    ("UTC 2025-11-18 16:14:59", "exif", "Asia/Tokyo", "2025-11-18T16:14:59"),
    ("20250726_231028_577", "filename", None, "2025-07-26T23:10:28.577000"),
    ("20250912T225554Z", "filename", "Asia/Tokyo", "2025-09-12T22:55:54"),
    ("20250627191032", "filename", None, "2025-06-27T19:10:32"),
    ("1750811895", "exif", "Asia/Tokyo", "2025-06-25T00:38:15"),
    ("1767132905950236", "exif", "Asia/Tokyo", "2025-12-30T22:15:05.950236"),
    ("May 3, 2025 1:02 PM", "manual", None, "2025-05-03T13:02:00"),
    ("2024-02-29 23:59:59", None, None, "2024-02-29T23:59:59"),
    *[(v, "exif", None, None) for v in (
        "2025-02-29 10:00:00", "2025-13-01 10:00:00", "2025-01-01 24:00:00", "2025-01-01 10:60:00", "2025-10-09", "02/2025", "--", "",
        "0000:00:00 00:00:00", "    :  :     :  :  ", None, "2025-01-01 13:00 PM", "2025-01-01 10:00:00 XYZ", "2025-01-01 10:00:00 Foo/Bar", "12345", "x" * 50_000,
    )],
]


def test_timestamp_cases(spark):
    rows = [(i, v, s, z, "extra") for i, (v, s, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, v string, src string, zone string, source string")
    got = {r["id"]: r for r in normalise_timestamps(df, "id", "v", "src", "zone", priors=DAY_FIRST).collect()}
    epoch = dt.datetime(1970, 1, 1)
    for i, (value, _, _, want) in enumerate(CASES):
        us = got[i]["utc_us"]
        assert (us is None) == (want is None), (value, us)
        if want:
            assert epoch + dt.timedelta(microseconds=us) == dt.datetime.fromisoformat(want), value
        twice = got[i]["ambiguity"] == "zone"
        assert got[i]["status"] == ("ambiguous" if twice else "resolved" if want else "unreadable"), value


def test_every_day_of_many_years(spark):
    df = spark.range(0, 800_000, 37).select(
        F.col("id"), F.date_format(F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd 00:00:01").alias("v"), F.lit(None).cast("string").alias("z")
    )
    first = (dt.date(1, 1, 1) - dt.date(1970, 1, 1)).days
    wrong = normalise_timestamps(df, "id", "v", "z", "z").where(
        ~F.col("utc_us").eqNullSafe((F.col("id") + first) * 86_400_000_000 + 1_000_000)
    )
    assert wrong.count() == 0


def test_mixture_decides_between_day_first_and_month_first(spark):
    rows = [("a", f"2025 {d}") for d in ()] + [("us", "03/25/2025 10:00"), ("us", "12/31/2024 10:00"), ("us", "01/02/2025 10:00"), ("eu", "25/03/2025 10:00"), ("eu", "01/02/2025 10:00"), ("none", "01/02/2025 10:00")]
    df = spark.createDataFrame([(i, v, s, None) for i, (s, v) in enumerate(rows)], "id int, v string, src string, zone string")
    got = {r["id"]: r for r in normalise_timestamps(df, "id", "v", "src", "zone").collect()}
    assert got[2]["format"] == "mdy" and got[2]["status"] == "resolved"
    assert got[4]["format"] == "dmy" and got[4]["status"] == "resolved"
    assert got[5]["status"] == "ambiguous" and got[5]["utc_us"] is None and abs(got[5]["posterior"] - 0.5) < 1e-9 and got[5]["ambiguity"] == "format"
    declared = {r["id"]: r for r in normalise_timestamps(df, "id", "v", "src", "zone", priors=DAY_FIRST).collect()}
    assert declared[2]["format"] == declared[5]["format"] == "dmy" and declared[5]["status"] == "resolved"


def test_sources_that_write_both_ways_stay_ambiguous(spark):
    rows = [("03/25/2025 10:00",)] * 3 + [("25/03/2025 10:00",)] * 2 + [("01/02/2025 10:00",)] * 4
    df = spark.createDataFrame(rows, "v string").selectExpr("v", "'both' as src", "cast(null as string) as zone", "monotonically_increasing_id() as id")
    got = [r for r in normalise_timestamps(df, "id", "v", "src", "zone").collect() if r["status"] == "ambiguous"]
    assert len(got) == 4 and {r["format"] for r in got} == {"mdy"} and all(abs(r["posterior"] - 3.01 / 5.02) < 1e-6 for r in got)


def test_local_times_that_occur_twice_are_told(spark):
    zones = {"Europe/Berlin": "2025-10-26 02:30:00", "America/New_York": "2024-11-03 01:15:00", "Australia/Lord_Howe": "2025-04-06 01:45:00"}
    df = spark.createDataFrame([(z, v, "exif") for z, v in zones.items()] + [("Asia/Tokyo", "2025-10-26 02:30:00", "exif")], "zone string, v string, src string")
    got = {r["zone"]: r for r in normalise_timestamps(df.withColumn("k", F.col("zone")), "zone", "v", "src", "k").collect()}
    assert [got[z]["status"] for z in zones] == ["ambiguous"] * 3 and got["Asia/Tokyo"]["status"] == "resolved"
    assert [got[z]["other_us"] - got[z]["utc_us"] for z in zones] == [3_600_000_000, 3_600_000_000, 1_800_000_000]
    assert all(abs(got[z]["posterior"] - 0.5) < 1e-9 and got[z]["ambiguity"] == "zone" for z in zones)


def test_offsets_of_one_digit(spark):
    rows = [("2025-01-01 10:00:00 UTC+2", 8 * 60), ("2025-01-01 10:00:00 GMT-3", 13 * 60), ("2025-01-01 10:00:00 +5:30", 4 * 60 + 30), ("2025-01-01 10:00:00 +0530", 4 * 60 + 30), ("2025-01-01 10:00:00+02", 8 * 60)]
    df = spark.createDataFrame([(i, v, "x", "Asia/Tokyo") for i, (v, _) in enumerate(rows)], "id int, v string, src string, zone string")
    got = {r["id"]: r["utc_us"] for r in normalise_timestamps(df, "id", "v", "src", "zone").collect()}
    day = (dt.date(2025, 1, 1) - dt.date(1970, 1, 1)).days * 86_400_000_000
    assert [got[i] for i in range(len(rows))] == [day + m * 60_000_000 for _, m in rows]


def test_timestamps_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, v string, src string, zone string")
    assert normalise_timestamps(df, "id", "v", "src", "zone").count() == 0
