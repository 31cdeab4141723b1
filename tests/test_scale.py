"""Ways of splitting hot keys against brute force, and streams of several files."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators.replay import group_digests, replay
from frameloom.operators.similarity import guard_comparisons, near_pairs
from frameloom.plans import sampling
from frameloom.streaming import events

ASSETS = "asset_key string, source_id string, source_group string, offset_ms bigint, digest string, hash bigint, key string"


@pytest.mark.parametrize(("scope", "crowded"), [("project", 5), ("project", 10**9), ("source_group", 5)])
def test_crowded_blocks_lose_no_near_pair(spark, scope, crowded):
    rng = random.Random(2)
    rows = []
    for i in range(220):
        h = (rng.getrandbits(42) << 21) | 0b1010 if i % 2 else rng.getrandbits(63)
        for c in range(rng.randrange(1, 4)):
            for bit in rng.sample(range(63), rng.randrange(0, 6)):
                h ^= 1 << bit
            rows.append((f"k{i}-{c}", f"s{i % 7}", f"g{i % 3}", None if i % 5 else i * 1000, None if i % 4 else f"d{i % 8}", h, "clash"))
    got = {tuple(r) for r in near_pairs(spark.createDataFrame(rows, ASSETS), scope=scope, crowded=crowded).collect()}

    def fits(a, b):
        far = a[1] == b[1] and a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > 30_000
        return (scope == "project" or a[2] == b[2]) and not far and not (a[4] is not None and a[4] == b[4]) and (a[5] ^ b[5]).bit_count() <= 8

    assert got == {tuple(sorted((a[0], b[0]))) for i, a in enumerate(rows) for b in rows[i + 1 :] if fits(a, b)}


@pytest.mark.parametrize("stretch", [1, 10, 10_000])
def test_snapping_over_stretches(spark, stretch):
    rng = random.Random(4)
    frames = {"a": [rng.randrange(0, 500) for _ in range(12)], "b": [7], "c": []}
    times = [(e, rng.randrange(-20, 520)) for e in "abcd" for _ in range(60)] + [(None, 5), ("a", None)]
    f = spark.createDataFrame([(e, t) for e, ts in frames.items() for t in ts], "e string, f bigint")
    t = spark.createDataFrame([(e, x, "kept") for e, x in times], "e string, t bigint, c string")
    got = sorted(map(tuple, sampling.snap_to_frames(t, f, "e", "t", "f", stretch).collect()), key=repr)
    near = lambda e, x: min(frames.get(e) or [None], key=lambda y: (abs(y - x), y)) if e and x is not None and frames.get(e) else None
    assert got == sorted([(e, x, "kept", near(e, x)) for e, x in times], key=repr)


def test_folds_of_many_keys(spark):
    df = spark.range(3000).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"), F.lit("x").alias("state"))
    start, step, finish = (lambda: {"s": 0}), (lambda s, r: s.update(s=s["s"] + r[0]) or ([(s["s"],)] if r[0] % 2 else [])), (lambda s: [(-s["s"],)])
    got = sorted(map(tuple, replay(df, ["k"], ["v"], ["v"], start, step, "k bigint, total bigint", finish).collect()))
    want = []
    for k in range(37):
        total = 0
        for v in range(k, 3000, 37):
            total += v
            want += [(k, total)] if v % 2 else []
        want.append((k, -total))
    assert got == sorted(want)
    assert replay(df.limit(0), ["k"], ["v"], ["v"], start, step, "k bigint, total bigint", finish).count() == 0


def test_group_digests_take_any_order_and_repeats(spark):
    import hashlib

    keys = [f"k{i:03}" for i in range(300)]
    df = spark.createDataFrame([("g", k) for k in reversed(keys)] + [("g", keys[5]), ("h", "é"), ("h", None), (None, "x")], "g string, k string")
    got = {r["g"]: r for r in group_digests(df, "g", "k").collect()}
    assert got["g"]["group_id"] == "sim-" + hashlib.sha256(("similarity-v1" + "".join(keys)).encode()).hexdigest()[:12]
    assert (got["g"]["n_members"], got["g"]["first_key"], got["g"]["last_key"]) == (300, keys[0], keys[-1]) and got["h"]["n_members"] == 1 and len(got) == 2


def test_change_selection_by_brute_force(spark):
    rng = random.Random(9)
    points = [(e, rng.randrange(0, 3000), rng.random()) for e in "abc" for _ in range(200)] + [(None, 1, 0.5), ("a", None, 0.5), ("d", 3, None)]
    got = sorted(map(tuple, sampling.change_selection(spark.createDataFrame(points, "e string, t bigint, s double"), "e", "t", "s", 0.8, 20, 400).collect()))
    want = []
    for e in "abcd":
        last = None
        for _, t, s in sorted((p for p in points if p[0] == e and p[1] is not None), key=lambda p: (p[1], -1 if p[2] is None else p[2])):
            if last is None or t - last >= 400 or (s is not None and s >= 0.8 and t - last >= 20):
                last = t
                want.append((e, t))
    assert got == sorted(want)


def test_a_stream_of_files_in_order_selects_as_one_table(spark, tmp_path):
    rng = random.Random(3)
    points = sorted((rng.randrange(0, 9000), rng.choice("ab"), rng.random()) for _ in range(300))
    for i in range(0, 300, 50):
        spark.createDataFrame([(e, t, s) for t, e, s in points[i : i + 50]], "e string, t bigint, s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "points"))
    stream = events.read_stream(spark, str(tmp_path / "points"), files_per_batch=1)
    got = {tuple(r) for r in events.run_to_table(events.select_changes(stream, "e", "t", "s", 0.8, 50, 900), "append").select("e", "t").collect()}
    whole = sampling.change_selection(spark.read.parquet(str(tmp_path / "points")).groupBy("e", "t").agg(F.max("s").alias("s")), "e", "t", "s", 0.8, 50, 900)
    assert got == {tuple(r) for r in whole.collect()}


def test_a_stream_that_writes_nothing_is_empty(spark, tmp_path):
    spark.createDataFrame([], "e string, t bigint, s double").write.parquet(str(tmp_path / "none"))
    stream = events.read_stream(spark, str(tmp_path / "none")).where("e = 'x'")
    assert events.run_to_table(stream.select("e", "t"), "append").count() == 0


def test_comparisons_over_a_limit_are_refused(spark):
    counts = spark.createDataFrame([("a", 1_500_000), ("b", 500_000)], "g string, n_comparisons bigint")
    assert guard_comparisons(counts) == 2_000_000 and guard_comparisons(counts.limit(0)) == 0
    with pytest.raises(ValueError, match="over the limit"):
        guard_comparisons(counts, limit=1_999_999)
