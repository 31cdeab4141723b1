"""Golden values of the planners, names, hashes and kernels."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import kernels as K
from frameloom.functions import names
from frameloom.functions.hashing import hex16, little_endian, quick_fingerprint
from frameloom.functions.measures import clamped_index, reflected_index, rounded_ms
from frameloom.operators import store
from frameloom.operators.ranges import contained_in
from frameloom.operators.similarity import near_pairs
from frameloom.plans import sampling
from frameloom.plans.export import file_names, parse_template, render_template
from frameloom.plans.tiles import axis_positions, plan_tiles
from frameloom.sources.probe import frame_times, transcode_percent, video_facts
from frameloom.sources.scan import fingerprints, list_files


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("one")])
    return row.select(column.alias("v")).first()["v"]


def test_time_plans(spark):
    d = F.lit(3100).cast("bigint")
    assert value(spark, sampling.fixed_interval(d, 1000)) == [0, 1000, 2000, 3000]
    assert value(spark, sampling.frame_interval(d, F.lit("30000/1001"), 30)) == [0, 1001, 2002, 3003]
    assert value(spark, sampling.frame_interval(d, F.lit("0/0"), 30)) is None
    assert value(spark, sampling.target_count(F.lit(201).cast("bigint"), 3)) == [0, 100, 200]
    assert value(spark, sampling.target_count(d, 1)) == [1550]
    assert value(spark, sampling.fixed_interval(F.lit(0).cast("bigint"), 10)) == []
    assert value(spark, sampling.every_nth_frame(F.array(*map(F.lit, (0, 40, 80, 120, 160))), 2)) == [0, 80, 160]
    assert value(spark, sampling.range_times(F.lit(10), F.lit(31), 10)) == [10, 20, 30]
    with pytest.raises(ValueError):
        sampling.fixed_interval(d, 0)


def test_snapping_and_nearest(spark):
    frames = spark.createDataFrame([("v", t) for t in (0, 40, 80, 120, 160, 200, 40)] + [("v", None), (None, 5)], "k string, f bigint")
    times = spark.createDataFrame([("v", 0, 1), ("v", 100, 2), ("v", 500, 3), ("w", 7, 4), (None, 5, 5), ("v", None, 6), ("v", 100, 2)], "k string, t bigint, f bigint")
    got = sorted((r["f"], r["snapped"]) for r in sampling.snap_to_frames(times, frames, "k", "t", "f").collect())
    assert got == [(1, 0), (2, 80), (2, 80), (3, 200), (4, None), (5, None), (6, None)]
    existing = spark.createDataFrame([("v", 1999), ("v", 3001)], "k string, t bigint")
    planned = spark.createDataFrame([("v", t) for t in (0, 1000, 2000, 3000, 3002)] + [(None, 1)], "k string, t bigint")
    got = {r["t"]: r["nearest"] for r in sampling.nearest_within(planned, existing, "k", "t").collect()}
    assert got == {0: None, 1000: None, 2000: 1999, 3000: 3001, 3002: 3001, 1: None}


def test_change_selection(spark):
    points = [("v", t, s) for t, s in ((0, 0.0), (100, 0.9), (400, 0.9), (600, 0.1), (1500, 0.0))] + [("w", 5, None), (None, 1, 1.0)]
    df = spark.createDataFrame(points, "k string, t bigint, s double")
    got = sorted(tuple(r) for r in sampling.change_selection(df, "k", "t", "s", 0.5, 300, 1000).collect())
    assert got == [("v", 0), ("v", 400), ("v", 1500), ("w", 5)]


@pytest.mark.parametrize(("strategy", "want"), [("discard", [0, 40]), ("pad", [0, 40, 80]), ("shift_to_edge", [0, 40, 52])])
def test_tile_positions(spark, strategy, want):
    assert value(spark, axis_positions(F.lit(100), F.lit(48), F.lit(8), F.lit(strategy))) == want


def test_tile_positions_against_a_walk(spark):
    def walk(length, tile, overlap, strategy):
        if length <= tile:
            return [] if length == 0 or (strategy == "discard" and length < tile) else [0]
        out, p = [], 0
        while p + tile <= length if strategy == "discard" else p < length if strategy == "pad" else p + tile < length:
            out.append(p)
            p += tile - overlap
        return out + [length - tile] if strategy == "shift_to_edge" else out

    cases = [(n, t, o, s) for n in range(0, 40, 3) for t in (1, 2, 5, 12) for o in range(0, t, 2) for s in ("discard", "pad", "shift_to_edge")]
    df = spark.createDataFrame(cases, "n int, t int, o int, s string")
    for r in df.withColumn("p", axis_positions(F.col("n"), F.col("t"), F.col("o"), F.col("s"))).collect():
        assert r["p"] == walk(r["n"], r["t"], r["o"], r["s"]), r
    assert value(spark, axis_positions(F.lit(10), F.lit(4), F.lit(4), F.lit("pad"))) is None


def test_tile_plan_ends_at_the_region(spark):
    region = spark.createDataFrame([(10, 20, 100, 60, 48, 40, 8, 0, "shift_to_edge", "mine")], "x int, y int, width int, height int, tile_width int, tile_height int, overlap_x int, overlap_y int, edge_strategy string, tile string")
    tiles = plan_tiles(region).collect()
    assert max(t["source_x"] + t["source_width"] for t in tiles) == 110 and max(t["source_y"] + t["source_height"] for t in tiles) == 80
    assert not any(t["padded"] for t in tiles) and {t["tile"] for t in tiles} == {"mine"}
    padded = plan_tiles(region.withColumn("width", F.lit(40)).withColumn("height", F.lit(40)).withColumn("tile_width", F.lit(32)).withColumn("tile_height", F.lit(32)).withColumn("overlap_y", F.lit(8)).withColumn("edge_strategy", F.lit("pad")))
    assert padded.count() == 4 and padded.where("padded").count() == 3
    assert plan_tiles(region.limit(0)).count() == 0


@pytest.mark.parametrize(("raw", "want"), [(" CON. ", "_CON"), ("cam:01/frame?", "cam_01_frame_"), ("lpt9.txt", "_lpt9.txt"), (" . ", None), ("a\tb", "a_b"), (None, None), ("x" * 5000, "x" * 5000)])
def test_sanitized_names(spark, raw, want):
    assert value(spark, names.sanitized_stem(F.lit(raw).cast("string"))) == want


def test_file_names(spark):
    items = spark.createDataFrame([(1, "frame"), (2, "FRAME"), (3, "frame"), (4, "frame_0003"), (5, "taken"), (6, ".."), (7, None)], "i int, stem string")
    occupied = spark.createDataFrame([("TAKEN.png",), ("frame_0002.png",), (None,)], "n string")
    got = {r["i"]: r["file_name"] for r in file_names(items, "stem", ".PNG", "i", occupied).collect()}
    assert got == {1: "frame.png", 2: "FRAME_0004.png", 3: "frame_0005.png", 4: "frame_0003.png", 5: "taken_0002.png", 6: None, 7: None}
    with pytest.raises(ValueError):
        file_names(items, "stem", "p/ng", "i")


def test_file_names_of_many_conflicts(spark):
    rows = [*[(i, "frame") for i in range(1, 12_002)], (20_000, "frame_10005"), (20_001, "frame_0010006")]
    items = spark.createDataFrame(rows, "i bigint, stem string")
    occupied = spark.createDataFrame([("frame_10003.png",), ("frame_1234567.png",)], "n string")
    got = {r["i"]: r["file_name"] for r in file_names(items, "stem", "png", "i", occupied).collect()}
    assert len(set(got.values())) == len(got) == 12_003 and not {"frame_10003.png", "frame_1234567.png"} & set(got.values())
    assert [got[i] for i in (1, 1000, 9999, 10_000, 10_003, 10_004)] == ["frame.png", "frame_1000.png", "frame_9999.png", "frame_10000.png", "frame_10004.png", "frame_10006.png"]
    assert got[12_001] == "frame_12003.png" and got[20_000] == "frame_10005.png" and got[20_001] == "frame_0010006.png"


def test_templates(spark):
    assert parse_template("a}b{row}") == [("text", "a}b"), ("field", "row")]
    for bad in ("", " ", "{row", "{nope}", "{row}}"):
        with pytest.raises(ValueError):
            parse_template(bad)
    assert value(spark, render_template("{source}-{row}", {"source": F.lit("s"), "row": F.lit(3)})) == "s-3"
    assert value(spark, render_template("{roi}", {"roi": F.lit(None).cast("string")})) is None


def test_text_functions(spark):
    assert value(spark, names.clock_text(F.lit(363_723_004))) == "101:02:03.004"
    assert [value(spark, names.clock_ms(F.lit(t))) for t in ("12.5", "1:02:03.004", "x", "")] == [12_500, 3_723_004, None, None]
    assert value(spark, names.without_extended_prefix(F.lit(r"\\?\UNC\srv\x"))) == r"\\srv\x"
    assert value(spark, names.without_extended_prefix(F.lit(r"\\?\C:\x"))) == r"C:\x"
    assert value(spark, names.rgba_of_hex(F.lit("#0aFF10"))) == [10, 255, 16, 255]
    assert value(spark, names.hex_of_rgba(F.array(*map(F.lit, (10, 255, 16, 255))))) == "#0aff10"
    assert value(spark, names.stem(F.lit(".hidden"))) == ".hidden" and value(spark, names.stem(F.lit("a.b.jpg"))) == "a.b"
    assert [value(spark, names.file_kind(F.lit(p))) for p in ("a/b.JPG", "b.m2ts", "b.txt", "b", ".jpg")] == ["image", "video", "unsupported", "unsupported", "unsupported"]
    assert [value(spark, names.valid_project_name(F.lit(n))) for n in ("ok", " ", "a.", "a?b")] == [True, False, False, False]
    assert value(spark, rounded_ms(F.lit("2.5005"))) == 2501 and value(spark, rounded_ms(F.lit("N/A"))) is None and value(spark, rounded_ms(F.lit("-1"))) is None
    assert [value(spark, reflected_index(F.lit(i), F.lit(3))) for i in (-1, 0, 2, 3, 4, 5)] == [1, 0, 2, 1, 0, 1]
    assert value(spark, reflected_index(F.lit(7), F.lit(1))) == 0 and value(spark, clamped_index(F.lit(9), F.lit(3))) == 2


def test_fingerprints(spark, tmp_path):
    big = bytes(range(256)) * 800
    for name, data in (("a.png", b"x" * 10), ("sub/b.JPG", big), ("c.txt", b"t"), ("d.mp4", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = fingerprints(list_files(spark, str(tmp_path), str(tmp_path / "sub"), content=True))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert len(got) == files.count() == 3  # the empty file isn't listed
    assert {n: r["failure"] for n, r in got.items()} == {"a.png": None, "b.JPG": None, "c.txt": "unsupported"}
    for name, data in (("a.png", b"x" * 10), ("b.JPG", big)):
        edges = data[:65536] + (data[-65536:] if len(data) > 65536 else b"")
        assert got[name]["quick_fingerprint"] == hashlib.sha256(struct.pack("<Q", len(data)) + edges).hexdigest()
        assert got[name]["sha256"] == hashlib.sha256(data).hexdigest()
    assert value(spark, little_endian(F.lit(258), 4)) == b"\x02\x01\x00\x00"
    assert value(spark, hex16(F.lit(255))) == "00000000000000ff"
    assert value(spark, quick_fingerprint(F.lit(None).cast("binary"))) is None


def test_probe_documents(spark):
    doc = '{"streams":[{"index":0,"codec_type":"audio"},{"index":1,"codec_type":"video","codec_name":"h264","width":1920,"tags":{"a":"b"}}],"format":{"duration":"2.50","tags":{"creation_time":"t"}}}'
    facts = value(spark, video_facts(F.lit(doc)))
    assert (facts["codec"], facts["width"], facts["duration_ms"], facts["creation_time"]) == ("h264", 1920, 2500, "t")
    for bad in ("{}", "nonsense", None, '{"streams":[]}'):
        assert value(spark, video_facts(F.lit(bad).cast("string"))) is None
    frames = '{"frames":[{"best_effort_timestamp_time":"0.040"},{"best_effort_timestamp_time":"0.0"},{"best_effort_timestamp_time":"N/A"},{},{"best_effort_timestamp_time":"0.040"}]}'
    assert value(spark, frame_times(F.lit(frames))) == [0, 40] and value(spark, frame_times(F.lit("x"))) == []
    assert value(spark, transcode_percent(F.lit("out_time_us=500000"), F.lit(1000))) == 50
    assert value(spark, transcode_percent(F.lit("frame=5"), F.lit(1000))) is None


def test_ranges_against_brute_force(spark):
    import random

    rng = random.Random(1)
    ranges = [("v", s, s + rng.choice([1, 100, 20_000, 5_000_000])) for s in (rng.randrange(10_000_000) for _ in range(60))] + [("v", 5, 5), (None, 0, 9)]
    points = [(rng.choice(["v", "w", None]), rng.randrange(11_000_000)) for _ in range(400)] + [("v", None)]
    got = contained_in(spark.createDataFrame(points, "k string, p bigint"), spark.createDataFrame(ranges, "k string, s bigint, e bigint"), "k", "p", "s", "e", "inside").collect()
    assert len(got) == len(points)
    for r in got:
        assert r["inside"] == (r["k"] is not None and r["p"] is not None and any(k == r["k"] and s <= r["p"] < e for k, s, e in ranges))


@pytest.mark.parametrize("scope", ["source", "source_group", "project"])
def test_near_pairs_against_brute_force(spark, scope):
    import random

    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(250):
        h = rng.choice(base)
        for b in rng.sample(range(63), rng.randrange(0, 7)):
            h ^= 1 << b
        rows.append((f"k{i:03}", rng.choice(["s1", "s2", None]), rng.choice(["g1", "g2"]), rng.choice([None, rng.randrange(200_000)]), rng.choice(["d1", "d2", None, f"x{i}"]), rng.choice([h, h, h, None])))
    df = spark.createDataFrame(rows, "asset_key string, source_id string, source_group string, offset_ms bigint, digest string, hash bigint")
    part = {"source": 1, "source_group": 2}.get(scope)
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[5] is None or b[5] is None or (part and (a[part] is None or a[part] != b[part])) or (a[4] is not None and a[4] == b[4]):
                continue
            if a[1] is not None and a[1] == b[1] and a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > 30_000:
                continue
            if (a[5] ^ b[5]).bit_count() <= 8:
                want.add((a[0], b[0]))
    got = [tuple(r) for r in near_pairs(df, scope).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_upsert_and_folds(spark):
    schema = "k string, a int, b string"
    old = spark.createDataFrame([("x", 1, None), ("y", 2, "o"), (None, 9, "n")], schema)
    new = spark.createDataFrame([("y", 5, "n"), ("z", 7, None), (None, 4, None)], schema)
    got = {r["k"]: (r["a"], r["b"], r["existed"]) for r in store.upsert(old, new, ["k"], {"a": store.GREATEST, "b": store.NEW_FIRST}).collect()}
    assert got == {"x": (1, None, True), "y": (5, "n", True), "z": (7, None, False), None: (9, "n", True)}
    versions = spark.createDataFrame([("x", 1, "first"), ("x", 3, None), ("x", 2, "mid")], schema)
    got = store.fold_versions(versions.withColumn("c", F.col("b")), ["k"], ["a"], first=["c"], last_known=["b"]).first()
    assert (got["a"], got["b"], got["c"]) == (3, "mid", "first")
    log = spark.createDataFrame([(1, i, a) for i, a in enumerate(["keep", "lock", "exclude", "unlock"])] + [(2, 1, "exclude"), (2, 2, "restore"), (3, 1, "unknown")], "e int, n int, a string")
    assert {tuple(r) for r in store.event_state(log, "e", "n", "a").collect()} == {(1, "exclude", False), (2, None, False), (3, None, False)}


def test_kernels():
    y, x = np.mgrid[:64, :64]
    gradient = ((x + y) % 256).astype(np.uint8)
    assert K.global_ssim(gradient, gradient) == pytest.approx(1.0)
    assert K.perceptual_hash(gradient) == K.perceptual_hash(gradient) and K.perceptual_hash(gradient) < 1 << 63
    flat = K.quality(np.full((48, 64), 24, np.uint8))
    assert flat["sharpness"] == 0 and flat["low_information"] > 0.95 and flat["underexposed_ratio"] == 0
    rgba = np.arange(64, dtype=np.uint8).reshape(4, 4, 4)
    tile = K.render_tile(rgba, (1, 1, 3, 3), (1, 1, 5, 5), "constant", (1, 2, 3, 255))
    assert tile.shape == (5, 5, 4) and tile[4, 4].tolist() == [1, 2, 3, 255] and (tile[:3, :3] == rgba[1:, 1:]).all()
    two = np.array([[10, 20]], np.uint8)
    assert K.render_tile(two, (0, 0, 2, 1), (0, 0, 4, 1), "edge")[0, :, 0].tolist() == [10, 20, 20, 20]
    assert K.render_tile(two, (0, 0, 2, 1), (0, 0, 4, 1), "reflect")[0, :, 0].tolist() == [10, 20, 10, 20]
    a = np.arange(6).reshape(2, 3)
    assert K.orient(a, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and K.orient(a, 3).tolist() == [[5, 4, 3], [2, 1, 0]] and K.orient(a, 5).tolist() == a.T.tolist()
    assert K.brighten(two, 5, -3, 9)[1] == K.brighten(two, 5, -3, 9)[1]
    with pytest.raises(ValueError):
        K.brighten(two, 5, 3, 2)


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        image = rng.integers(0, 256, (13, 17, channels), np.uint8)
        assert (K.decode_png(K.encode_png(image)) == image).all()
    for bad in (b"", b"GIF89a", K.encode_png(np.zeros((4, 4), np.uint8))[:40]):
        with pytest.raises(ValueError):
            K.decode_png(bad)


def test_measured_column(spark):
    image = K.encode_png(np.full((8, 8), 200, np.uint8))
    df = spark.createDataFrame([(1, image), (2, b"broken"), (3, None)], "i int, content binary")
    got = {r["i"]: r["m"] for r in df.select("i", K.measure_images()("content").alias("m")).collect()}
    assert got[1]["width"] == 8 and got[1]["entropy"] == 0 and got[1]["decode_error"] is None
    assert got[2]["decode_error"] and got[2]["width"] is None and got[3]["decode_error"] == "no content"
