"""Limits that must not lose rows without a word, and settings that must not be guessed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frameloom import session
from frameloom.functions.kernels import decode_png
from frameloom.plans import sampling
from frameloom.plans.export import file_names

ROOT = Path(__file__).resolve().parent.parent


def test_rates_without_a_denominator(spark):
    df = spark.createDataFrame([("25", 1000), ("30000/1001", 1000), ("0", 1000), ("25/0", 1000), (None, 1000), ("x", 1000)], "r string, d bigint")
    got = [r[0] for r in df.select(sampling.frame_interval(F.col("d"), F.col("r"), 5)).collect()]
    assert got[0] == [0, 200, 400, 600, 800] and got[1] == [0, 167, 334, 501, 667, 834][: len(got[1])] and got[2:] == [None] * 4


def test_plans_of_exactly_the_limit_and_over_it(spark):
    times = lambda ms: spark.range(1).select(F.size(sampling.frame_interval(F.lit(ms).cast("bigint"), F.lit("25/1"), 1))).first()[0]
    assert times(4_000_000) == 100_000
    for plan in (sampling.frame_interval(F.lit(4_000_040).cast("bigint"), F.lit("25/1"), 1), sampling.fixed_interval(F.lit(100_001).cast("bigint"), 1), sampling.range_times(F.lit(5).cast("bigint"), F.lit(100_006).cast("bigint"), 1)):
        with pytest.raises(PySparkException, match="over the limit"):
            spark.range(1).select(plan).collect()


def test_frame_counts_are_exact(spark):
    rows = [(d, n, k) for d in (1, 33, 34, 1001, 99_999, 4_000_000) for n, k in ((30000, 1001), (25, 1), (999, 1000), (1, 7))]
    df = spark.createDataFrame([(d, f"{n}/{k}") for d, n, k in rows], "d bigint, r string")
    got = [r[0] for r in df.select(sampling.frame_counts(F.col("d"), F.col("r"), 3)).collect()]

    def brute(d, n, k):
        i = 0
        while (i * 3 * k * 1000 + n // 2) // n < d:
            i += 1
        return i

    assert got == [brute(*r) for r in rows]


def test_names_fold_ascii_letters_only(spark):
    df = spark.createDataFrame([(1, "Ä"), (2, "ä"), (3, "A"), (4, "a")], "id int, s string")
    assert [r[0] for r in file_names(df, "s", "jpg", "id").orderBy("id").select("file_name").collect()] == ["Ä.jpg", "ä.jpg", "A.jpg", "a_0002.jpg"]


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.ensure_checkpoint_dir(Session())


def test_superseded_checkpoints_are_removed(spark):
    df = session.cut(spark.range(10))
    stored = Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert stored.exists()
    session.release(df)
    session.release(spark.range(3))
    assert not stored.exists()


def test_filtered_rows_of_pixels():
    import struct
    import zlib

    import numpy as np

    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (9, 7, 3))
    raw = b""
    for y in range(9):
        kind = y % 5
        row = pixels[y].reshape(-1)
        up = pixels[y - 1].reshape(-1) if y else np.zeros(21, int)
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, near][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    packed = zlib.compress(raw)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", packed[:40]) + chunk(b"IDAT", packed[40:]) + chunk(b"IEND", b"")
    assert (decode_png(png) == pixels).all()


@pytest.mark.parametrize("broken", [None, "import no_such_module\n"])
def test_the_core_stands_without_the_subpackage(tmp_path, broken):
    shutil.copytree(ROOT / "frameloom", tmp_path / "frameloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    left = tmp_path / "frameloom" / "llm"
    (left / "__pycache__").mkdir(parents=True)
    if broken:
        (left / "__init__.py").touch()
        (left / "catalog.py").write_text(broken)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_missing_folders_and_empty_files_are_told(spark, tmp_path):
    from frameloom.sources.scan import list_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(b"1")
    (tmp_path / "a" / "empty.png").write_bytes(b"")
    (tmp_path / "a" / "note.txt").write_bytes(b"1")
    got = {r["path"].rsplit("/", 1)[-1]: r["failure"] for r in list_files(spark, str(tmp_path / "a"), str(tmp_path / "gone"), content=True).collect()}
    print(got)
    assert got.items() >= {"x.png": None, "note.txt": "unsupported", "gone": "missing"}.items()
    assert got.get("empty.png", "empty") == "empty"
    assert [r["failure"] for r in list_files(spark, str(tmp_path / "gone")).collect()] == ["missing"]
