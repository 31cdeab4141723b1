"""Files, snapshots, documents and projects on disk."""

import json

import pytest
from pyspark.errors import PySparkException

from frameloom.queries import catalog
from frameloom.schema import TABLES, create_missing, create_project
from frameloom.sources.sinks import put_bytes, snapshot, write_document, write_files
from frameloom.sources.tables import read_table


def test_files_are_whole_and_never_overwritten(spark, tmp_path):
    (tmp_path / "taken.png").write_bytes(b"old")
    rows = [("a.png", bytearray(b"1")), ("b.png", bytearray(b"2" * 100_000)), ("taken.png", bytearray(b"new")), ("../out.png", bytearray(b"x")), (None, bytearray(b"x")), ("c.png", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_name string, content binary, error string")
    for _ in range(2):  # a second run of the same tasks finds its own files
        got = {r["file_name"]: r["error"] for r in write_files(df, str(tmp_path)).collect()}
        assert got == {"a.png": None, "b.png": None, "taken.png": "the name is taken", "../out.png": "not a file name", None: "no name or content", "c.png": "no name or content"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.png", "b.png", "taken.png"] and (tmp_path / "taken.png").read_bytes() == b"old"
    assert put_bytes(str(tmp_path / "nowhere"), "a", b"") is not None


def test_snapshots_and_documents(spark, tmp_path):
    df = spark.range(5)
    snapshot(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5
    with pytest.raises(PySparkException):
        snapshot(df, str(tmp_path / "s"))
    for n in (1, 2):
        write_document(str(tmp_path / "d.json"), {"n": n, "name": "仓库"})
    assert json.loads((tmp_path / "d.json").read_text(encoding="utf-8")) == {"n": 2, "name": "仓库"}


def test_projects(spark, tmp_path):
    folder = str(tmp_path / "p")
    create_project(spark, folder, "north")
    assert create_missing(spark, folder) == []
    assert all(read_table(spark, folder, t).count() == 0 for t in TABLES)
    with pytest.raises(FileExistsError):
        create_project(spark, folder, "north")
    for name in ("src_status_counts", "p2_found", "p5_found", "review_counts", "import_actions", "candidates_made", "export_frames_skip", "export_tiles_plan", "near_duplicate_edges_project", "comparison_counts"):
        if name == "p2_found" or name in catalog.QUERIES:
            assert catalog.QUERIES[name](spark, folder).count() in (0, 1), name
