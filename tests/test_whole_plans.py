"""Plans over all inputs: every candidate of a video is exported, and every profile keeps its tiles."""

import json
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def test_export_covers_candidates(spark):
    run = {k: entry.queries()[k](spark, str(FOLDER)) for k in ("export_inputs", "export_tiles", "export_tiles_all", "export_index_all", "export_totals_all", "render_names_all", "item_hashes_all", "manifest_lines_all")}
    offsets = {r["candidate_id"]: r["video_offset_ms"] for r in run["export_inputs"].where("candidate_id is not null").collect()}
    tiles = run["export_tiles_all"].collect()
    frames = [r for r in tiles if r["candidate_id"] is not None]
    assert frames and all(offsets[r["candidate_id"]] == r["video_offset_ms"] for r in frames)
    assert len(tiles) - len(frames) == run["export_tiles"].count()
    lines = run["manifest_lines_all"].collect()
    assert len({r["file_name"] for r in lines}) == len(lines) == len(tiles)
    said = [json.loads(r["record"]) for r in lines]
    assert sorted((r["candidateId"], r["videoOffsetMs"]) for r in said if r["candidateId"]) == sorted((r["candidate_id"], r["video_offset_ms"]) for r in frames)
    assert run["export_index_all"].count() == len(tiles) == run["export_totals_all"].agg({"n_items": "sum"}).first()[0]
    assert run["item_hashes_all"].select("item_hash").distinct().count() == len(tiles)
    assert all(f"_{r['video_offset_ms']}_" in r["raw_name"] for r in run["render_names_all"].where("candidate_id is not null").collect())


def test_exclusions_keep_other_profiles(spark):
    plan, kept = (entry.queries()[k](spark, str(FOLDER)).select("profile_id", "tile_row", "tile_column") for k in ("tile_plan", "tile_exclusions_all"))
    assert kept.select("profile_id").distinct().count() > entry.queries()["tile_exclusions"](spark, str(FOLDER)).select("profile_id").distinct().count()
    assert all(r["tile_row"] == 0 for r in plan.exceptAll(kept).collect()) and kept.exceptAll(plan).count() == 0


def test_plans_over_the_largest_piece(spark, monkeypatch):
    from frameloom.plans import sampling

    names = ("plan_fixed_interval", "plan_frame_interval", "plan_valid_ranges", "group_sampling_rollup")
    run = lambda: [sorted(map(tuple, entry.queries()[k](spark, str(FOLDER)).collect()), key=repr) for k in names]
    whole = run()
    monkeypatch.setattr(sampling, "LARGEST_PLAN", 7)
    assert run() == whole and all(whole)
