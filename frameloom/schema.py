"""The project's tables and their columns, and projects made of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from frameloom.sources.sinks import write_document

#: Columns of the tables of a project, as in its test tables.
TABLES = {
    "source_assets": """id string, absolute_path string, file_name string, relative_folder string, source_group string, source_identifier string, kind string, status string,
        size_bytes bigint, modified_unix_ms bigint, quick_fingerprint string, sha256 string, width int, height int, duration_ms bigint, codec string, frame_rate string,
        capture_time string, capture_time_source string, orientation int, thumbnail_path string, error string, imported_at timestamp_ntz, last_checked_at timestamp_ntz""",
    "source_removals": "source_id string, source_group string, removed_at timestamp_ntz, reason string",
    "candidate_images": """id string, source_id string, video_offset_ms bigint, source_frame_number bigint, selection_method string, parameters_json string, image_path string,
        thumbnail_path string, width int, height int, pinned boolean, created_at timestamp_ntz""",
    "video_selections": "id string, source_id string, start_ms bigint, end_ms bigint, label string, protected boolean, created_at timestamp_ntz",
    "roi_profiles": """id string, scope_kind string, scope_value string, name string, x int, y int, width int, height int, render_config_json string, created_at timestamp_ntz,
        updated_at timestamp_ntz""",
    "review_inputs": """asset_key string, source_id string, candidate_id string, image_path string, video_offset_ms bigint, pinned boolean, width int, height int, aspect_ratio double,
        sharpness double, underexposed_ratio double, overexposed_ratio double, entropy double, low_information double, content_sha256 string, perceptual_hash string,
        decode_error string, reasons array<string>, analyzed_at timestamp_ntz""",
}

#: Changes of the tables so far; a project keeps the number of the last one it has.
VERSION = 1


def create_missing(spark: SparkSession, folder: str) -> list[str]:
    """Write an empty table for each that a project folder lacks, and return their names; running again changes nothing."""
    made = []
    for name, columns in TABLES.items():
        path = f"{folder}/{name}.parquet"
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            spark.createDataFrame([], columns).write.parquet(path)
            made.append(name)
    return made


def create_project(spark: SparkSession, folder: str, name: str) -> None:
    """A new project: its folder, its document and empty tables. A folder that is there already is an error."""
    Path(folder).mkdir(parents=True)
    create_missing(spark, folder)
    write_document(f"{folder}/project.json", {"name": name, "version": VERSION})
