"""Sinks beside tables: single files of bytes, snapshots of tables, documents."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import ship_package


def put_bytes(folder: str, name: str, content: bytes) -> str | None:
    """Write a file that is either there whole or not at all: None, or why it wasn't written. Nothing is overwritten."""
    target = Path(folder) / name
    if os.path.basename(name) != name or name in ("", ".", ".."):
        return "not a file name"
    part = target.with_name(f".{uuid.uuid4().hex}.part")
    try:
        with part.open("xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.link(part, target)  # fails where the name is taken, in one step
    except FileExistsError:
        return "the name is taken"
    except OSError as e:
        return e.strerror or str(e)
    finally:
        part.unlink(missing_ok=True)
    return None


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write rows of (file_name, content) as files of a folder that all executors share: (file_name, error).

    Lazy, as every frame: what is computed from the result decides what is written, so take it once. A task that runs
    again finds the names it wrote taken; a file whose content is the same then counts as written. Null names or
    contents are errors.
    """
    ship_package(files.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for name, content in zip(batch["file_name"], batch["content"], strict=True):
                if name is None or content is None:
                    errors.append("no name or content")
                    continue
                error = put_bytes(folder, name, bytes(content))
                if error == "the name is taken" and (Path(folder) / name).read_bytes() == bytes(content):
                    error = None
                errors.append(error)
            yield pd.DataFrame({"file_name": batch["file_name"], "error": errors})

    return files.select("file_name", F.col("content").cast("binary").alias("content")).mapInPandas(write, "file_name string, error string")


def snapshot(table: DataFrame, path: str) -> None:
    """A copy of a table as it is now; a folder that is there already is an error."""
    table.write.mode("errorifexists").parquet(path)


def write_document(path: str, document: dict) -> None:
    """A JSON document in the place of what was there, in one step."""
    target = Path(path)
    part = target.with_name(f".{uuid.uuid4().hex}.part")
    part.write_text(json.dumps(document, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(target)
