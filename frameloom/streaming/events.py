"""Structured Streaming: windowed counts of late events, and change selection that goes on across batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A table's files as a stream, so many files a batch."""
    schema = spark.read.parquet(path).schema
    # A pattern, because the path of a stream must be a folder and a table may be a single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def window_counts(events: DataFrame, time: str, key: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Counts per key and tumbling window; events later than ``lateness`` are left out of windows already closed."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), key, "n_events")


def select_changes(points: DataFrame, entity: str, time: str, score: str, threshold: float, least: int, most: int) -> DataFrame:
    """The streaming form of change selection: the state of an entity is the time last taken.

    Points of one batch are taken in time order; points before the last one taken come too late and are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        taken = []
        rows = pd.concat(list(batches)).groupby("t", as_index=False)["s"].max().sort_values("t")
        for t, s in zip(rows["t"].tolist(), rows["s"].tolist(), strict=True):
            if last is None or (t > last and (t - last >= most or (s >= threshold and t - last >= least))):
                last = t
                taken.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({entity: [key[0]] * len(taken), time: taken})

    kind = points.schema[entity].dataType.simpleString()
    rows = points.select(F.col(entity).alias("k"), F.col(time).cast("bigint").alias("t"), F.col(score).cast("double").alias("s")).where("k is not null and t is not null")
    return rows.groupBy("k").applyInPandasWithState(step, f"{entity} {kind}, {time} bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def frame_changes(frames: DataFrame, entity: str, order: str, pixels: str) -> DataFrame:
    """The streaming form of frame differences: (entity, order, frame, score), where the state of an entity is its last
    frame. The first frame has score 0, a later one its mean difference from the one before, as a share of the full range.

    Frames of one batch are taken in order; ones before the last taken come too late and are left out, as are frames of
    another size than the one before, which can't be compared.
    """
    size = 4

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, number, before = state.get if state.exists else (None, -1, None)
        before = None if before is None else np.frombuffer(before, np.uint8)
        out = []
        rows = pd.concat(list(batches)).sort_values("t")
        for t, px in zip(rows["t"].tolist(), rows["px"].tolist(), strict=True):
            now = np.asarray(px, np.uint8)
            if last is not None and (t <= last or len(now) != len(before)):
                continue
            score = 0.0 if before is None else float(np.abs(now.astype(np.int32) - before).mean() / 255)
            last, number, before = t, number + 1, now
            out.append((key[0], t, number, score))
        if last is not None:
            state.update((last, number, before.tobytes()))
        yield pd.DataFrame(out, columns=range(size)).set_axis([entity, order, "frame", "score"], axis=1)

    kinds = [frames.schema[c].dataType.simpleString() for c in (entity, order)]
    rows = frames.select(F.col(entity).alias("k"), F.col(order).alias("t"), F.col(pixels).alias("px")).where("k is not null and t is not null and px is not null")
    made = f"{entity} {kinds[0]}, {order} {kinds[1]}, frame bigint, score double"
    return rows.groupBy("k").applyInPandasWithState(step, made, f"last {kinds[1]}, number bigint, before binary", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now, and return what it wrote.

    Every batch overwrites its own folder of the shared checkpoint folder, so that a batch that runs again after a loss
    leaves no copy. Added: ``batch``, by which the last update of a row can be told.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    written: list[int] = []  # this function runs where the query was started

    def write(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())]))
    return spark.read.parquet(f"{base}/out")
