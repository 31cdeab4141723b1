"""Documents of a media probe, read as nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.measures import rounded_ms

PROBE = """streams array<struct<index: int, codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, duration: string, tags: map<string, string>>>,
  format struct<filename: string, duration: string, size: string, tags: map<string, string>>"""
FRAMES = "frames array<struct<best_effort_timestamp_time: string>>"


def video_facts(document: Column) -> Column:
    """A struct of the first video stream of a probe document: codec, size, rate, duration_ms, creation_time.

    The duration comes from the format, else the stream; the creation time from the stream's tags, else the format's.
    A document without a video stream, or that is no document, gives null.
    """
    d = F.from_json(document, PROBE)
    s = F.try_element_at(F.filter(F.coalesce(d["streams"], F.array()), lambda x: x["codec_type"] == "video"), F.lit(1))
    tag = lambda tags: F.try_element_at(tags, F.lit("creation_time"))
    facts = F.struct(
        s["codec_name"].alias("codec"), s["width"].alias("width"), s["height"].alias("height"), s["avg_frame_rate"].alias("frame_rate"),
        rounded_ms(F.coalesce(d["format"]["duration"], s["duration"])).alias("duration_ms"),
        F.coalesce(tag(s["tags"]), tag(d["format"]["tags"])).alias("creation_time"),
    )
    return F.when(s.isNotNull(), facts)


def frame_times(document: Column) -> Column:
    """The times of a frame document in milliseconds, ascending and distinct; unreadable and negative ones are left out."""
    frames = F.coalesce(F.from_json(document, FRAMES)["frames"], F.array())
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(frames, lambda x: rounded_ms(x["best_effort_timestamp_time"])))))


def transcode_percent(line: Column, duration_ms: Column) -> Column:
    """Progress out of an ``out_time_us=`` line, at most 99; null for other lines."""
    us = F.nullif(F.regexp_extract(line, r"^out_time_us=(\d+)\s*$", 1), F.lit("")).cast("bigint")
    return F.when((duration_ms > 0) & us.isNotNull(), F.least(F.lit(99), F.floor(us / (duration_ms * 10))))
