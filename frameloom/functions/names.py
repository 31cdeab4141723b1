"""Column functions on paths, file names and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.text import ascii_lower, trim_blank

# Extensions of supported files, device names a file may not have, players' codecs by extension.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mts", "m2ts")
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))
PLAYABLE = {"h264": ("mp4", "m4v", "mov"), "av1": ("mp4", "webm"), "vp8": ("webm",), "vp9": ("webm",)}
UNGROUPED = "未分组"


def extension(path: Column) -> Column:
    """The extension in lower case, without its dot; empty where the last part of the path has none."""
    return ascii_lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]*)$", 1))


def stem(name: Column) -> Column:
    """A file name without its extension; a leading dot begins no extension."""
    return F.regexp_replace(name, r"(?<=[^/\\])\.[^./\\]*$", "")


def file_kind(path: Column) -> Column:
    """``image``, ``video`` or ``unsupported`` by extension."""
    return (
        F.when(extension(path).isin(*IMAGE_EXTENSIONS), "image")
        .when(extension(path).isin(*VIDEO_EXTENSIONS), "video")
        .otherwise("unsupported")
    )


def group_of(folder: Column, root: Column) -> Column:
    """The first part of a relative folder; without one the name of the root, else a fallback."""
    first = F.split(F.translate(folder, "\\", "/"), "/")[0]
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(root, F.lit("")), F.lit(UNGROUPED))


def identifier_of(folder: Column, root: Column) -> Column:
    """The last part of a relative folder; without one the name of the root, else a fallback."""
    last = F.element_at(F.split(F.translate(folder, "\\", "/"), "/"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(root, F.lit("")), F.lit(UNGROUPED))


def sanitized_stem(name: Column) -> Column:
    """A file stem that every file system takes; null where nothing is left.

    Control and reserved characters become ``_``, blanks around and dots and blanks at the end go, and a device
    name before the first dot gets ``_`` in front.
    """
    clean = F.regexp_replace(name, r'[\p{Cc}<>:"/\\|?*]', "_")
    clean = F.regexp_replace(trim_blank(clean), r"[. ]+$", "")
    device = F.upper(F.substring_index(clean, ".", 1)).isin(*DEVICE_NAMES)
    return F.nullif(F.when(device, F.concat(F.lit("_"), clean)).otherwise(clean), F.lit(""))


def clock_text(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm; the hours go on beyond 99; null for null and negative ones."""
    part = lambda divisor, modulus: F.floor(ms / divisor) % modulus if modulus else F.floor(ms / divisor)
    return F.when(ms >= 0, F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000))


def clock_ms(text: Column) -> Column:
    """Milliseconds of plain seconds or H:MM:SS(.mmm); null for anything else."""
    seconds = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.round(text.cast("double") * 1000))
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$", i)
    clock = F.when(part(1) != "", F.round((part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double")) * 1000))
    return F.coalesce(seconds, clock).cast("bigint")


def without_extended_prefix(path: Column) -> Column:
    r"""A Windows path without the prefix of extended paths: ``\\?\UNC\x`` is ``\\x`` and ``\\?\x`` is ``x``."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\\?\\", "")


def plays_directly(codec: Column, path: Column) -> Column:
    """Whether a browser can play the file as it is, by codec and extension."""
    ext, rule = extension(path), F.lit(False)
    for name, extensions in PLAYABLE.items():
        rule = rule | ((F.lower(codec) == name) & ext.isin(*extensions))
    return F.coalesce(rule, F.lit(False))


def size_text(size: Column) -> Column:
    """Bytes for display: whole bytes under 1024, else one decimal in KB, MB or GB."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", size / float(1024**power))
    return F.when(size.isNull(), None).when(size < 1024, F.format_string("%d B", size)).when(size < 1024**2, unit(1, "KB")).when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def rgba_of_hex(color: Column) -> Column:
    """``#rrggbb`` as [r, g, b, 255]; null for anything else."""
    byte = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), F.array(byte(2), byte(4), byte(6), F.lit(255)))


def hex_of_rgba(rgba: Column) -> Column:
    """[r, g, b, a] as ``#rrggbb``."""
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(rgba[i].cast("bigint")), 2, "0") for i in range(3)]))


def contains_text(query: str, *columns: Column) -> Column:
    """Whether the columns, joined by blanks, hold the text, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def valid_project_name(name: Column) -> Column:
    """Whether a project may have that name: not blank, no reserved character, no dot or blank at the end."""
    return F.coalesce((trim_blank(name) != "") & ~name.rlike(r'[<>:"/\\|?*]') & ~name.rlike(r"[. ]$"), F.lit(False))
