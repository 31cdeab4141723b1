"""Headers of image files: size, orientation and capture time without decoding pixels."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

# Tags of the image file directory.
_ORIENTATION, _DATE_TIME, _EXIF, _ORIGINAL = 0x0112, 0x0132, 0x8769, 0x9003
_FACTS = "width int, height int, orientation int, capture_time string, error string"


def _directory(block: bytes, order: str, at: int) -> dict[int, tuple[int, int, bytes]]:
    """tag -> (type, count, value or place of it) of one directory of a TIFF block."""
    out = {}
    if at + 2 > len(block):
        return out
    (n,) = struct.unpack_from(order + "H", block, at)
    for i in range(n):
        place = at + 2 + 12 * i
        if place + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", block, place)
        out[tag] = (kind, count, block[place + 8 : place + 12])
    return out


def _text(block: bytes, order: str, entry: tuple[int, int, bytes] | None) -> str | None:
    if not entry or entry[0] != 2:
        return None
    _, count, value = entry
    raw = value[:count] if count <= 4 else block[(at := struct.unpack(order + "I", value)[0]) : at + count]
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None


def _tags(block: bytes) -> tuple[int, str | None]:
    """(orientation, capture time) of a TIFF block; 1 and None where it doesn't say."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if not order or len(block) < 8:
        return 1, None
    main = _directory(block, order, struct.unpack_from(order + "I", block, 4)[0])
    more = _directory(block, order, struct.unpack(order + "I", main[_EXIF][2])[0]) if _EXIF in main else {}
    turn = struct.unpack_from(order + "H", main[_ORIENTATION][2])[0] if _ORIENTATION in main else 1
    return (turn if 1 <= turn <= 8 else 1), _text(block, order, more.get(_ORIGINAL)) or _text(block, order, main.get(_DATE_TIME))


def inspect_header(data: bytes) -> tuple[int, int, int, str | None]:
    """(width, height, orientation, capture time) of a JPEG or PNG; sizes are those of the upright picture. ValueError for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return *struct.unpack(">II", data[16:24]), 1, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG or PNG")
    turn, time, at = 1, None, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a broken JPEG")
        mark, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            turn, time = _tags(body[6:])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if len(body) < 5:
                break
            height, width = struct.unpack_from(">HH", body, 1)
            return (height, width, turn, time) if turn >= 5 else (width, height, turn, time)
        at += 2 + length
    raise ValueError("a JPEG without a size")


def inspect_images():
    """A vectorised column function: the head of an image file -> its facts, or the error that it can't be read."""

    @F.pandas_udf(_FACTS)
    def inspect(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                if data is None:
                    raise ValueError("no content")
                rows.append((*inspect_header(bytes(data)), None))
            except (ValueError, struct.error) as e:
                rows.append((None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "orientation", "capture_time", "error"]).astype({"width": "Int32", "height": "Int32", "orientation": "Int32"})

    return inspect
