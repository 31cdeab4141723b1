"""Headers of image files: byte orders, orientations, and files that say nothing or are broken."""

import struct

import pytest

from frameloom.functions.kernels import encode_png
from frameloom.sources.images import inspect_header


def tiff(order, orientation=None, time=None, original=None):
    mark = b"II" if order == "<" else b"MM"
    entries = []
    size = (orientation is not None) + (time is not None) + (original is not None)
    data_at = 8 + 2 + 12 * size + 4
    data = b""
    if orientation is not None:
        entries.append(struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0))
    if time is not None:
        entries.append(struct.pack(order + "HHII", 0x0132, 2, len(time) + 1, data_at + len(data)))
        data += time.encode() + b"\0"
    if original is not None:
        entries.append(struct.pack(order + "HHII", 0x8769, 4, 1, data_at + len(data)))
        inner = data_at + len(data)
        data += struct.pack(order + "HHHIII", 1, 0x9003, 2, len(original) + 1, inner + 18, 0) + original.encode() + b"\0"
    return mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", size) + b"".join(entries) + b"\0" * 4 + data


def jpeg(block=None, width=640, height=480, before=b""):
    app = b"" if block is None else b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    return b"\xff\xd8" + before + app + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientations(order, orientation):
    got = inspect_header(jpeg(tiff(order, orientation, "2024:01:02 03:04:05")))
    assert got == ((480, 640) if orientation >= 5 else (640, 480)) + (orientation, "2024:01:02 03:04:05")


def test_original_time_comes_first():
    assert inspect_header(jpeg(tiff("<", 1, "2024:01:02 03:04:05", "2023:01:01 00:00:00")))[3] == "2023:01:01 00:00:00"


def test_files_that_say_nothing():
    assert inspect_header(jpeg()) == (640, 480, 1, None)
    assert inspect_header(jpeg(tiff(">", 9))) == (640, 480, 1, None)
    assert inspect_header(jpeg(b"XX" + b"\0" * 20, before=b"\xff\xe0\x00\x04ab")) == (640, 480, 1, None)


def test_png():
    import numpy as np

    assert inspect_header(encode_png(np.zeros((5, 7), np.uint8))) == (7, 5, 1, None)


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xc0\x00\x03", b"\xff\xd8\x00\x00\x00\x00"])
def test_broken_files(data):
    with pytest.raises((ValueError, struct.error)):
        inspect_header(data)
