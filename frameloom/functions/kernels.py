"""Image kernels in numpy, and the vectorised functions that apply them to columns."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Codecs that are there; any other fails for its row, as an unreadable image does.
CODECS = ("png",)

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of a (height, width) or (height, width, 1..4) array."""
    a = np.atleast_3d(np.asarray(pixels, np.uint8))
    height, width, channels = a.shape
    kind = {n: k for k, n in _CHANNELS.items()}[channels]
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    rows = np.hstack([np.zeros((height, 1), np.uint8), a.reshape(height, -1)]).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width, channels) array of an 8-bit PNG without interlacing or palette; ValueError for others."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        (length,), tag = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if len(body) < length:
            raise ValueError("a truncated file")
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif tag == b"IDAT":
            packed.append(body)
        at += 12 + length
    if not head or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("a kind of PNG that isn't supported")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError) as e:
        raise ValueError("a truncated file") from e
    out = np.zeros((height, width * channels), np.int32)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        mode, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if mode == 2:
            line = line + above
        elif mode == 1:
            line = np.cumsum(line.reshape(-1, channels), axis=0).reshape(-1)
        elif mode in (3, 4):
            line = np.array(_unpredicted(line.tolist(), above.tolist(), channels, mode == 3), np.int32)
        above = out[y] = line & 255
    return out.reshape(height, width, channels).astype(np.uint8)


def _unpredicted(line: list[int], above: list[int], channels: int, average: bool) -> list[int]:
    """A row of bytes whose values were given against the average of, or the nearest among, their neighbours."""
    done = [0] * channels
    corner = [0] * channels + above
    for i, value in enumerate(line):
        left, up = done[i], above[i]
        if average:
            guess = (left + up) >> 1
        else:
            c = corner[i]
            from_left, from_up, from_corner = abs(up - c), abs(left - c), abs(left + up - 2 * c)
            guess = left if from_left <= from_up and from_left <= from_corner else up if from_up <= from_corner else c
        done.append((value + guess) & 255)
    return done[channels:]


def luma(pixels: np.ndarray) -> np.ndarray:
    """Brightness of RGB(A) pixels by the Rec. 709 weights, in whole levels; gray stays as it is."""
    a = np.atleast_3d(pixels)
    if a.shape[2] < 3:
        return a[:, :, 0].astype(np.uint8)
    weighted = a[:, :, :3].astype(np.int64) @ np.array([2126, 7152, 722])
    return (weighted // 10000).astype(np.uint8)


def _weights(source: int, target: int, support: float, kernel) -> np.ndarray:
    scale = source / target
    wide = max(scale, 1.0)
    centres = (np.arange(target) + 0.5) * scale - 0.5
    x = (np.arange(source)[None, :] - centres[:, None]) / wide
    w = np.where(np.abs(x) < support, kernel(x), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int, method: str = "lanczos3") -> np.ndarray:
    """Pixels resampled to a size, with the ``lanczos3`` or ``triangle`` filter."""
    kernel, support = (lambda x: np.sinc(x) * np.sinc(x / 3), 3.0) if method == "lanczos3" else (lambda x: 1 - np.abs(x), 1.0)
    a = np.atleast_3d(pixels).astype(np.float64)
    a = np.einsum("ty,yxc->txc", _weights(a.shape[0], height, support, kernel), a)
    a = np.einsum("tx,yxc->ytc", _weights(a.shape[1], width, support, kernel), a)
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def perceptual_hash(pixels: np.ndarray) -> int:
    """63 bits: which of the lowest 8 x 8 cosine coefficients (without the first) are over their median."""
    small = luma(resize(pixels, 32, 32)).astype(np.float32)
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * (2 * n + 1) * k / 64).astype(np.float32)
    low = (basis @ small @ basis.T)[:8, :8].reshape(-1)[1:]
    return int(sum(1 << i for i in np.flatnonzero(low > np.sort(low)[31])))


def quality(pixels: np.ndarray) -> dict[str, float]:
    """Size, sharpness, exposure ratios, entropy and low information of an image."""
    y = luma(pixels).astype(np.float64)
    height, width = y.shape
    share = np.bincount(y.astype(np.int64).reshape(-1), minlength=256) / y.size
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    sharpness = 0.0
    if min(height, width) >= 3:
        edge = 4 * y[1:-1, 1:-1] - y[:-2, 1:-1] - y[2:, 1:-1] - y[1:-1, :-2] - y[1:-1, 2:]
        sharpness = float((edge**2).mean() - edge.mean() ** 2)
    unit = lambda x: min(max(x, 0.0), 1.0)
    return {
        "width": width, "height": height, "aspect_ratio": width / max(height, 1), "sharpness": sharpness,
        "underexposed_ratio": float(share[:17].sum()), "overexposed_ratio": float(share[239:].sum()), "entropy": entropy,
        "low_information": 1 - (0.7 * unit(entropy / 8) + 0.3 * unit(float(y.std()) / 64)),
    }


def global_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two images over one window, after resampling to 256 x 256."""
    x, y = (luma(resize(i, 256, 256, "triangle")).astype(np.float64).reshape(-1) for i in (a, b))
    n, c1, c2 = x.size - 1, (0.01 * 255) ** 2, (0.03 * 255) ** 2
    dx, dy = x - x.mean(), y - y.mean()
    return float((2 * x.mean() * y.mean() + c1) * (2 * (dx @ dy) / n + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (dx @ dx / n + dy @ dy / n + c2)))


def orient(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned upright by the orientation tag (1 to 8); other values change nothing."""
    turns = {
        2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: np.swapaxes(a, 0, 1),
        6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(a, 2).swapaxes(0, 1), 8: lambda a: np.rot90(a, 1),
    }
    return turns.get(orientation, lambda a: a)(pixels)


def render_tile(pixels: np.ndarray, roi: tuple[int, int, int, int], tile: tuple[int, int, int, int], padding: str = "constant", fill: tuple[int, ...] = (0, 0, 0, 255)) -> np.ndarray:
    """The canvas of a tile (x, y, width, height in the image) of a region: pixels outside image or region are padded.

    ``constant`` takes the fill colour, ``edge`` the nearest pixel of the region, ``reflect`` mirrors inside it.
    """
    a = np.atleast_3d(pixels)
    x0, y0, w, h = roi
    w, h = min(w, a.shape[1] - x0), min(h, a.shape[0] - y0)
    xs, ys = np.arange(tile[0], tile[0] + tile[2]), np.arange(tile[1], tile[1] + tile[3])
    inside = ((ys >= y0) & (ys < y0 + h))[:, None] & ((xs >= x0) & (xs < x0 + w))[None, :]

    def take(at: np.ndarray, first: int, length: int) -> np.ndarray:
        at = at - first
        if padding == "reflect" and length > 1:
            at = np.mod(at, 2 * length - 2)
            at = np.where(at >= length, 2 * length - 2 - at, at)
        return first + np.clip(at, 0, length - 1)

    canvas = a[take(ys, y0, h)[:, None], take(xs, x0, w)[None, :]]
    return np.where(inside[:, :, None], canvas, np.array(fill[: a.shape[2]], np.uint8)) if padding == "constant" else canvas


def brighten(pixels: np.ndarray, seed: int, least: int, most: int) -> tuple[np.ndarray, int]:
    """Pixels with a brightness offset in [least, most] that the seed decides, and the offset."""
    if least > most:
        raise ValueError("least is over most")
    offset = least + zlib.crc32(struct.pack("<q", seed)) % (most - least + 1)
    return np.clip(np.asarray(pixels, np.int32) + offset, 0, 255).astype(np.uint8), offset


_MEASURED = "width int, height int, aspect_ratio double, sharpness double, underexposed_ratio double, overexposed_ratio double, entropy double, low_information double, perceptual_hash bigint, decode_error string"


def measure_images():
    """A vectorised column function: encoded image -> its quality, perceptual hash, or the error that it can't be read."""

    @F.pandas_udf(_MEASURED)
    def measure(content: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in _MEASURED.split(", ")]
        rows = []
        for data in content:
            try:
                if data is None:
                    raise ValueError("no content")
                pixels = decode_png(bytes(data))
                rows.append(quality(pixels) | {"perceptual_hash": perceptual_hash(pixels), "decode_error": None})
            except ValueError as e:
                rows.append(dict.fromkeys(names) | {"decode_error": str(e)})
        return pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32", "perceptual_hash": "Int64"})

    return measure
