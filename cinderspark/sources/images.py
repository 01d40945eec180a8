"""Pictures at the edge: small pixel tables to PNG files, and PNG files to data URIs."""

from __future__ import annotations

import base64
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that a picture may have: what is brought to the driver is bounded.
MOST_CELLS = 40_000_000
#: Stops of the green-yellow-red ramp, low to high, and the class palette.
RAMP = ((0, 104, 55), (166, 217, 106), (255, 255, 191), (253, 174, 97), (165, 0, 38))
PALETTE = ("#1a9850", "#91cf60", "#ffffbf", "#fee08b", "#fdae61", "#f46d43", "#a50026")


def byte_level(value: Column, scale: float = 0.30) -> Column:
    """A fixed stretch to 0..255, the same for every date; no data is 0."""
    level = F.least(F.greatest(F.coalesce(value, F.lit(0.0)) / F.lit(scale), F.lit(0.0)), F.lit(1.0))
    return F.floor(level * 255).cast("int")


def to_array(pixels: DataFrame, columns: list[str], height: int, width: int, y0: int = 0, x0: int = 0) -> np.ndarray:
    """Cells (y, x) of a window as an array; cells that are absent are 0."""
    if height * width > MOST_CELLS:
        raise ValueError(f"{height} x {width} cells are over {MOST_CELLS}: cut a window or thin the grid first")
    inside = pixels.where((F.col("y") >= y0) & (F.col("y") < y0 + height) & (F.col("x") >= x0) & (F.col("x") < x0 + width))
    frame = inside.select("y", "x", *columns).toPandas()
    out = np.zeros((height, width, len(columns)), np.float64)
    out[frame["y"] - y0, frame["x"] - x0] = frame[columns].to_numpy(np.float64)
    return np.nan_to_num(out)


def write_png(path: str | Path, rgba: np.ndarray) -> Path:
    """Write 8-bit RGB or RGBA."""
    height, width, bands = rgba.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.astype(np.uint8).reshape(height, width * bands)], 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 6 if bands == 4 else 2, 0, 0, 0)
    target = Path(path)
    target.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b""))
    return target


def rgb_png(pixels: DataFrame, path: str, bands: tuple[str, str, str], height: int, width: int, scale: float = 0.30) -> Path:
    """Three bands under the fixed stretch."""
    names = ["red", "green", "blue"]
    levels = pixels.select("y", "x", *[byte_level(F.col(b), scale).alias(n) for b, n in zip(bands, names)])
    return write_png(path, to_array(levels, names, height, width))


def ramp_png(
    pixels: DataFrame, path: str, value: str, height: int, width: int, low: float = -0.3, high: float = 1.0, clear_below: float | None = None
) -> Path:
    """One value under the colour ramp; no data is the ramp's low end, and what is below a threshold is clear."""
    level = F.least(F.greatest((F.coalesce(value, F.lit(low)) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    shown = F.lit(1) if clear_below is None else (F.coalesce(value, F.lit(low)) >= clear_below).cast("int")
    cells = to_array(pixels.select("y", "x", level.alias("level"), shown.alias("shown")), ["level", "shown"], height, width)
    at = np.linspace(0, 1, len(RAMP))
    rgb = [np.interp(cells[..., 0], at, [stop[k] for stop in RAMP]) for k in range(3)]
    return write_png(path, np.stack([*rgb, cells[..., 1] * 255], -1))


def class_png(pixels: DataFrame, path: str, code: str, height: int, width: int, clear_below: int = 0, palette: tuple[str, ...] = PALETTE) -> Path:
    """Codes under a palette, never blended; codes below a limit, and no data, are clear."""
    cells = to_array(pixels.select("y", "x", (F.coalesce(code, F.lit(-1)) + 2).alias("k")), ["k"], height, width)[..., 0].astype(int) - 2
    colours = np.array([[int(c[k : k + 2], 16) for k in (1, 3, 5)] for c in palette] + [[0, 0, 0]])
    known = (cells >= max(clear_below, 0)) & (cells < len(palette))
    rgb = colours[np.where(known, cells, len(palette))]
    return write_png(path, np.concatenate([rgb, np.where(known, 255, 0)[..., None]], -1))


def contour(mask: DataFrame, height: int, width: int) -> np.ndarray:
    """Cells of a mask (y, x, m) that have a neighbour outside it, as an array of booleans."""
    m = to_array(mask.select("y", "x", F.col("m").cast("int").alias("m")), ["m"], height, width)[..., 0] > 0
    wide = np.pad(m, 1)
    inside = wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:]
    return m & ~inside


def overlay(rgba: np.ndarray, cells: np.ndarray, colour: str) -> np.ndarray:
    """A picture with some cells in a colour, opaque; three bands become four."""
    out = rgba if rgba.shape[2] == 4 else np.concatenate([rgba, np.full((*rgba.shape[:2], 1), 255, rgba.dtype)], 2)
    out = out.copy()
    out[cells] = [*(int(colour[k : k + 2], 16) for k in (1, 3, 5)), 255]
    return out


def marks(points: DataFrame, height: int, width: int, radius: int = 1) -> np.ndarray:
    """Cells within ``radius`` of points (row_f, col_f), as squares cut at the picture's edge; at most MOST_CELLS points."""
    at = points.select(F.floor("row_f").cast("long").alias("y"), F.floor("col_f").cast("long").alias("x")).distinct()
    frame = at.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).limit(MOST_CELLS).toPandas()
    out = np.zeros((height, width), bool)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            out[np.clip(frame["y"] + dy, 0, height - 1), np.clip(frame["x"] + dx, 0, width - 1)] = True
    return out


def data_uri(path: str | Path, kind: str = "image/png") -> str:
    return f"data:{kind};base64,{base64.b64encode(Path(path).read_bytes()).decode()}"
