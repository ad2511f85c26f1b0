"""Quick-look images: pixels are aggregated in Spark and encoded with the standard library."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.functions.cloud import cell
from standscan.operators.points import origin

# Colours of classes 0-9, and of ignored points last.
PALETTE = ((139, 115, 85), (214, 39, 40), (44, 160, 44), (31, 119, 180), (255, 127, 14), (148, 103, 189), (140, 86, 75), (227, 119, 194), (127, 127, 127), (188, 189, 34), (200, 200, 200))


def pixels(cloud: DataFrame, field: str, size, across: str = "x", up: str = "y", depth: str = "z") -> DataFrame:
    """``(px, py, value)``: the value of the topmost point of each pixel, ties to the larger pid."""
    u0, v0 = origin(cloud, (across, up))
    return cloud.groupBy(cell(across, size, u0).alias("px"), cell(up, size, v0).alias("py")).agg(F.max_by(field, F.struct(depth, "pid")).alias("value"))


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit RGB image as PNG."""
    h, w, _ = image.shape
    raw = np.zeros((h, 1 + 3 * w), "u1")
    raw[:, 1:] = image.reshape(h, -1)

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def _colours(values: np.ndarray, categorical: bool) -> np.ndarray:
    if categorical:
        table = np.array(PALETTE, "u1")
        return table[np.where(values < 0, len(PALETTE) - 1, values.astype(int) % (len(PALETTE) - 1))]
    low, high = (np.nanmin(values), np.nanmax(values)) if len(values) else (0.0, 1.0)
    t = np.clip((values - low) / max(high - low, 1e-12), 0, 1)
    return np.stack([68 + 185 * t, 1 + 230 * t, 84 + 60 * np.sin(np.pi * t)], axis=1).astype("u1")


def _marks(image: np.ndarray, instances: DataFrame, x0: float, y0: float, size: float, arm: int = 5) -> None:
    """Draw a cross at each pixel that holds the centre of an object ``(x, y)``."""
    h, w, _ = image.shape
    at = instances.select(cell("x", size, x0).alias("px"), cell("y", size, y0).alias("py")).where(F.col("px").between(0, w - 1) & F.col("py").between(0, h - 1)).distinct()
    for r in at.collect():
        row, col = h - 1 - r["py"], r["px"]
        image[row, max(0, col - arm) : col + arm + 1] = 0
        image[max(0, row - arm) : row + arm + 1, col] = 0


def render(cloud: DataFrame, field: str, path: str, width: int = 1200, band: float = 2.0, classes: Sequence[str] | None = None, instances: DataFrame | None = None) -> None:
    """A top view and, below it, a side view of the transect around the median y.

    ``instances`` are marked in the top view. With ``classes`` the field holds class numbers,
    and their colours are written by name to ``path`` + ``.json``. The image's width bounds the
    pixels that reach the driver.
    """
    if field not in cloud.columns:
        raise KeyError(f"the cloud has no field {field}; it has {sorted(cloud.columns)}")
    span = cloud.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.median("y").alias("m")).first()
    size = max((span["b"] - span["a"]), (span["d"] - span["c"]), 1e-9) / width
    views = [pixels(cloud, field, size), pixels(cloud.where(F.abs(F.col("y") - span["m"]) < band), field, size, "x", "z", "y")]
    categorical = classes is not None or dict(cloud.dtypes)[field] in ("int", "bigint", "smallint", "tinyint")
    parts = []
    for view in views:
        rows = view.where("value is not null").toPandas()
        h = int(rows["py"].max()) + 1 if len(rows) else 1
        image = np.full((h, width + 1, 3), 255, "u1")
        if len(rows):
            image[h - 1 - rows["py"].to_numpy("i8"), rows["px"].to_numpy("i8")] = _colours(rows["value"].to_numpy("f8"), categorical)
        if instances is not None and not parts:
            _marks(image, instances, span["a"], span["c"], size)
        parts.append(image)
    if classes is not None:
        with open(path + ".json", "w") as f:
            json.dump({c: PALETTE[i % (len(PALETTE) - 1)] for i, c in enumerate(classes)} | {"ignored": PALETTE[-1]}, f)
    with open(path, "wb") as f:
        f.write(png_bytes(np.concatenate([parts[0], np.full((10, width + 1, 3), 220, "u1"), parts[1]])))


def render_confusion(matrix: list[list[int]], path: str, block: int = 48) -> None:
    """A row-normalised heat map of a confusion matrix."""
    m = np.array(matrix, "f8")
    share = np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
    shade = (255 * (1 - share)).astype("u1").repeat(block, axis=0).repeat(block, axis=1)
    with open(path, "wb") as f:
        f.write(png_bytes(np.stack([shade, shade, np.full_like(shade, 255)], axis=2)))


def _line(image: np.ndarray, xs: Sequence[float], ys: Sequence[float], span: tuple[float, float, float, float], colour: tuple[int, int, int]) -> None:
    """A polyline in a panel whose corners are the lowest and highest x and y of ``span``."""
    h, w, _ = image.shape
    lo_x, hi_x, lo_y, hi_y = span
    px = [round((x - lo_x) / (hi_x - lo_x or 1) * (w - 3)) + 1 for x in xs]
    py = [h - 2 - round((y - lo_y) / (hi_y - lo_y or 1) * (h - 3)) for y in ys]
    for x, y in zip(px, py, strict=True):
        image[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] = colour
    for (xa, ya), (xb, yb) in zip(zip(px, py), zip(px[1:], py[1:])):
        steps = max(abs(xb - xa), abs(yb - ya), 1)
        for k in range(steps + 1):
            image[ya + round((yb - ya) * k / steps), xa + round((xb - xa) * k / steps)] = colour


def render_curves(history: Sequence[dict], path: str, width: int = 420, height: int = 260) -> None:
    """Two panels by round: the training loss, and the mean IoU of training and, where measured, of validation (0 to 1).

    The ranges and colours are written to ``path`` + ``.json``.
    """
    series = {c: [(r["round"], r[c]) for r in history if r.get(c) is not None] for c in ("train_loss", "train_miou", "val_miou")}
    colours = dict(zip(series, (PALETTE[1], PALETTE[3], PALETTE[2]), strict=True))
    last = max([r["round"] for r in history], default=1)
    top = max([v for _, v in series["train_loss"]], default=1.0)
    panels = []
    for names, high in ((("train_loss",), top), (("train_miou", "val_miou"), 1.0)):
        image = np.full((height, width, 3), 255, "u1")
        image[[0, -1]] = image[:, [0, -1]] = PALETTE[8]
        for name in names:
            if series[name]:
                _line(image, *zip(*series[name], strict=True), (1, last, 0.0, high), colours[name])
        panels.append(image)
    with open(path + ".json", "w") as f:
        json.dump({"rounds": last, "highest_loss": top, "colours": colours}, f)
    with open(path, "wb") as f:
        f.write(png_bytes(np.concatenate([panels[0], np.full((height, 10, 3), 220, "u1"), panels[1]], axis=1)))
