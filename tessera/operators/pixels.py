"""Pixel operators on numpy arrays (height, width, 3; uint8), and a DataFrame form that runs them per image in Arrow batches.

Areas of segments are those of the polygon through the middles of a component's outer border pixels, holes included.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Rows of the image source, blue first, as three channels; None for unusable ones."""
    if not data or height <= 0 or width <= 0 or channels not in (1, 3, 4) or len(data) != height * width * channels:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, :3].copy()


def png(image: np.ndarray) -> bytes:
    """An image file of the array."""
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 3)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray | None:
    h, w = image.shape[:2]
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
    return image[y1:y2, x1:x2].copy() if x2 > x1 and y2 > y1 else None


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    ys, xs = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(ys), 0, h - 1).astype(int), np.clip(np.floor(xs), 0, w - 1).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None, None], np.clip(xs - x0, 0, 1)[None, :, None]
    a = image.astype(np.float64)
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def letterbox(image: np.ndarray, width: int, height: int, fill: int = 114) -> np.ndarray:
    h, w = image.shape[:2]
    scale = min(width / w, height / h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    out = np.full((height, width, 3), fill, np.uint8)
    x, y = (width - nw) // 2, (height - nh) // 2
    out[y : y + nh, x : x + nw] = resized(image, nw, nh)
    return out


def border_mode(image: np.ndarray) -> tuple[int, ...]:
    """The border's most common exact colour; corners count twice."""
    edge = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    colours, first, n = np.unique(edge, axis=0, return_index=True, return_counts=True)
    return tuple(int(v) for v in colours[np.lexsort((first, -n))[0]])


def dominant_colour(image: np.ndarray, boxes: list[tuple[int, int, int, int]] = (), pad: int = 0) -> tuple[int, ...]:
    """Mean of the fullest of 16 x 16 x 16 colour bins, outside padded boxes; of the whole image if they leave nothing."""
    keep = np.ones(image.shape[:2], bool)
    for x1, y1, x2, y2 in boxes:
        keep[max(0, y1 - pad) : max(0, y2 + pad), max(0, x1 - pad) : max(0, x2 + pad)] = False
    px = image[keep] if keep.any() else image.reshape(-1, 3)
    bins = (px // 16).astype(np.int32) @ np.array([256, 16, 1])
    return tuple(int(round(v)) for v in px[bins == np.bincount(bins).argmax()].mean(0))


def fill_boxes(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, ...]) -> np.ndarray:
    """Boxes painted over, their far edges included."""
    out = image.copy()
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1) : y2 + 1, max(0, x1) : x2 + 1] = colour
    return out


def foreground(image: np.ndarray, background: tuple[int, ...], threshold: float) -> np.ndarray:
    """Pixels further than the threshold from the background colour."""
    return np.sqrt(((image.astype(np.float64) - np.array(background)) ** 2).sum(2)) > threshold


def components(mask: np.ndarray, diagonal: bool = True) -> list[tuple[int, int, int, int, int, tuple[int, int]]]:
    """(x1, y1, x2, y2, pixels, first pixel as (y, x)) of connected components, by union of row runs."""
    parent: list[int] = []
    runs, above = [], []
    reach = 1 if diagonal else 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    h, w = mask.shape
    padded = np.zeros((h, w + 2), bool)
    padded[:, 1:-1] = mask
    edge = np.flatnonzero(padded[:, 1:] != padded[:, :-1])
    last, here = -1, []
    for y, a, b in zip((edge[::2] // (w + 1)).tolist(), (edge[::2] % (w + 1)).tolist(), (edge[1::2] % (w + 1)).tolist()):
        if y != last:
            above, here, last = here if y == last + 1 else [], [], y
        k = len(parent)
        parent.append(k)
        for a2, b2, k2 in above:
            if a2 < b + reach and a < b2 + reach:
                parent[root(k)] = root(k2)
        runs.append((a, b, y, k))
        here.append((a, b, k))
    out: dict[int, list] = {}
    for a, b, y, k in runs:
        o = out.setdefault(root(k), [a, y, b, y + 1, 0, (y, a)])
        o[:5] = [min(o[0], a), min(o[1], y), max(o[2], b), max(o[3], y + 1), o[4] + b - a]
    return sorted(tuple(o) for o in out.values())


def without_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with what it encloses filled."""
    out = mask.copy()
    h, w = mask.shape
    outside = np.zeros((h + 2, w + 2), bool)
    outside[1:-1, 1:-1] = mask
    inner = [c for c in components(~outside, diagonal=False) if c[0] > 0]
    for _, _, _, _, _, (y, x) in inner:
        todo = [(y - 1, x - 1)]
        while todo:
            i, j = todo.pop()
            if not out[i, j]:
                out[i, j] = True
                todo += [(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
    return out


#: Eight neighbours clockwise, from the left.
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def border_area(mask: np.ndarray, first: tuple[int, int]) -> float:
    """Area of the polygon along the outer border of the component whose topmost, leftmost pixel is first; 0 for lines and points."""
    h, w = mask.shape
    inside = lambda p: 0 <= p[0] < h and 0 <= p[1] < w and bool(mask[p])
    at, back, twice, start = first, 0, 0, None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if inside(to):
                break
        else:
            return 0.0
        if (at, d) == start:
            return abs(twice) / 2
        start = start or (at, d)
        twice += at[1] * to[0] - to[1] * at[0]
        at, back = to, (d + 5) % 8 if d % 2 else (d + 6) % 8


def segments(image: np.ndarray, background: tuple[int, ...], threshold: float, min_area: float, tolerance: int = 3) -> list[tuple[int, int, int, int]]:
    """Boxes of foreground components of min_area at least; a two-pixel border is cleared, and long thin parts near it are dropped."""
    mask = foreground(image, background, threshold)
    mask[:2], mask[-2:], mask[:, :2], mask[:, -2:] = False, False, False, False
    mask = without_holes(mask)
    h, w = mask.shape
    out = []
    for x1, y1, x2, y2, _, first in components(mask):
        edge = x1 <= tolerance or y1 <= tolerance or x2 >= w - tolerance or y2 >= h - tolerance
        aspect = max((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1))
        if not (edge and aspect >= 5) and border_area(mask, first) >= min_area:
            out.append((x1, y1, x2, y2))
    return out


def transformed(blob: np.ndarray, rng: np.random.Generator, scale: tuple[float, float] | None = None, angle: float = 0.0, flip: float = 0.0, jitter: float = 0.0, flip_v: float = 0.0, background: tuple[int, ...] = (114, 114, 114), least: int = 4) -> np.ndarray:
    """Flip, rotate, scale, jitter, in this order, each by chance of rng."""
    if rng.random() < flip:
        blob = blob[:, ::-1]
    if rng.random() < flip_v:
        blob = blob[::-1]
    if angle:
        a = np.deg2rad(rng.uniform(-angle, angle))
        h, w = blob.shape[:2]
        nh, nw = int(np.ceil(abs(h * np.cos(a)) + abs(w * np.sin(a)))), int(np.ceil(abs(w * np.cos(a)) + abs(h * np.sin(a))))
        y, x = np.mgrid[:nh, :nw].astype(float)
        y, x = y - (nh - 1) / 2, x - (nw - 1) / 2
        sx, sy = np.rint(x * np.cos(a) + y * np.sin(a) + (w - 1) / 2).astype(int), np.rint(-x * np.sin(a) + y * np.cos(a) + (h - 1) / 2).astype(int)
        inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
        out = np.empty((nh, nw, 3), np.uint8)
        out[:] = background
        out[inside] = blob[sy[inside], sx[inside]]
        blob = out
    if scale:
        s = rng.uniform(*scale)
        blob = resized(blob, max(least, round(blob.shape[1] * s)), max(least, round(blob.shape[0] * s)))
    if jitter:
        blob = np.clip(blob * (1 + rng.uniform(-jitter, jitter, 3)), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(blob)


def feathered(height: int, width: int, radius: int) -> np.ndarray:
    """Weights that rise from the edges over radius pixels."""
    ramp = lambda n: np.minimum(1.0, (np.minimum(np.arange(n), np.arange(n)[::-1]) + 1) / (radius + 1))
    return np.minimum(ramp(height)[:, None], ramp(width)[None, :])


def paste(canvas: np.ndarray, blob: np.ndarray, x: int, y: int, radius: int = 0) -> None:
    h, w = blob.shape[:2]
    if not radius:
        canvas[y : y + h, x : x + w] = blob
        return
    m = feathered(h, w, radius)[:, :, None]
    canvas[y : y + h, x : x + w] = np.rint(blob * m + canvas[y : y + h, x : x + w] * (1 - m)).astype(np.uint8)


def per_image(images: DataFrame, work: Callable[[np.ndarray, pd.Series], list[tuple]], schema: str, extra: list[str] = ()) -> DataFrame:
    """work(array, row) over rows of the image source (path, height, width, channels, data, extra columns); its tuples follow schema. Unusable images give none."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for _, r in pdf.iterrows() if (a := decode(r.height, r.width, r.channels, r.data)) is not None for x in work(a, r)]
            yield pd.DataFrame(rows, columns=names)

    return images.select("path", "height", "width", "channels", "data", *extra).mapInPandas(run, schema)
