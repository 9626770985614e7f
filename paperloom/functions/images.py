"""Image numerics on luminance arrays; they run inside the recognition seam."""

from __future__ import annotations

import numpy as np


def ink_profile(luma: np.ndarray, threshold: int = 128) -> np.ndarray:
    """Dark pixels in each row."""
    return (luma < threshold).sum(axis=1).astype(np.int32)


def median3(luma: np.ndarray) -> np.ndarray:
    """Median of each 3 x 3 neighbourhood; edges are copied."""
    out = luma.copy()
    if min(luma.shape) >= 3:
        stack = [luma[1 + dy : luma.shape[0] - 1 + dy, 1 + dx : luma.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        out[1:-1, 1:-1] = np.median(np.stack(stack), axis=0).astype(luma.dtype)
    return out


def skew_degrees(luma: np.ndarray, most: float = 5.0, step: float = 0.5, threshold: int = 128) -> float:
    """The angle whose sheared rows vary most in ink; of equal ones the least."""
    ys, xs = np.nonzero(luma < threshold)
    if not len(ys):
        return 0.0
    height = luma.shape[0]
    best, least = 0.0, -1.0
    for angle in sorted(np.arange(-most, most + step / 2, step), key=abs):
        rows = np.rint(ys + (xs - luma.shape[1] / 2) * np.tan(np.radians(angle))).astype(int)
        score = np.bincount(rows[(rows >= 0) & (rows < height)], minlength=height).var()
        if score > least + 1e-9:
            best, least = float(angle), score
    return best


def grayscale(rgb: np.ndarray) -> np.ndarray:
    """Luminance of an (height, width, 3) image; all that a page needs whose zones are cut out, since turning it would move them."""
    return np.rint(rgb[..., :3] @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def _lanczos(length: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Sources and weights (wanted, 6) of an enlarged line."""
    at = (np.arange(wanted) + 0.5) * length / wanted - 0.5
    near = np.floor(at).astype(int)[:, None] + np.arange(-2, 4)
    away = at[:, None] - near
    weight = np.where(np.abs(away) < 3, np.sinc(away) * np.sinc(away / 3), 0.0)
    return near.clip(0, length - 1), weight / weight.sum(axis=1, keepdims=True)


def enlarged(luma: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image in a larger size, Lanczos of three lobes, one axis after the other."""
    out = luma.astype(float)
    for axis, wanted in ((0, height), (1, width)):
        source, weight = _lanczos(out.shape[axis], wanted)
        lines = np.moveaxis(out, axis, 0)
        out = np.moveaxis(sum(lines[source[:, k]] * weight[:, k].reshape(-1, 1) for k in range(6)), 0, axis)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def rotated(luma: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned clockwise on a white canvas that holds all of it, bilinear."""
    height, width = luma.shape
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    wide, high = (int(np.ceil(round(n, 6))) for n in (width * abs(cos) + height * abs(sin), width * abs(sin) + height * abs(cos)))
    y, x = np.mgrid[:high, :wide].astype(float)
    y, x = y - (high - 1) / 2, x - (wide - 1) / 2
    from_x, from_y = x * cos + y * sin + (width - 1) / 2, y * cos - x * sin + (height - 1) / 2
    padded = np.pad(luma.astype(float), 1, constant_values=255.0)
    from_x, from_y = (from_x + 1).clip(0, width + 1), (from_y + 1).clip(0, height + 1)
    x0, y0 = np.minimum(from_x.astype(int), width), np.minimum(from_y.astype(int), height)
    fx, fy = from_x - x0, from_y - y0
    top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
    bottom = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def preprocess(luma: np.ndarray, dpi: float = 0.0, wanted_dpi: int = 300, min_width: int = 0, cap: int = 12_000) -> np.ndarray:
    """A page made ready for recognition: enlarged to its resolution (or the least width, if that is unknown), straightened, median filtered."""
    height, width = luma.shape
    factor = wanted_dpi / dpi if dpi >= 1 else min_width / width
    factor = max(1.0, min(max(1.0, factor), cap / max(width, height)))
    wide, high = max(1, round(width * factor)), max(1, round(height * factor))
    page = enlarged(luma, wide, high) if wide > width or high > height else luma
    angle = skew_degrees(page)
    return median3(rotated(page, angle) if abs(angle) >= 0.5 else page)
