"""Pixel functions in numpy, for Arrow-batched use on arrays of decoded grey or RGB pixels.

Decoding itself and learned encoders are pluggable: ``encode_images`` takes
any function from a batch of pixel arrays to a matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed values of the reduction: the cubic's parameter and reach, and the bits of its whole-number weights.
CUBIC, REACH, WEIGHT_BITS = -0.5, 2.0, 22


def cubic_weights(size: int, to: int) -> np.ndarray:
    """(to, size) whole-number weights of the antialiased bicubic reduction (Keys 1981), each row adding up to about 2 ** WEIGHT_BITS."""
    scale = size / to
    wide = max(scale, 1.0)
    middle = (np.arange(to) + 0.5) * scale
    first = np.maximum(0, (middle - REACH * wide + 0.5).astype(int))
    last = np.minimum(size, (middle + REACH * wide + 0.5).astype(int))
    at = np.arange(size)
    x = np.abs((at[None] - middle[:, None] + 0.5) / wide)
    near = ((CUBIC + 2) * x - (CUBIC + 3)) * x * x + 1
    far = ((x - 5) * x + 8) * x * CUBIC - 4 * CUBIC
    w = np.where(x < 1, near, np.where(x < 2, far, 0.0)) * ((at[None] >= first[:, None]) & (at[None] < last[:, None]))
    w /= w.sum(1, keepdims=True)
    return np.trunc(w * 2**WEIGHT_BITS + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic reduction of whole grey values 0 to 255, rows first, rounded and limited after each direction."""

    def reduced(x: np.ndarray, to: int) -> np.ndarray:
        if x.shape[1] == to:
            return x
        return np.clip((x @ cubic_weights(x.shape[1], to).T + (1 << (WEIGHT_BITS - 1))) >> WEIGHT_BITS, 0, 255)

    return reduced(reduced(grey.astype(np.int64), width).T, height).T


def to_grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB pixels (the ITU-R 601 weights)."""
    return pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels.astype(np.float64)


def whole_grey(pixels: np.ndarray) -> np.ndarray:
    """Grey values as whole numbers from 0 to 255."""
    return np.clip(np.floor(to_grey(pixels) + 0.5), 0, 255).astype(np.int64)


def dhash(grey: np.ndarray) -> str:
    """Sixteen hexadecimal digits of the number whose bit n is the n-th comparison of neighbours in a 9 x 8 reduction."""
    small = resize(whole_grey(grey), 8, 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return np.packbits(bits[::-1]).tobytes().hex()


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, the image mirrored at its edges without repeating them; low for blurred images."""
    g = np.pad(grey.astype(np.float64), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def pixel_hash(pixels: np.ndarray) -> str:
    """SHA-256 over the size and the raw pixels."""
    head = f"{pixels.shape[1]}x{pixels.shape[0]}\n".encode()
    return hashlib.sha256(head + np.ascontiguousarray(pixels, np.uint8).tobytes()).hexdigest()


def mean_filter(x: np.ndarray, window: int) -> np.ndarray:
    """Mean over a square window, edges repeated."""
    half = window // 2
    padded = np.pad(x, (half, window - 1 - half), mode="edge")
    total = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = x.shape
    return (total[window : window + n, window : window + m] - total[:n, window : window + m] - total[window : window + n, :m] + total[:n, :m]) / window**2


#: Window of both mean filters of the saliency.
SALIENCY_WINDOW = 5


def spectral_saliency(grey: np.ndarray, window: int = SALIENCY_WINDOW) -> np.ndarray:
    """Spectral residual saliency (Hou and Zhang 2007) with the zero frequency's place in the middle, as a share of its peak."""
    f = np.fft.fft2(grey.astype(np.float64))
    log = np.log(np.abs(f) + 1e-8)
    power = np.abs(np.fft.ifft2(np.exp(log - mean_filter(log, window) + 1j * np.angle(f)))) ** 2
    out = mean_filter(np.fft.fftshift(power), window)
    peak = out.max(initial=0.0)
    return out / peak if np.isfinite(peak) and peak > 0 else np.zeros_like(out)


def saliency_term(saliency: np.ndarray, x: int, y: int, width: int, height: int) -> float:
    """How salient a pixel box is: the geometric mean of its share of the whole and of a third of its relative density, each 1 at most."""
    part = saliency[max(0, y) : y + height, max(0, x) : x + width]
    if not part.size:
        return 0.0
    mass = part.sum() / max(1e-6, saliency.sum())
    density = part.mean() / max(1e-6, saliency.mean())
    return float(np.sqrt(min(1.0, mass) * min(1.0, density / 3)))


def pad_square(pixels: np.ndarray, value: int = 127) -> np.ndarray:
    """Centred on a square of the longer side."""
    h, w = pixels.shape[:2]
    side = max(h, w)
    out = np.full((side, side, *pixels.shape[2:]), value, pixels.dtype)
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = pixels
    return out


#: Fixed views: (left, top, right, bottom) as fractions; and how much of the lower end the detail view of a tip takes.
VIEWS = {"global": (0, 0, 1, 1), "center": (0.125, 0.125, 0.875, 0.875), "left": (0, 0, 0.75, 1), "right": (0.25, 0, 1, 1), "top": (0, 0, 1, 0.75), "bottom": (0, 0.25, 1, 1)}
TIP_SHARE = 0.3


def cropped(pixels: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    """The part between fractions, rounded down, of one pixel at least each way."""
    h, w = pixels.shape[:2]
    x, y = int(left * w), int(top * h)
    return pixels[y : max(y + 1, int(bottom * h)), x : max(x + 1, int(right * w))]


def views(pixels: np.ndarray) -> dict[str, np.ndarray]:
    """Six overlapping views."""
    return {n: cropped(pixels, *v) for n, v in VIEWS.items()}


def tip_view(pixels: np.ndarray) -> np.ndarray:
    """The lower end, where tips and markings are."""
    return cropped(pixels, 0, 1 - TIP_SHARE, 1, 1)


def patch_mask(rows: int, cols: int, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    """Which cells of a grid have their middle within the box."""
    y, x = (np.arange(rows) + 0.5) / rows, (np.arange(cols) + 0.5) / cols
    return (((y >= top) & (y <= bottom))[:, None] & ((x >= left) & (x <= right))[None]).ravel()


def metrics(grey: np.ndarray) -> dict[str, float | int | str]:
    """Of whole grey values; larger images are to be reduced to 512 pixels a side for the blur before."""
    grey = whole_grey(grey)
    return {"dhash": dhash(grey), "blur": laplacian_variance(grey), "gray_std": float(grey.std()), "crop_pixels": int(grey.size), "min_side": int(min(grey.shape))}


def image_metrics(df: DataFrame, record: str, pixels: str, width: str) -> DataFrame:
    """(record, dhash, blur, gray_std, crop_pixels, min_side) of grey pixels in row order; null or empty pixels give nulls."""
    kind = df.schema[record].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {"dhash": None, "blur": None, "gray_std": None, "crop_pixels": None, "min_side": None}
        for pdf in batches:
            rows = []
            for r, p, w in zip(pdf[record], pdf[pixels], pdf[width], strict=True):
                ok = p is not None and w and not np.isnan(w) and len(p) and len(p) % int(w) == 0
                rows.append({record: r} | (metrics(np.asarray(p, np.float64).reshape(-1, int(w))) if ok else empty))
            yield pd.DataFrame(rows, columns=[record, *empty])

    return df.select(record, pixels, width).mapInPandas(run, f"`{record}` {kind}, dhash string, blur double, gray_std double, crop_pixels int, min_side int")


def stub_encoder(size: int = 64) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Deterministic stand-in for a learned encoder: a seeded unit vector by pixel content."""

    def encode(images: list[np.ndarray]) -> np.ndarray:
        out = np.stack([np.random.default_rng(int(pixel_hash(i)[:15], 16)).standard_normal(size) for i in images])
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)

    return encode


def encode_images(df: DataFrame, encoder: Callable[[list[np.ndarray]], np.ndarray], pixels: str = "pixels", width: str = "width") -> DataFrame:
    """Adds ``embedding``; equal pixels are encoded once and joined back by their hash.

    Null pixels get a null embedding.
    """
    rows = df.withColumn("_key", F.xxhash64(F.col(pixels), F.col(width)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [np.asarray(p, np.uint8).reshape(-1, int(w)) for p, w in zip(pdf[pixels], pdf[width], strict=True)]
            yield pd.DataFrame({"_key": pdf["_key"], "embedding": list(encoder(images)) if images else []})

    once = rows.where(F.col(pixels).isNotNull() & (F.size(pixels) > 0)).dropDuplicates(["_key"]).select("_key", pixels, width)
    return rows.join(once.mapInPandas(run, "_key bigint, embedding array<float>"), "_key", "left").drop("_key")
