"""Measures of decoded pictures: one job over rows of BGR bytes, numpy inside tasks, a row in and a row out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.values import colour_class, sharpness_score

#: measure -> its type, in the order of the output
MEASURES = {
    "mean_luma": "double", "clipped_highlight": "double", "clipped_shadow": "double", "dynamic_range": "double",
    "laplacian_var": "double", "tenengrad": "double", "fft_anisotropy": "double", "blur_angle_deg": "double", "noise_sigma": "double",
    "mean_r": "double", "mean_g": "double", "mean_b": "double", "mean_saturation": "double", "colours": "int",
    "dominant": "array<struct<r:int,g:int,b:int,weight:double>>", "phash": "string", "dhash": "string",
}


def decode_rows(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """height x width x 3 bytes, red first."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def grey_of(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def exposure(grey: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, share at 250 and more, share at 5 and less, 99th minus first percentile."""
    low, high = np.percentile(grey, (1, 99))
    return float(grey.mean()), float((grey >= 250).mean()), float((grey <= 5).mean()), float(high - low)


def _around(grey: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The picture shifted by -1..1 rows and columns, mirrored at its edge without repeating the edge."""
    g = grey.astype(np.float64)
    p = np.pad(g, [(1, 1) if n > 1 else (0, 0) for n in g.shape], "reflect")
    p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in g.shape], "edge")
    h, w = g.shape
    return {(i, j): p[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)}


def laplacian_var(grey: np.ndarray) -> float:
    if not grey.size:
        return 0.0
    s = _around(grey)
    return float((s[-1, 0] + s[1, 0] + s[0, -1] + s[0, 1] - 4 * s[0, 0]).var())


def tenengrad(grey: np.ndarray) -> float:
    if not grey.size:
        return 0.0
    s = _around(grey)
    gx = s[-1, 1] + 2 * s[0, 1] + s[1, 1] - s[-1, -1] - 2 * s[0, -1] - s[1, -1]
    gy = s[1, -1] + 2 * s[1, 0] + s[1, 1] - s[-1, -1] - 2 * s[-1, 0] - s[-1, 1]
    return float((gx * gx + gy * gy).mean())


def anisotropy(grey: np.ndarray, bins: int = 18, told: float = 0.45) -> tuple[float, float | None]:
    """How far one direction stands out in the spectrum's middle ring, and the angle of motion if it does."""
    h, w = grey.shape
    side = min(h, w)
    if side < 32:
        return 0.0, None
    lit = grey.astype(np.float64) * np.outer(np.hanning(h), np.hanning(w))
    power = np.abs(np.fft.fftshift(np.fft.fft2(lit)))
    y, x = np.ogrid[:h, :w]
    y, x = y - h // 2, x - w // 2
    radius = np.hypot(y, x)
    ring = (radius > max(8, side // 16)) & (radius < side // 2)
    angle = np.degrees(np.arctan2(*np.broadcast_arrays(y, x))) % 180
    at = np.minimum((angle[ring] / (180 / bins)).astype(int), bins - 1)
    mean = np.bincount(at, weights=power[ring], minlength=bins) / np.maximum(np.bincount(at, minlength=bins), 1)
    peak = int(mean.argmax())
    share = float(np.clip((mean[peak] - mean.mean()) / (mean[peak] + 1e-6), 0, 1))
    return share, float(((peak + 0.5) * (180 / bins) + 90) % 180) if share > told else None


def noise_sigma(grey: np.ndarray) -> float:
    """Immerkaer's estimate: the mean absolute response to a difference of Laplacians."""
    h, w = grey.shape
    if min(h, w) < 3:
        return 0.0
    g = grey.astype(np.float64)
    rows = g[:-2] - 2 * g[1:-1] + g[2:]
    response = rows[:, :-2] - 2 * rows[:, 1:-1] + rows[:, 2:]
    return float(np.abs(response).sum() * np.sqrt(np.pi / 2) / (6 * (w - 2) * (h - 2)))


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means: each output pixel averages what it covers, shares of edge pixels included."""
    for axis, n in ((0, height), (1, width)):
        a = np.moveaxis(np.asarray(a, np.float64), axis, 0)
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)])
        edge = np.linspace(0, len(a), n + 1)
        whole = np.minimum(edge.astype(int), len(a) - 1)
        part = (edge - whole).reshape(-1, *[1] * (a.ndim - 1))
        upto = total[whole] + part * a[whole]
        a = np.moveaxis(np.diff(upto, axis=0) * (n / len(a)), 0, axis)
    return a


def _bins(rgb: np.ndarray) -> np.ndarray:
    q = rgb.reshape(-1, 3).astype(np.int64) >> 4
    return q[:, 0] << 8 | q[:, 1] << 4 | q[:, 2]


def dominant(rgb: np.ndarray, most: int = 5) -> list[dict]:
    """The fullest bins of 16 steps a channel, each by its mean colour; the least bin first on ties."""
    key, flat = _bins(rgb), rgb.reshape(-1, 3)
    n = np.bincount(key, minlength=4096)
    top = [k for k in np.argsort(-n, kind="stable")[:most] if n[k]]
    out = []
    for k in top:
        r, g, b = np.rint(flat[key == k].mean(0)).astype(int)
        out.append({"r": int(r), "g": int(g), "b": int(b), "weight": float(n[k] / len(key))})
    return out


def colour_count(rgb: np.ndarray) -> int:
    return len(np.unique(_bins(np.rint(resize(rgb, 96, 96)).astype(np.uint8))))


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def phash(grey: np.ndarray) -> str:
    """Low 8 x 8 cosine coefficients of the 32 x 32 picture, against their median."""
    k, n = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = basis @ resize(grey, 32, 32) @ basis.T
    return _hex(low > np.median(low))


def dhash(grey: np.ndarray) -> str:
    small = resize(grey, 8, 9)
    return _hex(small[:, 1:] > small[:, :-1])


def measure(rgb: np.ndarray) -> list:
    grey = grey_of(rgb)
    r, g, b = (float(x) for x in rgb.reshape(-1, 3).mean(0))
    top, low = rgb.max(2).astype(np.float64), rgb.min(2).astype(np.float64)
    saturation = float(np.divide(top - low, top, out=np.zeros_like(top), where=top > 0).mean())
    return [*exposure(grey), laplacian_var(grey), tenengrad(grey), *anisotropy(grey), noise_sigma(grey), r, g, b, saturation, colour_count(rgb), dominant(rgb), phash(grey), dhash(grey)]


def image_metrics(images: DataFrame, id_col: str = "path") -> DataFrame:
    """id_col, width, height, error and MEASURES of rows width, height, channels, data. A row that cannot be measured has
    its error's text and null measures; the rest go on."""
    kind = dict(images.dtypes)[id_col]
    names = [id_col, "width", "height", "error", *MEASURES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, w, h, n, data in f.itertuples(index=False):
                try:
                    out.append([key, w, h, None, *measure(decode_rows(data, int(w), int(h), int(n)))])
                except (TypeError, ValueError, IndexError) as e:
                    out.append([key, w, h, f"{type(e).__name__}: {e}", *[None] * len(MEASURES)])
            yield pd.DataFrame(out, columns=names)

    schema = f"`{id_col}` {kind}, width int, height int, error string, " + ", ".join(f"{c} {t}" for c, t in MEASURES.items())
    return images.select(id_col, "width", "height", "channels", "data").mapInPandas(run, schema)


def derived(metrics: DataFrame) -> DataFrame:
    """metrics with sharp_score, and the colour class of the mean colour, as columns that Catalyst computes."""
    c: Column = colour_class("mean_r", "mean_g", "mean_b", "mean_saturation")
    scored = metrics.withColumn("sharp_score", sharpness_score("laplacian_var", "tenengrad", F.greatest("width", "height")))
    return scored.select("*", c.alias("_c")).select(*scored.columns, "_c.*")
