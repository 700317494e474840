"""Image kernels on NumPy arrays, used inside tasks on one frame at a time.

Borders mirror without repeating the edge pixel; resizing samples at half-pixel
centres; a filled circle holds the pixels whose centre lies within its radius.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Payload of one frame as (h, w) or (h, w, c)."""
    a = np.frombuffer(data, np.uint8)
    return a.reshape(height, width) if channels == 1 else a.reshape(height, width, channels)


def to_gray(img: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded to bytes."""
    if img.ndim == 2:
        return img
    bgr = img[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])
    return np.floor(bgr + 0.5).astype(np.uint8)


def _mirror(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, n, mode="reflect") if min(a.shape) > 1 else np.pad(a, n, mode="edge")


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = _mirror(gray.astype(float), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4.0 * p[1:-1, 1:-1]


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _mirror(gray.astype(float), 1)
    down = p[:-2] + 2.0 * p[1:-1] + p[2:]
    across = p[:, :-2] + 2.0 * p[:, 1:-1] + p[:, 2:]
    return down[:, 2:] - down[:, :-2], across[2:] - across[:-2]


def circle(height: int, width: int, cx: float, cy: float, radius: float) -> np.ndarray:
    y, x = np.ogrid[:height, :width]
    return (x - cx) ** 2 + (y - cy) ** 2 <= radius * radius


def roi_mask(height: int, width: int, mode: str = "circle", ratio: float = 0.40) -> np.ndarray:
    """Centred circle or rectangle."""
    if mode == "rect":
        w, h = max(1, round(width * ratio)), max(1, round(height * ratio))
        x0, y0 = max(0, (width - w) // 2), max(0, (height - h) // 2)
        mask = np.zeros((height, width), bool)
        mask[y0 : y0 + h, x0 : x0 + w] = True
        return mask
    return circle(height, width, width // 2, height // 2, max(1, round(min(width, height) * 0.5 * ratio)))


def _axis(n_out: int, n_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
    lo = np.minimum(np.floor(at).astype(int), max(n_in - 2, 0))
    return lo, np.minimum(lo + 1, n_in - 1), at - lo


def resize_linear(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    y0, y1, fy = _axis(height, gray.shape[0])
    x0, x1, fx = _axis(width, gray.shape[1])
    g = gray.astype(float)
    rows = g[y0] * (1 - fy)[:, None] + g[y1] * fy[:, None]
    out = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return np.floor(out + 0.5).astype(np.uint8) if gray.dtype == np.uint8 else out


def _area_weights(n_out: int, n_in: int) -> np.ndarray:
    edges = np.arange(n_out + 1) * n_in / n_out
    pix = np.arange(n_in)
    overlap = np.minimum(edges[1:, None], pix + 1) - np.maximum(edges[:-1, None], pix)
    w = np.clip(overlap, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resize_area(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the covered source area; for shrinking."""
    out = _area_weights(height, gray.shape[0]) @ gray.astype(float) @ _area_weights(width, gray.shape[1]).T
    return np.floor(out + 0.5).astype(np.uint8)


def resize_nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    y = np.minimum(np.arange(height) * a.shape[0] // height, a.shape[0] - 1)
    x = np.minimum(np.arange(width) * a.shape[1] // width, a.shape[1] - 1)
    return a[y][:, x]


def _inside(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Values in the region; all of them where the region is empty."""
    return values[mask] if mask.any() else values.ravel()


def raw_metrics(gray: np.ndarray, mode: str, ratio: float, tenengrad_scale: float = 1.0) -> dict[str, float]:
    """Region metrics of one frame; clipping and contrast come from the histogram of grey levels."""
    mask = roi_mask(*gray.shape, mode, ratio)
    levels = np.arange(256)
    share = np.bincount(_inside(gray, mask), minlength=256) / max(1, mask.sum() or gray.size)
    mean = share @ levels
    contrast = float(np.sqrt(share @ (levels - mean) ** 2))
    black, white = float(share[:17].sum()), float(share[245:].sum())
    spread, unclipped = min(contrast / 64.0, 1.0), 1.0 - min(black + white, 1.0)
    zoom = float(np.clip(tenengrad_scale, 0.1, 1.0))
    shape = [max(1, round(n * zoom)) for n in gray.shape]
    small = zoom < 0.999
    slopes = sobel(resize_area(gray, *shape) if small else gray)
    energy = sum(np.square(g) for g in slopes)
    return {
        "laplacian_var": float(np.var(_inside(laplacian(gray), mask))),
        "tenengrad": float(np.mean(_inside(energy, resize_nearest(mask, *shape) if small else mask))),
        "exposure_roi": float(np.clip(0.7 * spread + 0.3 * unclipped, 0.0, 1.0)),
        "black_clip": black,
        "white_clip": white,
        "contrast": contrast,
        "roi_pixel_count": float(mask.sum()),
    }


def direction_imbalance(gx: np.ndarray, gy: np.ndarray) -> float:
    ex, ey = np.abs(gx).sum(), np.abs(gy).sum()
    return 0.0 if ex + ey < 1e-6 else float(min(abs(ex / (ex + ey) - 0.5) * 2.0, 1.0))


def angle_concentration(gx: np.ndarray, gy: np.ndarray, bins: int = 18) -> float:
    """1 - normalised entropy of the gradient directions, weighted by magnitude."""
    mag = np.hypot(gx, gy).ravel()
    angle = np.mod(np.arctan2(gy, gx) + math.pi, math.pi).ravel()
    cell = np.minimum((angle / math.pi * bins).astype(int), bins - 1)
    hist = np.bincount(cell, weights=mag, minlength=bins)
    if hist.sum() <= 1e-6:
        return 0.0
    p = hist[hist > 0] / hist.sum()
    return float(min(max(1.0 + float(np.sum(p * np.log2(p))) / math.log2(bins), 0.0), 1.0))


def _frequency_bands(shape: tuple[int, int]) -> np.ndarray:
    """Band of each coefficient of a transform: 0 low, 1 middle, 2 high."""
    radius = np.hypot(*np.meshgrid(*(np.fft.fftfreq(n, 1.0 / n) for n in shape), indexing="ij"))
    return np.digitize(radius, np.array([0.15, 0.40]) * min(shape))


def spectrum_blur(gray: np.ndarray) -> float:
    """Lack of high against middle frequencies, averaged over the quadrants of 8 x 8 pixels or more."""
    quarters = [q for half in np.split(gray.astype(float), [gray.shape[0] // 2]) for q in np.split(half, [gray.shape[1] // 2], axis=1)]
    lacks = []
    for shape in {q.shape for q in quarters if min(q.shape) >= 8}:
        same = np.stack([q for q in quarters if q.shape == shape])
        energy = np.log1p(np.abs(np.fft.fft2(same))).reshape(len(same), -1)
        member = np.eye(3)[_frequency_bands(shape).ravel()]
        if (member.sum(axis=0)[1:] == 0).any():
            continue
        middle, high = (energy @ (member / np.maximum(member.sum(axis=0), 1))).T[1:]
        lacks.append(np.clip(1.0 - high / np.maximum(middle, 1e-6), 0.0, 1.0))
    return float(np.concatenate(lacks).mean()) if lacks else 0.0


def motion_blur(gray: np.ndarray, gx: np.ndarray, gy: np.ndarray, method: str = "legacy") -> float:
    """``legacy``, ``angle_hist`` or ``fft_hybrid`` blur score; 0 on a flat image."""
    if np.abs(gx).sum() + np.abs(gy).sum() < 1e-6:
        return 0.0
    if method == "angle_hist":
        return angle_concentration(gx, gy)
    if method == "fft_hybrid":
        mix = 0.25 * direction_imbalance(gx, gy) + 0.35 * angle_concentration(gx, gy) + 0.40 * spectrum_blur(gray)
        return float(min(max(mix, 0.0), 1.0))
    return direction_imbalance(gx, gy)


def softmax_depth(gx: np.ndarray, gy: np.ndarray, beta: float = 5.0) -> float:
    """Edge strength averaged with weights w * exp(beta w), on a log scale."""
    mag = np.hypot(gx, gy)
    peak = mag.max(initial=0.0)
    if peak < 1e-6:
        return 0.5
    w = (mag / peak).ravel()
    w = w[w > 0.01]
    e = w * np.exp(beta * (w - w.max()))
    if e.sum() < 1e-6:
        return 0.5
    return float(min(max(math.log2(1.0 + float((e * w).sum() / e.sum())), 0.0), 1.0))


def legacy_metrics(img: np.ndarray, scale: float = 0.5, method: str = "legacy", beta: float | None = 5.0) -> dict[str, float]:
    """Half-scale sharpness, blur, exposure and depth; ``beta=None`` skips the depth."""
    gray = to_gray(img)
    if scale < 1.0:
        gray = resize_linear(gray, int(gray.shape[0] * scale), int(gray.shape[1] * scale))
    gx, gy = sobel(gray)
    mean = float(gray.mean())
    return {
        "sharpness": float(np.var(laplacian(gray))),
        "motion_blur": motion_blur(gray, gx, gy, method),
        "exposure_gauss": math.exp(-((mean - 128.0) ** 2) / (2.0 * 80.0 * 80.0)),
        "softmax_depth": 0.0 if beta is None else softmax_depth(gx, gy, beta),
    }


@lru_cache(maxsize=8)
def gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2.0
    k = np.exp(-x * x / (2.0 * sigma * sigma))
    return k / k.sum()


@lru_cache(maxsize=64)
def blur_matrix(n: int, size: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Gaussian filter along one axis of length ``n`` as a matrix, mirrored borders included."""
    period = max(2 * (n - 1), 1)
    m = np.zeros((n, n))
    for i in range(n):
        for k, weight in enumerate(gaussian(size, sigma)):
            j = (i + k - size // 2) % period
            m[i, j if j < n else period - j] += weight
    return m


def _smooth(a: np.ndarray, size: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Separable Gaussian filter with mirrored borders."""
    if max(a.shape) <= 64:
        return blur_matrix(a.shape[0], size, sigma) @ a @ blur_matrix(a.shape[1], size, sigma).T
    k, n = gaussian(size, sigma), size // 2
    p = np.pad(a, n, mode="reflect")
    rows = sum(k[i] * p[i : i + a.shape[0]] for i in range(size))
    return sum(k[i] * rows[:, i : i + a.shape[1]] for i in range(size))


def ssim(a: np.ndarray, b: np.ndarray, scale: float = 0.5) -> float:
    """Mean structural similarity under an 11 x 11 Gaussian window; 0 if the shapes differ."""
    if a.shape != b.shape:
        return 0.0
    a, b = to_gray(a), to_gray(b)
    if scale < 1.0:
        h, w = int(a.shape[0] * scale), int(a.shape[1] * scale)
        a, b = resize_linear(a, h, w), resize_linear(b, h, w)
    a, b = a.astype(float), b.astype(float)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = _smooth(a), _smooth(b)
    va, vb = _smooth(a * a) - ma * ma, _smooth(b * b) - mb * mb
    cov = _smooth(a * b) - ma * mb
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))))


def ellipse(size: int) -> np.ndarray:
    """Filled ellipse inscribed in a ``size`` x ``size`` square, as a structuring element."""
    r = size // 2
    out = np.zeros((size, size), bool)
    for i in range(size):
        dy = i - r
        dx = round(r * math.sqrt(max(r * r - dy * dy, 0)) / r) if r else 0
        out[i, max(r - dx, 0) : min(r + dx + 1, size)] = True
    return out


def _morph(mask: np.ndarray, element: np.ndarray, grow: bool) -> np.ndarray:
    r = element.shape[0] // 2
    p = np.pad(mask.astype(bool), r, constant_values=not grow)
    out = np.full(mask.shape, not grow)
    for dy, dx in np.argwhere(element):
        part = p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
        out = out | part if grow else out & part
    return out


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _morph(mask, element[::-1, ::-1], True)


def erode(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return _morph(mask, element, False)


def open_close(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    opened = dilate(erode(mask, element), element)
    return erode(dilate(opened, element), element)


def moving_region(frames: list[np.ndarray], threshold: float = 30.0, pace: float = 0.3) -> np.ndarray:
    """Pixels that differ from a slowly adapting background in any frame.

    The background before frame i is a weighted sum of the frames before it: the first one weighs
    (1 - pace)^(i - 1), any later frame j pace * (1 - pace)^(i - 1 - j).
    """
    grays = np.stack([to_gray(f).astype(float) for f in frames])
    i, j = np.arange(1, len(frames))[:, None], np.arange(len(frames))
    weights = np.where(j < i, (1.0 - pace) ** (i - 1.0 - j) * np.where(j > 0, pace, 1.0), 0.0)
    differs = np.abs(grays[1:] - np.tensordot(weights, grays, 1)) > threshold
    return open_close(differs.any(axis=0), ellipse(5)) if len(frames) > 1 else np.zeros(grays.shape[1:], bool)
