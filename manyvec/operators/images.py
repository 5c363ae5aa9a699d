"""Image degradation, restoration and segmentation on rows (id, h, w, c, data binary): one Arrow pass a pipeline."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from manyvec.functions.glyphs import text_mask

IMAGE = "id long, h int, w int, c int, data binary"


def _each(image: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``work`` on each channel of (h, w, c)."""
    return np.stack([work(image[:, :, k].astype(float)) for k in range(image.shape[2])], axis=2)


def _clipped(image: np.ndarray) -> np.ndarray:
    return np.clip(image, 0, 255).astype(np.uint8)


def mirrored(channel: np.ndarray, ky: int, kx: int) -> np.ndarray:
    """Bordered by reflection without the edge itself."""
    return np.pad(channel, ((ky, ky), (kx, kx)), mode="reflect" if min(channel.shape) > max(ky, kx) else "symmetric")


def filtered(channel: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a small kernel."""
    kh, kw = kernel.shape
    wide, out = mirrored(channel, kh // 2, kw // 2), np.zeros_like(channel)
    for y, x in zip(*np.nonzero(kernel)):
        out += kernel[y, x] * wide[y : y + channel.shape[0], x : x + channel.shape[1]]
    return out


def gaussian_kernel(sigma: float, size: int) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _edged(stack: np.ndarray, ky: int, kx: int) -> np.ndarray:
    """``mirrored`` for images (n, h, w, c)."""
    h, w = stack.shape[1:3]
    return np.pad(stack, ((0, 0), (ky, ky), (kx, kx), (0, 0)), mode="reflect" if min(h, w) > max(ky, kx) else "symmetric")


def gaussian_stack(stack: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Gaussian blur of images (n, h, w, c): along rows, then along columns."""
    k = gaussian_kernel(sigma, int(6 * sigma + 1) | 1)
    half, (h, w) = len(k) // 2, stack.shape[1:3]
    wide = _edged(stack.astype(float), 0, half)
    rows = sum(k[i] * wide[:, :, i : i + w] for i in range(len(k)))
    wide = _edged(rows, half, 0)
    return _clipped(np.rint(sum(k[i] * wide[:, i : i + h] for i in range(len(k)))))


def gaussian_blur(image: np.ndarray, seed: int = 0, sigma: float = 3.0) -> np.ndarray:
    return gaussian_stack(image[None], sigma)[0]


def gaussian_noise(image: np.ndarray, seed: int = 0, std: float = 25.0) -> np.ndarray:
    return _clipped(image + np.random.default_rng(seed).normal(0, std, image.shape))


def salt_pepper(image: np.ndarray, seed: int = 0, amount: float = 0.05) -> np.ndarray:
    out, rng, n = image.copy(), np.random.default_rng(seed), int(amount * image.size)
    for value in (255, 0):
        out[rng.integers(0, image.shape[0], n), rng.integers(0, image.shape[1], n)] = value
    return out


def bilinear(channel: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between cells; 0 outside."""
    h, w = channel.shape
    out = np.zeros(y.shape)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            weight = (1 - np.abs(y - yy)) * (1 - np.abs(x - xx))
            out += np.where(inside, channel[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)] * weight, 0)
    return out


def _turned(shape: tuple[int, int], angle: float, cy: float, cx: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each cell comes from when turned counter-clockwise about (cy, cx)."""
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    a = np.deg2rad(angle)
    return cy + np.sin(a) * (x - cx) + np.cos(a) * (y - cy), cx + np.cos(a) * (x - cx) - np.sin(a) * (y - cy)


def motion_kernel(size: int, angle: float) -> np.ndarray:
    line = np.zeros((size, size))
    line[size // 2] = 1 / size
    return bilinear(line, *_turned(line.shape, angle, size // 2, size // 2))


def motion_blur(image: np.ndarray, seed: int = 0, kernel_size: int = 15, angle: float = 45.0) -> np.ndarray:
    k = motion_kernel(kernel_size, angle)
    return _clipped(np.rint(_each(image, lambda ch: filtered(ch, k))))


def tilt(image: np.ndarray, seed: int = 0, angle: float = 10.0) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = _turned((h, w), angle, (h - 1) / 2, (w - 1) / 2)
    yy, xx = np.rint(y).astype(int), np.rint(x).astype(int)
    inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
    return np.where(inside[:, :, None], image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], 255).astype(np.uint8)


#: fixed values: the standard luminance and chrominance quantisation tables
LUMINANCE = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMINANCE = np.array([
    [17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99], [99, 99, 99, 99, 99, 99, 99, 99],
])
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def chroma(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(luminance, blue and red difference) of (h, w, 3 or more), the differences around 128 as whole numbers."""
    r, g, b = image[..., 0].astype(float), image[..., 1].astype(float), image[..., 2].astype(float)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, *(np.clip(np.rint(d), 0, 255).astype(int) for d in ((b - y) / 1.772 + 128, (r - y) / 1.402 + 128))


def subsampled(plane: np.ndarray) -> np.ndarray:
    """Every 2 x 2 cells as their mean, rounded down and up in turn from column to column; edges are repeated."""
    wide = np.pad(plane, ((0, plane.shape[0] % 2), (0, plane.shape[1] % 2)), mode="edge")
    sums = wide[::2, ::2] + wide[1::2, ::2] + wide[::2, 1::2] + wide[1::2, 1::2]
    return (sums + 1 + np.arange(sums.shape[1]) % 2) >> 2


def upsampled(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Twice the size, each cell three parts of its own and one of the nearest neighbour, first down, then across."""
    wide = np.pad(plane, 1, mode="edge")
    rows = np.empty((2 * plane.shape[0], wide.shape[1]), int)
    rows[::2], rows[1::2] = 3 * wide[1:-1] + wide[:-2], 3 * wide[1:-1] + wide[2:]
    out = np.empty((rows.shape[0], 2 * plane.shape[1]), int)
    out[:, ::2], out[:, 1::2] = (3 * rows[:, 1:-1] + rows[:, :-2] + 8) >> 4, (3 * rows[:, 1:-1] + rows[:, 2:] + 7) >> 4
    return out[:h, :w]


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What cosine blocks leave of a plane when each coefficient is a multiple of the table's entry."""
    h, w = plane.shape
    wide = np.pad(plane.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = wide.reshape(wide.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    coded = np.rint(COSINES @ blocks @ COSINES.T / table) * table
    return ((COSINES.T @ coded @ COSINES).transpose(0, 2, 1, 3).reshape(wide.shape) + 128)[:h, :w]


def jpeg(image: np.ndarray, seed: int = 0, quality: int = 10) -> np.ndarray:
    """What quantised cosine blocks of this quality leave of the image; colour differences are kept for every second row and
    column only."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    light, colour = (np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (LUMINANCE, CHROMINANCE))
    h, w, c = image.shape
    if c < 3:
        return _clipped(np.rint(np.stack([_quantised(image[..., k], light) for k in range(c)], axis=2)))
    y, *differences = chroma(image)
    y = np.clip(np.rint(_quantised(np.rint(y), light)), 0, 255)
    cb, cr = (upsampled(np.clip(np.rint(_quantised(subsampled(d), colour)), 0, 255).astype(int), h, w) - 128 for d in differences)
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return _clipped(np.rint(np.concatenate([rgb, image[..., 3:].astype(float)], axis=2)))


def colour_planes(rows: DataFrame) -> DataFrame:
    """(id, cb, cr, cb_full, cr_full): colour differences of three-channel images as they are subsampled, and brought back
    to full size, row after row."""

    def run(parts):
        for pdf in parts:
            out = []
            for key, h, w, c, data in zip(pdf["id"], pdf["h"], pdf["w"], pdf["c"], pdf["data"]):
                small = [subsampled(d) for d in chroma(np.frombuffer(data, np.uint8).reshape(h, w, c))[1:]]
                out.append((key, *[p.ravel().tolist() for p in small], *[upsampled(p, h, w).ravel().tolist() for p in small]))
            yield pd.DataFrame(out, columns=["id", "cb", "cr", "cb_full", "cr_full"])

    return rows.select("id", "h", "w", "c", "data").mapInPandas(run, "id long, cb array<int>, cr array<int>, cb_full array<int>, cr_full array<int>")


def watermark(image: np.ndarray, seed: int = 0, text: str = "WATERMARK", alpha: float = 0.3, size: int = 1) -> np.ndarray:
    """The text in red, its corner a quarter across and half down, blended in at ``alpha``; what does not fit is cut off."""
    h, w, c = image.shape
    mask = text_mask(text, size)[: h - h // 2, : w - w // 4]
    at = (slice(h // 2, h // 2 + mask.shape[0]), slice(w // 4, w // 4 + mask.shape[1]))
    red = np.array([255, 0, 0][:c] if c >= 3 else [76] * c, float)  # 76: red as a grey level
    share, out = int(255 * alpha) / 255, image.astype(float)
    out[(*at, slice(0, len(red)))] += mask[..., None] * share * (red - out[(*at, slice(0, len(red)))])
    return _clipped(np.rint(out))


def nlmeans_stack(stack: np.ndarray, h: float = 10.0, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means of images (n, h, w, c): averages weighted by the likeness of the surrounding templates."""
    t, s = template // 2, search // 2
    n, hh, ww, c = stack.shape
    tall, broad = hh + 2 * t, ww + 2 * t
    # images last, so that each sum over rows or columns is taken for all of them at once
    wide = np.ascontiguousarray(np.moveaxis(_edged(stack.astype(float), s + t, s + t), 0, -1))
    centre = wide[s : s + tall, s : s + broad]
    total, weights = np.zeros((hh, ww, c, n)), np.zeros((hh, ww, 1, n))
    gaps, sums = np.empty((tall, broad, c, n)), np.zeros((tall + 1, broad + 1, n))
    inner = sums[1:, 1:]
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            other = wide[s + dy : s + dy + tall, s + dx : s + dx + broad]
            np.subtract(centre, other, out=gaps)
            np.multiply(gaps, gaps, out=gaps)
            inner[:] = gaps[:, :, 0] if c == 1 else gaps.mean(axis=2)
            for y in range(1, tall):
                inner[y] += inner[y - 1]
            for x in range(1, broad):
                inner[:, x] += inner[:, x - 1]
            gap = (sums[template:, template:] - sums[:-template, template:] - sums[template:, :-template] + sums[:-template, :-template]) / template**2
            w = np.exp(-np.maximum(gap, 0) / (h * h))[:, :, None]
            total += w * other[t : t + hh, t : t + ww]
            weights += w
    return np.ascontiguousarray(np.moveaxis(_clipped(np.rint(total / weights)), -1, 0))


def nlmeans(image: np.ndarray, seed: int = 0, h: float = 10.0, template: int = 7, search: int = 21) -> np.ndarray:
    return nlmeans_stack(image[None], h, template, search)[0]


def restore_gaussian(image: np.ndarray, seed: int = 0, sigma: float = 1.5) -> np.ndarray:
    return gaussian_blur(image, seed, sigma)


def grey(image: np.ndarray) -> np.ndarray:
    return image[..., 0].astype(float) if image.shape[-1] == 1 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114]))


def _box_sums(planes: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size neighbourhoods of (n, h, w), with zeros outside."""
    half = size // 2
    sums = np.pad(np.pad(planes, ((0, 0), (half, half), (half, half))).cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    return sums[:, size:, size:] - sums[:, :-size, size:] - sums[:, size:, :-size] + sums[:, :-size, :-size]


def wiener_stack(stack: np.ndarray, noise_power: float = 0.01) -> np.ndarray:
    """Local 5 x 5 Wiener filter of the grey images (n, h, w), back in their channels. Sums are of whole numbers, so they
    are exact; ``noise_power`` is for levels from 0 to 1."""
    x = grey(stack)
    sums, squares, noise = _box_sums(x, 5), _box_sums(x * x, 5), noise_power * 255 * 255
    mean, variance = sums / 25, (25 * squares - sums * sums) / 625
    gain = np.where(variance > noise, 1 - noise / np.where(variance > noise, variance, 1), 0)
    return np.repeat(_clipped(np.floor(mean + gain * (x - mean)))[..., None], stack.shape[3], axis=3)


def wiener(image: np.ndarray, seed: int = 0, noise_power: float = 0.01, local: bool = True) -> np.ndarray:
    """The local Wiener filter, or its form over frequencies."""
    if local:
        return wiener_stack(image[None], noise_power)[0]
    x = grey(image) / 255
    f = np.fft.fft2(x)
    power = np.abs(f) ** 2
    out = np.real(np.fft.ifft2(power / (power + noise_power * x.size) * f))
    return np.repeat(_clipped(out * 255)[:, :, None], image.shape[2], axis=2)


def filtered_zero(channel: np.ndarray, size: int) -> np.ndarray:
    """Sums over size x size neighbourhoods with zeros outside."""
    wide = np.pad(channel, size // 2)
    sums = np.pad(wide.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]


def _spread(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    count = filtered_zero((mask if grow else ~mask).astype(float), size if size % 2 else size + 1)
    return count > 0.5 if grow else count < 0.5


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers of 8-connected regions by spreading minima with pointer jumps; 0 outside."""
    h, w = mask.shape
    ids = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        wide = np.pad(np.where(mask, ids, h * w + 1), 1, constant_values=h * w + 1)
        low = np.minimum.reduce([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(mask, np.minimum(ids, low), 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(mask, flat[new], 0)
        if (new == ids).all():
            return ids
        ids = new


def segmented(image: np.ndarray, seed: int = 0, block_size: int = 11, c_offset: float = 2, morph_kernel_size: int = 5, min_area_ratio: float = 0.001, padding: int = 10, mode: str = "whiten") -> np.ndarray:
    """Foreground by adaptive threshold, closing and large regions; whitens or crops what lies outside their box.
    The box's far edges keep their padding where its near edges stop at the border."""
    if mode not in ("whiten", "crop"):
        raise ValueError(f"unknown mode {mode!r}")
    size = max(3, block_size) | 1
    g = grey(image)
    h, w = g.shape
    k = gaussian_kernel(0.3 * ((size - 1) * 0.5 - 1) + 0.8, size)
    wide = np.pad(g, size // 2, mode="edge")
    rows = sum(k[i] * wide[:, i : i + w] for i in range(size))
    mean = sum(k[i] * rows[i : i + h] for i in range(size))
    ink = g <= np.rint(mean) - c_offset
    closed = _spread(_spread(ink, morph_kernel_size, True), morph_kernel_size, False)
    ids = labelled(closed)
    areas = np.bincount(ids.ravel(), minlength=1)
    areas[0] = 0
    kept = areas[ids] >= max(h * w * min_area_ratio, 1)
    if not kept.any():
        return image
    ys, xs = np.flatnonzero(kept.any(axis=1)), np.flatnonzero(kept.any(axis=0))
    y, x = max(0, ys[0] - padding), max(0, xs[0] - padding)
    y2, x2 = y + min(h - y, ys[-1] - ys[0] + 1 + 2 * padding), x + min(w - x, xs[-1] - xs[0] + 1 + 2 * padding)
    if mode == "crop":
        return image[y:y2, x:x2].copy()
    out = np.full_like(image, 255)
    out[y:y2, x:x2] = image[y:y2, x:x2]
    return out


Step = tuple[str, dict]
DEGRADATIONS = {"gaussian_noise": gaussian_noise, "salt_pepper": salt_pepper, "gaussian_blur": gaussian_blur, "motion_blur": motion_blur, "tilt": tilt, "jpeg_compression": jpeg, "watermark": watermark}
RESTORATIONS = {"nlmeans": nlmeans, "gaussian": restore_gaussian, "wiener": wiener}
SEGMENTATIONS = {"adaptive": segmented}
#: Restorations of many images (n, h, w, c) of one size at once.
STACKS = {"nlmeans": nlmeans_stack, "gaussian": gaussian_stack, "wiener": wiener_stack}
#: Functions of one image that give the same for many of one size at once, by what does so; no random numbers are drawn there.
AT_ONCE = {nlmeans: nlmeans_stack, restore_gaussian: partial(gaussian_stack, sigma=1.5), gaussian_blur: gaussian_stack}
#: Functions whose work on an image far outweighs moving it: then images are dealt to more tasks than there are cores.
HEAVY = (nlmeans,)
#: Cells of the images that one step takes at once, unless a single image has more.
CELLS = 1 << 14


def by_size(pictures: list[np.ndarray], work: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """``work`` on stacks (n, h, w, c) of images of one size and at most CELLS cells; results in the images' order."""
    places: dict[tuple[int, ...], list[int]] = {}
    for i, image in enumerate(pictures):
        places.setdefault(image.shape, []).append(i)
    out: list[np.ndarray] = [None] * len(pictures)
    for shape, same in places.items():
        most = max(1, CELLS // max(1, int(np.prod(shape))))
        for at in range(0, len(same), most):
            lot = same[at : at + most]
            for i, image in zip(lot, work(np.stack([pictures[i] for i in lot]))):
                out[i] = image
    return out


# fixed values: named conditions
DEGRADED: dict[str, list[Step]] = {
    "light_noise": [("gaussian_noise", {"std": 15})],
    "heavy_noise": [("gaussian_noise", {"std": 50})],
    "motion_blur": [("motion_blur", {"kernel_size": 15, "angle": 45})],
    "tilt": [("tilt", {"angle": 15})],
    "jpeg_low": [("jpeg_compression", {"quality": 5})],
    "combined": [("gaussian_noise", {"std": 25}), ("motion_blur", {"kernel_size": 9, "angle": 30})],
}
RESTORED: dict[str, list[Step]] = {"nlmeans": [("nlmeans", {"h": 10})], "gaussian": [("gaussian", {"sigma": 1.5})], "wiener": [("wiener", {})]}


class Pipeline:
    """Steps in order, each checked against the registry when the pipeline is made."""

    def __init__(self, steps: list[Step], registry: dict[str, Callable]):
        if unknown := [n for n, _ in steps if n not in registry]:
            raise ValueError(f"unknown steps {unknown}; there are {sorted(registry)}")
        self.steps, self.registry = steps, registry

    def one(self, image: np.ndarray, key: int = 0) -> np.ndarray:
        for i, (name, options) in enumerate(self.steps):
            image = self.registry[name](image, self.seed(key, i, name), **options)
        return image

    @staticmethod
    def seed(key: int, i: int, name: str) -> int:
        return zlib.crc32(f"{key}/{i}/{name}".encode())

    def many(self, pictures: list[np.ndarray], keys: list[int]) -> list[np.ndarray]:
        """The same as ``one`` of each image; steps that can take images of one size at once do."""
        for i, (name, options) in enumerate(self.steps):
            work = self.registry[name]
            if work in AT_ONCE:
                pictures = by_size(pictures, partial(AT_ONCE[work], **options))
            else:
                pictures = [work(image, self.seed(key, i, name), **options) for image, key in zip(pictures, keys)]
        return pictures

    def __call__(self, images: DataFrame) -> DataFrame:
        def run(parts):
            for pdf in parts:
                pictures = [np.frombuffer(data, np.uint8).reshape(h, w, c) for h, w, c, data in zip(pdf["h"], pdf["w"], pdf["c"], pdf["data"])]
                out = self.many(pictures, [int(key) for key in pdf["id"]])
                yield pd.DataFrame([(key, *image.shape, image.tobytes()) for key, image in zip(pdf["id"], out)], columns=["id", "h", "w", "c", "data"])

        rows = images.select("id", "h", "w", "c", "data")
        if any(self.registry[name] in HEAVY for name, _ in self.steps):
            rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id")
        return rows.mapInPandas(run, IMAGE)


EVERY = DEGRADATIONS | RESTORATIONS | SEGMENTATIONS


def condition(name: str, degradation: str = "", restoration: str = "", **options) -> Pipeline:
    """The pipeline of a named condition: clean, degraded, restored or segmented."""
    steps = {"clean": lambda: [], "degraded": lambda: DEGRADED[degradation], "restored": lambda: DEGRADED[degradation] + RESTORED[restoration], "segmented": lambda: [("adaptive", options)]}
    if name not in steps:
        raise ValueError(f"unknown condition {name!r}")
    return Pipeline(steps[name](), EVERY)
