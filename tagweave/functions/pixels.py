"""Pixel kernels in numpy, for Arrow UDFs: letterboxes, tiles, blending, masks, resampling.

Images are height x width x channels; masks height x width, 0 to 255.
"""

from __future__ import annotations

import numpy as np

# Channel means and deviations of the image encoders.
CLIP_MEAN, CLIP_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _kernel(kind: str):
    """(radius, weight function) of a sampler."""

    def cubic(b: float, c: float):
        def f(x):
            x = np.abs(x)
            near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
            far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
            return np.where(x < 1, near, np.where(x < 2, far, 0.0))

        return f

    return {"lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)), "mitchell": (2.0, cubic(1 / 3, 1 / 3)), "bicubic": (2.0, cubic(0.0, 0.5)), "linear": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x)))}[kind]


def _weights(old: int, new: int, kind: str) -> np.ndarray:
    radius, f = _kernel(kind)
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    w = f((np.arange(old)[None, :] - centre[:, None]) / scale)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    """Separable resampling, in floats."""
    out = np.tensordot(_weights(image.shape[0], height, kind), image.astype(np.float64), axes=(1, 0))
    return np.moveaxis(np.tensordot(_weights(image.shape[1], width, kind), out, axes=(1, 1)), 0, 1)


def crop_resized(image: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    """Cut to the asked aspect around the middle, then resize."""
    h, w = image.shape[:2]
    ratio = min(w / width, h / height)
    cw, ch = max(1, round(width * ratio)), max(1, round(height * ratio))
    x, y = (w - cw) // 2, (h - ch) // 2
    return resized(image[y : y + ch, x : x + cw], width, height, kind)


def letterbox(image: np.ndarray, side: int, fill: float, kind: str = "lanczos") -> np.ndarray:
    """Fit into a square canvas, centred."""
    h, w = image.shape[:2]
    ratio = min(side / w, side / h)
    nw, nh = max(1, int(np.rint(w * ratio))), max(1, int(np.rint(h * ratio)))
    out = np.full((side, side, *image.shape[2:]), float(fill))
    y, x = (side - nh) // 2, (side - nw) // 2
    out[y : y + nh, x : x + nw] = np.clip(resized(image, nw, nh, kind), 0, 255)
    return out


def tagger_input(image: np.ndarray) -> np.ndarray:
    """1 x 448 x 448 x 3 on white, 0 to 255, blue first."""
    return letterbox(image, 448, 255)[None, :, :, ::-1].astype(np.float32)


def clip_tagger_input(image: np.ndarray) -> np.ndarray:
    """1 x 3 x 448 x 448 on white, normalised."""
    x = (letterbox(image, 448, 255) / 255 - CLIP_MEAN) / CLIP_STD
    return x.transpose(2, 0, 1)[None].astype(np.float32)


def detector_input(image: np.ndarray) -> np.ndarray:
    """1 x 416 x 416 x 3 on black, 0 to 1."""
    return (letterbox(image, 416, 0) / 255)[None].astype(np.float32)


def upscaler_input(image: np.ndarray) -> np.ndarray:
    """1 x 3 x even height x even width, blue first, 0 to 1."""
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    return (image[:h, :w, ::-1] / 255).transpose(2, 0, 1)[None].astype(np.float32)


def segmenter_input(image: np.ndarray, side: int = 1024) -> np.ndarray:
    """1 x 3 x side x side, sharpened and normalised."""
    x = letterbox(image, side, 0)
    x = np.clip(x + (x - blurred(x, 0.5)), 0, 255)
    return ((x / 255 - IMAGENET_MEAN) / IMAGENET_STD).transpose(2, 0, 1)[None].astype(np.float32)


def captioner_input(image: np.ndarray, side: int = 768) -> np.ndarray:
    """1 x 3 x side x side, stretched and normalised."""
    x = np.clip(resized(image, side, side, "bicubic"), 0, 255)
    return ((x / 255 - IMAGENET_MEAN) / IMAGENET_STD).transpose(2, 0, 1)[None].astype(np.float32)


def inpaint_input(image: np.ndarray, mask: np.ndarray, side: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Image 0 to 1 and mask 0 or 1 (softened first, then anything above 0)."""
    if image.shape[:2] != mask.shape[:2]:
        raise ValueError("image and mask differ in size")
    x = np.clip(resized(image, side, side), 0, 255) / 255
    m = blurred(resized(mask, side, side, "linear"), 1.0) > 1e-3
    return x.transpose(2, 0, 1)[None].astype(np.float32), m[None, None].astype(np.float32)


def blurred(image: np.ndarray, sigma: float = 22.0) -> np.ndarray:
    """Gaussian blur, edges repeated."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(wide, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def thumbnail(image: np.ndarray, most: int) -> np.ndarray:
    """Shrink so that the longer side is at most ``most``."""
    h, w = image.shape[:2]
    ratio = min(1.0, most / max(h, w))
    return np.clip(resized(image, max(1, round(w * ratio)), max(1, round(h * ratio))), 0, 255).astype(np.uint8)


def tile_pixels(image: np.ndarray, x: int, y: int, tile: int = 512) -> np.ndarray:
    """One tile; what lies outside the image mirrors it."""
    part = image[y : y + tile, x : x + tile]
    pad = [(0, tile - part.shape[0]), (0, tile - part.shape[1])] + [(0, 0)] * (part.ndim - 2)
    return np.pad(part, pad, mode="symmetric")


def tile_pair(image: np.ndarray, mask: np.ndarray, x: int, y: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Tile of an image and its mask as 0 or 1 (any channel above 0)."""
    if image.shape[:2] != mask.shape[:2]:
        raise ValueError("image and mask differ in size")
    flat = mask.max(axis=2) if mask.ndim == 3 else mask
    return tile_pixels(image, x, y, tile), (tile_pixels(flat, x, y, tile) > 0).astype(np.float32)


def feather(tile: int, overlap: int) -> np.ndarray:
    """Weights of a tile: ramps over half the overlap at each side, the lesser of both axes."""
    f = overlap // 2
    i = np.arange(tile, dtype=np.float64)
    side = np.ones(tile)
    if f:
        side = np.where(i < f, i / f, np.where(i >= tile - f, (tile - 1 - i) / f, 1.0))
    return np.minimum(side[None, :], side[:, None])


def blended(tiles: list[tuple[np.ndarray, int, int]], width: int, height: int, tile: int = 512, overlap: int = 126) -> np.ndarray:
    """Weighted mean of overlapping tiles (pixels, x, y), with alpha; pixels of no weight stay transparent black."""
    w = feather(tile, overlap)
    total, sums = np.zeros((height, width)), np.zeros((height, width, 3))
    for pixels, x, y in tiles:
        h, k = min(tile, height - y), min(tile, width - x)
        total[y : y + h, x : x + k] += w[:h, :k]
        sums[y : y + h, x : x + k] += pixels[:h, :k, :3] * w[:h, :k, None]
    out = np.zeros((height, width, 4), np.uint8)
    full = total > 0
    out[full, :3] = np.clip(sums[full] / total[full][:, None], 0, 255).astype(np.uint8)
    out[full, 3] = 255
    return out


def dilated(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """Largest value within a square."""
    wide = np.pad(mask, radius)
    view = np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1, 2 * radius + 1))
    return view.max(axis=(2, 3))


def median3(mask: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(np.pad(mask, 1, mode="edge"), (3, 3))
    return np.median(view, axis=(2, 3)).astype(mask.dtype)


def combined_masks(masks: list[np.ndarray], radius: int = 2, smooth: bool = True) -> np.ndarray:
    """Union of masks (anything above 0), dilated, then median and Gaussian smoothing."""
    if not masks or any(m.shape != masks[0].shape for m in masks):
        raise ValueError("masks of one size are needed")
    out = dilated((np.max(masks, axis=0) > 0).astype(np.uint8) * 255, radius)
    return np.clip(blurred(median3(out), 5.0), 0, 255).astype(np.uint8) if smooth else out


def rendered_mask(logits: np.ndarray, width: int, height: int, side: int = 1024) -> np.ndarray:
    """Mask of an image from low-resolution logits: sigmoid, enlarge, cut the padding off, fit, above a half."""
    p = resized(1 / (1 + np.exp(-logits.astype(np.float64))), side, side, "linear")
    ratio = min(side / width, side / height)
    nw, nh = int(np.rint(width * ratio)), int(np.rint(height * ratio))
    y, x = (side - nh) // 2, (side - nw) // 2
    return ((resized(p[y : y + nh, x : x + nw], width, height, "linear") > 0.5) * 255).astype(np.uint8)


def brush(mask: np.ndarray, x: float, y: float, radius: float, value: int = 255, hardness: float = 1.0) -> np.ndarray:
    """A circle drawn on a mask; below a hardness of 0.99 its rim fades out."""
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    d = np.hypot(xx - x, yy - y) / radius
    alpha = (d <= 1).astype(float) if hardness >= 0.99 else np.clip((1 - d) / max(1e-6, 1 - hardness), 0, 1)
    return (mask * (1 - alpha) + value * alpha).astype(np.uint8)


def tensor_image(x: np.ndarray, scale: float = 1.0, blue_first: bool = False) -> np.ndarray:
    """3 x h x w values to pixels: scaled, held within 0 to 255, cut to whole numbers."""
    out = np.clip(x.transpose(1, 2, 0) * scale, 0, 255).astype(np.uint8)
    return out[:, :, ::-1] if blue_first else out


def _coverage(start: float, size: float, limit: int) -> tuple[int, np.ndarray]:
    """First pixel and covered shares along one side of the span [start, start + size)."""
    a, b = max(0, int(np.floor(start))), min(limit, int(np.ceil(start + size)))
    i = np.arange(a, b)
    return a, np.clip(1 - np.maximum(0, start - i) - np.maximum(0, i + 1 - start - size), 0, None)


def detail_preserving(image: np.ndarray, width: int, height: int, power: float = 3.0) -> np.ndarray:
    """Downscaling that weighs each source pixel by its distance from the smoothed patch colour, to a power."""
    src = image[:, :, :3].astype(np.float64) / 255
    h, w = src.shape[:2]
    patch = min(w / width, h / height)
    x0, y0 = (w - width * patch) / 2, (h - height * patch) / 2
    spans_x = [_coverage(x * patch + x0, patch, w) for x in range(width)]
    spans_y = [_coverage(y * patch + y0, patch, h) for y in range(height)]
    mean = np.zeros((height, width, 3))
    for y, (a, cy) in enumerate(spans_y):
        rows = np.tensordot(cy, src[a : a + len(cy)], axes=(0, 0))
        for x, (b, cx) in enumerate(spans_x):
            mean[y, x] = cx @ rows[b : b + len(cx)] / (cx.sum() * cy.sum())
    near = np.pad(mean, ((1, 1), (1, 1), (0, 0)), mode="edge")
    kernel = np.outer((1, 2, 1), (1, 2, 1)) / 16
    smooth = sum(kernel[i, j] * near[i : i + height, j : j + width] for i in range(3) for j in range(3))
    out = np.zeros((height, width, 3))
    for y, (a, cy) in enumerate(spans_y):
        for x, (b, cx) in enumerate(spans_x):
            part = src[a : a + len(cy), b : b + len(cx)]
            share = np.outer(cy, cx)
            d2 = ((smooth[y, x] - part) ** 2).sum(axis=2)
            weight = np.where((d2 > 1e-9) & (power != 0), share * np.sqrt(d2) ** power, share)
            weight[share <= 1e-6] = 0
            total = weight.sum()
            out[y, x] = (part * weight[:, :, None]).sum(axis=(0, 1)) / total if total > 0 else smooth[y, x]
    return np.clip(out * 255 + 0.5, 0, 255).astype(np.uint8)
