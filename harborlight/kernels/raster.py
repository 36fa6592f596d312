"""Decoding and screening of rasters, in numpy."""

from __future__ import annotations

import io

import numpy as np

# What stands in for a missing band, in order.
SUBSTITUTES = {"nir": ("red", "green", "blue"), "red": ("green", "nir", "blue"), "green": ("red", "blue", "nir"), "blue": ("green", "red", "nir")}
BANDS = ("red", "green", "blue", "nir")


def decode(name: str, content: bytes) -> np.ndarray:
    """(H, W, C) of a .npy file; other kinds need codecs that are not installed and raise."""
    if not content:
        raise ValueError("ZERO_BYTE_FILE")
    if not name.lower().endswith(".npy"):
        raise ValueError("DECODE_ERROR: NoCodec")
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.ndim == 2:
        a = a[:, :, None]
    elif a.ndim == 3 and a.shape[0] <= 16 and a.shape[0] < min(a.shape[1:]):
        a = np.moveaxis(a, 0, 2)
    if a.ndim != 3 or a.shape[2] > 16:
        raise ValueError("DECODE_ERROR: Shape")
    if min(a.shape[:2]) < 16:
        raise ValueError("EMPTY_OR_TINY_RASTER")
    return a


def reflectance(a: np.ndarray, bands: list[str] | None = None, scale: float | None = None, offset: float = 0.0) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(H, W, 4) float32 red, green, blue, nir in 0..1.5; where all bands are 0; names of bands that others stand in for."""
    names = bands or {1: ["red"], 3: ["red", "green", "blue"]}.get(a.shape[2], [*BANDS, *map(str, range(12))][: a.shape[2]])
    scale = scale or (255.0 if a.dtype == np.uint8 else 1.0 if a.dtype.kind == "f" else 10000.0)
    x = np.where(np.isfinite(a), a, 0).astype(np.float32) if a.dtype.kind == "f" else a.astype(np.float32)
    have = {n: x[:, :, i] for i, n in enumerate(names[: x.shape[2]]) if n in BANDS}
    if not have:
        raise ValueError("NO_USABLE_BANDS")
    empty = np.all([v == 0 for v in have.values()], axis=0)
    good = {n: np.clip((v + offset) / scale, 0, 1.5) for n, v in have.items() if v.min() != v.max()} or {n: np.clip((v + offset) / scale, 0, 1.5) for n, v in have.items()}
    missing = [b for b in BANDS if b not in good]
    for b in missing:
        good[b] = next(good[s] for s in (*SUBSTITUTES[b], *good) if s in good)
    return np.stack([good[b] for b in BANDS], axis=2).astype(np.float32), empty, missing


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1) squares, clipped at the border, by an integral image."""
    h, w = a.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = np.cumsum(np.cumsum(a, axis=0, dtype=float), axis=1)
    y0, y1 = np.clip(np.arange(h) - r, 0, h), np.clip(np.arange(h) + r + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - r, 0, w), np.clip(np.arange(w) + r + 1, 0, w)
    return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return box_sum(mask, r) > 0 if r > 0 else mask.astype(bool)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected regions, in order of their first pixel; 0 elsewhere."""
    n = mask.size
    label = np.where(mask.ravel(), np.arange(1, n + 1), 0).reshape(mask.shape)
    while True:  # each pixel takes the least label around, then labels are followed to their own
        p = np.pad(label, 1)
        views = [p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        new = np.where(mask, np.min([np.where(v > 0, v, n + 1) for v in views], axis=0), 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(mask, flat[new], 0)
        if (new == label).all():
            break
        label = new
    kept, out = np.unique(label, return_inverse=True)
    return out.reshape(mask.shape) + (0 if kept[0] == 0 else 1)


def large(mask: np.ndarray, least: float) -> np.ndarray:
    lab = components(mask)
    keep = np.bincount(lab.ravel()) >= least
    keep[0] = False
    return keep[lab]


def screen(refl: np.ndarray, empty: np.ndarray, gsd: float) -> dict:
    """Masks and percentages of a scene: ice, cloud (bright core with a dilated fringe), land, open water."""
    red, green, blue, nir = (refl[:, :, i] for i in range(4))
    ndwi = (green - nir) / (green + nir + 1e-6)
    bright = (red + green + blue) / 3
    spread = np.abs(refl[:, :, :3] - bright[:, :, None]).sum(axis=2) / (bright + 1e-6)
    valid = ~empty
    ice = valid & (bright > 0.18) & (ndwi > 0.05) & (ndwi < 0.40)
    core = large(valid & (bright > 0.22) & (spread < 0.30) & ~ice, 40_000 / gsd**2)
    cloud = dilate(core, int(round(30 / gsd))) & valid
    land = dilate(large(valid & (ndwi < 0.0) & ~cloud & ~ice, 60_000 / gsd**2), int(round(60 / gsd))) & valid
    n = max(1, int(valid.sum()))
    water = valid & ~cloud & ~land & ~ice
    return {"ice": ice, "cloud": cloud, "land": land, "water": water, "cloud_pct": 100.0 * cloud.sum() / n, "ice_pct": 100.0 * ice.sum() / n, "water_pct": 100.0 * water.sum() / n, "valid_pct": 100.0 * valid.mean()}


def cfar(band: np.ndarray, sea: np.ndarray, gsd: float, k: float = 5.0, floor: float = 0.0015, contrast: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Detections and z scores against a ring of sea between 120 and 400 m, censored once of its own detections."""
    guard, ring = max(1, int(round(120 / gsd / 2))), max(2, int(round(400 / gsd / 2)))
    keep = sea.astype(float)
    for _ in range(2):
        n = box_sum(keep, ring) - box_sum(keep, guard)
        m = (box_sum(band * keep, ring) - box_sum(band * keep, guard)) / np.maximum(n, 1)
        v = (box_sum(band**2 * keep, ring) - box_sum(band**2 * keep, guard)) / np.maximum(n, 1) - m**2
        sigma = np.where(n < 16, np.inf, np.maximum(np.sqrt(np.maximum(v, 0)), floor))
        z = (band - m) / sigma
        hit = sea & (z > k) & (band - m > contrast)
        keep = sea & ~dilate(hit, 1)
    return hit, z


def contacts(refl: np.ndarray, empty: np.ndarray, gsd: float, cap: int = 400) -> list[dict]:
    """Bright regions on open water by falling area, then row and column, at most cap: centre, axes, contrast."""
    s = screen(refl, empty, gsd)
    hit, z = cfar(refl[:, :, 3].astype(float), s["water"], gsd)
    lab = components(hit)
    out = []
    for i in range(1, int(lab.max()) + 1):
        y, x = np.nonzero(lab == i)
        if len(y) < 3:
            continue
        spread = np.linalg.eigh(np.cov(np.stack([x, y])) + np.eye(2) / 12)
        out.append({"y": float(y.mean()), "x": float(x.mean()), "top": int(y.min()), "left": int(x.min()), "area_px": len(y), "length_m": float(4 * np.sqrt(spread.eigenvalues[1]) * gsd), "width_m": float(4 * np.sqrt(max(spread.eigenvalues[0], 0)) * gsd), "heading_deg": float(np.degrees(np.arctan2(spread.eigenvectors[0, 1], -spread.eigenvectors[1, 1])) % 180), "peak_z": float(z[y, x].max())})
    return sorted(out, key=lambda c: (-c["area_px"], c["top"], c["left"]))[:cap]


def normalise_chip(chip: np.ndarray) -> np.ndarray:
    """NCHW float32 input of the verifier from (N, H, W, C): per band minus its median, over 0.10, clipped to -2..5."""
    x = (chip - np.median(chip, axis=(1, 2), keepdims=True)) / 0.10
    return np.ascontiguousarray(np.moveaxis(np.clip(x, -2, 5), 3, 1), np.float32)
