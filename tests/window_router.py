"""A plain router of a small window, whole arrays at a time: what the distributed fill and flats are compared with."""

import numpy as np
import pandas as pd

from fluvispark.operators.fill import SCAN, _Tile, lowest_ways
from fluvispark.operators.stencil import OFFSETS, d8_kernel


def _near(a: np.ndarray, fill=np.nan) -> list[np.ndarray]:
    """The eight neighbours' values of every cell."""
    p = np.pad(a, 1, constant_values=fill)
    return [p[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]] for dr, dc in OFFSETS]


def filled(z: np.ndarray) -> np.ndarray:
    """The surface without depressions (NaN for no data), draining to its boundary cells, or to the lowest if there are none."""
    valid = ~np.isnan(z)
    seed = valid & (sum((~np.isnan(x)).astype(int) for x in _near(z)) < 8)
    if not seed.any():
        seed = z == np.nanmin(z)
    r, c = np.nonzero(valid)
    tile = _Tile(pd.DataFrame({"r": r, "c": c, "z": z[r, c], "seed": seed[r, c]}), (0, 0), max(z.shape) + 2, z.shape[1])
    out = np.full(z.shape, np.nan)
    out[r, c] = np.maximum(tile.z, lowest_ways(len(tile.nodes), tile.a, tile.b, tile.w, tile.level)[tile.node])
    return out


def _layers(start: np.ndarray, flat: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
    """Breadth-first layers from ``start`` over ``flat`` cells of equal elevation; 0 where not reached."""
    level, front, n = start.astype(int), start, 1
    height = np.where(flat, z, np.nan)
    while front.any():
        n += 1
        spread = np.zeros_like(flat)
        for near_front, near_z in zip(_near(front.astype(float), 0), _near(height), strict=True):
            spread |= (near_front > 0) & (np.abs(near_z - z) <= tolerance)
        front = spread & flat & (level == 0)
        level[front] = n
    return level


def directions(z: np.ndarray, cw: float, ch: float, method: str = "barnes") -> np.ndarray:
    """Steepest descent with resolved flats, -1 where there is none."""
    got = d8_kernel(cw, ch)({"z": np.pad(z, 1, constant_values=np.nan)}, 1)["dir"]
    out = np.where(np.isnan(got), -1, got).astype(int)
    valid = ~np.isnan(z)
    drain = valid & (out < 0) & (sum((~np.isnan(x)).astype(int) for x in _near(z)) < 8)
    tol, scan = (1e-9, SCAN) if method == "barnes" else (0.0, tuple(range(8)))
    order = sorted(range(8), key=lambda k: (k % 2 if method == "barnes" else 0, scan.index(k)))
    while True:
        flat = valid & (out < 0) & ~drain
        if not flat.any():
            return out
        near_z, near_done = _near(z), [x > 0 for x in _near((((out >= 0) | drain) & valid).astype(float), 0)]
        exit_ = np.full(z.shape, -1)
        for k in reversed(order):
            exit_ = np.where(flat & near_done[k] & (near_z[k] <= z + tol), k, exit_)
        outs = exit_ >= 0
        toward = _layers(outs, flat, z, tol)
        mask = toward.astype(float)
        if method == "barnes":
            reached = toward > 0
            high = reached & ~outs & np.any([x > z + tol for x in near_z], axis=0)
            away = _layers(high, reached, z, tol)
            label = np.where(reached, np.arange(z.size).reshape(z.shape), -1)
            while True:  # the least label of a flat spreads through it
                least = label.copy()
                for near_l, near in zip(_near(label.astype(float), -1), _near(np.where(reached, z, np.nan)), strict=True):
                    least = np.where(reached & (near_l >= 0) & (np.abs(near - z) <= tol), np.minimum(least, np.where(near_l >= 0, near_l, np.inf)), least)
                least = least.astype(int)
                jumped = np.where(reached, label.ravel()[np.maximum(least, 0)], -1)
                least = np.where(reached, np.minimum(least, jumped), -1)
                if (least == label).all():
                    break
                label = least
            height = np.zeros(z.size)
            np.maximum.at(height, label[reached], away[reached])
            mask = np.where(reached, 2.0 * toward + np.where(away > 0, height[np.maximum(label, 0)] - away, 0), 0)
        best, step = np.where(mask > 0, mask, np.inf), np.full(z.shape, -1)
        near_mask = [np.where((m > 0) & (np.abs(n - z) <= tol), m, np.inf) for m, n in zip(_near(mask, 0), near_z, strict=True)]
        low = np.min(near_mask, axis=0)
        for k in reversed(order):
            step = np.where((mask > 0) & (near_mask[k] == low) & (low < best), k, step)
        new = np.where(outs, exit_, step)
        if not (flat & (new >= 0)).any():
            return out
        out = np.where(flat & (new >= 0), new, out)
