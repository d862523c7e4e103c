"""Corners with a direction and 256 bits of brightness comparisons, found in one picture at several scales."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .images import luma

#: Scales of a picture and the ratio from one to the next; brightness by which a circle must differ; radius of the patch that gives the direction.
LEVELS, RATIO, CONTRAST, PATCH = 8, 1.2, 20, 15
#: Pixels from the border within which there is no corner: a turned comparison, and its smoothing, reach that far.
BORDER = PATCH + 4
#: The circle of 16 pixels around a corner, clockwise from the top, as (x, y); neighbours on it that must differ in the same way.
CIRCLE, ARC = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)], 9
HARRIS = 0.04


@lru_cache(maxsize=1)
def pattern() -> np.ndarray:
    """256 pairs of places in the patch (256 x 2 x 2), drawn once: near the centre more often than far from it."""
    r = np.random.default_rng(256)
    points = r.normal(0, PATCH / 2.5, (4096, 2))
    return points[np.hypot(*points.T) <= PATCH - 1][:512].reshape(256, 2, 2)


def shrunk(grey: np.ndarray, scale: float) -> np.ndarray:
    """A picture at 1 / ``scale``, bilinear."""
    h, w = grey.shape
    new_h, new_w = round(h / scale), round(w / scale)
    ys, xs = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((new_h, h), (new_w, w)))
    ys, xs = ys.clip(0, h - 1), xs.clip(0, w - 1)
    y0, x0 = np.minimum(ys.astype(int), max(h - 2, 0)), np.minimum(xs.astype(int), max(w - 2, 0))
    fy, fx = (ys - y0)[:, None], xs - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    rows = grey[y0] * (1 - fy) + grey[y1] * fy
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def box(values: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares of 2 * radius + 1 pixels; the border counts as repeated."""
    for axis in (0, 1):
        n = values.shape[axis]
        padded = np.pad(values, [(radius + 1, radius) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        total = np.cumsum(padded, axis)
        ends = np.take(total, np.arange(2 * radius + 1, 2 * radius + 1 + n), axis)
        values = ends - np.take(total, np.arange(n), axis)
    return values


def corners(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, response): pixels from which ARC neighbours on the circle differ in brightness, each the strongest of its 3 x 3 by Harris."""
    h, w = grey.shape
    if min(h, w) <= 2 * BORDER:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    centre = grey[3 : h - 3, 3 : w - 3]
    brighter, darker = np.zeros(centre.shape, np.uint32), np.zeros(centre.shape, np.uint32)
    for k, (dx, dy) in enumerate(CIRCLE):
        off = grey[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] - centre
        brighter |= (off > CONTRAST).astype(np.uint32) << np.uint32(k)
        darker |= (off < -CONTRAST).astype(np.uint32) << np.uint32(k)
    found = np.zeros((h, w), bool)
    for bits in (brighter, darker):
        ring = bits | bits << np.uint32(16)
        arc = ring.copy()
        for k in range(1, ARC):
            arc &= ring >> np.uint32(k)
        found[3 : h - 3, 3 : w - 3] |= (arc & np.uint32(0xFFFF)) != 0
    dy, dx = np.gradient(grey)
    xx, yy, xy = (box(v, 3) for v in (dx * dx, dy * dy, dx * dy))
    score = xx * yy - xy * xy - HARRIS * (xx + yy) ** 2
    score = np.where(found & (score > 0), score, 0)
    score[:BORDER], score[-BORDER:], score[:, :BORDER], score[:, -BORDER:] = 0, 0, 0, 0
    most = np.max([np.roll(score, (a, b), (0, 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)], 0)
    y, x = np.nonzero((score > 0) & (score == most))
    return x, y, score[y, x]


def features(rgb: np.ndarray, most: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places n x 2 in pixels of the picture, scores, angles, descriptors n x 4 of 64 bits), at most ``most`` corners, shared among the scales by their area.

    A picture without contrast, or too small for a patch, has none. The same picture always gives the same.
    """
    first = luma(rgb).astype(np.float64)
    shares = RATIO ** (-2.0 * np.arange(LEVELS))
    quota = np.floor(most * shares / shares.sum()).astype(int)
    quota[0] += most - quota.sum()
    side = np.arange(-PATCH, PATCH + 1)
    disc = [(dx, dy) for dy in side for dx in side if dx * dx + dy * dy <= PATCH * PATCH]
    ox, oy = np.array(disc).T
    out: list[list[np.ndarray]] = [[], [], [], []]
    for level in range(LEVELS):
        grey = first if level == 0 else shrunk(first, RATIO**level)
        x, y, score = corners(grey)
        order = np.lexsort((x, y, -score))[: quota[level]]
        x, y, score = x[order], y[order], score[order]
        if not len(x):
            continue
        patch = grey[y[:, None] + oy, x[:, None] + ox]
        angle = np.arctan2(patch @ oy, patch @ ox)
        smooth = box(box(grey, 2), 2) / 625
        sin, cos = np.sin(angle)[:, None, None], np.cos(angle)[:, None, None]
        px, py = pattern()[..., 0], pattern()[..., 1]
        seen = smooth[y[:, None, None] + np.rint(sin * px + cos * py).astype(int), x[:, None, None] + np.rint(cos * px - sin * py).astype(int)]
        bits = np.packbits(seen[..., 0] < seen[..., 1], axis=1, bitorder="little").view(np.int64)
        h, w = grey.shape
        places = np.stack([(x + 0.5) * first.shape[1] / w - 0.5, (y + 0.5) * first.shape[0] / h - 0.5], 1)
        for held, v in zip(out, (places, score, angle, bits), strict=True):
            held.append(v)
    empty = (np.empty((0, 2)), np.empty(0), np.empty(0), np.empty((0, 4), np.int64))
    return tuple(np.concatenate(v) if v else e for v, e in zip(out, empty, strict=True))
