"""Pictures and matrices in numpy: what runs inside tasks, a picture or a pair at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LONG_EDGE = 1600


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey values of an RGB picture (height x width x 3), rounded to bytes."""
    return pixels if pixels.ndim == 2 else np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """Pictures of a batch whose columns after the first are width, height and RGB bytes."""
    for w, h, data in zip(*(batch.column(k).to_pylist() for k in (1, 2)), batch.column(3), strict=True):
        yield np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, 3) if data.is_valid else None


def laplacian_variance(grey: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian over the interior; 0 for a side under three pixels."""
    if min(grey.shape) < 3:
        return 0.0
    g = grey.astype(np.float64)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def target_size(width: int, height: int, long_edge: int = LONG_EDGE) -> tuple[int, int]:
    scale = long_edge / max(width, height, 1)
    return (width, height) if scale >= 1 else (max(1, round(width * scale)), max(1, round(height * scale)))


def _shares(n: int, m: int) -> np.ndarray:
    """How much of each of n source cells falls in each of m equal target cells (m x n, rows sum to 1)."""
    edge = np.arange(m + 1) * n / m
    cell = np.arange(n)
    over = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
    return np.maximum(over, 0) * m / n


def downsample(pixels: np.ndarray, long_edge: int = LONG_EDGE) -> np.ndarray:
    """The area-weighted mean at ``long_edge`` pixels on the longer side; a smaller picture is left alone."""
    h, w = pixels.shape[:2]
    new_w, new_h = target_size(w, h, long_edge)
    if (new_w, new_h) == (w, h):
        return pixels
    rows = np.tensordot(_shares(h, new_h), pixels.astype(np.float64), 1)
    out = np.moveaxis(np.tensordot(_shares(w, new_w), rows, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def feather_weights(width: int, height: int) -> np.ndarray:
    cx, cy = (width - 1) / 2, (height - 1) / 2
    x, y = np.abs(np.arange(width) - cx), np.abs(np.arange(height) - cy)
    room = np.minimum((cx - x)[None, :], (cy - y)[:, None])
    return np.minimum(1, np.maximum(0, room) / max(1, min(cx, cy)))


def apply(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points (n x 2) through a 3 x 3 matrix, with the perspective divide."""
    p = np.c_[points, np.ones(len(points))] @ m.T
    return p[:, :2] / p[:, 2:]


def framed(pixels: np.ndarray) -> np.ndarray:
    """A picture as single-precision numbers with a border of zeros, as ``warp_framed`` reads it."""
    return np.pad(np.atleast_3d(pixels).astype(np.float32), ((1, 1), (1, 1), (0, 0)))


def warp(pixels: np.ndarray, to_source: np.ndarray, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """The window (x0, y0, width, height) of the picture seen through ``to_source``, bilinear, 0 outside."""
    return warp_framed(framed(pixels), to_source, x0, y0, width, height)


def warp_framed(src: np.ndarray, to_source: np.ndarray, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """``warp`` of a picture that ``framed`` made ready, for several windows of one picture."""
    ys, xs = np.mgrid[y0 : y0 + height, x0 : x0 + width]
    p = apply(to_source, np.c_[xs.ravel(), ys.ravel()].astype(np.float64))
    p = np.where(np.isfinite(p).all(1)[:, None], p, -9)
    h, w = src.shape[:2]
    p = np.clip(p + 1, -1, [w + 1, h + 1])
    a = np.floor(p).astype(int)
    f = p - a
    out = np.zeros((len(p), src.shape[2]))
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        x, y = a[:, 0] + dx, a[:, 1] + dy
        seen = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        weight = (f[:, 0] if dx else 1 - f[:, 0]) * (f[:, 1] if dy else 1 - f[:, 1]) * seen
        out += weight[:, None] * src[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
    return out.reshape(height, width, -1)


def clip_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas that convex quadrilaterals a and b (n x 4 x 2, counter-clockwise) have in common, for all pairs at once.

    By Green's theorem: each side is cut to its part inside the other quadrilateral, from lo to hi along it, and these parts enclose the
    common area. A side that lies on one of the other's in the same direction counts once, for a; in the opposite direction not at all.
    """
    out = np.zeros(len(a))
    for first, ours, theirs in ((True, a, b), (False, b, a)):
        d, e = np.roll(ours, -1, 1) - ours, np.roll(theirs, -1, 1) - theirs
        off = ours[:, :, None] - theirs[:, None]  # n x our corners x their corners x 2
        left = e[:, None, :, 0] * off[..., 1] - e[:, None, :, 1] * off[..., 0]
        turn = e[:, None, :, 0] * d[:, :, None, 1] - e[:, None, :, 1] * d[:, :, None, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = -left / turn
        along = first & ((d[:, :, None] * e[:, None]).sum(3) > 0)
        outside = (turn == 0) & ((left < 0) | (left == 0) & ~along)
        lo = np.where(turn > 0, at, np.where(outside, 2, 0)).max(2).clip(0)
        hi = np.where(turn < 0, at, 1).min(2).clip(None, 1)
        out += (np.where(hi > lo, hi - lo, 0) * (ours[..., 0] * d[..., 1] - ours[..., 1] * d[..., 0])).sum(1) / 2
    return np.abs(out)


def quad_area(q: np.ndarray) -> np.ndarray:
    r = np.roll(q, -1, 1)
    return np.abs((q[..., 0] * r[..., 1] - r[..., 0] * q[..., 1]).sum(1)) / 2


# Fixed values of the homography estimate: matches needed, pixels an inlier may be off, inliers and their share needed.
MIN_MATCHES, INLIER_PX, MIN_INLIERS, MIN_RATIO = 8, 3.0, 8, 0.3


def fit_homographies(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of k sets of n point pairs (k x n x 2) the least squares matrix by the normalised direct linear transform, and whether it is one."""

    def centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(1)
        s = np.sqrt(2) / np.maximum(np.linalg.norm(p - c[:, None], axis=2).mean(1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2], t[:, 2, 2] = -s[:, None] * c, 1
        return (p - c[:, None]) * s[:, None, None], t

    (a, ta), (b, tb) = centred(src), centred(dst)
    k, n = a.shape[:2]
    one, z = np.concatenate([a, np.ones((k, n, 1))], 2), np.zeros((k, n, 3))
    system = np.concatenate([np.concatenate([one, z, -b[..., :1] * one], 2), np.concatenate([z, one, -b[..., 1:] * one], 2)], 1)
    h = np.linalg.inv(tb) @ np.linalg.svd(system, full_matrices=2 * n < 9)[2][:, -1].reshape(k, 3, 3) @ ta
    good = (np.abs(h[:, 2, 2]) > 1e-12) & np.isfinite(h).all((1, 2))
    return h / np.where(good, h[:, 2, 2], 1)[:, None, None], good


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    h, good = fit_homographies(src[None], dst[None])
    return h[0] if good[0] else None


#: Samples of a homography that are solved and tested at once; the chance that is left for a better one when sampling ends.
AT_ONCE, MISSED = 64, 1e-6


def ransac_homography(src: np.ndarray, dst: np.ndarray, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, int] | None:
    """(matrix, inliers) from point pairs, or None where too few agree. The same pairs always give the same answer.

    Samples of four pairs are drawn and solved many at once. They end early once so many pairs agree that another sample of four of those would have been met
    but for a chance of MISSED.
    """
    if len(src) < MIN_MATCHES:
        return None
    rng, best, most, done = np.random.default_rng(seed), None, 0, 0
    lifted = np.c_[src, np.ones(len(src))]
    with np.errstate(all="ignore"):
        while done < rounds:
            k = min(AT_ONCE, rounds - done)
            pick = rng.random((k, len(src))).argpartition(4, 1)[:, :4]
            h, fine = fit_homographies(src[pick], dst[pick])
            p = lifted @ h.transpose(0, 2, 1)
            good = fine[:, None] & (np.linalg.norm(p[..., :2] / p[..., 2:] - dst, axis=2) <= INLIER_PX)
            count = good.sum(1)
            done += k
            if count.max() > most:
                best, most = good[count.argmax()], int(count.max())
            if (1 - (most / len(src)) ** 4) ** done <= MISSED:
                break
        if best is None or most < 4:
            return None
        h = fit_homography(src[best], dst[best])
        inliers = int((np.linalg.norm(apply(h, src) - dst, axis=1) <= INLIER_PX).sum()) if h is not None else 0
    return (h, inliers) if inliers >= MIN_INLIERS and inliers >= MIN_RATIO * len(src) else None


# Fixed values of the alignment: trust in position (m), heading (radians) and a matched point (m); steps at most.
POSITION_SIGMA, HEADING_SIGMA, VISUAL_SIGMA, STEPS, HUBER = 3.0, np.radians(5.0), 2.0, 12, 1.345
#: Up to so many pictures the system is solved as one matrix (9 numbers for each pair of pictures).
DENSE = 160


def similarity_matrix(tx: float, ty: float, theta: float, scale: float, cx: float, cy: float) -> np.ndarray:
    s, c = scale * np.sin(theta), scale * np.cos(theta)
    return np.array([[c, -s, tx - cx * c + cy * s], [-s, -c, ty + cx * s + cy * c], [0, 0, 1]])


def align(start: np.ndarray, scale: np.ndarray, centre: np.ndarray, edges: list[tuple[int, int, np.ndarray, float, float]]) -> np.ndarray:
    """``aligned`` with edges one by one: (i, j, h, width, height)."""
    m = len(edges)
    i, j = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    h = np.array([e[2] for e in edges], float).reshape(m, 3, 3)
    return aligned(start, scale, centre, i, j, h, np.array([e[3:5] for e in edges], float).reshape(m, 2))


def aligned(start: np.ndarray, scale: np.ndarray, centre: np.ndarray, i: np.ndarray, j: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions and headings (n x 3: east, north, theta) that agree with their start and with matched points.

    An edge (of m: i, j, h (m x 3 x 3), size (m x 2: width, height)) says that picture i's corners and middle lie at h of them in picture j; what both place on the
    ground should coincide. Levenberg-Marquardt with Huber weights on the edges, STEPS at most; the best state so far is kept. The normal
    equations are kept as 3 x 3 blocks, one for each picture and each edge. Up to DENSE pictures they are solved as one matrix; beyond by conjugate
    gradients, so memory grows with pictures and edges, not with their square.
    """
    n, m = len(start), len(i)
    prior = 1 / np.array([POSITION_SIGMA, POSITION_SIGMA, HEADING_SIGMA])
    p = size[:, None] * np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    q = np.concatenate([p, np.ones((m, 5, 1))], 2) @ h.transpose(0, 2, 1)
    q = q[..., :2] / q[..., 2:]

    def ground(x: np.ndarray, k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of pictures k in metres, and how they turn with the heading."""
        r = (at - centre[k][:, None]) * scale[k][:, None, None]
        s, c = np.sin(x[k, 2])[:, None], np.cos(x[k, 2])[:, None]
        turned = np.stack([c * r[..., 0] - s * r[..., 1], -s * r[..., 0] - c * r[..., 1]], 2)
        return turned + x[k, None, :2], np.stack([turned[..., 1], -turned[..., 0]], 2)

    def add(into: np.ndarray, k: np.ndarray, values: np.ndarray) -> None:
        flat, per = into.reshape(n, -1), values.reshape(len(k), -1)
        for c in range(per.shape[1]):
            flat[:, c] += np.bincount(k, per[:, c], n)

    def state(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Cost, gradient (n x 3), blocks of pictures (n x 3 x 3) and of edges (m x 3 x 3)."""
        r = x - start
        r[:, 2] = np.mod(r[:, 2] + np.pi, 2 * np.pi) - np.pi
        r *= prior
        grad, own = r * prior, np.tile(np.diag(prior**2), (n, 1, 1))
        if not m:
            return (r**2).sum() / 2, grad, own, np.empty((0, 3, 3))
        (a, da), (b, db) = ground(x, i, p), ground(x, j, q)
        d = ((a - b) / VISUAL_SIGMA).reshape(m, 10)
        far = np.linalg.norm(d, axis=1)
        near = far <= HUBER
        weight = np.where(near, 1.0, HUBER / np.where(near, 1, far))[:, None, None]
        cost = (r**2).sum() / 2 + np.where(near, far**2 / 2, HUBER * (far - HUBER / 2)).sum()
        ji, jj = np.zeros((m, 5, 2, 3)), np.zeros((m, 5, 2, 3))
        ji[:, :, 0, 0] = ji[:, :, 1, 1] = 1
        jj[:, :, 0, 0] = jj[:, :, 1, 1] = -1
        ji[..., 2], jj[..., 2] = da, -db
        ji, jj = ji.reshape(m, 10, 3) / VISUAL_SIGMA, jj.reshape(m, 10, 3) / VISUAL_SIGMA
        turned = [(x.transpose(0, 2, 1) * weight) for x in (ji, jj)]
        for k, t, mine in ((i, turned[0], ji), (j, turned[1], jj)):
            add(grad, k, (t @ d[:, :, None])[..., 0])
            add(own, k, t @ mine)
        return cost, grad, own, turned[0] @ jj

    def solve(grad: np.ndarray, own: np.ndarray, cross: np.ndarray) -> np.ndarray:
        """The step that the blocks ask for; conjugate gradients go with the pictures' own blocks inverted before."""
        if n <= DENSE:
            whole = np.zeros((n, n, 3, 3))
            np.add.at(whole, (i, j), cross)
            whole += whole.transpose(1, 0, 3, 2)
            whole[range(n), range(n)] += own
            return np.linalg.solve(whole.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n), -grad.reshape(-1)).reshape(n, 3)
        inverse = np.linalg.inv(own)

        def product(v: np.ndarray) -> np.ndarray:
            out = (own @ v[:, :, None])[..., 0]
            if m:
                add(out, i, (cross @ v[j][:, :, None])[..., 0])
                add(out, j, (v[i][:, None, :] @ cross)[:, 0])
            return out

        x, r = np.zeros((n, 3)), -grad
        z = (inverse @ r[:, :, None])[..., 0]
        v, rz = z, (r * z).sum()
        enough = 1e-20 * max(rz, 1e-300)
        for _ in range(min(30 * n, 3000)):
            if rz <= enough:
                break
            av = product(v)
            step = rz / (v * av).sum()
            x, r = x + step * v, r - step * av
            z = (inverse @ r[:, :, None])[..., 0]
            last, rz = rz, (r * z).sum()
            v = z + rz / last * v
        return x

    x, damping = start.astype(float).copy(), 1e-4
    cost, grad, own, cross = state(x)
    for _ in range(STEPS):
        for _ in range(8):
            damped = own.copy()
            damped[:, range(3), range(3)] *= 1 + damping
            step = solve(grad, damped, cross)
            new = state(x + step)
            if new[0] <= cost:
                break
            damping *= 10
        else:
            break
        gain, x = (cost - new[0]) / max(cost, 1e-12), x + step
        cost, grad, own, cross = new
        damping = max(damping / 10, 1e-9)
        if cost <= 1e-9 or gain < 1e-4:
            break
    return x
