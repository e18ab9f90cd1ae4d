"""Column functions of plane geometry; none needs Python on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _turn(degrees: Column) -> Column:
    """Degrees modulo 360, in [0, 360); what lies less than a rounding step below 360 is 0, and both signs go through the same steps."""
    return (degrees % 360.0 + 360.0) % 360.0


def heading_deg(dx: Column, dy: Column) -> Column:
    """Direction of a vector in [0, 360), east 0, growing from x to y; 0 for a vector of no length."""
    still = (F.abs(dx) < 1e-6) & (F.abs(dy) < 1e-6)
    return F.when(still, F.lit(0.0)).otherwise(_turn(F.degrees(F.atan2(dy, dx)) + 360.0))


def wrap_deg(delta: Column) -> Column:
    """An angle difference in [-180, 180)."""
    return _turn(delta + 180.0) - 180.0


def angle_between(h1: Column, h2: Column) -> Column:
    """The smaller angle between two headings, in [0, 180]."""
    d = F.pmod(F.abs(h1 - h2), F.lit(360.0))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def normalised(px: Column, py: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pixel coordinates as fractions of the image."""
    return px / F.greatest(F.lit(1), width), py / F.greatest(F.lit(1), height)


def scale_to_world(px: Column, py: Column, metres_per_pixel: float, origin: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    return (px - origin[0]) * metres_per_pixel, (py - origin[1]) * metres_per_pixel


def project(px: Column, py: Column, h) -> tuple[Column, Column]:
    """A homography (3 x 3 numbers); a vanishing denominator counts as 1."""
    (a, b, c), (d, e, f), (g, i, j) = ((float(x) for x in row) for row in h)
    w = px * g + py * i + j
    w = F.when(F.abs(w) > 1e-7, w).otherwise(1.0)
    return (px * a + py * b + c) / w, (px * d + py * e + f) / w


def box_shape(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Centre, extents and area of a box, not clamped."""
    return {"cx": (x1 + x2) / 2.0, "cy": (y1 + y2) / 2.0, "width": x2 - x1, "height": y2 - y1, "area": (x2 - x1) * (y2 - y1)}


def box_to_measure(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Box as a tracker measures it: centre, aspect ratio and height, extents of one pixel at least."""
    w, h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    return {"cx": x1 + w / 2.0, "cy": y1 + h / 2.0, "aspect": w / h, "h": h}


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union has no area."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(zero, x[2] - x[0]) * F.greatest(zero, x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring (array of struct x, y), by counting crossings of a ray."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(ring, k).alias("p"), F.get(ring, F.pmod(k + 1, n)).alias("q")))

    def crossed(e: Column) -> Column:
        py, qy = e["p"]["y"], e["q"]["y"]
        at = (e["q"]["x"] - e["p"]["x"]) * (y - py) / (qy - py) + e["p"]["x"]
        return F.when((py > y) != (qy > y), x < at).otherwise(False)

    return F.when(n >= 3, F.size(F.filter(edges, crossed)) % 2 == 1).otherwise(False)


def estimate_homography(source, target, tolerance: float = 3.0) -> np.ndarray | None:
    """Fit a homography to four or more point pairs on the driver; with more, pairs that fit badly are left out.

    The fit minimises the algebraic error of all pairs, then once more of those within
    ``tolerance`` of the best fit to any four neighbouring pairs.
    """
    p, q = np.asarray(source, float), np.asarray(target, float)
    if len(p) < 4 or len(p) != len(q):
        return None

    def fit(a, b):
        rows = []
        for (x, y), (u, v) in zip(a, b):
            rows.append([x, y, 1, 0, 0, 0, -u * x, -u * y, -u])
            rows.append([0, 0, 0, x, y, 1, -v * x, -v * y, -v])
        h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h

    def errors(h):
        w = np.c_[p, np.ones(len(p))] @ h.T
        d = np.where(np.abs(w[:, 2:]) > 1e-7, w[:, 2:], 1.0)
        return np.hypot(*(w[:, :2] / d - q).T)

    best = fit(p, q)
    if len(p) > 4 and errors(best).max() > tolerance:
        rng = np.random.default_rng(0)
        tries = [fit(p[s], q[s]) for s in (rng.choice(len(p), 4, replace=False) for _ in range(200))]
        inside = max((errors(h) <= tolerance for h in tries), key=np.sum)
        if inside.sum() < 4:
            return None
        best = fit(p[inside], q[inside])
    return best if valid_homography(best) else None


def valid_homography(h) -> bool:
    h = np.asarray(h, float)
    return h.shape == (3, 3) and bool(np.isfinite(h).all()) and 1e-6 <= abs(np.linalg.det(h)) <= 1e8


def estimate_affine(source, target) -> np.ndarray | None:
    """A similarity (rotation, one scale, shift) from three or more pairs, as a 3 x 3 matrix."""
    p, q = np.asarray(source, float), np.asarray(target, float)
    if len(p) < 3:
        return None
    x, y, one, none = p[:, 0], p[:, 1], np.ones(len(p)), np.zeros(len(p))
    rows = np.r_[np.c_[x, -y, one, none], np.c_[y, x, none, one]]
    a, b, c, d = np.linalg.lstsq(rows, np.r_[q[:, 0], q[:, 1]], rcond=None)[0]
    return np.array([[a, -b, c], [b, a, d], [0, 0, 1.0]])


def world_transform(px: Column, py: Column, matrix=None, pairs=None, metres_per_pixel: float | None = None) -> tuple[Column, Column]:
    """Pixel to world by the first that is given: a matrix, four point pairs or more, a scale; else 0.05 metres a pixel."""
    if matrix is not None:
        return project(px, py, matrix)
    if pairs is not None and len(pairs[0]) >= 4 and (h := estimate_homography(*pairs)) is not None:
        return project(px, py, h)
    return scale_to_world(px, py, metres_per_pixel if metres_per_pixel and metres_per_pixel > 0 else 0.05)


def ground_sampling(altitude_m: Column, sensor_mm: float, focal_mm: float, image_px: int = 1920) -> Column:
    """Metres a pixel seen from a height, 0.01 at least."""
    return F.greatest(F.lit(0.01), altitude_m * (sensor_mm / 1000.0) / ((focal_mm / 1000.0) * image_px))
