"""Plain numpy counterparts used to check Spark results."""

import numpy as np


def haversine(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371000 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def inside(polygons, x, y):
    """Even-odd test of points against polygons of rings."""
    out = np.zeros(len(x), bool)
    for rings in polygons:
        odd = np.zeros(len(x), bool)
        for r in rings:
            for i in range(len(r)):
                (x1, y1), (x2, y2) = r[i], r[(i + 1) % len(r)]
                if y1 != y2:
                    odd ^= ((y1 <= y) != (y2 <= y)) & (x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x)
        out |= odd
    return out
