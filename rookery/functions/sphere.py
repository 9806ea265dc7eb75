"""Great-circle geometry on numpy arrays, and a vantage-point tree over it."""

from __future__ import annotations

import numpy as np

RADIUS_M = 6_371_008.8


def distance(lat_a, lon_a, lat_b, lon_b, radius: float = RADIUS_M):
    """Great-circle metres between points in degrees (haversine form, exact for near points)."""
    a, b = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon_b, lon_a)) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def unit_vectors(lat, lon) -> np.ndarray:
    la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def nearest_and_reach(lat, lon, p_lat, p_lon, slack_m: float, block: int = 4096):
    """Nearest pivot of each point, and (point, pivot) pairs of other pivots within that distance plus ``slack_m``.

    A point within ``slack_m / 2`` of a point q lies at most ``slack_m`` farther from q's nearest
    pivot than from its own, by the triangle inequality; so these pivots' cells are all that can
    hold a neighbour. Distances come from products of unit vectors, which are right to a metre.
    """
    points, pivots_ = unit_vectors(lat, lon), unit_vectors(p_lat, p_lon).T
    homes, points_, reached = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)]
    for at in range(0, len(points), block):
        dot = points[at : at + block] @ pivots_
        home = dot.argmax(axis=1)
        rows = np.arange(len(dot))
        least = np.arccos(np.clip(dot[rows, home], -1, 1))
        near = dot >= np.cos(np.minimum(least + (slack_m + 2.0) / RADIUS_M, np.pi))[:, None]
        near[rows, home] = False
        i, j = np.nonzero(near)
        homes.append(home)
        points_.append(i + at)
        reached.append(j)
    return np.concatenate(homes), np.concatenate(points_), np.concatenate(reached)


class VantageTree:
    """Vantage-point tree; each node splits its points at the median distance to one of them."""

    def __init__(self, lat, lon, leaf: int = 24):
        self.lat, self.lon = np.asarray(lat, float), np.asarray(lon, float)
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(self.lat)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = at
            if len(rows) <= leaf:
                self.nodes.append([rows])
                continue
            # the point farthest from an arbitrary one sees the rest in rings
            seed = rows[0]
            far = rows[distance(self.lat[seed], self.lon[seed], self.lat[rows], self.lon[rows]).argmax()]
            d = distance(self.lat[far], self.lon[far], self.lat[rows], self.lon[rows])
            order = d.argsort(kind="stable")
            half = len(rows) // 2
            low, high = d[order[half - 1]], d[order[half]]
            self.nodes.append([far, low, high, -1, -1])
            todo.append((rows[order[:half]], at, 3))
            todo.append((rows[order[half:]], at, 4))

    def within(self, lat, lon, radius_m: float, most: int = 1_000_000):
        """Yields (query, point) index arrays of pairs at most ``radius_m`` apart, about ``most`` or fewer at a time."""
        lat, lon = np.asarray(lat, float), np.asarray(lon, float)
        todo = [(0, np.arange(len(lat)))] if len(self.lat) and len(lat) else []
        slack = radius_m + 1e-3
        held, n = [], 0
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                rows = node[0]
                step = max(1, most // len(rows))
                for start in range(0, len(q), step):
                    part = q[start : start + step]
                    d = distance(lat[part, None], lon[part, None], self.lat[None, rows], self.lon[None, rows])
                    i, j = np.nonzero(d <= radius_m)
                    if n + len(i) > most and held:
                        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                        held, n = [], 0
                    held.append((part[i], rows[j]))
                    n += len(i)
                continue
            far, low, high, inner, outer = node
            d = distance(self.lat[far], self.lon[far], lat[q], lon[q])
            if len(a := q[d <= low + slack]):
                todo.append((inner, a))
            if len(b := q[d >= high - slack]):
                todo.append((outer, b))
        if held:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
