"""Centroids in memory and a graph over them that finds the near ones of a vector."""

from __future__ import annotations

import math

import numpy as np

SLAB = 1 << 16  #: distances worked out at a time


class CentroidGraph:
    """Centroids linked to their nearest ones and to a few far ones; searches start at a sample of entry points.

    Built from at most ``centroid_bytes`` of centroids (see posting_search), so its size doesn't follow the table's."""

    def __init__(self, points: np.ndarray, degree: int = 16, back: int = 12, far_links: int = 4):
        self.points = np.ascontiguousarray(points, np.float32)
        k = len(points)
        self.entry = np.unique(np.linspace(0, k - 1, min(k, 2 * int(np.ceil(np.sqrt(k))))).astype(np.int64))
        near = min(degree, k - 1)
        links = np.random.Generator(np.random.PCG64(k)).integers(0, k, (k, near + back + far_links)).astype(np.int32)
        self.links = links
        if not near:
            return
        norms = (self.points.astype(np.float64) ** 2).sum(axis=1)
        far = np.empty((k, near))
        for at in range(0, k, 1024):
            some = slice(at, min(k, at + 1024))
            gap = norms[some, None] + norms[None, :] - 2.0 * (self.points[some] @ self.points.T)
            gap[np.arange(gap.shape[0]), np.arange(some.start, some.stop)] = np.inf
            links[some, :near] = np.argpartition(gap, near - 1, axis=1)[:, :near]
            far[some] = np.take_along_axis(gap, links[some, :near].astype(np.int64), axis=1)
        # back links: a centroid that is near to many others is found from them, and they from it
        to, of = links[:, :near].reshape(-1), np.repeat(np.arange(k), near)
        order = np.lexsort((of, far.reshape(-1), to))
        to, of = to[order], of[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        few = place < back
        links[to[few], near + place[few]] = of[few]

    def __len__(self) -> int:
        return len(self.points)

    def distance(self, rows: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.float32)
        for at in range(0, len(row), SLAB):
            gap = rows[row[at : at + SLAB]] - self.points[node[at : at + SLAB]]
            out[at : at + SLAB] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return out

    def _entries(self, rows: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(rows)), len(self.entry))
        return self.distance(rows, row, np.tile(self.entry, len(rows))).reshape(len(rows), -1)

    def beam(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, distance) of about the ``width`` nearest centroids of every row, nearest first (ties: smaller number);
        -1 and inf where there are fewer.  Best-first search: every step follows the links of the nearest centroid of each
        row that it has not followed yet."""
        n, k = len(rows), len(self)
        seen = np.zeros((n, k), bool)
        far = self._entries(rows)
        seen[:, self.entry] = True
        start = min(width, len(self.entry))
        order = np.argsort(far, axis=1, kind="stable")[:, :start]
        node = np.full((n, width), -1, np.int64)
        dist = np.full((n, width), np.inf, np.float32)
        node[:, :start], dist[:, :start] = self.entry[order], np.take_along_axis(far, order, axis=1)
        followed = node < 0
        while True:
            row = np.flatnonzero(~followed.all(axis=1))
            if not len(row):
                return node, dist
            slot = np.argmin(followed[row], axis=1)  # beams are sorted: the first one not followed is the nearest
            followed[row, slot] = True
            r = np.repeat(row, self.links.shape[1])
            c = self.links[node[row, slot]].reshape(-1).astype(np.int64)
            new = np.unique((r * k + c)[~seen[r, c]])
            r, c = np.divmod(new, k)
            if not len(r):
                continue
            seen[r, c] = True
            d = self.distance(rows, r, c)
            better = d < dist[r, -1]
            r, c, d = r[better], c[better], d[better]
            if not len(r):
                continue
            touched, first, count = np.unique(r, return_index=True, return_counts=True)
            most = int(count.max())
            place = np.arange(len(r)) - np.repeat(first, count)
            more_c = np.full((len(touched), most), -1, np.int64)
            more_d = np.full((len(touched), most), np.inf, np.float32)
            which = np.repeat(np.arange(len(touched)), count)
            more_c[which, place], more_d[which, place] = c, d
            all_c, all_d = np.hstack((node[touched], more_c)), np.hstack((dist[touched], more_d))
            all_f = np.hstack((followed[touched], more_c < 0))
            order = np.lexsort((all_c, all_d), axis=1)[:, :width]
            node[touched], dist[touched] = np.take_along_axis(all_c, order, axis=1), np.take_along_axis(all_d, order, axis=1)
            followed[touched] = np.take_along_axis(all_f, order, axis=1)

    def within(self, rows: np.ndarray, ratio: float, at_least: int = 4, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of the ``at_least`` nearest centroids found, and of all found within ``ratio`` times the distance
        of the nearest one (inf: all): starting from the beam, links are followed while they lead to centroids in that range."""
        n, k = len(rows), len(self)
        if math.isinf(ratio):
            return tuple(x.reshape(-1) for x in np.indices((n, k)))
        node, dist = self.beam(rows, max(width, at_least))
        reach = np.maximum(dist[:, 0] * np.float32(ratio), dist[:, at_least - 1])
        seen = np.zeros((n, k), bool)
        there = node >= 0
        row, c, d = np.nonzero(there)[0], node[there], dist[there]
        seen[row, c] = True
        found = []
        while len(row):
            inside = d <= reach[row]
            found.append((row[inside], c[inside], d[inside]))
            r = np.repeat(row[inside], self.links.shape[1])
            c = self.links[c[inside]].reshape(-1).astype(np.int64)
            row, c = np.divmod(np.unique((r * k + c)[~seen[r, c]]), k)
            seen[row, c] = True
            d = self.distance(rows, row, c)
        row, c, d = (np.concatenate(x) for x in zip(*found))
        best = np.full(n, np.inf, np.float32)
        np.minimum.at(best, row, d)  # a nearer one than the beam's may have turned up on the way
        keep = d <= np.maximum(best * np.float32(ratio), dist[:, at_least - 1])[row]
        return row[keep], c[keep]

    def closure(self, rows: np.ndarray, ratio: float, most: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of the lists that hold each row: the nearest one, and for rows near a boundary others within
        ``ratio``, unless a list that was taken already is nearer to that list than the row is."""
        node, dist = self.beam(rows, width)
        corner = self.points[np.maximum(node, 0)]
        taken = np.zeros(node.shape, bool)
        taken[:, 0] = True
        for j in range(1, node.shape[1]):
            open_ = (node[:, j] >= 0) & (dist[:, j] <= dist[:, 0] * np.float32(ratio)) & (taken.sum(axis=1) < most)
            if not open_.any():
                break
            gap = corner[:, :j] - corner[:, j, None]
            between = np.sqrt(np.einsum("nij,nij->ni", gap, gap))
            open_ &= ~(taken[:, :j] & (between <= dist[:, j, None])).any(axis=1)
            taken[:, j] = open_
        row, slot = np.nonzero(taken)
        return row, node[row, slot]
