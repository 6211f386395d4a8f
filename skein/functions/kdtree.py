"""A small space-partitioning tree over a bounded sample, for routing rows to cells."""

from __future__ import annotations

import numpy as np


def build_tree(sample: np.ndarray, n_cells: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, left, right); a leaf has axis -1 and its cell number in ``left``.

    The largest part is always cut next, at the middle of its widest axis.
    """
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    parts = {0: sample}
    cells = 1
    while cells < n_cells:
        for node in sorted(parts, key=lambda i: -len(parts[i])):
            part = parts[node]
            if len(part) < 2:
                continue
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            values = np.sort(part[:, axis])
            cut = float(values[len(values) // 2])
            below = part[:, axis] < cut
            if not below.any():
                higher = values[values > cut]
                if not len(higher):
                    continue
                cut = float(higher[0])
                below = part[:, axis] < cut
            left, right = len(nodes), len(nodes) + 1
            nodes += [(-1, 0.0, nodes[node][2], 0), (-1, 0.0, cells, 0)]
            nodes[node] = (axis, cut, left, right)
            del parts[node]
            parts[left], parts[right] = part[below], part[~below]
            cells += 1
            break
        else:
            break
    return nodes


def find_cells(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """Cell number of every point."""
    axis = np.array([n[0] for n in nodes])
    cut = np.array([n[1] for n in nodes])
    left = np.array([n[2] for n in nodes])
    right = np.array([n[3] for n in nodes])
    at = np.zeros(len(points), dtype=np.int64)
    while True:
        inner = np.flatnonzero(axis[at] >= 0)
        if not len(inner):
            return left[at]
        here = at[inner]
        below = points[inner, axis[here]] < cut[here]
        at[inner] = np.where(below, left[here], right[here])


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points x boxes) distance from each point to the nearest spot of each box."""
    total = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j, None]
        gap = np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0)
        total += gap * gap
    return np.sqrt(total)


def space_order(unit: np.ndarray, bits: int = 60) -> np.ndarray:
    """Place of points along a space-filling order: the leading bits of all coordinates in turn.

    Coordinates count in units of the widest axis, 0 .. 1; what lies outside goes to the border.
    """
    dims = max(1, unit.shape[1])
    each = max(1, min(16, bits // dims))
    codes = np.clip(np.floor(unit * (1 << each)), 0, (1 << each) - 1).astype(np.int64)
    out = np.zeros(len(unit), np.int64)
    for bit in range(each - 1, -1, -1):
        for j in range(min(dims, bits)):
            out = (out << 1) | (codes[:, j] >> bit & 1)
    return out
