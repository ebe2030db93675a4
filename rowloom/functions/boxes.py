"""Boxes as tuples or arrays (x1, y1, x2, y2, score): overlap and suppression."""

from __future__ import annotations

import numpy as np


def iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return float(both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both))


def _groups(boxes: np.ndarray, overlap: float) -> list[np.ndarray]:
    """Indices in groups: the best box left, then those it overlaps; sides count one pixel more than their difference."""
    left = np.argsort(-boxes[:, 4], kind="stable")
    area = (boxes[:, 2] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 1] + 1)
    out = []
    while len(left):
        best, rest = left[0], left[1:]
        w = np.minimum(boxes[best, 2], boxes[rest, 2]) - np.maximum(boxes[best, 0], boxes[rest, 0]) + 1
        h = np.minimum(boxes[best, 3], boxes[rest, 3]) - np.maximum(boxes[best, 1], boxes[rest, 1]) + 1
        hit = (w > 0) & (h > 0) & (w * h / area[rest] > overlap)
        out.append(np.concatenate(([best], rest[hit])))
        left = rest[~hit]
    return out


def best_nms(boxes: list, overlap: float) -> np.ndarray:
    """The best box of each group of overlapping ones."""
    b = np.asarray(boxes, float).reshape(-1, 5)
    return b[[g[0] for g in _groups(b, overlap)]] if len(b) else b


def average_nms(boxes: list, overlap: float) -> np.ndarray:
    """Each group's mean box, weighted by score, with the best score."""
    b = np.asarray(boxes, float).reshape(-1, 5)
    out = []
    for g in _groups(b, overlap) if len(b) else []:
        weight = b[g, 4]
        mean = (b[g, :4] * weight[:, None]).sum(axis=0) / weight.sum() if weight.sum() else b[g[0], :4]
        out.append([*mean, b[g[0], 4]])
    return np.array(out).reshape(-1, 5)


def smooth(boxes: list, before: list, after: list, least_overlap: float = 0.5) -> np.ndarray:
    """Boxes averaged, by position, with the boxes of the frames before and after that overlap them most."""
    out = []
    for box in np.asarray(boxes, float).reshape(-1, 5):
        near = [box]
        for others in (before, after):
            candidates = [o for o in np.asarray(others, float).reshape(-1, 5) if iou(box, o) >= least_overlap]
            if candidates:
                near.append(max(candidates, key=lambda o: iou(box, o)))
        out.append([*np.mean([n[:4] for n in near], axis=0), box[4]])
    return np.array(out).reshape(-1, 5)
