"""Kernels for what is inherently sequential in a plane or a small graph; Spark deals out planes and graphs."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import offsets


def _steps(ndim: int, connectivity: int):
    axes = ("z", "y", "x")[3 - ndim :]
    return [s[3 - ndim :] for s in offsets(axes, connectivity)[1:]]


def _near(at, shape, steps):
    for s in steps:
        k = tuple(a + d for a, d in zip(at, s, strict=True))
        if all(0 <= a < n for a, n in zip(k, shape, strict=True)):
            yield k


def regional_minima(a: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """Labels 1.. of the plateaus without a lower neighbour, numbered by their first voxel; 0 elsewhere."""
    steps, out, seen, n = _steps(a.ndim, connectivity), np.zeros(a.shape, np.int64), np.zeros(a.shape, bool), 0
    for start in np.ndindex(a.shape):
        if seen[start]:
            continue
        plateau, lowest, queue = [start], True, deque([start])
        seen[start] = True
        while queue:
            for k in _near(queue.popleft(), a.shape, steps):
                if a[k] < a[start]:
                    lowest = False
                elif a[k] == a[start] and not seen[k]:
                    seen[k] = True
                    plateau.append(k)
                    queue.append(k)
        if lowest:
            n += 1
            for k in plateau:
                out[k] = n
    return out


def watershed(a: np.ndarray, seeds: np.ndarray | None = None, dams: bool = True, connectivity: int = 1, mask: np.ndarray | None = None) -> np.ndarray:
    """Floods a from its seeds, or its regional minima, level by level and first come first served within a level.

    With dams a voxel that two basins reach stays 0. Outside the mask all is 0."""
    steps = _steps(a.ndim, connectivity)
    labels = (regional_minima(a, connectivity) if seeds is None else np.asarray(seeds)).astype(np.int64).copy()
    inside = np.ones(a.shape, bool) if mask is None else mask.astype(bool)
    labels[~inside] = 0
    queue, count, dam = [], 0, np.zeros(a.shape, bool)
    waiting = labels != 0
    for at in zip(*np.nonzero(labels), strict=True):
        for k in _near(at, a.shape, steps):
            if inside[k] and not waiting[k]:
                waiting[k] = True
                heapq.heappush(queue, (a[k], count, k))
                count += 1
    while queue:
        level, _, at = heapq.heappop(queue)
        around = [k for k in _near(at, a.shape, steps) if labels[k] and not dam[k]]
        different = {int(labels[k]) for k in around}
        if len(different) > 1 and dams:
            dam[at] = True
            continue
        if around:
            labels[at] = labels[min(around, key=lambda k: (a[k], k))]
        for k in _near(at, a.shape, steps):
            if inside[k] and not waiting[k]:
                waiting[k] = True
                heapq.heappush(queue, (max(level, a[k]), count, k))
                count += 1
    return labels


def compact_watershed(a: np.ndarray, seeds: np.ndarray, compactness: float = 0.01, connectivity: int = 1) -> np.ndarray:
    """Seeded flood whose cost adds to the landscape the distance to the seed, weighted."""
    steps, labels = _steps(a.ndim, connectivity), np.asarray(seeds).astype(np.int64).copy()
    queue = [(float(a[s]), i, s, s) for i, s in enumerate(zip(*np.nonzero(labels), strict=True))]
    heapq.heapify(queue)
    done, count = np.zeros(a.shape, bool), len(queue)
    names = {s: int(labels[s]) for _, _, s, _ in queue}
    while queue:
        _, _, at, seed = heapq.heappop(queue)
        if done[at]:
            continue
        done[at], labels[at] = True, names[seed]
        for k in _near(at, a.shape, steps):
            if not done[k]:
                far = float(np.linalg.norm(np.subtract(k, seed)))
                heapq.heappush(queue, (float(a[k]) + compactness * far, count, k, seed))
                count += 1
    return labels


def reconstruct(marker: np.ndarray, mask: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """Grey reconstruction by dilation of marker under mask: values spread downhill from the highest on."""
    steps, out = _steps(mask.ndim, connectivity), np.minimum(marker, mask).copy()
    queue = [(-out[k], k) for k in np.ndindex(out.shape)]
    heapq.heapify(queue)
    while queue:
        v, at = heapq.heappop(queue)
        if -v < out[at]:
            continue
        for k in _near(at, out.shape, steps):
            new = min(-v, mask[k])
            if new > out[k]:
                out[k] = new
                heapq.heappush(queue, (-new, k))
    return out


def hminima(a: np.ndarray, depth: float, connectivity: int = 1) -> np.ndarray:
    """a with its minima shallower than depth filled in."""
    top = a.max()
    return top - reconstruct(top - a - depth, top - a, connectivity)


def impose_minima(a: np.ndarray, minima: np.ndarray, connectivity: int = 1) -> np.ndarray:
    """a changed so that the listed voxels are its only minima."""
    top = a.max()
    marker = np.where(minima, top - a, a.min() - a.max() + 0 * a)
    return top - reconstruct(np.minimum(marker, top - a), top - a, connectivity)


def nearest_label(labels: np.ndarray) -> np.ndarray:
    """Zero voxels take the nearest label by chessboard distance, of equals the least."""
    out = labels.copy()
    steps = _steps(labels.ndim, labels.ndim)
    while (out == 0).any() and out.any():
        new = out.copy()
        for at in zip(*np.nonzero(out == 0), strict=True):
            around = [out[k] for k in _near(at, out.shape, steps) if out[k]]
            if around:
                new[at] = min(around)
        out = new
    return out


def flood_fill(volume: np.ndarray, start, acceptable) -> list[tuple]:
    """The voxels that face neighbours lead to from start through acceptable labels; none if start's isn't."""
    if volume.ndim != 3:
        raise ValueError("a volume has three axes")
    fine, start = set(acceptable), tuple(start)
    if volume[start] not in fine:
        return []
    seen, queue = {start}, deque([start])
    while queue:
        for k in _near(queue.popleft(), volume.shape, _steps(3, 1)):
            if k not in seen and volume[k] in fine:
                seen.add(k)
                queue.append(k)
    return sorted(seen)


def biconnected(edges: list[tuple[int, int]]) -> list[set[int]]:
    """The node sets of a graph's biconnected components, by depth-first search without recursion."""
    near: dict[int, list[int]] = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    out, depth, low = [], {}, {}
    for root in near:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack, pile = [(root, None, iter(near[root]))], []
        while stack:
            u, parent, it = stack[-1]
            for v in it:
                if v == parent:
                    continue
                if v not in depth:
                    depth[v] = low[v] = len(stack)
                    pile.append((u, v))
                    stack.append((v, u, iter(near[v])))
                    break
                if depth[v] < depth[u]:
                    low[u] = min(low[u], depth[v])
                    pile.append((u, v))
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] >= depth[parent]:
                        part = set()
                        while True:
                            e = pile.pop()
                            part |= {*e}
                            if e == (parent, u):
                                break
                        out.append(part)
    return out


def inclusions(edges: list[tuple[int, int]], outside: int) -> dict[int, int]:
    """Node to the node that encloses it: all but the biconnected component with ``outside`` fold into what joins them to it."""
    parts = biconnected(edges)
    held: dict[int, int] = {}
    done, front = set(), [outside]
    while front:
        at = front.pop()
        for i, p in enumerate(parts):
            if i not in done and at in p:
                done.add(i)
                top = held.get(at, at)
                for n in p - {at}:
                    if outside in p:
                        front.append(n)
                    else:
                        held[n] = top
                        front.append(n)
    return {k: v for k, v in held.items() if v != outside}


def by_plane(voxels: DataFrame, kernel, value: str, out: str, kind: str = "long") -> DataFrame:
    """(idx, out): kernel(array) of each plane; a plane is one task's group, so its size bounds the memory."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        a = np.full((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1), pdf[value].max(), pdf[value].dtype)
        at = (pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0)
        a[at] = pdf[value]
        return pd.DataFrame({"z": pdf.z, "idx": pdf.idx, out: kernel(a)[at]})

    return voxels.select("z", "y", "x", "idx", value).groupBy("z").applyInPandas(run, f"z int, idx long, {out} {kind}")


def watershed_sequence(voxels: DataFrame, value: str = "cents", **options) -> DataFrame:
    """(z, idx, label): each plane flooded by itself, ids made unique by the planes' counts before."""
    from pyspark.sql import Window

    flooded = by_plane(voxels, lambda a: watershed(a, **options), value, "label")
    tops = flooded.groupBy("z").agg(F.max("label").alias("top"))
    before = Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    shift = tops.select("z", F.coalesce(F.sum("top").over(before), F.lit(0)).alias("shift"))
    return flooded.join(shift, "z").select("z", "idx", F.when(F.col("label") != 0, F.col("label") + F.col("shift")).otherwise(0).alias("label"))


def normalised_cut(w: np.ndarray, k: int, rounds: int = 10, offset: float = 0.5, seed: int = 0) -> np.ndarray:
    """Cluster of each node of a small affinity matrix: leading eigenvectors of the scaled matrix, rows of unit length, k-means."""
    a = w + offset * np.eye(len(w))
    d = 1 / np.sqrt(a.sum(1) + offset)
    _, vectors = np.linalg.eigh(d[:, None] * a * d[None, :])
    rows = vectors[:, -k:]
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    rng, best, score = np.random.default_rng(seed), np.zeros(len(w), int), np.inf
    for _ in range(rounds):
        centres = rows[rng.choice(len(rows), k, False)]
        for _ in range(50):
            far = ((rows[:, None] - centres[None]) ** 2).sum(2)
            near = far.argmin(1)
            new = np.array([rows[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        if far.min(1).sum() < score:
            best, score = near, far.min(1).sum()
    return best
