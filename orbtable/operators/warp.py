"""The adaptive warp of one small mesh inside a task: the same rounds as `iterate.adaptive_warp`, on arrays.

A round there is a handful of jobs, which cost seconds each however little they move; a mesh whose points and faces are
few has all its rounds done here by one task. Larger ones go through the joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from orbtable.operators.spatial import DET_MIN, INSIDE_TOL

#: Grid points times faces of a mesh that one task warps; all are tried against all, CHUNK at a time.
SMALL = 1 << 22
CHUNK = 1 << 18


def unit(p: np.ndarray) -> np.ndarray:
    n = np.sqrt((p * p).sum(1, keepdims=True))
    return p / np.where(n > 0, n, 1.0)


def vertex_density(faces: np.ndarray, p: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """(valence + 1) / (share of incident area) as in `faces.vertex_density`; NaN where no vertex has any."""
    faces = faces[alive[faces].all(1)]
    a, b, c = (p[faces[:, k]] for k in range(3))
    area = 0.5 * np.sqrt((np.cross(b - a, c - a) ** 2).sum(1))
    around = np.bincount(faces.ravel(), np.repeat(area, 3), len(p))
    valence = np.bincount(faces.ravel(), minlength=len(p))
    d = np.full(len(p), np.nan)
    has = around > 0
    d[has] = (valence[has] + 1) / (around[has] / area.sum())
    d[~has] = d[has].min() if has.any() else np.nan
    return d


def located(faces: np.ndarray, chart: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (m, 3) and weights (m, 3) of the face that `spatial.locate` picks for each unit direction; faces in the order of f."""
    a, b, c = (chart[faces[:, k]] for k in range(3))
    normals = np.stack([np.cross(b, c), np.cross(c, a), np.cross(a, b)])
    det = (a * normals[0]).sum(1)
    usable = np.abs(det) >= DET_MIN
    normals = normals / np.where(usable, det, np.nan)[None, :, None]
    corners, weights = np.zeros((len(asked), 3), int), np.zeros((len(asked), 3))
    step = max(1, CHUNK // max(1, len(faces)))
    for s in range(0, len(asked), step):
        p = asked[s:s + step]
        w = np.stack([p @ n.T for n in normals])
        hit = (w >= INSIDE_TOL).all(0)
        pick = hit.argmax(1)
        for k in np.flatnonzero(hit.sum(1) != 1):
            pick[k] = preferred(faces, chart, p[k], np.flatnonzero(hit[k]))
        out = w[:, np.arange(len(p)), pick].T
        corners[s:s + step], weights[s:s + step] = faces[pick], out / out.sum(1, keepdims=True)
        for k in np.flatnonzero(~hit.any(1)):  # nowhere: the nearest vertex alone counts
            weights[s + k] = faces[pick[k]] == nearest(chart, p[k])
    return corners, weights


def nearest(chart: np.ndarray, p: np.ndarray) -> int:
    return int(np.argmin(((chart - p) ** 2).sum(1)))


def preferred(faces: np.ndarray, chart: np.ndarray, p: np.ndarray, hits: np.ndarray) -> int:
    """Of the faces that hold p one of the nearest vertex, else one of its neighbours, else any; without any the vertex's first face."""
    own = (faces == nearest(chart, p)).any(1)
    if not len(hits):
        return int(own.argmax())
    ring = np.isin(faces, faces[own]).any(1)
    tier = np.where(own[hits], 0, np.where(ring[hits], 1, 2))
    return int(hits[np.lexsort((hits, tier))[0]])


def warp_arrays(faces: np.ndarray, chart: np.ndarray, density: np.ndarray, grid: np.ndarray, points: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Points after the rounds, and which of them are still there (a point without an edge has no mean)."""
    chart, p, alive = unit(chart), points, np.ones(len(points), bool)
    u, w = grid[:, [0, 1, 2]].ravel(), grid[:, [1, 2, 0]].ravel()
    for _ in range(rounds):
        corners, weights = located(faces, chart, unit(p))
        r = (weights * density[corners]).sum(1) / vertex_density(grid, p, alive)
        met = alive[w]
        total = np.bincount(u[met], r[w[met]], len(p))
        alive = np.bincount(u[met], minlength=len(p)) > 0
        mean = np.stack([np.bincount(u[met], r[w[met]] * p[w[met], k], len(p)) for k in range(3)], 1)
        p = np.where(alive[:, None], unit(mean / np.where(alive, total, 1.0)[:, None]), 0.0)
    return p, alive


PARTS = "mesh_id string, part int, i bigint, a bigint, b bigint, c bigint, x double, y double, z double, d double"


def warp_mesh(rows: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """(mesh_id, v, x, y, z) of one mesh from rows of PARTS: 0 chart vertices with density, 1 faces, 2 grid faces, 3 grid points."""
    vert, face, grid, point = (rows[rows["part"] == k].sort_values("i") for k in range(4))

    def corners(table: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
        t = table[["a", "b", "c"]].to_numpy(np.int64)
        t = t[np.isin(t, ids).all(1)]
        return np.searchsorted(ids, t)

    vid, pid = vert["i"].to_numpy(), point["i"].to_numpy()
    xyz = lambda t: t[["x", "y", "z"]].to_numpy(float)
    p, alive = warp_arrays(corners(face, vid), xyz(vert), vert["d"].to_numpy(float), corners(grid, pid), xyz(point), rounds)
    return pd.DataFrame({"mesh_id": rows["mesh_id"].iloc[0], "v": pid[alive], **{k: p[alive, j] for j, k in enumerate("xyz")}})
