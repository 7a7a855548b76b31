import struct

import numpy as np
import pytest

from orbtable.sources import ranges
from orbtable.sources.ranges import mesh_records

N = 5000


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(1)
    return rng.random((N, 3), dtype=np.float32), rng.integers(0, N, (2 * N, 3), dtype=np.uint32)


def _ply(xyz, polygons, e="<", index="int"):
    fmt = "binary_little_endian" if e == "<" else "binary_big_endian"
    head = f"ply\nformat {fmt} 1.0\nelement vertex {len(xyz)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(polygons)}\nproperty uchar flag\nproperty list uchar {index} vertex_indices\nend_header\n"
    return head.encode() + np.asarray(xyz, e + "f4").tobytes() + b"".join(struct.pack(f"{e}BB{len(p)}i", 7, len(p), *map(int, p)) for p in polygons)


def _tables(df):
    v = sorted((r["v"], r["x"], r["y"], r["z"]) for r in df.where("v IS NOT NULL").collect())
    f = sorted((r["f"], r["a"], r["b"], r["c"]) for r in df.where("f IS NOT NULL").collect())
    return v, f


def test_ranges_of_one_file_make_the_whole(spark, tmp_path, arrays):
    """Files cut every 1,000 bytes, far from record borders, give the rows of numpy, each once."""
    xyz, tri = arrays
    (tmp_path / "a.mesh").write_bytes(b"SHM1" + struct.pack("<II", N, 2 * N) + xyz.tobytes() + tri.tobytes())
    (tmp_path / "b.PLY").write_bytes(_ply(xyz, tri, ">"))
    quads = np.concatenate([tri, tri[:, :1]], axis=1)
    (tmp_path / "q.ply").write_bytes(_ply(xyz, quads))
    facets = np.zeros(N, np.dtype([("n", "<f4", (3,)), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    facets["v"] = xyz[tri[:N]]
    (tmp_path / "c.stl").write_bytes(b"solid".ljust(80) + struct.pack("<I", N) + facets.tobytes())
    rows = mesh_records(spark, str(tmp_path), step=1000).cache()
    assert rows.rdd.getNumPartitions() > 600
    assert rows.where("reason IS NOT NULL").count() == 0
    want_v = [(k, *map(float, p)) for k, p in enumerate(xyz)]
    want_f = [(k, *map(int, t)) for k, t in enumerate(tri)]
    of = lambda name: _tables(rows.where(rows["mesh_id"].endswith(name)))
    assert of("a.mesh") == (want_v, want_f)
    assert of("b.PLY") == (want_v, want_f)
    fans = [(2 * k + j, *map(int, (q[0], q[1 + j], q[2 + j]))) for k, q in enumerate(quads) for j in (0, 1)]
    assert of("q.ply") == (want_v, fans)
    assert of("c.stl") == ([(k, *map(float, p)) for k, p in enumerate(xyz[tri[:N]].reshape(-1, 3))], [])
    rows.unpersist()


def test_refused_files_give_one_row(spark, tmp_path, arrays):
    xyz, tri = arrays
    whole = b"SHM1" + struct.pack("<II", N, 2 * N) + xyz.tobytes() + tri.tobytes()
    (tmp_path / "cut.mesh").write_bytes(whole[:-5])
    (tmp_path / "mark.mesh").write_bytes(b"SHM2" + whole[4:])
    (tmp_path / "empty.mesh").write_bytes(b"")
    (tmp_path / "text.stl").write_text("solid\nendsolid\n")
    (tmp_path / "mixed.ply").write_bytes(_ply(xyz, [*tri[:50], (1, 2, 3, 4)]))
    # as long as fifty triangles would be, and still of different lengths
    (tmp_path / "even.ply").write_bytes(_ply(xyz, [*tri[:48], (1, 2, 3, 4), (1, 2)]))
    got = mesh_records(spark, str(tmp_path), step=10_000).where("reason IS NOT NULL").collect()
    reasons = {r["mesh_id"].rsplit("/", 1)[1]: r["reason"] for r in got}
    assert len(got) == len(reasons)
    assert set(reasons) == {"cut.mesh", "mark.mesh", "empty.mesh", "mixed.ply", "even.ply"}
    assert reasons["mixed.ply"] == reasons["even.ply"] == ranges.VARYING


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    assert mesh_records(spark, str(tmp_path)).count() == 0
