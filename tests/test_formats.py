import json
import struct

import pytest

from orbtable.operators import mesh as mo
from orbtable.sources import meshes as sm

CORNERS = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
QUADS = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
TRIS = [(q[0], q[k], q[k + 1]) for q in QUADS for k in (1, 2)]


def write_cubes(d):
    (d / "a.OBJ").write_text("# cube\n" + "".join(f"v {x} {y} {z}\n" for x, y, z in CORNERS) + "".join("f " + " ".join(f"{i + 1}/1/1" for i in q) + "\n" for q in QUADS))
    (d / "b.off").write_text("OFF\n8 6 0 # counts\n" + "".join(f"{x} {y} {z}\n" for x, y, z in CORNERS) + "".join("4 " + " ".join(map(str, q)) + "\n" for q in QUADS))
    head = "ply\nformat {}\nelement vertex 8\nproperty {} nx\nproperty {} x\nproperty {} y\nproperty {} z\nelement face 6\nproperty list uchar int vertex_indices\nend_header\n"
    (d / "c.ply").write_text(head.format("ascii 1.0", *["float"] * 4) + "".join(f"9 {x} {y} {z}\n" for x, y, z in CORNERS) + "".join("4 " + " ".join(map(str, q)) + "\n" for q in QUADS))
    for name, fmt, e in (("d.ply", "binary_little_endian 1.0", "<"), ("e.ply", "binary_big_endian 1.0", ">")):
        body = b"".join(struct.pack(e + "dddd", 9, *c) for c in CORNERS) + b"".join(struct.pack(e + "B4i", 4, *q) for q in QUADS)
        (d / name).write_bytes(head.format(fmt, *["double"] * 4).encode() + body)
    facet = lambda t: "facet normal 0 0 0\nouter loop\n" + "".join("vertex {} {} {}\n".format(*CORNERS[i]) for i in t) + "endloop\nendfacet\n"
    (d / "f.stl").write_text("solid cube\n" + "".join(map(facet, TRIS)) + "endsolid\n")
    (d / "g.stl").write_bytes(b"solid but binary".ljust(80) + struct.pack("<I", 12) + b"".join(
        struct.pack("<12fH", 0, 0, 0, *[c for i in t for c in CORNERS[i]], 0) for t in TRIS))
    (d / "h.mesh").write_bytes(b"SHM1" + struct.pack("<II", 8, 12) + struct.pack("<24f", *[c for p in CORNERS for c in p]) + struct.pack("<36I", *[i for t in TRIS for i in t]))
    (d / "i.glb").write_bytes(b"????")


def test_cube_in_every_format(spark, tmp_path):
    write_cubes(tmp_path)
    v, f, rejected = sm.read_meshes(spark, str(tmp_path))
    rows = mo.euler_char(v, f).collect()
    assert len(rows) == 8
    for r in rows:
        assert (r["nv"], r["nf"], r["chi"]) == (8, 12, 2), r
    assert [r["mesh_id"].rsplit("/", 1)[1] for r in rejected.collect()] == ["i.glb"]
    area = mo.face_corners(f, v, ["x", "y", "z"])
    from orbtable.operators import faces as fo
    assert all(abs(r["area"] - 6) < 1e-6 for r in fo.surface_area(area).collect())


def test_manifest(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"key": "k", "label": "l", "file": "f", "nv": 8, "nf": 12, "euler": 0, "source": "s", "normalized": True}]))
    counts = spark.createDataFrame([("k", 8, 12, 2)], "mesh_id string, nv bigint, nf bigint, chi bigint")
    r = sm.check_manifest(sm.read_manifest(spark, str(tmp_path / "p.json")), counts).first()
    assert (r["nv_ok"], r["nf_ok"], r["euler_ok"]) == (True, True, False)


def test_awkward_files(spark, tmp_path):
    """Lower-case keywords, long headers and one-line facets are read; what is not a mesh is reported."""
    write_cubes(tmp_path)
    read = lambda name: (tmp_path / name).read_bytes()
    comment = b"comment " + b"format  binary " * 60 + b"\n"
    (tmp_path / "low.off").write_bytes(read("b.off").replace(b"OFF\n", b"off "))
    (tmp_path / "not.off").write_bytes(read("b.off").replace(b"OFF", b"hello"))
    (tmp_path / "long.ply").write_bytes(read("d.ply").replace(b"ply\n", b"ply\n" + comment, 1))
    (tmp_path / "long_text.ply").write_bytes(read("c.ply").replace(b"ply\n", b"ply\n" + comment, 1))
    (tmp_path / "cut.ply").write_bytes(read("d.ply")[:-30])
    (tmp_path / "no.ply").write_bytes(b"nothing of the kind\n")
    (tmp_path / "line.STL").write_bytes(read("f.stl").replace(b"\nvertex", b" vertex"))
    (tmp_path / "not.stl").write_bytes(read("f.stl").replace(b"solid cube\n", b"", 1))
    (tmp_path / "odd.stl").write_bytes(read("f.stl").replace(b"endsolid", b"vertex 1 2 3\nendsolid"))
    (tmp_path / "bad.mesh").write_bytes(b"SHM2" + read("h.mesh")[4:])
    (tmp_path / "cut.mesh").write_bytes(read("h.mesh")[:-8])
    v, f, rejected = sm.read_meshes(spark, str(tmp_path))
    short = lambda r: r["mesh_id"].rsplit("/", 1)[1]
    whole = {short(r) for r in mo.euler_char(v, f).collect() if (r["nv"], r["nf"], r["chi"]) == (8, 12, 2)}
    assert whole == {"a.OBJ", "b.off", "c.ply", "d.ply", "e.ply", "f.stl", "g.stl", "h.mesh", "low.off", "long.ply", "long_text.ply", "line.STL"}
    assert {short(r) for r in rejected.collect()} == {"i.glb", "not.off", "cut.ply", "no.ply", "not.stl", "odd.stl", "bad.mesh", "cut.mesh"}


def test_binary_lists_of_varying_length(spark, tmp_path):
    """A binary PLY of triangles and quads has no fixed records: it is walked, beside files that are read in ranges."""
    write_cubes(tmp_path)
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 8\nproperty double x\nproperty double y\nproperty double z\nelement face 7\nproperty list uchar int vertex_indices\nend_header\n"
    polygons = [*QUADS[:5], *[(QUADS[5][0], QUADS[5][k], QUADS[5][k + 1]) for k in (1, 2)]]
    (tmp_path / "mixed.ply").write_bytes(head + b"".join(struct.pack("<ddd", *c) for c in CORNERS) + b"".join(struct.pack(f"<B{len(p)}i", len(p), *p) for p in polygons))
    v, f, rejected = sm.read_meshes(spark, str(tmp_path))
    short = lambda r: r["mesh_id"].rsplit("/", 1)[1]
    whole = {short(r) for r in mo.euler_char(v, f).collect() if (r["nv"], r["nf"], r["chi"]) == (8, 12, 2)}
    assert {"mixed.ply", "d.ply", "h.mesh", "g.stl"} <= whole
    assert {short(r) for r in rejected.collect()} == {"i.glb"}
