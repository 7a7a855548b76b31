"""Mesh formats: the supplier meshes written out as file lines or bytes, and parsed back."""

from __future__ import annotations

import struct

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.meshes import L, q, rs
from orbtable.catalog.sqlkit import HALF, rnd, values
from orbtable.operators import mesh as mo
from orbtable.session import scratch_path, settle, small_batches
from orbtable.sources import meshes as sm

NV = B.L_NLAT * B.L_NPHI + 2
NF = 2 * B.L_NLAT * B.L_NPHI

#: Meshes that a Python stage writes at a time.
MESHES = 100


def _lines(*parts: DataFrame) -> DataFrame:
    """Union of (mesh_id, pos, line) rows, cut into blocks of 64 lines like splits of a file."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("mesh_id", F.floor(F.col("pos") / 64).cast("bigint").alias("block"), "pos", "line")


def _vertex_lines(m, head: str = "", start: int = 0) -> DataFrame:
    return m.vertices.select("mesh_id", (F.col("v") + start).alias("pos"), F.concat(F.lit(head), F.concat_ws(" ", *[F.col(k).cast("string") for k in "xyz"])).alias("line"))


def obj_lines(m) -> DataFrame:
    one = lambda c: F.concat((F.col(c) + 1).cast("string"), F.lit("/7/"), F.col("f").cast("string"))
    f = m.faces.select("mesh_id", (F.col("f") + NV).alias("pos"), F.concat_ws(" ", F.lit("f"), one("a"), one("b"), one("c")).alias("line"))
    return _lines(_vertex_lines(m, "v "), f)


def polygon_lines(m, start: int) -> DataFrame:
    return m.faces.select("mesh_id", (F.col("f") + start).alias("pos"), F.concat_ws(" ", F.lit("3"), "a", "b", "c").alias("line"))


def head_lines(m, text: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("pos"), F.lit(t).alias("line")) for k, t in enumerate(text)])
    return m.faces.select("mesh_id").distinct().select("mesh_id", F.inline(rows))


def through_files(content: DataFrame, ending: str) -> tuple[DataFrame, DataFrame]:
    """content(mesh_id, content) written as one file per mesh and read with read_meshes; mesh ids as before."""
    spark = content.sparkSession
    folder = scratch_path(spark, "files")

    def put(it):
        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root)
        for pdf in it:
            for mesh, data in zip(pdf["mesh_id"], pdf["content"]):
                with filesystem.open_output_stream(f"{root}/{mesh}.{ending}") as out:  # a second attempt writes the same bytes
                    out.write(bytes(data))
            yield pdf[["mesh_id"]]

    with small_batches(spark, MESHES):  # a row is a whole mesh
        settle(content.mapInPandas(put, "mesh_id string"), "written")
    name = F.regexp_extract("mesh_id", r"([^/]+)\.[^./]+$", 1)
    v, f, _ = sm.read_meshes(spark, folder)
    return v.withColumn("mesh_id", name), f.withColumn("mesh_id", name)


def text_of(lines: DataFrame) -> DataFrame:
    """(mesh_id, content) of bounded meshes' lines in order."""
    rows = lines.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return rows.select("mesh_id", F.concat(F.array_join("rows.line", "\n"), F.lit("\n")).cast("binary").alias("content"))


@q("src_obj", " SELECT mesh_id, v, " + rs("x", "y", "z") + " FROM verts", corners=False)
def _(spark, sf):
    return sm.parse_obj(obj_lines(L(spark, sf)))[0]


@q("src_obj_faces", " SELECT mesh_id, f, a, b, c FROM faces", corners=False)
def _(spark, sf):
    return sm.parse_obj(obj_lines(L(spark, sf)))[1]


@q("fan_triangulate", f""", pg AS (SELECT 's' || s_suppkey AS mesh_id, range AS g, 2 + (s_suppkey + range) % 5 AS n FROM supplier, range(6)),
fn AS (SELECT mesh_id, g, k.range AS k, 10*g AS a, 10*g + k.range AS b, 10*g + k.range + 1 AS c FROM pg, range(1, 7) k WHERE k.range <= n - 2)
SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY g, k) - 1 AS f, a, b, c FROM fn""", corners=False)
def _(spark, sf):
    """Polygons of two to six corners per supplier."""
    s = B.table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("g"))
    n = 2 + (F.col("s_suppkey") + F.col("g")) % 5
    p = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("mesh_id"), F.col("g").cast("bigint").alias("g"),
                 F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: 10 * F.col("g") + i).alias("ids"))
    return sm._number_faces(sm.fan_triangulate(p, F.col("ids")))


@q("src_off", " SELECT mesh_id, f, a, b, c FROM faces", corners=False)
def _(spark, sf):
    """Comments and a blank line included; read from files."""
    m = L(spark, sf)
    head = head_lines(m, ["OFF", "# a comment", f"{NV} {NF} 0  # counts", ""])
    return through_files(text_of(_lines(head, _vertex_lines(m, "", 4), polygon_lines(m, 4 + NV))), "off")[1]


def ply_lines(m) -> DataFrame:
    head = ["ply", "format ascii 1.0", "comment made of order lines", f"element vertex {NV}", "property float nx", "property float x", "property float y",
            "property float z", f"element face {NF}", "property uchar flag", "property list uchar int vertex_indices", "end_header"]
    n = len(head)
    v = m.vertices.select("mesh_id", (F.col("v") + n).alias("pos"), F.concat_ws(" ", F.lit("0.5"), *[F.col(k).cast("string") for k in "xyz"]).alias("line"))
    f = m.faces.select("mesh_id", (F.col("f") + n + NV).alias("pos"), F.concat_ws(" ", F.lit("9 3"), "a", "b", "c").alias("line"))
    return _lines(head_lines(m, head), v, f)


@q("src_ply", " SELECT mesh_id, v, " + rs("x", "y", "z") + " FROM verts", corners=False)
def _(spark, sf):
    """An extra property before x and before the index list."""
    return sm.parse_ply_ascii(ply_lines(L(spark, sf)))[0]


@q("src_ply_faces", " SELECT mesh_id, f, a, b, c FROM faces", corners=False)
def _(spark, sf):
    """Read from files."""
    return through_files(text_of(ply_lines(L(spark, sf))), "Ply")[1]


@q("src_stl", f""", so AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY ord) - 1 AS id FROM (SELECT mesh_id, v, min(ord) AS ord FROM (
 SELECT mesh_id, a AS v, 3*f AS ord FROM faces UNION ALL SELECT mesh_id, b, 3*f+1 FROM faces UNION ALL SELECT mesh_id, c, 3*f+2 FROM faces) GROUP BY 1, 2))
SELECT so.mesh_id, so.id AS v, {rs('x', 'y', 'z')} FROM so JOIN verts ON verts.mesh_id = so.mesh_id AND verts.v = so.v""", corners=False)
def _(spark, sf):
    """Facets as text, welded back to shared vertices in first-seen order."""
    m = L(spark, sf)
    fr = mo.face_corners(m.faces, m.vertices, ["x", "y", "z"])
    at = lambda i, k: F.struct(F.lit(i).cast("bigint").alias("k"), F.concat_ws(" ", F.lit("vertex"), *[F.col(k + c).cast("string") for c in "xyz"]).alias("line"))
    rows = fr.select("mesh_id", "f", F.inline(F.array(at(0, "a"), at(1, "b"), at(2, "c"))))
    return mo.weld(sm.parse_stl_ascii(_lines(rows.select("mesh_id", (3 * F.col("f") + F.col("k")).alias("pos"), "line"))))[0]


@q("src_shm", f" SELECT mesh_id, v, {', '.join(rnd(f'CAST(CAST({k} AS FLOAT) AS DOUBLE)', k) for k in 'xyz')} FROM verts", corners=False)
def _(spark, sf):
    """One packed file per mesh, encoded by Spark from bounded meshes, read as byte ranges."""
    m = L(spark, sf)

    @F.pandas_udf("binary")
    def pack(xs: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for x, f in zip(xs, fs):
            flat = [c for r in x for c in (r["x"], r["y"], r["z"])]
            tri = [c for r in f for c in (r["a"], r["b"], r["c"])]
            out.append(b"SHM1" + struct.pack("<II", len(x), len(f)) + struct.pack(f"<{len(flat)}f", *flat) + struct.pack(f"<{len(tri)}I", *tri))
        return pd.Series(out)

    v = m.vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("v", "x", "y", "z"))).alias("vs"))
    f = m.faces.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("f", "a", "b", "c"))).alias("fs"))
    return through_files(v.join(f, "mesh_id").select("mesh_id", pack("vs", "fs").alias("content")), "mesh")[0]


@register("src_dispatch", """SELECT p_partkey, path, ext, CASE WHEN ext IN ('mesh', 'obj', 'off', 'ply', 'stl') THEN 'read' ELSE 'rejected' END AS fate FROM (
 SELECT p_partkey, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM (
 SELECT p_partkey, '/data/' || p_brand || '.v2/' || p_partkey || '.' || ['OBJ', 'off', 'Ply', 'stl', 'mesh', 'glb'][1 + p_partkey % 6] AS path FROM part))""")
def _(spark, sf):
    """The reader every path would go to."""
    p = B.table(spark, sf, "part")
    ext = F.array(*[F.lit(e) for e in ("OBJ", "off", "Ply", "stl", "mesh", "glb")])
    path = F.concat(F.lit("/data/"), "p_brand", F.lit(".v2/"), F.col("p_partkey").cast("string"), F.lit("."), ext[(F.col("p_partkey") % 6).cast("int")])
    d = p.select("p_partkey", path.alias("path")).withColumn("ext", sm.suffix(F.col("path")))
    return d.withColumn("fate", F.when(F.col("ext").isin(*sm.TEXT_SUFFIXES, "mesh"), "read").otherwise("rejected"))


@q("src_manifest", "," + HALF + """, ct AS (SELECT v.mesh_id, nv, nf, nv - ne + nf AS chi FROM (SELECT mesh_id, count(*) AS nv FROM verts GROUP BY 1) v JOIN (SELECT mesh_id, count(*) AS ne FROM edges GROUP BY 1) e USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS nf FROM faces GROUP BY 1) f USING (mesh_id)),
mf AS (SELECT 's' || s_suppkey AS key, 106 + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS nv, 208 AS nf, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 2 END AS euler FROM supplier)
SELECT key, mf.nv = ct.nv AS nv_ok, mf.nf = ct.nf AS nf_ok, mf.euler = ct.chi AS euler_ok FROM mf JOIN ct ON ct.mesh_id = mf.key""", corners=False)
def _(spark, sf):
    """A manifest of the suppliers, some entries wrong, written as JSON and checked against counts."""
    s = F.col("s_suppkey")
    rows = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), s.cast("string")).alias("key"), F.col("s_name").alias("label"), F.lit("x.mesh").alias("file"),
        F.when(s % 7 == 0, NV + 1).otherwise(NV).alias("nv"), F.lit(NF).alias("nf"), F.when(s % 11 == 0, 0).otherwise(2).alias("euler"),
        F.lit("order lines").alias("source"), F.lit(True).alias("normalized"))
    path = scratch_path(spark, "manifest")
    rows.write.json(path)
    manifest = spark.read.schema("key string, label string, file string, nv bigint, nf bigint, euler bigint, source string, normalized boolean").json(path)
    m = L(spark, sf)
    return sm.check_manifest(manifest, mo.euler_char(m.vertices, m.faces))
