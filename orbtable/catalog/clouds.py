"""Point clouds: the embedding directions as clouds on the sphere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbtable import bindings as B
from orbtable.catalog import register
from orbtable.catalog.meshes import L, q, rs
from orbtable.catalog.places import pts_cte
from orbtable.catalog.sqlkit import CORN, PI, rnd
from orbtable.catalog.surfaces import directions
from orbtable.functions.vec import vec
from orbtable.operators import cloud as cl, spatial as spt, stars as st
from orbtable.session import dimension
from orbtable.sources import generate as gen

K = 25
_KNN = "WITH " + pts_cte() + f""", dr AS (SELECT cloud_id, p, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM pts),
pr AS (SELECT a.cloud_id, a.p, b.x-a.x AS x, b.y-a.y AS y, b.z-a.z AS z, row_number() OVER (PARTITION BY a.cloud_id, a.p ORDER BY (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z), b.p) AS k
 FROM dr a JOIN dr b ON a.cloud_id = b.cloud_id),
cv AS (SELECT cloud_id, p, count(*) AS n, {', '.join(f'sum({a}*{b})-sum({a})*sum({b})/count(*) AS c{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM pr WHERE k <= {K} GROUP BY 1, 2)"""


def neighbours(spark, sf) -> DataFrame:
    return dimension(spark, ("knn", sf), lambda: spt.knn_join(directions(spark, sf), K))


@register("covariance", _KNN + f" SELECT cloud_id, p, {rs('cxx', 'cxy', 'cxz', 'cyy', 'cyz', 'czz')} FROM cv")
def _(spark, sf):
    return cl.covariance(directions(spark, sf), neighbours(spark, sf))


@register("pca_frame", _KNN + f""", e0 AS (SELECT *, (cxx+cyy+czz)/3 AS q FROM cv),
e1 AS (SELECT *, sqrt((pow(cxx-q,2)+pow(cyy-q,2)+pow(czz-q,2)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS s FROM e0),
e2 AS (SELECT *, greatest(-1.0, least(1.0, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz) - cxy*(cxy*(czz-q)-cyz*cxz) + cxz*(cxy*cyz-(cyy-q)*cxz))/(2*s*s*s))) AS r FROM e1),
e3 AS (SELECT *, acos(r)/3 AS a FROM e2)
SELECT cloud_id, p, {rnd('q+2*s*cos(a)', 'l1')}, {rnd(f'3*q-(q+2*s*cos(a))-(q+2*s*cos(a+2*{PI}/3))', 'l2')}, {rnd(f'q+2*s*cos(a+2*{PI}/3)', 'l3')} FROM e3""")
def _(spark, sf):
    """Eigenvalues; the normals are tested separately."""
    return cl.pca_frame(directions(spark, sf), neighbours(spark, sf)).select("cloud_id", "p", "l1", "l2", "l3")


@register("mls_laplacian")
def _(spark, sf):
    return cl.mls_laplacian(directions(spark, sf), neighbours(spark, sf))


@register("local_delaunay_ring")
def _(spark, sf):
    return cl.local_delaunay_ring(directions(spark, sf), neighbours(spark, sf))


_HULL = "WITH " + pts_cte() + """, dr AS (SELECT cloud_id, p, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM pts),
tr AS (SELECT a.cloud_id, a.p AS a, b.p AS b, c.p AS c, a.x AS ox, a.y AS oy, a.z AS oz,
  (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz
  FROM dr a JOIN dr b ON b.cloud_id = a.cloud_id AND b.p > a.p JOIN dr c ON c.cloud_id = a.cloud_id AND c.p > b.p),
sd AS (SELECT t.cloud_id, a, b, c, count(*) FILTER ((d.x-ox)*nx+(d.y-oy)*ny+(d.z-oz)*nz > 0) AS above, count(*) FILTER ((d.x-ox)*nx+(d.y-oy)*ny+(d.z-oz)*nz < 0) AS below
  FROM tr t JOIN dr d ON d.cloud_id = t.cloud_id AND d.p NOT IN (t.a, t.b, t.c) GROUP BY 1, 2, 3, 4)"""


@register("induced_mesh", _HULL + " SELECT cloud_id, a, CASE WHEN above = 0 THEN b ELSE c END AS b, CASE WHEN above = 0 THEN c ELSE b END AS c FROM sd WHERE above = 0 OR below = 0")
def _(spark, sf):
    """The closed mesh of every cloud; the SQL tries the circle of every three points."""
    return st.sphere_mesh(directions(spark, sf), K)


def _mesh_rings(spark, sf) -> DataFrame:
    """One-rings of the supplier meshes in the shape of local rings."""
    f = L(spark, sf).faces
    return f.select(F.col("mesh_id").alias("cloud_id"), F.explode(F.array("a", "b", "c")).alias("p"), "a", "b", "c")


@q("ring_minus_self", " SELECT DISTINCT mesh_id AS cloud_id, p, u FROM (SELECT mesh_id, p, unnest([a, b, c]) AS u FROM (SELECT *, unnest([a, b, c]) AS p FROM faces)) WHERE u <> p", corners=False)
def _(spark, sf):
    return cl.ring_minus_self(_mesh_rings(spark, sf))


@q("pole_balance", f""", cp AS (SELECT mesh_id, v AS p, ty AS x, tz AS y, tx AS z FROM verts),
rg AS (SELECT DISTINCT mesh_id, p, u FROM (SELECT mesh_id, p, unnest([a, b, c]) AS u FROM (SELECT *, unnest([a, b, c]) AS p FROM faces)) WHERE u <> p),
no AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY z DESC, p) AS k FROM cp) WHERE k = 1),
so AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY z, p) AS k FROM cp) WHERE k = 1),
nr AS (SELECT o.mesh_id, avg(sqrt(pow(n.x/(1-n.z)-o.x/(1-o.z),2)+pow(n.y/(1-n.z)-o.y/(1-o.z),2))) AS nt FROM no o JOIN rg ON rg.mesh_id = o.mesh_id AND rg.p = o.p JOIN cp n ON n.mesh_id = o.mesh_id AND n.p = rg.u GROUP BY 1),
sr AS (SELECT o.mesh_id, avg(sqrt(pow(n.x/(1+n.z)-o.x/(1+o.z),2)+pow(n.y/(1+n.z)-o.y/(1+o.z),2))) AS st FROM so o JOIN rg ON rg.mesh_id = o.mesh_id AND rg.p = o.p JOIN cp n ON n.mesh_id = o.mesh_id AND n.p = rg.u GROUP BY 1),
pl AS (SELECT mesh_id, p, x/(1+z)*sqrt(nt*st)/st AS u, y/(1+z)*sqrt(nt*st)/st AS w FROM cp JOIN nr USING (mesh_id) JOIN sr USING (mesh_id))
SELECT mesh_id AS cloud_id, p, {rnd('2*u/(1+u*u+w*w)', 'x')}, {rnd('2*w/(1+u*u+w*w)', 'y')}, {rnd('(1-u*u-w*w)/(1+u*u+w*w)', 'z')} FROM pl""", corners=False)
def _(spark, sf):
    """The warped charts seen along another axis, so that no point sits on a pole."""
    pts = L(spark, sf).warped.select(F.col("mesh_id").alias("cloud_id"), F.col("v").alias("p"), F.col("sy").alias("x"), F.col("sz").alias("y"), F.col("sx").alias("z"))
    return cl.pole_balance(pts, _mesh_rings(spark, sf))
