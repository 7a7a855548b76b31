from orbtable import bindings as B
from orbtable.catalog.meshes import _params
from orbtable.plans import policy


def test_report_tells_how_the_flow_ended(spark, sf):
    """With a limit that every chart exceeds, the area flow runs and its cap of one step is reported."""
    m = B.lineitem_meshes(spark, sf)
    one = lambda df: df.where("mesh_id = 's1'")
    chart, report = policy.map_policy(one(m.vertices), one(m.faces), _params(spark, sf), max_ratio=1.0, max_steps=1)
    r = report.first()
    assert (r["crowded"], r["steps"], r["stopped"], r["folds"]) == (True, 1, "max steps", 0)
    assert 0 < r["flow_spread"] < 10 and chart.select("v").distinct().count() == one(m.vertices).count()
