"""Schemas of the tables the operators exchange (DDL strings)."""

VERTICES = "mesh_id STRING, v BIGINT, x DOUBLE, y DOUBLE, z DOUBLE"
FACES = "mesh_id STRING, f BIGINT, a BIGINT, b BIGINT, c BIGINT"
CHART = "mesh_id STRING, v BIGINT, sx DOUBLE, sy DOUBLE, sz DOUBLE"
RINGS = "nlat INT, i INT, theta DOUBLE, ct DOUBLE, st DOUBLE, w DOUBLE"
BASIS = "i INT, l INT, m INT, y DOUBLE"
SAMPLES = "field_id STRING, comp STRING, i INT, j INT, f DOUBLE"
COEFFS = "field_id STRING, comp STRING, l INT, m INT, re DOUBLE, im DOUBLE"
GAINS = "spec_id STRING, l INT, g DOUBLE"
POWER = "field_id STRING, l INT, p DOUBLE"
TRIPLETS = "mesh_id STRING, row BIGINT, col BIGINT, val DOUBLE"
POINTS = "cloud_id STRING, p BIGINT, x DOUBLE, y DOUBLE, z DOUBLE"
KNN = "cloud_id STRING, p BIGINT, rank INT, q BIGINT, d2 DOUBLE"
LOCATED = "mesh_id STRING, q BIGINT, f BIGINT, w0 DOUBLE, w1 DOUBLE, w2 DOUBLE, how STRING"
LINES = "mesh_id STRING, block BIGINT, pos BIGINT, line STRING"
