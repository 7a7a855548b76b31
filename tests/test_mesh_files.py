"""Files are written from bounded batches of meshes."""

import struct

from pyspark.sql import functions as F


def test_files_are_written_from_bounded_batches(spark):
    from orbtable.catalog import ingest

    data = b"SHM1" + struct.pack("<II", 3, 1) + struct.pack("<9f", *range(9)) + struct.pack("<3I", 0, 1, 2)

    def encode(parts):
        for part in parts:
            assert len(part) <= 100, "too many meshes at once"
            yield part.assign(content=[data] * len(part))

    ids = spark.range(130, numPartitions=1).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("mesh_id"))
    v, f = ingest.through_files(ids.mapInPandas(encode, "mesh_id string, content binary"), "mesh")
    assert v.count() == 390 and f.select("mesh_id").distinct().count() == 130
