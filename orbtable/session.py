"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orbtable")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # few bytes can mean much geometry: keep small stages spread over the cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir` as the cluster names it.

    Only a local session without that setting gets a scratch folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _ROOTS[app] = tempfile.mkdtemp(prefix="spark-orbtable-")
    return _ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_plain(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet as large as its rows: the planner takes the size of the files for that of the table.

    Numbers of faces and repeated coordinates shrink a hundredfold by dictionaries, and a table of
    millions of rows would be taken for one to broadcast.
    """
    df.write.mode(mode).option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Jobs started inside pass Python stages at most `rows` rows at a time; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, label: str = "step", packed: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage of iterative jobs, survives executor loss, and gives the next
    plan true sizes, so that joins are broadcast only when the table is small. `packed`
    compresses the files instead, for texts and blocks that no join should judge by size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if packed:
        df.write.parquet(path)
    else:
        write_plain(df, path)
    return spark.read.schema(df.schema).parquet(path)


_DIMENSIONS: dict[tuple, str] = {}


def dimension(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A small derived table kept once per application under `key`.

    Written like any other step, so its size is known to every later plan; rebuilt when
    the folder has been cleaned in between.
    """
    full = (spark.sparkContext.applicationId, *key)
    if full in _DIMENSIONS:
        try:
            return spark.read.parquet(_DIMENSIONS[full])
        except AnalysisException:
            pass
    path = scratch_path(spark, "-".join(str(k).strip("/").replace("/", "_").replace(":", "") for k in key))
    write_plain(build(), path)
    _DIMENSIONS[full] = path
    return spark.read.parquet(path)
