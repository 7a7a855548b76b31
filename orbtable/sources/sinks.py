"""Coefficient sink with a two-phase commit, and its reader.

A write sorts the coefficients by range of (field, component, m, l). Each task writes one Parquet file and checks
that what it saw of every component is gapless; only the two ends of its range travel to the commit, which
stitches them in order. A write becomes visible by one small record that names its files: what a failed
task or a refused write leaves behind is never read.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from orbtable.functions.spectral import nlm
from orbtable.session import settle

RECORD = "write string, replaces boolean, files array<string>, lmax int, mmax int, nlat int, nphi int, filter string, source string, convention string, created_utc string"
GIVEN = ("lmax", "mmax", "nlat", "nphi", "filter", "source")


@dataclass
class Written(WriterCommitMessage):
    """One task's part: its place, file, first and last (field, component, position), and a fault if it found one."""

    place: int
    file: str | None = None
    head: tuple | None = None
    tail: tuple | None = None
    fault: str | None = None


class CoeffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, replaces: bool):
        self.root, self.replaces, self.write_id = options["path"], replaces, uuid.uuid4().hex
        self.given = {k: options[k] if k in ("filter", "source") else int(options[k]) for k in GIVEN}
        self.full = nlm(self.given["lmax"], self.given["mmax"])

    def _place(self, *parts: str) -> tuple[fs.FileSystem, str]:
        filesystem, root = fs.FileSystem.from_uri(self.root)
        return filesystem, "/".join([root.rstrip("/"), *parts])

    def _positions(self, l: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Place of (l, m) in the order by m, then l; -1 for pairs outside of the triangle."""
        top = self.given["lmax"]
        inside = (m >= 0) & (m <= self.given["mmax"]) & (l >= m) & (l <= top)
        return np.where(inside, m * (top + 1) - m * (m - 1) // 2 + l - m, -1)

    def follows(self, before: tuple | None, after: tuple | None) -> bool:
        """Whether `after` may come next in the sorted rows; None is the outside."""
        if before and after and before[:2] == after[:2]:
            return after[2] == before[2] + 1
        return (before is None or before[2] == self.full - 1) and (after is None or after[2] == 0)

    def write(self, iterator) -> Written:
        task = TaskContext.get()
        done = Written(task.partitionId())
        out = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if any(batch[c].null_count for c in ("field_id", "comp", "l", "m")):
                    done.fault = "a null key"
                    return done
                field, comp = (np.asarray(batch[c].to_pylist(), dtype=object) for c in ("field_id", "comp"))
                at = self._positions(*(batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("l", "m")))
                same = (field[1:] == field[:-1]) & (comp[1:] == comp[:-1])
                fine = np.where(same, at[1:] == at[:-1] + 1, (at[:-1] == self.full - 1) & (at[1:] == 0))
                first, last = ((field[k], comp[k], int(at[k])) for k in (0, -1))
                if (at < 0).any() or not fine.all() or (done.tail and not self.follows(done.tail, first)):
                    done.fault = f"field {first[0]!r} to {last[0]!r}"
                    return done
                done.head, done.tail = done.head or first, last
                if out is None:
                    done.file = f"{self.write_id}/part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
                    filesystem, name = self._place("data", done.file)
                    filesystem.create_dir(name.rsplit("/", 1)[0])
                    out = pq.ParquetWriter(name, batch.schema, filesystem=filesystem)
                out.write_batch(batch)
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Written]) -> None:
        parts = sorted((p for p in messages if p), key=lambda p: p.place)
        faults = [p.fault for p in parts if p.fault]
        ends = [None] + [e for p in parts if p.head for e in (p.head, p.tail)] + [None]
        faults += [f"at {(a or b)[:2]}" for a, b in zip(ends[::2], ends[1::2]) if (a or b) and not self.follows(a, b)]
        if faults:
            raise ValueError(f"coefficient tables must hold {self.full} distinct (l, m) per component: {faults[0]}")
        filesystem, folder = self._place("commits")
        filesystem.create_dir(folder)
        now = datetime.datetime.now(datetime.timezone.utc)
        record = {"write": self.write_id, "replaces": self.replaces, "files": [p.file for p in parts if p.file], **self.given,
                  "convention": "orthonormal, Condon-Shortley, m >= 0", "created_utc": now.strftime("%Y-%m-%dT%H:%M:%SZ")}
        name = f"{now.strftime('%Y%m%dT%H%M%S%f')}-{self.write_id}.json"
        with filesystem.open_output_stream(f"{folder}/_{name}") as out:
            out.write(json.dumps(record).encode())
        filesystem.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written]) -> None:
        filesystem, folder = self._place("data", self.write_id)
        if filesystem.get_file_info(folder).type == fs.FileType.Directory:
            filesystem.delete_dir(folder)


class CoeffStore(DataSource):
    """Write-only: rows sorted by range of (field_id, comp, m, l), options path and GIVEN; modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "coeff_store"

    def writer(self, schema, overwrite: bool) -> CoeffWriter:
        return CoeffWriter(dict(self.options), overwrite)


def _commits(spark: SparkSession, path: str) -> list:
    """Records of visible writes, oldest first; an overwrite hides those before it."""
    try:
        rows = spark.read.schema(RECORD).json(f"{path}/commits").withColumn("_at", F.col("_metadata.file_name")).collect()
    except AnalysisException:
        return []
    rows = sorted(rows, key=lambda r: r["_at"])
    start = max((k for k, r in enumerate(rows) if r["replaces"]), default=0)
    return rows[start:]


def write_coeffs(
    coeffs: DataFrame, path: str, *, lmax: int, nlat: int, nphi: int, mmax: int | None = None,
    filter_text: str = "off", source: str = "", mode: str = "errorifexists",
) -> None:
    """Write coeffs(field_id, comp, l, m, ...) as one visible step; modes errorifexists, append and overwrite.

    A component with missing, repeated or null (l, m) refuses the whole write with a ValueError. The
    coefficients are computed once; sorting reads the settled table. One writer at a time.
    """
    spark = coeffs.sparkSession
    if mode == "errorifexists" and _commits(spark, path):
        raise ValueError(f"{path} holds coefficients already")
    spark.dataSource.register(CoeffStore)
    order = ["field_id", "comp", "m", "l"]
    rows = settle(coeffs, "coeffs").repartitionByRange(*order).sortWithinPartitions(*order)
    given = dict(zip(GIVEN, (lmax, lmax if mmax is None else mmax, nlat, nphi, filter_text, source)))
    try:
        rows.write.format("coeff_store").options(**given).mode("overwrite" if mode == "overwrite" else "append").save(path)
    except PySparkException as e:
        if "distinct (l, m) per component" in str(e):
            raise ValueError(f"coefficient tables must hold {nlm(lmax, mmax)} distinct (l, m) per component") from e
        raise


def read_coeffs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(coefficients with their model, provenance per model) of all visible writes."""
    commits = _commits(spark, path)
    files = [f"{path}/data/{f}" for c in commits for f in c["files"]]
    rows = spark.read.parquet(*files) if files else spark.createDataFrame([], "field_id string, comp string, l int, m int, re double, im double")
    columns = rows.columns
    named = rows.withColumn("model", F.col("field_id").cast("string"))
    write = F.regexp_extract("_metadata.file_path", r"/data/([^/]+)/[^/]+$", 1) if files else F.lit("")
    models = named.select("model", write.alias("write")).distinct()
    records = spark.createDataFrame([tuple(c)[:-1] for c in commits], RECORD).drop("replaces", "files")
    return named.select(*columns, "model"), models.join(records, "write").drop("write")
