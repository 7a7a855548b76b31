"""Binary mesh files of any size as a Spark data source whose partitions are byte ranges.

`spark.read.format("mesh_records").load(folder)` lists the folder, cuts long files every `step` bytes
and packs short ones together. A task reads the header of its file and then only the records that begin in
its range, so one huge file is read by many tasks and a lost task rereads its range alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes in which a PLY header must end.
HEADER = 1 << 20
#: Records decoded at a time.
BATCH = 1 << 16
#: Reason given for a PLY whose lists differ in length: its records have no fixed places.
VARYING = "lists of varying length"
ROWS = "mesh_id string, reason string, v bigint, x double, y double, z double, f bigint, a bigint, b bigint, c bigint"
ARROW = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in ROWS.split(", "))])


@dataclass(frozen=True)
class Section:
    """`count` records of one kind (vertex, corners, face) from byte `start` on; lists hold `lengths` entries each."""

    kind: str
    start: int
    count: int
    record: np.dtype
    lengths: tuple[tuple[str, int], ...] = ()
    ids: str = ""

    @property
    def end(self) -> int:
        return self.start + self.count * self.record.itemsize


def _shm_sections(head: bytes) -> list[Section]:
    if head[:4] != b"SHM1":
        raise ValueError("the SHM1 mark is missing")
    nv, nf = (int(n) for n in np.frombuffer(head, "<u4", 2, 4))
    v = Section("vertex", 12, nv, np.dtype([(c, "<f4") for c in "xyz"]))
    return [v, Section("face", v.end, nf, np.dtype([("ids", "<u4", (3,))]), ids="ids")]


def _is_binary_stl(head: bytes, size: int) -> bool:
    """Header, count and 50 bytes per facet add up exactly; the word 'solid' proves nothing."""
    return len(head) >= 84 and 84 + 50 * int(np.frombuffer(head, "<u4", 1, 80)[0]) == size


def _stl_sections(head: bytes) -> list[Section]:
    facet = np.dtype([("n", "<f4", (3,)), ("v", "<f4", (3, 3)), ("a", "<u2")])
    return [Section("corners", 84, int(np.frombuffer(head, "<u4", 1, 80)[0]), facet)]


def _list_record(file, at: int, props, e: str) -> tuple[np.dtype, tuple]:
    """The record of an element with lists, as long as the one at byte `at`, and its list lengths."""
    from orbtable.sources.meshes import PLY_TYPES
    fields, lengths = [], []
    for k, (name, typ, count) in enumerate(props):
        if count:
            number = np.dtype(e + PLY_TYPES[count])
            here = file.read_at(number.itemsize, at)
            n = int(np.frombuffer(here, number)[0]) if len(here) == number.itemsize else 0
            fields.append((f"n{k}", number))
            lengths.append((f"n{k}", n))
            at += number.itemsize
        entry = np.dtype(e + PLY_TYPES[typ])
        fields.append((f"p{k}", entry, (n,)) if count else (f"p{k}", entry))
        at += entry.itemsize * (n if count else 1)
    return np.dtype(fields), tuple(lengths)


def _ply_sections(file, head: bytes, size: int) -> list[Section]:
    """Sections of a binary PLY; ValueError(VARYING) where the file's length shows that lists differ in length."""
    from orbtable.sources.meshes import INDEX_LISTS, PLY_TYPES, _ply_header
    mark = head.index(b"end_header")
    fmt, elements = _ply_header([ln.split() for ln in head[:mark].decode("ascii").splitlines() if ln.strip()])
    if fmt not in ("binary_little_endian", "binary_big_endian"):
        raise ValueError(f"no reader for this encoding of PLY: {fmt!r}")
    e, at, out = ("<" if fmt == "binary_little_endian" else ">"), head.index(b"\n", mark) + 1, []
    uniform = False
    for el in elements:
        props = el["props"]
        use = [k for k, p in enumerate(props) if p[2] and p[0] in INDEX_LISTS] if el["name"] == "face" else []
        if any(p[2] for p in props):
            uniform = True
            record, lengths = _list_record(file, at, props, e)
            out.append(Section("face" if use else el["name"] + " lists", at, el["count"], record, lengths, f"p{use[0]}" if use else ""))
        else:
            record = np.dtype([(p[0], e + PLY_TYPES[p[1]]) for p in props])
            out.append(Section("vertex" if el["name"] == "vertex" else "other", at, el["count"], record))
        at = out[-1].end
    if uniform and at != size:
        raise ValueError(VARYING)
    return out


def layout(file, path: str, size: int) -> list[Section] | None:
    """Sections of a binary mesh file, None for text, ValueError for what can't be read."""
    kind = path.rsplit(".", 1)[-1].lower()
    head = file.read_at(min(size, HEADER if kind == "ply" else 84), 0)
    if kind == "ply":
        mark = head.find(b"end_header")
        if mark < 0 or not head.startswith(b"ply"):
            raise ValueError("no PLY header")
        if not re.search(rb"(?m)^[ \t]*format[ \t]+binary", head[:mark]):
            return None
        found = _ply_sections(file, head, size)
    elif kind == "stl":
        if not _is_binary_stl(head, size):
            return None
        found = _stl_sections(head)
    else:
        found = _shm_sections(head)
    if found and found[-1].end > size:
        raise ValueError("the file is shorter than its header says")
    return found


def _batch(mesh: str, n: int, **columns) -> pa.RecordBatch:
    given = {"mesh_id": pa.array([mesh] * n, pa.string()), **columns}
    return pa.record_batch([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)


def _rows(mesh: str, part: Section, rows: np.ndarray, first: int) -> pa.RecordBatch:
    """Decoded records, numbered from `first`."""
    if part.kind == "vertex":
        return _batch(mesh, len(rows), v=np.arange(first, first + len(rows)), **{c: rows[c].astype(float) for c in "xyz"})
    if part.kind == "corners":
        xyz = rows["v"].astype(float).reshape(-1, 3)
        return _batch(mesh, len(xyz), v=np.arange(3 * first, 3 * first + len(xyz)), **dict(zip("xyz", np.ascontiguousarray(xyz.T))))
    ids = rows[part.ids].astype(np.int64)
    fan = max(ids.shape[1] - 2, 0)
    tri = np.stack([ids[:, [0, k, k + 1]] for k in range(1, fan + 1)], axis=1).reshape(-1, 3) if fan else np.zeros((0, 3), np.int64)
    return _batch(mesh, len(tri), f=np.arange(first * fan, first * fan + len(tri)), **dict(zip("abc", np.ascontiguousarray(tri.T))))


def _refused(mesh: str, reason: str) -> pa.RecordBatch:
    return _batch(mesh, 1, reason=[reason])


def read_range(filesystem, path: str, mesh: str, size: int, start: int, stop: int):
    """Record batches of the records that begin in [start, stop); the range from 0 reports a refused file."""
    with filesystem.open_input_file(path) as file:
        try:
            parts = layout(file, path, size)
        except (ValueError, KeyError, IndexError, OverflowError) as e:
            if start == 0:
                yield _refused(mesh, str(e))
            return
        for part in parts or ():
            if part.kind == "other":
                continue
            width = part.record.itemsize
            index = lambda byte: min(max(-((part.start - byte) // width), 0), part.count) if width else 0
            at, end = index(start), index(stop)
            while at < end:
                n = min(BATCH, end - at)
                rows = np.frombuffer(file.read_at(n * width, part.start + at * width), part.record)
                if any((rows[c] != k).any() for c, k in part.lengths):
                    yield _refused(mesh, VARYING)
                    return
                if not part.kind.endswith(" lists"):
                    yield _rows(mesh, part, rows, at)
                at += n


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, mesh_id, size, start, stop) read by one task."""

    parts: list


class MeshReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("step", 64 << 20))
        self.suffixes = tuple("." + s for s in options.get("suffixes", "mesh,ply,stl").split(","))

    def partitions(self) -> list[Ranges]:
        filesystem, root = fs.FileSystem.from_uri(self.path)
        info = filesystem.get_file_info(root)
        files = [info] if info.is_file else filesystem.get_file_info(fs.FileSelector(root))
        scheme = re.match(r"^(?!file:)\w+://[^/]*", self.path)
        out, pack, held = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if not f.is_file or f.base_name[:1] in "_." or not f.base_name.lower().endswith(self.suffixes):
                continue
            mesh = f"{scheme.group(0)}/{f.path.split('/', 1)[-1]}" if scheme else f"file:{f.path}"
            if f.size > self.step:
                out += [Ranges([(f.path, mesh, f.size, s, min(s + self.step, f.size))]) for s in range(0, f.size, self.step)]
                continue
            if pack and (held + f.size > self.step or len(pack) >= 256):
                out.append(Ranges(pack))
                pack, held = [], 0
            pack.append((f.path, mesh, f.size, 0, max(f.size, 1)))
            held += f.size
        return out + [Ranges(pack)] if pack or not out else out

    def read(self, partition: Ranges):
        filesystem, _ = fs.FileSystem.from_uri(self.path)
        for path, *span in partition.parts:
            yield from read_range(filesystem, path, *span)


class MeshRecords(DataSource):
    """Options: path (a folder or file; another file system than the workers' own needs its scheme), suffixes, step (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "mesh_records"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> MeshReader:
        return MeshReader(dict(self.options))


def mesh_records(spark: SparkSession, path: str, suffixes: str = "mesh,ply,stl", step: int = 64 << 20):
    """Rows of all binary files: vertices (v set), faces (f set; STL: corners as vertices) and refused files (reason set)."""
    spark.dataSource.register(MeshRecords)
    return spark.read.format("mesh_records").option("suffixes", suffixes).option("step", step).load(path)
