"""Binary trajectories (DCD) as a table: ``spark.read.format("dcd").load(path)``.

A DCD file is a sequence of Fortran records, each between two copies of its length: a header
(``CORD`` and 20 integers), titles, the number of atoms, and per frame an optional cell and the
x, y and z of all atoms as 32-bit floats. Without fixed atoms all frames are equally long, so
a task seeks its own range of frames. Bounds on ``frame`` in a filter move the range where the
session sets ``spark.sql.python.filterPushdown.enabled``, and so do the options ``start`` and
``stop``; the option ``stride`` takes every so many frames and ``frames`` sets how many make a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "path string, frame long, step long, atom int, x float, y float, z float, cell array<double>"
#: Frames of a task, unless the option says otherwise, and atoms of a batch.
FRAMES, ATOMS = 256, 1 << 18


@dataclass
class Layout:
    """What the head of a file says."""

    order: str
    frames: int
    first_step: int
    every: int
    atoms: int
    cell: bool
    head: int

    @property
    def frame_bytes(self) -> int:
        return 56 * self.cell + 3 * (4 * self.atoms + 8)


def open_file(path: str):
    """A local file, or one of a store that pyarrow knows by its address."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        return store.open_input_file(inside)
    return open(path, "rb")


def layout(f) -> Layout:
    """Read the head of a file; anything but whole frames without fixed atoms is an error."""
    import struct

    start = f.read(4)
    order = next((o for o in "<>" if len(start) == 4 and struct.unpack(f"{o}i", start)[0] == 84), None)
    if order is None or f.read(4) != b"CORD":
        raise ValueError("not a DCD file")
    control = struct.unpack(f"{order}20i", f.read(80))
    if control[8]:
        raise ValueError("files with fixed atoms are not supported")
    if control[11]:
        raise ValueError("files with a fourth dimension are not supported")
    f.read(4)
    (titles,) = struct.unpack(f"{order}i", f.read(4))
    f.seek(92 + 8 + titles)
    size, atoms, end = struct.unpack(f"{order}3i", f.read(12))
    if size != 4 or end != 4:
        raise ValueError("the record with the number of atoms is damaged")
    out = Layout(order, control[0], control[1], control[2], atoms, bool(control[10]), 92 + 8 + titles + 12)
    f.seek(0, 2)
    held, rest = divmod(f.tell() - out.head, out.frame_bytes)
    if rest:
        raise ValueError(f"the last frame is cut off after {rest} of {out.frame_bytes} bytes")
    out.frames = held  # writers that were stopped leave an old count in the head
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p] if options.get("path") else []
        if not self.paths:
            raise ValueError("a path is needed")
        self.size, self.stride = int(options.get("frames", FRAMES)), int(options.get("stride", 1))
        if self.size < 1 or self.stride < 1:
            raise ValueError("frames and stride must be positive")
        self.low, self.high = int(options.get("start", 0)), options.get("stop")
        self.high = None if self.high is None else int(self.high)

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            low = high = None
            if getattr(f, "attribute", None) == ("frame",):
                if isinstance(f, EqualTo):
                    low, high = f.value, f.value + 1
                elif isinstance(f, GreaterThan):
                    low = f.value + 1
                elif isinstance(f, GreaterThanOrEqual):
                    low = f.value
                elif isinstance(f, LessThan):
                    high = f.value
                elif isinstance(f, LessThanOrEqual):
                    high = f.value + 1
            if low is None and high is None:
                yield f
                continue
            if low is not None:
                self.low = max(self.low, low)
            if high is not None:
                self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with open_file(path) as f:
                frames = layout(f).frames
            stop = frames if self.high is None else min(frames, self.high)
            out += [Range(path, at, min(stop, at + self.size)) for at in range(max(0, self.low), stop, self.size)]
        return out or [Range(self.paths[0], 0, 0)]

    def read(self, partition: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.float32()] * 3, pa.list_(pa.float64())]
        schema = pa.schema([pa.field(f.split()[0], k) for f, k in zip(SCHEMA.split(", "), kinds, strict=True)])
        with open_file(partition.path) as f:
            head = layout(f)
            real, record = np.dtype(f"{head.order}f4"), 4 * head.atoms
            for frame in range(partition.start + -partition.start % self.stride, partition.stop, self.stride):
                f.seek(head.head + frame * head.frame_bytes)
                raw = f.read(head.frame_bytes)
                cell = np.frombuffer(raw, f"{head.order}f8", 6, 4).tolist() if head.cell else None
                at = 56 * head.cell
                xyz = [np.frombuffer(raw, real, head.atoms, at + 4 + i * (record + 8)).astype("f4") for i in range(3)]
                for a in range(0, head.atoms, ATOMS):
                    n = min(ATOMS, head.atoms - a)
                    columns = [[partition.path] * n, np.full(n, frame), np.full(n, head.first_step + frame * head.every), np.arange(a, a + n), *[c[a : a + n] for c in xyz], [cell] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class Trajectory(DataSource):
    """Frames of DCD files, a row for each atom and frame. ``path`` may name several files, with commas."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("dcd")`` known to the session; executors get the code with the tasks."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Trajectory)
