"""Array archives (.npz) as a Spark data source: headers by seeking, rows in ranges, types and shapes as they are.

    spark.dataSource.register(ArrayArchives)
    spark.read.format("array_archives").load(folder)                            # file, row and a column for each array
    spark.read.format("array_archives").option("what", "headers").load(folder)  # one row for each array

A folder is a local path that all machines share, or an address that pyarrow's file systems know. Files are read by
seeking: the archive's directory, then the first bytes of each array, then the rows a task needs. Files of up to SMALL_BYTES
are dealt unopened, many to a task, which checks and reads them; only of larger ones does the driver read headers, to cut them. Arrays of one file have one length, that
of their first axis; arrays of no axis are repeated in each row. Integers and floats keep their width (unsigned ones take
the next), booleans and text their type, and further axes become nested lists. A column that the given schema
calls binary holds the row's bytes. Compressed arrays can't be entered in the middle, so a task
inflates and drops what lies before its rows. Objects are never unpickled. The option pathGlobFilter chooses files by
name before any is opened. (Filters aren't pushed down: Spark 4.1.2 keeps a filter that was pushed into a Python
source for all later uses of the same DataFrame, which would lose rows.)
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of arrays that a task reads.
PARTITION_BYTES = 32 << 20
#: Files of up to so many bytes are read whole by one task, among others.
SMALL_BYTES = 1 << 20
#: What opening a file counts for among the bytes of a task: at most 128 files of PARTITION_BYTES.
OPEN_BYTES = 256 << 10
#: Files whose headers the driver reads at a time to lay out partitions.
HEADER_READERS = 32
HEADERS = "file string, array string, shape array<long>, dtype string, columnar boolean, compressed boolean, bytes long"

_TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}
_ARROW = {"bool": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0), "float16": pa.float32(), "float32": pa.float32(), "float64": pa.float64()}


@dataclass
class Member:
    """An array in an archive; data is the place of its first value within the member."""

    name: str
    shape: tuple[int, ...]
    dtype: np.dtype
    columnar: bool
    compressed: bool
    data: int

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize

    def spark_type(self) -> T.DataType:
        kind = {"U": T.StringType(), "S": T.BinaryType()}.get(self.dtype.kind) or _TYPES.get(self.dtype.name)
        if kind is None:
            raise ValueError(f"{self.name}: no type for {self.dtype}")
        for _ in self.shape[1:]:
            kind = T.ArrayType(kind, False)
        return kind


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def archive_sizes(path: str, glob: str = "*") -> list[tuple[str, int]]:
    """All .npz files under a folder whose names fit a pattern, or the file itself, in order, and their bytes."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    own = system.get_file_info(inner)
    if own.type == fs.FileType.File:
        return [(path, own.size)]
    return sorted((prefix + f.path, f.size) for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(".npz") and fnmatchcase(f.base_name, glob))


def archive_files(path: str, glob: str = "*") -> list[str]:
    """The files of archive_sizes()."""
    return [f for f, _ in archive_sizes(path, glob)]


def packed(files: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Files in order in packs of up to `most` bytes, of which opening one takes OPEN_BYTES."""
    pack, held = [], 0
    for file, size in files:
        if pack and held + size + OPEN_BYTES > most:
            yield pack
            pack, held = [], 0
        pack.append(file)
        held += size + OPEN_BYTES
    if pack:
        yield pack


def members(archive: zipfile.ZipFile, name: str = "") -> list[Member]:
    """The arrays of an archive, from their headers."""
    out = []
    for info in archive.infolist():
        with archive.open(info) as file:
            version = np.lib.format.read_magic(file)
            read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
            if read is None:
                raise ValueError(f"{name}: unknown version {version} of {info.filename}")
            shape, columnar, dtype = read(file)
            out.append(Member(info.filename.removesuffix(".npy"), shape, dtype, columnar, info.compress_type != zipfile.ZIP_STORED, file.tell()))
    return out


def _rows(archive: zipfile.ZipFile, member: Member, start: int, end: int) -> np.ndarray:
    if member.dtype.hasobject:
        raise ValueError(f"{member.name} holds objects")
    with archive.open(member.name + ".npy") as file:
        if member.columnar and len(member.shape) > 1:  # a row is spread over the whole array
            return np.lib.format.read_array(file, allow_pickle=False)[start:end]
        size = member.row_bytes if member.shape else member.dtype.itemsize
        count = end - start if member.shape else 1
        file.seek(member.data + (start * size if member.shape else 0))
        return np.frombuffer(file.read(count * size), member.dtype).reshape((count, *member.shape[1:]) if member.shape else ())


def _column(values: np.ndarray, binary: bool) -> pa.Array:
    """An Arrow array of the rows of an array; lists are built on the flat values, axis by axis."""
    if binary and values.dtype.kind != "S":
        return pa.array([row.tobytes() for row in values], pa.binary())
    flat = values.reshape(-1)
    if values.dtype.kind == "U":
        out = pa.array(flat.tolist(), pa.string())
    elif values.dtype.kind == "S":
        out = pa.array(flat.tolist(), pa.binary())
    elif values.dtype.name == "uint64":
        out = pa.array(flat.tolist(), pa.int64()).cast(pa.decimal128(20, 0)) if flat.max(initial=0) < 1 << 63 else pa.array([int(x) for x in flat], pa.decimal128(20, 0))
    else:
        kind = _ARROW[values.dtype.name]
        out = pa.array(np.ascontiguousarray(flat).astype(values.dtype.newbyteorder("=")).astype(kind.to_pandas_dtype()), kind)
    for axis in range(values.ndim - 1, 0, -1):
        n, width = int(np.prod(values.shape[:axis])), values.shape[axis]
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), out)
    return out


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class _Files(InputPartition):
    """Whole files, unopened so far."""

    files: list[str]


class ArrayArchives(DataSource):
    """Options: what (rows or headers), bytes and rows (of a partition at most), ident (an array of one text that must be the file's name), contract
    (JSON: array -> [types, shape]; null in a shape stands for any size), pathGlobFilter."""

    @classmethod
    def name(cls) -> str:
        return "array_archives"

    def schema(self) -> str | T.StructType:
        if self.options.get("what") == "headers":
            return HEADERS
        files = archive_files(self.options["path"], self.options.get("pathGlobFilter", "*"))
        if not files:
            raise ValueError(f"no archives in {self.options['path']}")
        with _opened(files[0]) as file, zipfile.ZipFile(file) as archive:
            columns = [T.StructField(m.name, m.spark_type()) for m in members(archive, files[0]) if m.name != self.options.get("ident")]
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.what = options["path"], options.get("what", "rows")
        self.bytes, self.ident = int(options.get("bytes", PARTITION_BYTES)), options.get("ident")
        self.rows = int(options.get("rows", 1 << 40))
        self.contract = json.loads(options.get("contract", "{}"))
        self.schema, self.glob = schema, options.get("pathGlobFilter", "*")

    def partitions(self) -> list[InputPartition]:
        files = archive_sizes(self.path, self.glob)
        if self.what == "headers":
            return [_Files(pack) for pack in packed([(f, 0) for f, _ in files], PARTITION_BYTES)] or [_Files([])]
        small = min(SMALL_BYTES, self.bytes)
        out: list[InputPartition] = [_Files(pack) for pack in packed([(f, n) for f, n in files if n <= small], self.bytes)]
        large = [f for f, n in files if n > small]
        with ThreadPoolExecutor(HEADER_READERS) as pool:
            out += [r for ranges in pool.map(self._ranges, large) for r in ranges]
        return out or [_Files([])]

    def _ranges(self, name: str) -> list[_Range]:
        with _opened(name) as file, zipfile.ZipFile(file) as archive:
            return self._cut(name, self._as_wanted(name, archive))

    def _cut(self, name: str, found: list[Member]) -> list[_Range]:
        """Ranges of rows of a file, of the partition's bytes and rows at most."""
        n = max((m.shape[0] for m in found if m.shape), default=1)
        step = min(self.rows, max(1, self.bytes // max(1, sum(m.row_bytes for m in found if m.shape))))
        return [_Range(name, at, min(n, at + step)) for at in range(0, n, step)]

    def _as_wanted(self, name: str, archive: zipfile.ZipFile) -> list[Member]:
        """The members that the schema names, as the contract wants them."""
        known = {m.name: m for m in members(archive, name)}
        wanted = [f.name for f in self.schema if f.name not in ("file", "row")]
        lacking = sorted({*wanted, *self.contract, *([self.ident] if self.ident else [])} - set(known))
        if lacking:
            raise ValueError(f"{name}: missing arrays {lacking}")
        for k, (kinds, shape) in self.contract.items():
            m = known[k]
            if m.dtype.name not in kinds or len(m.shape) != len(shape) or any(b not in (None, a) for a, b in zip(m.shape, shape, strict=True)):
                raise ValueError(f"{name}: {k} is {m.dtype.name} {m.shape}")
        for f in self.schema:
            if f.name in wanted and not isinstance(f.dataType, T.BinaryType) and known[f.name].spark_type().simpleString() != f.dataType.simpleString():
                raise ValueError(f"{name}: {f.name} is {known[f.name].spark_type().simpleString()} instead of {f.dataType.simpleString()}")
        if len({known[k].shape[0] for k in wanted if known[k].shape}) > 1:
            raise ValueError(f"{name}: arrays differ in length: { {k: known[k].shape for k in wanted} }")
        if self.ident:
            own, stem = _rows(archive, known[self.ident], 0, 1), name.rsplit("/", 1)[-1].removesuffix(".npz")
            if known[self.ident].shape not in ((), (1,)) or str(own.reshape(-1)[0]) != stem:
                raise ValueError(f"{name}: {self.ident} isn't the file's name")
        return [known[k] for k in wanted]

    def read(self, partition: _Range | _Files) -> Iterator[Any]:
        for name in partition.files if isinstance(partition, _Files) else [partition.file]:
            with _opened(name) as file, zipfile.ZipFile(file) as archive:
                if self.what == "headers":
                    for m in members(archive, name):
                        yield name, m.name, list(m.shape), m.dtype.str, m.columnar, m.compressed, archive.getinfo(m.name + ".npy").compress_size
                    continue
                wanted = members(archive, name) if isinstance(partition, _Range) else self._as_wanted(name, archive)
                for part in self._cut(name, wanted) if isinstance(partition, _Files) else [partition]:
                    yield self._batch(archive, {m.name: m for m in wanted}, part)

    def _batch(self, archive: zipfile.ZipFile, known: dict[str, Member], part: _Range) -> pa.RecordBatch:
        count, columns = part.end - part.start, []
        for f in self.schema:
            if f.name == "file":
                columns.append(pa.array([part.file] * count, pa.string()))
            elif f.name == "row":
                columns.append(pa.array(np.arange(part.start, part.end)))
            else:
                values = _rows(archive, known[f.name], part.start, part.end)
                columns.append(_column(values if values.ndim else np.repeat(values, count), isinstance(f.dataType, T.BinaryType)))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema])
