"""Dense ``.npy`` matrices as a splittable source (S7) and an ordered sink.

Both are Python data sources.  The reader's planner reads only the headers and cuts each
matrix into ranges of rows of about ``split_bytes``, so one large file is read
by many tasks, each by seeks into its own bytes.  The writer gives every key (a species) one
matrix file: a row's bytes have a fixed place in it (header + place x row
bytes), so tasks write their rows into the file side by side, a task that runs
again writes the same bytes to the same place, and the commit, which checks the
number of rows of every file, only renames them.

Paths are plain or ``file:`` paths, or URIs that pyarrow opens (reading only); the sink
needs a file system on which tasks can write at a position (local, NFS, Lustre).
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from numpy.lib import format as npy_format
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sporeframe.functions.clean import path_safe
from sporeframe.operators.ranking import group_row_number

NPY_SCHEMA = "source string, row_idx bigint, embedding array<float>"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Header:
    """Where a matrix's numbers lie in its file."""

    rows: int
    width: int
    dtype: str
    by_column: bool
    offset: int


def read_header(f) -> Header:
    version = npy_format.read_magic(f)
    read = npy_format.read_array_header_1_0 if version == (1, 0) else npy_format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if dtype.hasobject or dtype.kind not in "fiub":
        raise ValueError(f"not a matrix of numbers: {dtype}")
    if len(shape) < 2:  # a vector, or one number, is one row
        shape, by_column = (1, int(np.prod(shape))), False
    width = int(np.prod(shape[1:]))
    if by_column and len(shape) > 2:
        raise ValueError("a matrix of more than two dimensions has to be stored row by row")
    return Header(shape[0], width, dtype.str, by_column and width > 1, f.tell())


@dataclass
class RowRange(InputPartition):
    path: str
    header: Header
    first: int
    end: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.npy")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[RowRange]:
        fs, base = _open(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else "file:" if not self.path.startswith("file://") else "file://"
        info = fs.get_file_info(base)
        found = fs.get_file_info(pa.fs.FileSelector(base, recursive=True)) if info.type == pa.fs.FileType.Directory else [info]
        parts = []
        for file in sorted((x for x in found if x.type == pa.fs.FileType.File), key=lambda x: x.path):
            if info.type == pa.fs.FileType.Directory and not fnmatch.fnmatch(os.path.basename(file.path), self.glob):
                continue
            with fs.open_input_file(file.path) as f:
                header = read_header(f)
            step = max(1, self.split_bytes // max(1, header.width * np.dtype(header.dtype).itemsize))
            parts += [RowRange(scheme + file.path, header, lo, min(lo + step, header.rows)) for lo in range(0, header.rows, step)]
        return parts or [RowRange("", Header(0, 0, "<f4", False, 0), 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if part.end == part.first:
            return
        fs, path = _open(part.path)
        h, dtype = part.header, np.dtype(part.header.dtype)
        step = max(1, BATCH_BYTES // max(1, h.width * 4))
        with fs.open_input_file(path) as f:
            for lo in range(part.first, part.end, step):
                hi = min(lo + step, part.end)
                if h.by_column:  # a stretch of every column
                    cols = []
                    for c in range(h.width):
                        f.seek(h.offset + (c * h.rows + lo) * dtype.itemsize)
                        cols.append(np.frombuffer(f.read((hi - lo) * dtype.itemsize), dtype=dtype))
                    block = np.column_stack(cols)
                else:
                    f.seek(h.offset + lo * h.width * dtype.itemsize)
                    block = np.frombuffer(f.read((hi - lo) * h.width * dtype.itemsize), dtype=dtype).reshape(hi - lo, h.width)
                flat = pa.array(np.ascontiguousarray(block, dtype=np.float32).ravel())
                offsets = pa.array(np.arange(0, (hi - lo + 1) * h.width, h.width, dtype=np.int32) if h.width else np.zeros(hi - lo + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * (hi - lo)), pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(offsets, flat)],
                                                 names=["source", "row_idx", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """By file: its key, how many rows it has in all, and how many of them this task wrote."""

    files: dict[str, tuple[str, int, int]]


class NpyWriter(DataSourceArrowWriter):
    """Rows ``(key, file, place, rows, embedding)``: row ``place`` of ``rows`` of matrix ``file``."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        fs, self.path = _open(options["path"])
        if not isinstance(fs, pa.fs.LocalFileSystem):
            raise ValueError("matrices are written by position: the path must be a mounted file system")
        self.dtype, self.overwrite = np.dtype(options.get("dtype", "float32")), overwrite
        self.scratch = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.scratch, exist_ok=True)
        files: dict[str, tuple[str, int, int]] = {}
        name, out, width, start = None, None, 0, 0
        try:
            for batch in batches:
                vectors = batch.column("embedding")
                ends = vectors.offsets.to_numpy()
                values = vectors.values.to_numpy(zero_copy_only=False)
                for i, (key, file, place, rows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "file", "place", "rows")))):
                    row = values[ends[i] : ends[i + 1]].astype(self.dtype)
                    if file != name:  # rows come by file and place
                        if out:
                            out.close()
                        name, width = file, len(row)
                        out = os.fdopen(os.open(f"{self.scratch}/{file}", os.O_RDWR | os.O_CREAT, 0o644), "r+b")
                        npy_format.write_array_header_1_0(out, {"descr": npy_format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": (rows, width)})
                        start = out.tell()
                    if len(row) != width:
                        raise ValueError(f"{key}: vectors of {width} and {len(row)} values")
                    out.seek(start + place * width * self.dtype.itemsize)
                    out.write(row.tobytes())
                    old = files.get(file, (key, rows, 0))
                    if old[0] != key:
                        raise ValueError(f"{old[0]!r} and {key!r} would share the file {file}")
                    files[file] = (key, rows, old[2] + 1)
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        have: dict[str, tuple[str, int, int]] = {}
        for m in (m for m in messages if m):
            for file, (key, rows, n) in m.files.items():
                old = have.get(file, (key, rows, 0))
                if old[:2] != (key, rows):
                    raise ValueError(f"{old[0]!r} and {key!r} would share the file {file}")
                have[file] = (key, rows, old[2] + n)
        short = [f for f, (_, rows, n) in have.items() if rows != n]
        if short:
            raise ValueError(f"rows are missing or double in {short[:3]}")
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in os.listdir(self.path):
                if old.endswith(".npy") and old not in have:
                    os.remove(f"{self.path}/{old}")
        for file in have:
            os.replace(f"{self.scratch}/{file}", f"{self.path}/{file}")
        if os.path.isdir(self.scratch) and not os.listdir(self.scratch):
            os.rmdir(self.scratch)

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.scratch):
            for file in os.listdir(self.scratch):
                os.remove(f"{self.scratch}/{file}")
            os.rmdir(self.scratch)


class NpySource(DataSource):
    """``format("npy_matrix")``: options ``path``, ``glob``, ``split_bytes`` (reading), ``dtype`` (writing)."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return NPY_SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def read_npy(spark: SparkSession, path: str, glob_filter: str = "*.npy", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Dense ``.npy`` matrices below ``path`` to ``(source, row_idx, embedding)`` rows, row order kept as ``row_idx``.

    Matrices stored by row or by column, of any numeric type (cast to float); a vector is one row; further dimensions are
    flattened; an empty matrix, or no file, gives no rows."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_matrix").option("glob", glob_filter).option("split_bytes", split_bytes).load(path)


def write_npy(df: DataFrame, path: str, key: str, order_cols: Sequence[str], vector: str, dtype: str = "float32", mode: str = "overwrite") -> None:
    """One ``<key>.npy`` matrix per key (spaces become ``_``, a NULL key ``null``), rows in the order of ``order_cols``.

    ``order_cols`` must give a total order inside a key.  Rows are numbered without gathering a key in one task,
    and rows of a large key are written by several.  A key without rows writes no file.  Vectors of one key must
    have one length, and none may be NULL; two keys that would share a file are an error."""
    spark = df.sparkSession
    spark.dataSource.register(NpySource)
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = df.select(name.alias("key"), F.concat(path_safe(name), F.lit(".npy")).alias("file"), *order_cols, F.col(vector).cast("array<double>").alias("embedding"))
    numbered = group_row_number(rows, ["key"], list(order_cols), "_rn", count_name="rows")
    out = numbered.select("key", "file", (F.col("_rn") - 1).alias("place"), "rows", "embedding")
    out = out.repartitionByRange("file", "place").sortWithinPartitions("file", "place")
    out.write.format("npy_matrix").option("dtype", dtype).mode(mode).save(path)
