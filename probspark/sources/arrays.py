"""Array files as tables: .npy by ranges of rows, HDF5 data sets where h5py is installed.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("columns", "0,2").load(path)

A file's header gives the schema (c0, c1, ...); tasks read ranges of rows of about `rangeBytes`, each by one seek. Paths are
opened on the executors through pyarrow's file systems: a folder that all machines mount, or a store that it knows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short", "i1": "byte", "u1": "short", "u2": "int", "u4": "long", "b1": "boolean"}


def _opened(path: str):
    """A random-access file of a local path or a URI."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem().open_input_file(path)
    system, inside = pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(inside)


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, kind of number and place of the first value."""
    with _opened(path) as f:
        head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"unknown version {version} of the npy format")
    shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if by_columns and len(shape) > 1 and min(shape) > 1:
        raise ValueError("arrays are stored by rows")
    if not 1 <= len(shape) <= 2 or dtype.hasobject or dtype.str[1:] not in KINDS:
        raise ValueError("an array of one or two dimensions, of numbers, is needed")
    return shape, dtype, head.tell()


class Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def _ranges(n: int, row_bytes: int, range_bytes: int) -> list[Rows]:
    step = max(1, range_bytes // max(1, row_bytes))
    return [Rows(k, min(n, k + step)) for k in range(0, n, step)] or [Rows(0, 0)]


def _batch(x: np.ndarray, columns: Sequence[int], schema) -> pa.RecordBatch:
    kinds = [pa.from_numpy_dtype(np.dtype({"short": "i2", "long": "i8", "int": "i4", "byte": "i1", "boolean": "?"}.get(kind, {"double": "f8", "float": "f4"}.get(kind)))) for kind in schema]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, c]).astype(x.dtype.newbyteorder("="))).cast(k) for c, k in zip(columns, kinds, strict=True)], names=[f"c{c}" for c in columns])


def _wanted(options: dict, width: int) -> list[int]:
    asked = [int(c) for c in options["columns"].split(",")] if options.get("columns") else list(range(width))
    if any(not 0 <= c < width for c in asked):
        raise ValueError(f"columns are 0 to {width - 1}")
    return asked


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", 64 << 20))
        self.shape, self.dtype, self.place = npy_header(self.path)
        self.width = self.shape[1] if len(self.shape) == 2 else 1
        self.columns = _wanted(options, self.width)
        self.kinds = [KINDS[self.dtype.str[1:]]] * len(self.columns)

    def partitions(self) -> Sequence[InputPartition]:
        return _ranges(self.shape[0], self.width * self.dtype.itemsize, self.range_bytes)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        size = self.width * self.dtype.itemsize
        with _opened(self.path) as f:
            for k in range(partition.start, partition.stop, 65_536):
                n = min(65_536, partition.stop - k)
                x = np.frombuffer(f.read_at(n * size, self.place + k * size), self.dtype).reshape(n, self.width)
                yield _batch(x, self.columns, self.kinds)


class NpySource(DataSource):
    """Options: columns (numbers with commas), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        r = NpyReader(dict(self.options))
        return ", ".join(f"c{c} {k}" for c, k in zip(r.columns, r.kinds, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(dict(self.options))


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict):
        try:
            import h5py
        except ImportError as e:
            raise ImportError("HDF5 files need h5py") from e
        self.path, self.dataset, self.range_bytes = options["path"], options["dataset"], int(options.get("rangebytes", 64 << 20))
        with _opened(self.path) as f, h5py.File(f, "r") as file:
            d = file[self.dataset]
            self.shape, self.dtype = d.shape, d.dtype
        self.width = self.shape[1] if len(self.shape) == 2 else 1
        self.columns = _wanted(options, self.width)
        self.kinds = [KINDS[self.dtype.str[1:]]] * len(self.columns)

    def partitions(self) -> Sequence[InputPartition]:
        return _ranges(self.shape[0], self.width * self.dtype.itemsize, self.range_bytes)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        import h5py

        with _opened(self.path) as f, h5py.File(f, "r") as file:
            for k in range(partition.start, partition.stop, 65_536):
                x = file[self.dataset][k : min(k + 65_536, partition.stop)]
                yield _batch(x.reshape(len(x), self.width), self.columns, self.kinds)


class Hdf5Source(DataSource):
    """Options: dataset, columns, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        r = Hdf5Reader(dict(self.options))
        return ", ".join(f"c{c} {k}" for c, k in zip(r.columns, r.kinds, strict=True))

    def reader(self, schema) -> DataSourceReader:
        return Hdf5Reader(dict(self.options))


def _read(spark: SparkSession, source: type[DataSource], path: str, columns: Sequence[int] | None, **options) -> DataFrame:
    spark.dataSource.register(source)
    if columns is not None:
        options["columns"] = ",".join(map(str, columns))
    return spark.read.format(source.name()).options(**options).load(path)


def read_npy(spark: SparkSession, path: str, columns: Sequence[int] | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows of a .npy array as columns c0, c1, ...; only the asked ones are decoded."""
    return _read(spark, NpySource, path, columns, rangeBytes=range_bytes)


def read_hdf5(spark: SparkSession, path: str, dataset: str, columns: Sequence[int] | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows of a data set of an HDF5 file."""
    return _read(spark, Hdf5Source, path, columns, dataset=dataset, rangeBytes=range_bytes)
