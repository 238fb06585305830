"""NPZ archives of item vectors as a Spark data source: option path, item_key, vector_key, dim, partitions.

`spark.dataSource.register(NpzEmbeddings); spark.read.format("npz_embeddings").option("path", p).load()`.
The arrays are read in slices of rows, one slice a partition, and of these 10,000 rows at a time; float16 becomes
float. A path may be a URI of any file system that pyarrow knows."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Names that an archive may give its ids, in order of preference. Fixed values.
ID_KEYS = ("item_id", "item_ids", "ids", "id")


def id_key(shapes: dict[str, tuple[int, ...]]) -> str:
    """The key of the ids: a usual name, else the only one-dimensional array."""
    for k in ID_KEYS:
        if k in shapes:
            return k
    flat = [k for k, shape in shapes.items() if len(shape) == 1]
    if len(flat) != 1:
        raise ValueError(f"no array of ids among {sorted(shapes)}")
    return flat[0]


class Member:
    """An array of an archive, of which rows are read and no more. It needs a file handle of its own to seek in."""

    def __init__(self, archive: zipfile.ZipFile, key: str):
        self.file = archive.open(f"{key}.npy")
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.file)
        if fortran and len(self.shape) > 1:
            raise ValueError(f"{key} is stored by columns")
        self.begin = self.file.tell()
        self.row = int(np.prod(self.shape[1:])) * self.dtype.itemsize

    def rows(self, begin: int, end: int) -> np.ndarray:
        self.file.seek(self.begin + begin * self.row)
        return np.frombuffer(self.file.read((end - begin) * self.row), self.dtype).reshape(end - begin, *self.shape[1:])


class Slice(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class NpzEmbeddings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_embeddings"

    def schema(self) -> str:
        return "item_id long, embedding array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self.options)


class NpzReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.dim = int(options["dim"]) if "dim" in options else None
        self.vector_key = options.get("vector_key", "embedding")
        self.item_key = options.get("item_key")

    def _open(self) -> tuple[Member, Member]:
        """Ids and vectors, checked by their headers."""
        files, path = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{os.path.abspath(self.path)}")
        archive = lambda: zipfile.ZipFile(files.open_input_file(path))
        found = {n.removesuffix(".npy"): Member(archive(), n.removesuffix(".npy")) for n in archive().namelist()}
        key = self.item_key or id_key({k: m.shape for k, m in found.items()})
        for k in (key, self.vector_key):
            if k not in found:
                raise KeyError(f"{self.path} has no {k}")
        ids, v = found[key], found[self.vector_key]
        if len(ids.shape) != 1 or len(v.shape) != 2 or ids.shape[0] != v.shape[0]:
            raise ValueError(f"ids {ids.shape} and vectors {v.shape} do not fit")
        if self.dim and v.shape[1] < self.dim:
            raise ValueError(f"vectors have {v.shape[1]} elements, {self.dim} are needed")
        return ids, v

    def partitions(self) -> list[InputPartition]:
        n = self._open()[0].shape[0]
        step = max(1, -(-n // self.parts))
        return [Slice(i, min(n, i + step)) for i in range(0, n, step)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        ids, v = self._open()
        for at in range(partition.begin, partition.end, 10_000):
            to = min(partition.end, at + 10_000)
            rows = np.ascontiguousarray(v.rows(at, to)[:, : self.dim], np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids.rows(at, to).astype(np.int64)), lists], ["item_id", "embedding"])


def read_npz(spark: SparkSession, path: str, **options):
    spark.dataSource.register(NpzEmbeddings)
    reader = spark.read.format("npz_embeddings").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
