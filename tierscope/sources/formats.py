"""Binary layouts of vector files and graph indexes, and their Spark sources.

All numbers are little-endian. Fixed values of the layouts:
matrix: int32 rows, int32 columns, then rows; index: a 4096-byte first sector
with an int32 9 x 1 header and nine u64 (nodes, dimensions, medoid, node bytes,
nodes per sector, frozen count, frozen place, reorder flag, file size), then
sectors of node records (vector, u32 degree, slots of u32); truth: int32 queries,
int32 k, int32 ids, float32 distances; pivots: a u64 offset table (4 or 5
sections) before 256 centroids, center and chunk offsets.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tierscope.sources import files

SECTOR = 4096
TYPES = {"f4": "<f4", "u1": "u1", "u4": "<u4", "u8": "<u8", "i4": "<i4"}
#: Rows of a matrix per partition of a scan.
ROWS = 250_000


def header(path: str, offset: int = 0) -> tuple[int, int]:
    """Rows and columns at ``offset``."""
    raw = files.read(path, offset, 8)
    if len(raw) < 8:
        raise ValueError(f"{path}: no header at {offset}")
    return struct.unpack("<ii", raw)


def section(path: str, dtype: str, offset: int = 0, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Rows lo..hi of a section; ValueError if the file ends before."""
    rows, cols = header(path, offset)
    kind = np.dtype(TYPES[dtype])
    need = offset + 8 + rows * cols * kind.itemsize
    if (have := files.size(path) or 0) < need:
        raise ValueError(f"{path}: {need} bytes needed, file has {have}")
    hi = rows if hi is None else hi
    width = cols * kind.itemsize
    return np.frombuffer(files.read(path, offset + 8 + lo * width, (hi - lo) * width), kind).reshape(hi - lo, cols)


def packed(x: np.ndarray, dtype: str) -> bytes:
    """A section as it is in a file: rows, columns, values."""
    return struct.pack("<ii", *x.shape) + np.ascontiguousarray(x, TYPES[dtype]).tobytes()


def write_section(path: str, x: np.ndarray, dtype: str = "f4") -> None:
    files.write(path, [packed(x, dtype)])


@dataclass(frozen=True)
class IndexMeta:
    npts: int
    ndims: int
    medoid: int
    node_bytes: int
    per_sector: int
    frozen: int
    frozen_at: int
    reorder: bool
    file_size: int
    slots: int


def index_meta(path: str, dtype: str) -> IndexMeta:
    """Metadata of an index file, with the slots of a list derived from it."""
    rows, cols = header(path)
    if cols != 1:
        raise ValueError(f"{path}: {cols} columns of metadata")
    if rows == 12:
        raise NotImplementedError("indexes built with reordered data aren't supported")
    if rows != 9:
        raise ValueError(f"{path}: {rows} metadata fields")
    n, d, medoid, size, per, frozen, at, reorder, total = (int(v) for v in section(path, "u8")[:, 0])
    rest = size - d * np.dtype(TYPES[dtype]).itemsize - 4
    if per < 1 or rest < 0 or rest % 4:
        raise ValueError(f"{path}: node records of {size} bytes don't fit {d} x {dtype}")
    return IndexMeta(n, d, medoid, size, per, frozen, at, bool(reorder), total, rest // 4)


def node_offset(meta: IndexMeta, node: int) -> int:
    if not 0 <= node < meta.npts:
        raise IndexError(f"node {node} of {meta.npts}")
    return (node // meta.per_sector + 1) * SECTOR + (node % meta.per_sector) * meta.node_bytes


def read_nodes(path: str, meta: IndexMeta, dtype: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, degrees and slots of nodes lo..hi; padding never leaves here."""
    first, last = lo // meta.per_sector, (hi - 1) // meta.per_sector
    raw = np.frombuffer(files.read(path, (first + 1) * SECTOR, (last - first + 1) * SECTOR), np.uint8).reshape(-1, SECTOR)
    records = raw[:, : meta.per_sector * meta.node_bytes].reshape(-1, meta.node_bytes)[lo - first * meta.per_sector : hi - first * meta.per_sector]
    width = meta.ndims * np.dtype(TYPES[dtype]).itemsize
    cell = lambda a, b, t: np.ascontiguousarray(records[:, a:b]).view(t)
    return cell(0, width, TYPES[dtype]), cell(width, width + 4, "<u4")[:, 0], cell(width + 4, meta.node_bytes, "<u4")


def write_index_rows(path: str, rows: Iterable[tuple], n: int, d: int, slots: int, medoid: int, dtype: str = "f4") -> None:
    """An index file from (vector, neighbours) in order of node, a sector at a time."""
    size = d * np.dtype(TYPES[dtype]).itemsize + 4 + 4 * slots
    per = SECTOR // size
    if per < 1:
        raise ValueError("a node record is larger than a sector")
    meta = np.array([n, d, medoid, size, per, 0, 0, 0, (-(-n // per) + 1) * SECTOR], "<u8")

    def body() -> Iterator[bytes]:
        yield (struct.pack("<ii", 9, 1) + meta.tobytes()).ljust(SECTOR, b"\0")
        sector = b""
        for i, (vector, nbrs) in enumerate(rows):
            record = np.ascontiguousarray(vector, TYPES[dtype]).tobytes() + struct.pack("<I", len(nbrs)) + np.array(nbrs, "<u4").tobytes()
            sector += record.ljust(size, b"\0")
            if i % per == per - 1:
                yield sector.ljust(SECTOR, b"\0")
                sector = b""
        if sector:
            yield sector.ljust(SECTOR, b"\0")

    files.write(path, body())


def write_index(path: str, vectors: np.ndarray, nbrs: list[list[int]], slots: int, medoid: int, dtype: str = "f4") -> None:
    write_index_rows(path, zip(vectors, nbrs, strict=True), *vectors.shape, slots, medoid, dtype)


def read_pivots(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(256 x dims centroids, center, chunk offsets) of a pivots file."""
    table = section(path, "u8")[:, 0]
    if len(table) not in (4, 5):
        raise ValueError(f"{path}: {len(table)} sections")
    centroids, middle = section(path, "f4", int(table[0])), section(path, "f4", int(table[1]))
    chunks = section(path, "u4", int(table[3 if len(table) == 5 else 2]))
    if centroids.shape[0] != 256 or middle.shape != (centroids.shape[1], 1):
        raise ValueError(f"{path}: {centroids.shape} centroids, {middle.shape} center")
    return centroids, middle[:, 0], chunks[:, 0]


def write_pivots(path: str, centroids: np.ndarray, middle: np.ndarray, chunks: np.ndarray) -> None:
    parts = [(centroids, "f4"), (middle[:, None], "f4"), (chunks[:, None], "u4")]
    at, offsets = SECTOR, []
    for x, _ in parts:
        offsets.append(at)
        at += 8 + x.shape[0] * x.shape[1] * 4
    table = packed(np.array([*offsets, at], "<u8")[:, None], "u8")
    files.write(path, [table.ljust(SECTOR, b"\0"), *(packed(x, t) for x, t in parts)])


def entry_points(index_path: str, dtype: str) -> tuple[list[int], np.ndarray]:
    """Ids and vectors: the medoid files if both are there, else the medoid."""
    ids, vectors = f"{index_path}_medoids.bin", f"{index_path}_centroids.bin"
    if files.size(ids) is not None and files.size(vectors) is not None:
        i, v = section(ids, "u4")[:, 0], section(vectors, "f4")
        if len(i) != len(v):
            raise ValueError(f"{len(i)} medoids and {len(v)} centroids")
        return [int(x) for x in i], v
    meta = index_meta(index_path, dtype)
    v, _, _ = read_nodes(index_path, meta, dtype, meta.medoid, meta.medoid + 1)
    return [meta.medoid], v.astype("<f4")


@dataclass
class Rows(InputPartition):
    lo: int
    hi: int


class MatrixReader(DataSourceReader):
    """Row ranges of a matrix file; columns row_id and values."""

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], options.get("dtype", "f4")
        self.offset, self.rows = int(options.get("offset", 0)), int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        n, _ = header(self.path, self.offset)
        section(self.path, self.dtype, self.offset, 0, 0)
        return [Rows(lo, min(lo + self.rows, n)) for lo in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for lo in range(partition.lo, partition.hi, 10_000):
            x = section(self.path, self.dtype, self.offset, lo, min(lo + 10_000, partition.hi)).astype(np.float64)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["row_id", "values"])


@dataclass
class Part(WriterCommitMessage):
    """A task's rows in order of their ids, in a file beside the target."""

    path: str
    rows: int
    cols: int


class MatrixWriter(DataSourceWriter):
    """Rows (row_id, values) as one matrix file, in order of row_id.

    Every task attempt writes a file of its own beside the target, in the same
    store; the driver joins those that the messages name, a chunk of each at a
    time, so leftovers of failed attempts don't count and its memory is bounded.
    """

    CHUNK = 4_096

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], options.get("dtype", "f4")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        data = sorted((r[0], list(r[1])) for r in rows)
        context = TaskContext.get()
        name = f"{self.path}.part-{context.partitionId():06d}-{context.taskAttemptId()}"
        x = np.array([v for _, v in data], TYPES[self.dtype]).reshape(len(data), -1) if data else np.zeros((0, 0), TYPES[self.dtype])
        ids = np.array([i for i, _ in data], "<i8").reshape(-1, 1)
        if data:
            files.write(name, [np.concatenate([ids.view(np.uint8), x.view(np.uint8)], 1).tobytes()])
        return Part(name, *x.shape)

    def _rows(self, part: Part) -> Iterator[tuple[int, bytes]]:
        width = 8 + part.cols * np.dtype(TYPES[self.dtype]).itemsize
        for lo in range(0, part.rows, self.CHUNK):
            raw = files.read(part.path, lo * width, min(self.CHUNK, part.rows - lo) * width)
            for at in range(0, len(raw), width):
                yield int.from_bytes(raw[at : at + 8], "little", signed=True), raw[at + 8 : at + width]

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None and m.rows]
        if len({m.cols for m in parts}) > 1:
            self.abort(messages)
            raise ValueError(f"{self.path}: rows of different lengths")

        def body() -> Iterator[bytes]:
            yield struct.pack("<ii", sum(m.rows for m in parts), parts[0].cols if parts else 0)
            for _, raw in heapq.merge(*map(self._rows, parts), key=lambda r: r[0]):
                yield raw

        files.write(self.path, body())
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                files.delete(m.path)


class MatrixSource(DataSource):
    """``spark.read.format("matrixfile").option("dtype", "f4").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "matrixfile"

    def schema(self) -> str:
        return "row_id long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MatrixWriter(dict(self.options))


class GraphReader(DataSourceReader):
    """Node ranges of an index file. Filters on node_id narrow the ranges (see
    ``register``)."""

    def __init__(self, options: dict):
        self.path, self.dtype, self.rows = options["path"], options.get("dtype", "f4"), int(options.get("rows", ROWS))
        self.lo, self.hi = 0, None

    def pushFilters(self, filters):
        from pyspark.sql import datasource as ds

        for f in filters:
            if getattr(f, "attribute", None) == ("node_id",) and isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual, ds.GreaterThan, ds.LessThanOrEqual, ds.LessThan)):
                if isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual, ds.GreaterThan)):
                    self.lo = max(self.lo, f.value + isinstance(f, ds.GreaterThan))
                if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual, ds.LessThan)):
                    top = f.value + (not isinstance(f, ds.LessThan))
                    self.hi = top if self.hi is None else min(self.hi, top)
            yield f  # Spark checks them again

    def partitions(self) -> list[InputPartition]:
        meta = index_meta(self.path, self.dtype)
        hi = meta.npts if self.hi is None else min(self.hi, meta.npts)
        return [Rows(lo, min(lo + self.rows, hi)) for lo in range(self.lo, hi, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        meta = index_meta(self.path, self.dtype)
        for lo in range(partition.lo, partition.hi, 10_000):
            hi = min(lo + 10_000, partition.hi)
            v, degree, slots = read_nodes(self.path, meta, self.dtype, lo, hi)
            for i in range(hi - lo):
                d = int(degree[i])
                yield lo + i, v[i].astype(float).tolist(), d, slots[i, :d].astype(int).tolist()


class GraphSource(DataSource):
    """``spark.read.format("graphindex").option("dtype", "f4").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "graphindex"

    def schema(self) -> str:
        return "node_id long, vec array<double>, degree int, nbrs array<long>"

    def reader(self, schema) -> DataSourceReader:
        return GraphReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let them see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
    spark.dataSource.register(GraphSource)


def read_pivots_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunk, centroid, sub) and the center of a pivots file."""
    c, middle, at = read_pivots(path)
    rows = [(k, j, c[j, at[k] : at[k + 1]].astype(float).tolist()) for k in range(len(at) - 1) for j in range(256)]
    return spark.createDataFrame(rows, "chunk long, centroid long, sub array<double>"), spark.createDataFrame([(middle.astype(float).tolist(),)], "center array<double>")


def read_truth(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """query_id, rank, node_id, dist of a truth file, by ranges of queries."""
    n, k = header(path)
    if (files.size(path) or 0) < 8 + 8 * n * k:
        raise ValueError(f"{path}: {8 + 8 * n * k} bytes needed, file has {files.size(path)}")
    starts = spark.createDataFrame([(lo,) for lo in range(0, n, rows)], "lo long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                m = min(rows, n - lo) * k
                ids = np.frombuffer(files.read(path, 8 + 4 * lo * k, 4 * m), "<i4")
                dist = np.frombuffer(files.read(path, 8 + 4 * n * k + 4 * lo * k, 4 * m), "<f4")
                at = np.arange(m)
                yield pa.RecordBatch.from_arrays([pa.array(lo + at // k), pa.array(at % k), pa.array(ids.astype(np.int64)), pa.array(dist.astype(np.float64))], names=["query_id", "rank", "node_id", "dist"])

    return starts.repartition(max(1, -(-n // rows))).mapInArrow(run, "query_id long, rank long, node_id long, dist double")


def write_truth(truth: DataFrame, path: str) -> None:
    """A truth file from (query_id, rank, node_id, dist); k ids a query.

    Executors write ids and distances as matrix files beside it, and the driver
    copies them into one, a chunk at a time.
    """
    from pyspark.sql import functions as F

    lists = truth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "dist"))).alias("x"))
    register(truth.sparkSession)
    sides = [(f"{path}.ids", "i4", F.col("x.node_id")), (f"{path}.dists", "f4", F.col("x.dist"))]
    for name, dtype, values in sides:
        lists.select(F.col("query_id").alias("row_id"), values.cast("array<double>").alias("values")).write.format("matrixfile").mode("append").option("dtype", dtype).save(name)

    def body() -> Iterator[bytes]:
        yield files.read(sides[0][0], 0, 8)
        for name, _, _ in sides:
            total = files.size(name) or 0
            for at in range(8, total, 1 << 24):
                yield files.read(name, at, min(1 << 24, total - at))

    files.write(path, body())
    for name, _, _ in sides:
        files.delete(name)


def read_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All JSON records of a folder; the schema is given, as maps would else be
    taken for structs."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


#: What a curve file holds.
CURVE = "order string, bytes_total double, mean_recall double, normalized_recall double"


def write_curve(curve: DataFrame, path: str) -> None:
    """A curve as one CSV file with a header; curves have a row per fraction."""
    curve.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_curve(spark: SparkSession, path: str, schema: str = CURVE) -> DataFrame:
    """Curves with the given columns; a file with another header is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A validation report (one row) as one JSON record."""
    report.coalesce(1).write.mode("overwrite").json(path)
