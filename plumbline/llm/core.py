"""Shared parts of the data pipeline operators: scratch tables, byte-level word hashing, links to components."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so batches stay small; the hashing below also cuts them by bytes.
BATCH_ROWS = 400
#: Bytes that are hashed at a time.
PIECE = 1 << 18
#: Rows of (id) or (id, few longs) that may be broadcast: 1 M rows are some 30 MB. Larger sides are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Edges (two longs) of which the driver finds the components itself: 4 MB. More of them take rounds of joins.
DRIVER_EDGES = 1 << 18

_own: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one does in local mode; on a cluster it is an
    error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
        _own.append((spark, base))
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is removed when the driver ends, since lazy results may read it until then."""
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex[:12]}"
    _own.append((spark, path))
    return path


def scratch_made() -> list[str]:
    """The paths that this driver has made and not dropped."""
    return [path for _, path in _own]


def drop_scratch(paths: list[str]) -> None:
    """Deletes scratch tables that nothing reads any more: after the results that read them were written."""
    for spark, path in [x for x in _own if x[1] in set(paths)]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _own.remove((spark, path))


@atexit.register
def _clean() -> None:
    try:
        drop_scratch(scratch_made())
    except Exception:  # noqa: BLE001 - the session may be gone
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def finer_partitions(spark: SparkSession, times: int = 4) -> Iterator[None]:
    """Shuffles of what is run within have so many times the usual number of partitions, and small ones are not put together: for exchanges of many
    short rows, whose hash tables take far more memory than their compressed bytes tell."""
    keys = {"spark.sql.shuffle.partitions": str(times * int(spark.conf.get("spark.sql.shuffle.partitions"))), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_file(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a file in the shared folder, for executors that read or write it themselves."""
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks: Iterable[bytes]) -> None:
    """The file appears whole or not at all: a task that is run again writes beside and moves."""
    system, path = shared_file(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    aside = _aside(path)
    with system.open_output_stream(aside) as f:
        for chunk in chunks:
            f.write(chunk)
    _put(system, aside, path)


def write_parquet(uri: str, batches: list[pa.RecordBatch]) -> None:
    """A Parquet file of a task's own; whole or not at all, as write_whole."""
    system, path = shared_file(uri)
    aside = _aside(path)
    pq.write_table(pa.Table.from_batches(batches), aside, filesystem=system)
    _put(system, aside, path)


def _aside(path: str) -> str:
    """A name beside path, hidden from readers of the folder, of its own for each attempt."""
    folder, name = path.rsplit("/", 1)
    return f"{folder}/_{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else uuid.uuid4().hex[:8]}.part"


def _put(system: fs.FileSystem, aside: str, path: str) -> None:
    """Moves aside to path. Where moving does not replace a file, an earlier attempt's file is as good."""
    try:
        system.move(aside, path)
    except OSError:
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(aside)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts may be long. The setting is read when a plan runs, long after it was made, so it stays; one that is smaller
    already is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release_memory() -> None:
    """Gives what a task has freed back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with small batches; memory goes back after each task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def worker_cache() -> dict:
    """What a Python process keeps from task to task (functions travel by value, so their globals do not last)."""
    return vars(sys.modules.setdefault("_plumbline_cache", types.ModuleType("_plumbline_cache")))


# --- hashing -------------------------------------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of splitmix64)."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, _U), np.cumprod(np.full(max(n - 1, 0), base, _U), dtype=_U)])


#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache()
    if len(kept.get("up", ())) < n:
        kept["up"], kept["down"] = _powers(BASE, n), _powers(INVERSE, n)
    return kept["up"], kept["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (in order, apart): the sum of table[byte] * BASE**(place in the span), from running sums over pieces
    that end between spans."""
    out = np.empty(len(starts), _U)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            stop = ends[j - 1]
            up, down = _power_tables(max(PIECE, int(stop - base)) + 1)
            run = np.zeros(stop - base + 1, _U)
            np.cumsum(table[data[base:stop]] * up[: stop - base], out=run[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix64((run[e] - run[s]) * down[s] + (e - s).astype(_U))
            i = j
    return out


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts: starts and ends (byte positions), a 64-bit hash each, and by document the index of its
    first word (bounds, one more than documents)."""

    def __init__(self, texts: pa.Array, lower: bool = False, separators: bytes = b" \t\n\x0b\x0c\r", hashed: bool = True):
        self.data, self.offsets = text_bytes(texts)
        table = np.ones(256, bool)
        table[list(separators)] = False
        inside = table[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[at] = inside[at]
        last = inside.copy()  # at i: the word ends with byte i
        last[:-1] &= ~inside[1:]
        before = at[at > 0] - 1
        last[before] = inside[before]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(lower) if hashed else np.zeros(0, _U)

    def _hash(self, lower: bool) -> np.ndarray:
        codes = np.arange(256)
        if lower:
            codes[65:91] += 32
        return hash_spans(self.data, self.starts, self.ends, mix64(codes.astype(_U) + _U(0x1234567)))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each document, in order, and the bounds by document. A document of fewer words gives its whole sequence as one;
    without words, none."""
    counts, n = np.diff(bounds), len(hashes)
    odd = mix64(np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, _U)
        for j in range(min(k, n)):
            total[: n - j] += hashes[j:] * odd[j] if j else hashes * odd[0]
        total += _U(k)
        left = np.repeat(bounds[1:], counts) - np.arange(n)
        valid = left >= k
        for m in range(1, k):
            at = bounds[:-1][counts == m]
            if len(at):
                total[at] = sum((hashes[at + j] * odd[j] for j in range(m)), np.zeros(len(at), _U)) + _U(m)
                valid[at] = True
    return mix64(total[valid]), np.concatenate([[0], np.cumsum(valid, dtype=np.int64)])[bounds]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a piece has about so many bytes of text (one row at least)."""
    _, offsets = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, _U).view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


# --- components ----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: long): rows (node, component), component the least node reachable.

    Up to DRIVER_EDGES edges go to the driver, since each round of joins costs it far more memory in plans than they take. Of more, large-star and
    small-star steps alternate until nothing changes (each links every node to the least of its neighbours, so they end); each round is a table in the
    shared folder. No edges give no rows; self-loops and nulls are ignored."""
    spark = edges.sparkSession
    e = materialize(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.count() <= DRIVER_EDGES:
        t = e.toArrow()
        node, component = least_reachable(t["u"].to_numpy(), t["v"].to_numpy())
        return spark.createDataFrame(pa.table({"node": node, "component": component}), "node long, component long")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = materialize(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), sorted, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]  # trees are flat here, so these are their tops
        if np.array_equal(x, y):
            return nodes, nodes[top]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(top, up := top[top]):
            top = up
