"""Token ids in binary shards, with a minimal perfect hash index from document key to place."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.core import map_arrow, mix64, shared_file, slices, write_parquet, write_whole
from plumbline.llm.tokens import ENCODE_BYTES, Encoder

#: A shard: MAGIC, the bytes of an id (u8: 2 if the vocabulary allows, else 4), then the raw ids (little-endian), then for each document the end of its ids (u64), then the number of documents (u64).
MAGIC = b"TOKSHRD"
#: An index file: INDEX_MAGIC, the length of a JSON header (u32), the header, the seeds (u32 by bucket), and by slot a fingerprint (u32), a shard (u32), the first id's place (u64), the number of ids (u64) and of documents (u32).
INDEX_MAGIC = b"TOKMPHF1"
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("ids", "<u8"), ("documents", "<u4")])
#: Keys of a bucket on average. More: fewer seeds, longer search.
BUCKET = 4
#: Keys of an index file, about: some 3 MB. There are as many files as the number of keys asks for.
INDEX_KEYS = 1 << 16
#: Tasks of an exchange by index file or shard; beyond it several files fall to a task.
MOST_TASKS = 100_000
#: Bytes of text that a shard is to hold, about.
SHARD_BYTES = 32 << 20


# --- the hash --------------------------------------------------------------------------------------


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def build_mphf(h: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct 64-bit values by hash and displace: buckets in falling size each try seeds until their keys fall on
    free slots. Slot of h: _slot(h, seeds[bucket], n)."""
    n = len(h)
    m = n // BUCKET + 1
    bucket = (mix64(h + np.uint64(1)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    ends = np.cumsum(size)
    seeds = np.zeros(m, np.uint32)
    free = np.ones(n, bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        keys = h[order[ends[b] - size[b] : ends[b]]]
        start = 0
        while True:
            with np.errstate(over="ignore"):
                slots = (mix64(keys[:, None] ^ ((tries + np.uint64(start)) * np.uint64(0x9E3779B97F4A7C15))[None, :]) % np.uint64(n)).astype(np.int64)
            good = free[slots].all(0)
            for t in np.flatnonzero(good):
                mine = slots[:, t]
                if len(set(mine.tolist())) == len(mine):
                    free[mine] = False
                    seeds[b] = start + int(tries[t])
                    break
            else:
                start += 64
                if start > 1 << 26:
                    raise ValueError("two keys of an index have the same 64-bit hash")
                continue
            break
    return seeds


class KeyIndex:
    """One index file, read; lookups take constant time: bucket, seed, slot, fingerprint."""

    def __init__(self, data: bytes):
        assert data[:8] == INDEX_MAGIC, "not an index file"
        (length,) = struct.unpack_from("<I", data, 8)
        self.n = json.loads(data[12 : 12 + length])["keys"]
        m = self.n // BUCKET + 1
        self.seeds = np.frombuffer(data, "<u4", m, 12 + length)
        self.slots = np.frombuffer(data, SLOT, self.n, 12 + length + 4 * m)

    @staticmethod
    def pack(h: np.ndarray, prints: np.ndarray, shard: np.ndarray, start: np.ndarray, ids: np.ndarray, documents: np.ndarray) -> Iterator[bytes]:
        seeds = build_mphf(h)
        slots = np.zeros(len(h), SLOT)
        at = _slot(h, seeds[(mix64(h + np.uint64(1)) % np.uint64(len(seeds))).astype(np.int64)], len(h))
        for name, values in (("fingerprint", prints), ("shard", shard), ("start", start), ("ids", ids), ("documents", documents)):
            slots[name][at] = values
        header = json.dumps({"keys": len(h)}).encode()
        yield INDEX_MAGIC + struct.pack("<I", len(header)) + header
        yield seeds.astype("<u4").tobytes()
        yield slots.tobytes()

    def find(self, h: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the keys, and whether the stored fingerprint agrees (a key that is not there agrees once in 2**32)."""
        if not self.n:
            return np.zeros(0, SLOT), np.zeros(len(h), bool)
        s = self.slots[_slot(h, self.seeds[(mix64(h + np.uint64(1)) % np.uint64(len(self.seeds))).astype(np.int64)], self.n)]
        return s, s["fingerprint"] == prints


# --- writing and reading -----------------------------------------------------------------------------


def _hashes(key: str) -> list:
    """Of a key of any type, null included: its 64-bit hash and its fingerprint's source."""
    c = F.col(key).cast("string")
    return [F.xxhash64(c.isNull(), c).alias("h"), F.xxhash64(F.lit(7), c.isNull(), c).alias("h2")]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Writes all documents' ids (null text: empty), each with end_id behind, in ascending order of the key (null first, repeated keys side by side by
    text) into path/shards, what is in each shard into path/manifest (Parquet, a file a shard), and the index into path/index. Tasks write all of
    these files themselves, each whole or not at all; a task that is run again writes the same.

    Sorting is a range exchange on the key and a hash of the text, so that a key with a third of all rows is split over tasks; each task streams one shard."""
    spark = docs.sparkSession
    size = int(docs.select(F.col(text_col))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(shuffle, min(200_000, size // shard_bytes + 1))
    d = docs.select(F.col(key_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("tie"))
    d = d.repartitionByRange(shards, F.col("key").asc_nulls_first(), "tie").sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", "text").select("key", "text")

    kind = d.schema["key"].dataType.simpleString()
    for folder in ("shards", "manifest", "index"):
        system, name = shared_file(f"{path}/{folder}")
        system.create_dir(name, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of(tokenizer), TaskContext.get().partitionId()
        narrow = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        ends, told = [np.zeros(1, np.int64)], []

        def chunks() -> Iterator[bytes]:
            yield MAGIC + bytes([2 if narrow else 4])
            for batch in batches:
                for b in slices(batch, "text", ENCODE_BYTES):
                    ids, bounds = encoder.encode_ended(b.column(1), end_id)
                    n = np.diff(bounds)
                    at = ends[-1][-1] + bounds[1:]
                    columns = [b.column(0).take(pa.array(np.arange(len(n)))), pa.array(np.full(len(n), shard), pa.int32()), pa.array(at - n), pa.array(n)]
                    told.append(pa.RecordBatch.from_arrays(columns, ["key", "shard", "start", "n_ids"]))
                    ends.append(at)
                    yield ids.astype("<u2" if narrow else "<u4").tobytes()
            every = np.concatenate(ends)[1:]
            yield every.astype("<u8").tobytes() + struct.pack("<Q", len(every))

        write_whole(f"{path}/shards/{shard:06d}.ids", chunks())
        if told:
            write_parquet(f"{path}/manifest/{shard:06d}.parquet", told)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    map_arrow(d, write, "shard int").write.format("noop").mode("overwrite").save()
    told = open_store(spark, path, kind)
    keys = told.groupBy("key").agg(F.min(F.struct("shard", "start")).alias("first"), F.sum("n_ids").alias("ids"), F.count("*").alias("documents"))
    parts = told.count() // INDEX_KEYS + 1
    keys = keys.select("key", *_hashes("key"), "first.shard", "first.start", "ids", "documents").repartition(min(parts, MOST_TASKS), F.pmod("h2", F.lit(parts)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One index file for each remainder of h2 (several may meet in a task)."""
        got = list(batches)  # some INDEX_KEYS keys a file, 44 bytes each
        if not got:
            return
        c = {n: np.concatenate([b.column(n).to_numpy() for b in got]) for n in got[0].schema.names}
        h, h2 = (c[n].astype(np.int64).view(np.uint64) for n in ("h", "h2"))
        bucket = np.mod(c["h2"], parts)
        for k in np.unique(bucket):
            m = bucket == k
            write_whole(f"{path}/index/{k:06d}.mph", KeyIndex.pack(h[m], (h2[m] >> np.uint64(32)).astype(np.uint32), *(c[n][m] for n in ("shard", "start", "ids", "documents"))))
        yield pa.RecordBatch.from_arrays([pa.array([len(bucket)], pa.int64())], ["keys"])

    map_arrow(keys.select("h", "h2", "shard", "start", "ids", "documents"), index, "keys long").write.format("noop").mode("overwrite").save()
    write_whole(f"{path}/parts", [str(parts).encode()])


def lookup(keys: DataFrame, path: str, key_col: str = "doc_id") -> DataFrame:
    """For each distinct key that is stored: (key, shard, start, n_ids, documents), by the hash index alone. Rows are dealt by index file, which each task reads once."""
    system, name = shared_file(f"{path}/parts")
    with system.open_input_file(name) as f:
        parts = int(f.read())
    kind = keys.schema[key_col].dataType.simpleString()
    schema = f"key {kind}, shard int, start long, n_ids long, documents long"
    k = keys.select(F.col(key_col).alias("key")).distinct().select("key", *_hashes("key")).withColumn("part", F.pmod("h2", F.lit(parts)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[int, KeyIndex] = {}
        for b in batches:
            part = b.column("part").to_numpy()
            for p in np.unique(part):
                if p not in read:
                    read.clear()
                    system, name = shared_file(f"{path}/index/{p:06d}.mph")
                    if system.get_file_info(name).type != fs.FileType.File:  # no key has this remainder
                        continue
                    with system.open_input_file(name) as f:
                        read[p] = KeyIndex(f.read())
                mine = np.flatnonzero(part == p)
                h = b.column("h").to_numpy()[mine].view(np.uint64)
                prints = (b.column("h2").to_numpy()[mine].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                s, good = read[p].find(h, prints)
                s = s[good]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(mine[good])), *(pa.array(s[n].astype(t)) for n, t in (("shard", np.int32), ("start", np.int64), ("ids", np.int64), ("documents", np.int64)))], ["key", "shard", "start", "n_ids", "documents"])

    return map_arrow(k.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part").select("key", "h", "h2", "part"), find, schema)


def read_documents(places: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Of each place (key, shard, start, n_ids, documents) the documents' ids: a row (key, start, n_ids, ids_crc32[, ids]) for each, start counted
    over all shards. A key whose documents run on into the next shards is followed there."""
    kind = places.schema["key"].dataType.simpleString()
    sizes: dict[int, tuple[int, int]] = {}  # by shard: ids of all shards before it, its own
    base = 0
    # one row by shard
    for shard, size in sorted(open_store(places.sparkSession, path, kind).groupBy("shard").agg(F.sum("n_ids")).collect()):
        sizes[shard] = base, size
        base += size
    order = sorted(sizes)
    names = ["key", "start", "n_ids", "ids_crc32", "ids"][: 5 if with_ids else 4]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}

        def shard_file(k: int) -> tuple:
            """The open file, where each of its documents ends, and the bytes of an id; two shards are held."""
            if k not in opened:
                if len(opened) > 1:
                    opened.pop(next(iter(opened)))[0].close()
                system, name = shared_file(f"{path}/shards/{k:06d}.ids")
                f = system.open_input_file(name)
                total = f.size()
                (n,) = struct.unpack("<Q", f.read_at(8, total - 8))
                head = f.read_at(8, 0)
                assert head[:7] == MAGIC, "not a shard"
                opened[k] = (f, np.frombuffer(f.read_at(8 * n, total - 8 - 8 * n), "<u8").astype(np.int64), head[7])
            return opened[k]

        def documents(k: int, start: int, left: int) -> Iterator[tuple]:
            """(start, number of ids, checksum, ids) of a key's documents, one at a time."""
            while left:
                f, ends, wide = shard_file(k)
                i = int(np.searchsorted(ends, start, "right"))
                here = min(left, len(ends) - i)
                for end in ends[i : i + here].tolist():
                    ids = np.frombuffer(f.read_at(wide * (end - start), 8 + wide * start), f"<u{wide}").astype("<u4").tobytes()
                    yield sizes[k][0] + start, end - start, zlib.crc32(ids), ids
                    start = end
                left -= here
                if left:
                    k, start = order[order.index(k) + 1], 0

        def batch(keys: pa.Array, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names)

        for b in batches:
            owner, rows, held = [], [], 0
            for i, place in enumerate(zip(*(b.column(n).to_pylist() for n in ("shard", "start", "documents")), strict=True)):
                for row in documents(*place):
                    owner.append(i)
                    rows.append(row[: len(names) - 1])
                    held += 64 + (len(row[-1]) if with_ids else 0)
                    if held > ENCODE_BYTES:
                        yield batch(b.column("key"), owner, rows)
                        owner, rows, held = [], [], 0
            yield batch(b.column("key"), owner, rows)

    near = places.repartitionByRange(max(1, min(len(order), MOST_TASKS)), "shard", "start").sortWithinPartitions("shard", "start")
    return map_arrow(near, read, f"key {kind}, start long, n_ids long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def open_store(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """What is stored: (key, shard, start, n_ids). kind: the key's type."""
    return spark.read.schema(f"key {kind}, shard int, start long, n_ids long").parquet(f"{path}/manifest")
