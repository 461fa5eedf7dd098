"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.core import map_arrow, materialize, scratch, shared_file, slices, write_whole
from plumbline.llm.tokens import ENCODE_BYTES, Encoder


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Bins for counts[l] pieces of length l: (how many bins, the lengths in each), every piece used once.

    Fill greedily: the longest piece left opens a bin, the longest that fits follows, until none fits. Best-two-fit: then the bin's smallest piece
    gives way to the two pieces left that fill its gap and place more tightly than it did. The same bin is made as many times as pieces last, so the
    work depends on the number of lengths and not on the number of pieces."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins: list[tuple[int, list[int]]] = []

    def longest(most: int, used: dict[int, int]) -> int:
        while most > 0 and left[most] - used.get(most, 0) <= 0:
            below = np.flatnonzero(left[:most] > 0)
            most = int(below[-1]) if len(below) else 0
        return most

    while left.any():
        used: dict[int, int] = {}
        chosen: list[int] = []
        gap = capacity
        while gap and (one := longest(min(gap, len(left) - 1), used)):
            chosen.append(one)
            used[one] = used.get(one, 0) + 1
            gap -= one
        if gap and len(chosen) > 1:
            small = chosen[-1]
            room = gap + small
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            there = np.flatnonzero(free[: room + 1] > 0)
            best, pair = small, None
            if len(there):
                want = np.searchsorted(there, room - there, "right") - 1
                for i, j in zip(range(len(there)), want, strict=True):
                    a = int(there[i])
                    while j >= 0 and there[j] == a and free[a] < 2:
                        j -= 1
                    if j >= 0 and a + int(there[j]) > best:
                        best, pair = a + int(there[j]), (a, int(there[j]))
            if pair:
                chosen[-1:] = sorted(pair, reverse=True)
                used = {}
                for x in chosen:
                    used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= times * n
        bins.append((times, chosen))
    return bins


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, place[, ids]): each document's ids and end_id, cut into pieces of capacity tokens only
    where it is longer; the first piece takes the remainder. part and place (the rank among the pieces of that length in that part) name a piece. Here
    ids take two bytes each where the vocabulary allows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        small = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        for batch in batches:
            for b in slices(batch, "text", ENCODE_BYTES):
                ids, bounds = encoder.encode_ended(b.column(1), end_id)
                data = ids.astype("<u4").tobytes()
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                of = np.repeat(np.arange(len(total)), pieces)
                k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (total - 1) % capacity + 1
                x = np.where(k == 0, 0, first[of] + (k - 1) * capacity)
                n = np.where(k == 0, first[of], capacity)
                spans = [(4 * p, 4 * q) for p, q in zip((bounds[of] + x).tolist(), (bounds[of] + x + n).tolist(), strict=True)]
                crc = [zlib.crc32(data[p:q]) for p, q in spans]
                lengths = n
                order = np.argsort(lengths, kind="stable")
                runs = np.searchsorted(lengths[order], lengths[order])
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n)) - runs + seen[lengths[order]]
                seen += np.bincount(lengths, minlength=capacity + 1)
                columns = [b.column(0).take(pa.array(of)), pa.array(k.astype(np.int32)), pa.array(x), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                if with_ids:
                    narrow = ids.astype("<u2").tobytes() if small else data
                    columns.append(pa.array([narrow[p // 2 : q // 2] if small else narrow[p:q] for p, q in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[doc_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most capacity tokens by best-two-fit.

    A table of pieces is written once to the shared folder; their lengths are counted by part, the counts of the capacity many lengths make the plan
    on the driver (its size depends on the number of lengths, not of documents), and each piece finds its bin from its rank among the pieces of its
    length. The ranks before each part are a small file in the shared folder, which the tasks that read the part's pieces open; so neither texts nor
    ids move, and no piece meets another in a task.

    Null or empty texts give one piece with the end id. Repeated and null ids are kept as rows of their own; ties are dealt by place. Extra columns
    are left out. An empty table gives no rows. Result: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, doc_col, text_col, with_ids), "pieces")
    path = scratch(docs.sparkSession, "ranks")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, lengths, ranks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                table = np.zeros(capacity + 1, "<i8")
                table[lengths] = ranks
                write_whole(f"{path}/{part}", [table.tobytes()])
            yield b.select(["part"])

    by = before.groupBy("part").agg(F.collect_list("length").alias("lengths"), F.collect_list("before").alias("ranks"))  # capacity many at most
    map_arrow(by.select("part", "lengths", "ranks"), save, "part int").write.format("noop").mode("overwrite").save()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    ranks, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, lengths in plan_bins(counts, capacity):
        offset = 0
        for x in lengths:
            slots.append((x, int(ranks[x]), sequence, offset))
            ranks[x] += times
            offset += x
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def ranks_before(part: int) -> np.ndarray:
            if part not in held:
                if len(held) > 64:
                    held.clear()
                system, name = shared_file(f"{path}/{part}")
                with system.open_input_file(name) as f:
                    held[part] = np.frombuffer(f.read(), "<i8")
            return held[part]

        for b in batches:
            if not b.num_rows:
                continue
            length, part = b.column("length").to_numpy(), b.column("part").to_numpy()
            rank = b.column("place").to_numpy().copy()
            for p in np.unique(part):
                mine = part == p
                rank[mine] += ranks_before(int(p))[length[mine]]
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                lo, hi = starts[x], starts[x + 1]
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], "right") - 1
            columns = [b.column(n) for n in names]
            if with_ids:  # two bytes each where the vocabulary allows, four in the result
                columns[-1] = pa.array([x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(columns[-1].to_pylist(), length.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(pieces.select(*names, "part", "place"), place, f"{kinds}, sequence_id long, offset long")
