"""N-gram Jaccard self-join by parity sketches: no pair at or above the threshold is lost, and no group is expanded into all its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.core import BROADCAST_ROWS, Words, components, finer_partitions, list_array, map_arrow, materialize, mix64, shingles, signed, slices

#: Counters (a fixed number, 4 MB) of how many documents have a shingle, by hash.
COUNTERS = 1 << 20
#: A shingle is common if its counter is above this much and COMMON_TIMES the mean.
COMMON_LEAST, COMMON_TIMES = 32, 2
#: Least number of blocks of a sketch.
LEAST_BLOCKS = 256
#: Rounds in which each key's documents meet one of them only.
STAR_ROUNDS = 2

#: Bits of the sketch that is compared within a join's condition.
FLAT_BITS = 1024

_U = np.uint64


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the bounds by text. A-Z count as a-z."""
    w = Words(texts, lower=True)
    g, b = shingles(w.hashes, w.bounds, k)
    each = [np.unique(g[x:y]) for x, y in zip(b, b[1:])]
    return np.concatenate([*each, np.zeros(0, _U)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])


def set_hash(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each set: equal sets have one."""
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(g ^ _U(0xA5A5A5A5)), dtype=_U)])
        return mix64(run[b[1:]] - run[b[:-1]] + np.diff(b).astype(_U))


def _slot(g: np.ndarray) -> np.ndarray:
    return (g >> _U(40)).astype(np.int64) & (COUNTERS - 1)


def _band(n: np.ndarray) -> np.ndarray:
    """floor(log2 n), exactly."""
    return np.frexp(n.astype(float))[1] - 1


def block_keys(g: np.ndarray, b: np.ndarray, common: np.ndarray, percent: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set, their bounds, and whether a set has too few filled blocks to be sure.

    Sets are compared within size bands [2**u, 2**(u+1)); a set takes part in its own and, if a partner may be there, in the next. A band's sketch is
    a fixed number of blocks; each shingle falls into one block by hash, and a block holds the XOR of its shingles' hashes, so shingles that two sets
    share cancel in the difference, and no more blocks differ than the symmetric difference has elements. With J >= percent/100 a set of n has at most
    d = n * (100 - percent) / percent elements of difference to any partner. Blocks of rare shingles come first, those of common ones (a passage in
    many documents) after them, for all sets alike. Both sets give their first d + 1 filled blocks: at most d of them differ, so one that both give is
    equal (pigeonhole)."""
    n = np.diff(b)
    d = n * (100 - percent) // percent
    band = _band(np.maximum(n, 1))
    some = np.flatnonzero(d > 0)  # others link with equal sets only
    up = some[100 * n[some] >= percent * (np.int64(2) << band[some])]
    doc, kind = np.concatenate([some, up]), np.concatenate([band[some], band[up] + 1])
    if not len(doc):
        return np.zeros(0, _U), np.zeros(len(b), np.int64), np.zeros(len(n), bool)
    size = n[doc]
    of = np.repeat(np.arange(len(doc)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b[doc], size)
    # 1.5 times the d of the band's largest; twice that where d is so near to n that n shingles would fill too few
    blocks = np.maximum(LEAST_BLOCKS, (3 if percent >= 70 else 6) * (np.int64(1) << kind) * (100 - percent) // percent)
    with np.errstate(over="ignore"):
        part = (mix64(g[at] + _U(seed)) % blocks[of].astype(_U)).astype(np.int64) + np.where(common[at], blocks[of], 0)
    place = (of.astype(np.int64) << 33) | part
    by = np.argsort(place, kind="stable")
    place = place[by]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    folded = np.bitwise_xor.reduceat(g[at[by]], first)
    owner = (place[first] >> 33).astype(np.int64)
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    take = rank <= d[doc[owner]]
    with np.errstate(over="ignore"):
        key = mix64(folded[take] ^ mix64(((place[first][take] & ((1 << 33) - 1)).astype(_U) << _U(8)) + kind[owner[take]].astype(_U)))
    filled = np.bincount(owner, minlength=len(doc))
    short = np.zeros(len(n), bool)
    short[doc[filled <= d[doc]]] = True
    whose = doc[owner[take]]
    by = np.argsort(whose, kind="stable")
    return key[by], np.searchsorted(whose[by], np.arange(len(n) + 1)), short


def parity_bits(g: np.ndarray) -> np.ndarray:
    """A sketch of 4 to 8 bits a shingle (a power of two, 64 at least): each shingle flips one bit. The Hamming distance of two sketches is at most
    the symmetric difference; half of a sketch XORed on the other half is the sketch of half the size."""
    bits = max(64, int(8 << int(_band(np.array([max(len(g), 1)]))[0])))
    flips = np.bincount((mix64(g ^ _U(0x51E7C4)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def flat_bits(g: np.ndarray) -> np.ndarray:
    """As parity_bits, of FLAT_BITS bits whatever the size."""
    flips = np.bincount((mix64(g ^ _U(0xF1A7)) & _U(FLAT_BITS - 1)).astype(np.int64), minlength=FLAT_BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def common_slots(d: DataFrame, k: int) -> np.ndarray:
    """Which counters are common, from all documents. Each task adds up its own counters; they are summed in slices, and a table of fixed size reaches the driver."""
    pieces = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for b in slices(batch, "text"):
                held.append(_slot(shingle_sets(b.column("text"), k)[0]))
                n += len(held[-1])
                if n > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), pa.array([x.astype("<u4").tobytes() for x in np.split(np.minimum(total, 2**32 - 1), pieces)], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(x, "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    total = np.zeros((pieces, COUNTERS // pieces), np.int64)
    for p, x in map_arrow(map_arrow(d.select("text"), count, schema).repartition(pieces, "piece"), add, schema).collect():
        total[p] += np.frombuffer(x, "<u4")
    total = total.reshape(-1)
    return total > max(COMMON_LEAST, COMMON_TIMES * total.mean())


def signatures(d: DataFrame, k: int, percent: int, common: np.ndarray, seed: int) -> DataFrame:
    """Rows (id, n, node, keys, short) of all documents; node hashes the set."""
    packed = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for b in slices(batch, "text"):
                g, at = shingle_sets(b.column("text"), k)
                key, bounds, short = block_keys(g, at, table[_slot(g)], percent, seed)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(at)), pa.array(signed(set_hash(g, at))), list_array(signed(key), bounds), pa.array(short)], ["id", "n", "node", "keys", "short"])

    return map_arrow(d.select("id", "text"), run, "id long, n long, node long, keys array<long>, short boolean")


def sets_of(d: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (node, n, bits, flat, shingles) of the nodes wanted, each from one document that has the set. wanted: (node, id)."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    w = wanted.select(F.col("id").alias("id_")).distinct()
    texts = d.join(F.broadcast(w) if few else w, d["id"] == w["id_"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                g, at = shingle_sets(b.column("text"), k)
                bits = [parity_bits(g[x:y]) for x, y in zip(at, at[1:])]
                flat = np.concatenate([flat_bits(g[x:y]) for x, y in zip(at, at[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(signed(set_hash(g, at))), pa.array(np.diff(at)), list_array(np.concatenate(bits), np.concatenate([[0], np.cumsum([len(x) for x in bits])])), list_array(flat, np.arange(b.num_rows + 1) * (FLAT_BITS // 64)), list_array(signed(g), at)], ["node", "n", "bits", "flat", "shingles"])

    s = map_arrow(texts.select("id", "text"), run, "node long, n long, bits array<long>, flat array<long>, shingles array<long>")
    s = materialize(s.join(F.broadcast(wanted.select("node")) if few else wanted.select("node"), "node", "left_semi"), "sets")
    rows = s.agg(F.count("*"), F.count_distinct("node")).first()
    return s if rows[0] == rows[1] else materialize(s.dropDuplicates(["node"]), "sets")  # rows repeat an id


def _folded(bits: Column, size: Column) -> Column:
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > size, F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar. First by sizes and parity bits, which turn away nearly all others, then by the sets."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    p = pairs.join(side("u"), "u").join(side("v"), "v").where(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    least = F.least(F.size("bits_u"), F.size("bits_v"))
    flips = F.aggregate(F.zip_with(_folded(F.col("bits_u"), least), _folded(F.col("bits_v"), least), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    p = p.where(flips * (100 + percent) <= (100 - percent) * (F.col("n_u") + F.col("n_v"))).select("u", "v")
    p = materialize(p, "near")
    used = materialize(p.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "used")
    few = used.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = sets.join(F.broadcast(used) if few else used, "node", "left_semi")  # only these sets move
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    p = p.join(side("u"), "u").join(side("v"), "v").withColumn("both", F.size(F.array_intersect("s_u", "s_v")))
    return p.where(F.expr(f"100 * both >= {percent} * (size(s_u) + size(s_v) - both)")).select("u", "v")


def linked(d: DataFrame, sig: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (node, component) of the nodes with a link to another (similarity at or above percent), component the least node reachable.

    Links are sought until every link of the whole graph lies within one component; not all of them need be found for that.

    Documents that share a key first meet one of them, which is the same for most keys of a group: as many pairs as documents. Where the links found
    put all of a key's nodes into one component nothing is left to test. What remains, nodes of different components with a common key, is compared in
    full, within a join whose condition is the Hamming distance."""
    keys = sig.select("node", F.explode("keys").alias("key"))
    many = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    with finer_partitions(d.sparkSession):
        many = materialize(many, "keys")
    shared = keys.join(many, "key").distinct()
    # most keys of a group have the same nodes: one of them stands for all
    group = shared.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"), F.count("*").alias("n"))
    with finer_partitions(d.sparkSession):
        shared = materialize(shared.join(group.groupBy("a", "b", "n").agg(F.min("key").alias("key")).select("key"), "key"), "shared")
    nodes = shared.select("node").distinct()
    wanted = materialize(sig.groupBy("node").agg(F.min("id").alias("id")).join(nodes, "node", "left_semi"), "nodes")
    sets = sets_of(d, wanted, k)
    # a node's weight: how many keys it shares; the middle of a group of edited copies shares most
    weight = shared.groupBy("node").agg((F.count("*") * F.lit(1 << 20) + F.col("node").bitwiseAND(F.lit((1 << 20) - 1))).alias("weight"))
    shared = materialize(shared.join(weight, "node"), "weighed")
    found = tested = parts = None
    news = True
    open_ = shared.withColumn("part", F.col("node"))
    for r in range(STAR_ROUNDS + 1):
        if parts is not None and news:
            now = shared.join(parts, shared["node"] == parts["node_"], "left").select("key", "node", "weight", F.coalesce("part_", "node").alias("part"))
            mixed = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
            open_ = materialize(now.join(materialize(mixed, "mixed"), "key", "left_semi"), "open")
            if open_.isEmpty():
                break
        if r < STAR_ROUNDS:
            pairs = materialize(star_pairs(open_, again=r > 0), "pairs")
        else:
            pairs = materialize(rest_pairs(open_, sets, percent), "pairs")
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        good = materialize(verify(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = good if found is None else found.unionByName(good)
        news = parts is None or not good.isEmpty()  # else the parts stay, and with them what is open
        if news:
            parts = materialize(components(found), "parts").select(F.col("node").alias("node_"), F.col("component").alias("part_"))
    return parts.select(F.col("node_").alias("node"), F.col("part_").alias("component"))


def star_pairs(open_: DataFrame, again: bool) -> DataFrame:
    """Of each key the pairs of its heaviest node with all nodes of other parts. again: of the heaviest node outside that node's part, as the first
    met its others before."""

    def heaviest(x: DataFrame) -> DataFrame:
        """A table of its own, so that the join with it may be dealt anew where one key has many nodes."""
        return materialize(x.groupBy("key").agg(F.max_by("node", "weight").alias("p_node"), F.max_by("part", "weight").alias("p_part")), "pivots")

    pivot = heaviest(open_)
    if again:
        pivot = heaviest(open_.join(pivot, "key").where("part <> p_part").select("key", "node", "weight", "part"))
    return open_.join(pivot, "key").where("part <> p_part").select(F.least("node", "p_node").alias("u"), F.greatest("node", "p_node").alias("v")).distinct()


def rest_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different parts with a common key whose sizes and flat parity sketches let them be similar. The Hamming distance is part
    of the join's condition, so what shares a key but no more is never a row."""
    flat = [f"f{i}" for i in range(FLAT_BITS // 64)]
    known = open_.select("key", "node", "part").join(sets.select("node", "n", *[F.get("flat", i).alias(f) for i, f in enumerate(flat)]), "node")
    a, b = (known.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "part", "n", *flat)]) for x in "uv")
    flips = " + ".join(f"bit_count({f}_u ^ {f}_v)" for f in flat)
    fits = F.expr(f"node_u < node_v and part_u <> part_v and 100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v) and ({flips}) * {100 + percent} <= {100 - percent} * (n_u + n_v)")
    return a.join(b, (a["key"] == b["key"]) & fits).select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id). Documents link if the Jaccard similarity of their sets of k-word shingles is at least
    percent/100; component_id is the least id reachable by links.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z were lower-cased; a text of fewer than k words is one shingle; empty and null texts have none and link
    with nothing. Equal sets are one node throughout. Rows that repeat an id link through it only if their sets do; a null id gives the component of
    its set's other documents, or null. Ids are integers. Extra columns are left out; an empty table gives no rows."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("component ids are the least of integer ids")
    if not 60 <= percent < 100:
        raise ValueError("sketches tell sets apart from 60 percent on; equal sets need no join")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = common_slots(d, k)
    for seed in range(8):
        sig = materialize(signatures(d, k, percent, common, seed), "signatures")
        if sig.where("short").isEmpty():  # else another way of dealing shingles into blocks
            break
    else:
        raise RuntimeError("no seed fills enough blocks of every set")
    parts = linked(d, sig, k, percent)
    node = sig.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    own = node.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    group = own.groupBy("part").agg(F.min("least").alias("component_id"))
    known = own.join(group, "part").select("node", "component_id")
    out = sig.select("id", "n", "node").join(known, "node", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
