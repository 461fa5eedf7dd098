"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.core import Words, map_arrow, shingles, signed, slices

#: Words of a seed.
GRAM = 4
#: Alignment: points of a match, a mismatch, a gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage is a copy from this share of an item's highest score on, and MARGIN points more (but no more than the highest): a few words in a row are half of a short item, and no sign of a copy.
SIMILAR, MARGIN = 0.5, 4
#: Bytes of benchmark texts that are held at a time, on the driver and in each task. A larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20

#: White space and ASCII punctuation part words; A to Z count as a to z.
_SEPARATORS = bytes([*range(9, 14), *range(32, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_TABLE = 1 << 20


def _words(texts: pa.Array) -> Words:
    return Words(texts, lower=True, separators=_SEPARATORS)


@dataclass
class Block:
    """Items of a benchmark: ids, words (hashes) by item, the numbers of words that seeds have, and seeds: sorted gram hashes with the items and
    places where each stands. An item of fewer than GRAM words is one seed."""

    ids: list
    words: list[np.ndarray]
    sizes: list[int]
    grams: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Block:
        w = _words(pa.array(texts, pa.string()))
        g, b = shingles(w.hashes, w.bounds, GRAM)
        item, place = np.repeat(np.arange(len(ids)), np.diff(b)), np.arange(len(g)) - np.repeat(b[:-1], np.diff(b))
        sizes = np.unique(np.minimum(w.counts(), GRAM))
        return cls(ids, [w.hashes[x:y] for x, y in zip(w.bounds, w.bounds[1:])], sizes[sizes > 0].tolist(), *cls._sorted(g, item, place))

    @staticmethod
    def _sorted(g: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple:
        by = np.argsort(g, kind="stable")
        grams, first = np.unique(g[by], return_index=True)
        return grams, np.append(first, len(g)), item[by], place[by]

    def table(self) -> np.ndarray:
        t = np.zeros(_TABLE, bool)
        t[(self.grams & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        return t

    def find(self, g: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in g that hold a seed, and its number."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(table[(g & np.uint64(_TABLE - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        good = self.grams[k] == g[at]
        return at[good], k[good]


def align(item: np.ndarray, text: np.ndarray) -> int:
    """The best local alignment score of two runs of words (Smith and Waterman; linear gaps), row by row."""
    n = len(text)
    row, best = np.zeros(n + 1, np.int64), 0
    slope = np.arange(n + 1) * -GAP
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + slope) - slope, 0)
        best = max(best, int(new.max()))
        row = new
    return best


def at_most(item: np.ndarray, text: np.ndarray) -> int:
    """No local alignment scores more: each word of a passage that the item has counts as a match, any other as one point less."""
    run = np.cumsum(np.where(np.isin(text, item), MATCH, MISMATCH))
    return int((run - np.minimum.accumulate(np.append(0, run[:-1]))).max(initial=0))


def needed(m: int) -> float:
    """The points from which a passage is a copy of an item of m words."""
    return min(SIMILAR * MATCH * m + MARGIN, MATCH * m)


def marks(block: Block, table: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, word where the item would begin) of every seed in a batch."""
    out = []
    for size in block.sizes:
        g, b = shingles(w.hashes, w.bounds, size)
        at, seed = block.find(g, table)
        times = block.bounds[seed + 1] - block.bounds[seed]
        of = np.repeat(np.arange(len(at)), times)
        k = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(block.bounds[seed], times)
        doc = np.searchsorted(b, at, "right")[of] - 1
        out.append((doc, block.item[k], at[of] - b[doc] - block.place[k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def matches(block: Block, table: np.ndarray, w: Words) -> list[tuple[int, int, int, float, int, int]]:
    """(document, item, score, similarity, first and last word of the passage) of each copy in a batch; of an item's passages in a document the best."""
    doc, item, start = marks(block, table, w)
    if not len(doc):
        return []
    out: list[tuple[int, int, int, float, int, int]] = []
    by = np.lexsort((start, item, doc))
    doc, item, start = doc[by], item[by], start[by]
    new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(item, prepend=-1))
    for x, y in zip(new, np.append(new[1:], len(doc))):
        d, i = int(doc[x]), int(item[x])
        own, text = block.words[i], w.hashes[w.bounds[d] : w.bounds[d + 1]]
        m = len(own)
        slack = m // 2 + 2
        need = needed(m)
        best = (0, 0, 0)
        s = start[x:y]
        cut = np.flatnonzero(np.diff(s) > m + 2 * slack) + 1
        for part in np.split(s, cut):
            lo, hi = max(0, int(part[0]) - slack), min(len(text), int(part[-1]) + m + slack)
            if at_most(own, text[lo:hi]) >= max(need, best[0]):
                best = max(best, (align(own, text[lo:hi]), -lo, hi))
        if best[0] >= need:
            out.append((d, i, best[0], best[0] / (MATCH * m), -best[1], best[2]))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, each item once. Null texts and items without words find nothing."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(item_col, text_col).dropDuplicates().toLocalIterator():
        ids.append(r[0])
        texts.append(r[1] or "")
        size += len(texts[-1]) + 100
        if size >= most:
            yield Block.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block.of(ids, texts)


def _scan(docs: DataFrame, block: Block, keep: list[str], text: str, rows: Callable, schema: str) -> DataFrame:
    """rows(batch, words, table) for each slice of docs."""
    table = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal table
        table = block.table() if table is None else table
        for batch in batches:
            for b in slices(batch, text):
                yield rows(b, _words(b.column(b.schema.get_field_index(text))), table)

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep]), run, schema)


def find_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row and item of which it holds a copy, exact, edited or paraphrased: (id, item, score, similarity, from_word,
    to_word; the passage lies between).

    Each seed of an item in a document marks where the item would lie there; stretches around the marks are aligned, unless a bound says that no copy
    can be there. Every seed counts, however many documents have it. Documents never leave their task and the benchmark is held in blocks of bounded
    size. Null or empty texts match nothing; repeated rows match each; repeated items count once (by id and text, so an id may have several texts, and
    is then found once for each); an item of fewer than GRAM words is found wherever its words stand in a row, so one of a single word is in every
    document that has the word; ids are of any type, null included; empty tables give no rows."""
    spark = docs.sparkSession
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, item {benchmark.schema[item_col].dataType.simpleString()}, score long, similarity double, from_word long, to_word long"
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in blocks(benchmark, item_col, item_text):

        def rows(b: pa.RecordBatch, w: Words, table: np.ndarray, block: Block = block) -> pa.RecordBatch:
            m = matches(block, table, w)
            col = list(zip(*m, strict=True)) if m else [[]] * 6
            ids = b.column("id").take(pa.array(col[0], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            found = [pa.array(c, t) for c, t in zip(col[2:], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids, pa.array([block.ids[i] for i in col[1]], item_kind), *found], ["id", "item", "score", "similarity", "from_word", "to_word"])

        one = _scan(d, block, ["id", "text"], "text", rows, kinds)
        out = one if out is None else out.unionByName(one)
    out = out if out is not None else spark.createDataFrame([], kinds)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def remove_copies(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that hold a copy of an item (as find_copies has them)."""
    for block in blocks(benchmark, item_col, item_text):

        def rows(b: pa.RecordBatch, w: Words, table: np.ndarray, block: Block = block) -> pa.RecordBatch:
            keep = np.ones(b.num_rows, bool)
            keep[[m[0] for m in matches(block, table, w)]] = False
            return b.filter(pa.array(keep))

        docs = _scan(docs, block, docs.columns, text_col, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return docs
