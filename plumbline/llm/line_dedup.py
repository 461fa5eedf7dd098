"""Line deduplication over a corpus: lines within one word of an earlier line go, by a deletion-neighbourhood join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.core import BROADCAST_ROWS, Words, finer_partitions, list_array, map_arrow, materialize, mix64, signed, slices

#: Words by which two lines may differ (inserted, deleted or another): the edit bound. The join below is made for one.
EDITS = 1
#: And the share of the longer line's words by which they may differ. One rule for all lines; without it any two lines of one word each would be copies.
SHARE = 0.2
#: Stretches of a line, one of which holds the edit.
STRETCHES = 4
#: Length classes grow by this factor.
CLASS_STEP = 1.25

_U = np.uint64
_R = 0xD6E8FEB86659FD93


def least_words(share: float) -> int:
    """The least length of the longer of two lines that differ by EDITS words, at most share of its words."""
    return max(2, math.ceil(EDITS / share - 1e-9))


def _class_starts(least: int, most: int) -> np.ndarray:
    """First length of each class, from least up to past most."""
    out = [least]
    while out[-1] <= most + 1:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_STEP)))
    return np.array(out)


class Lines:
    """The lines of a batch of texts (split at \\n) as runs of words: document, number in it, first word, number of words, and hashes of any head and tail."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        self.words = w.hashes
        breaks = np.flatnonzero(w.data == 10) + 1
        owner = np.searchsorted(w.offsets[1:], breaks - 1, "right")
        # each text opens a line where it starts, and each break one in the text that holds it
        at = np.concatenate([w.offsets[:-1], breaks])
        owner = np.concatenate([np.arange(len(w.offsets) - 1), owner])
        by = np.lexsort((np.arange(len(at)), owner))
        at, self.doc = at[by], owner[by]
        self.number = np.arange(len(at)) - np.searchsorted(self.doc, self.doc)
        bound = np.searchsorted(w.starts, np.concatenate([at, [len(w.data)]]))
        self.first, self.n = bound[:-1], np.diff(bound)
        most = int(self.n.max()) if len(self.n) else 0
        self.power = np.concatenate([np.ones(1, _U), np.cumprod(np.full(most + 1, _R, _U), dtype=_U)])
        self.down = np.concatenate([np.ones(1, _U), np.cumprod(np.full(most + 1, pow(_R, -1, 1 << 64), _U), dtype=_U)])
        place = np.arange(len(self.words)) - np.repeat(self.first, self.n)
        length = np.repeat(self.n, self.n)
        with np.errstate(over="ignore"):
            self.up_run = np.concatenate([np.zeros(1, _U), np.cumsum(self.words * self.power[place], dtype=_U)])
            self.back_run = np.concatenate([np.zeros(1, _U), np.cumsum(self.words * self.power[length - 1 - place], dtype=_U)])

    def head(self, line: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the line's first n words."""
        return self.up_run[self.first[line] + n] - self.up_run[self.first[line]]

    def tail(self, line: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of the line's last n words."""
        end = self.first[line] + self.n[line]
        return self.back_run[end] - self.back_run[end - n]

    def whole(self) -> np.ndarray:
        line = np.arange(len(self.n))
        return mix64(self.head(line, self.n) + self.n.astype(_U) * _U(0x9E3779B97F4A7C15))

    def stretch_keys(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First level: (line, from word, to word, key) for each stretch of each line: the key hashes what is before and behind.

        Cuts are counted from the line's start before the stretch and from its end behind it, and are the same for all lines of a length class (the
        first of least words), so two lines that are one word apart, in the stretch, have equal keys. A line one word shorter than a class takes part
        in it also."""
        starts = _class_starts(least, int(self.n.max()) if len(self.n) else least)
        lines = np.flatnonzero(self.n >= least - 1)
        own = np.searchsorted(starts, self.n[lines], "right") - 1
        edge, in_one = np.flatnonzero(self.n[lines] + 1 == starts[own + 1]), np.flatnonzero(own >= 0)
        line, kind = np.concatenate([lines[in_one], lines[edge]]), np.concatenate([own[in_one], own[edge] + 1])
        least = starts[kind] - 1
        out = []
        for j in range(STRETCHES):
            a, b = least * j // STRETCHES, least - least * (j + 1) // STRETCHES
            with np.errstate(over="ignore"):
                key = mix64(mix64(self.head(line, a) + (kind * STRETCHES + j).astype(_U)) ^ (self.tail(line, b) * _U(0x94D049BB133111EB)))
            out.append((line, a, self.n[line] - b, key))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def word_keys(self, line: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second level: (line, role, key) of all variants of a line with one word of a..b deleted. Role 0: the place is part of the key (equal: one
        word differs, or none). Role 1: it is not; role 2: the line itself, nothing deleted (1 and 2 equal: one word is inserted). Lines of fewer than
        least words are only the shorter of two, so they have none with a word deleted."""
        size = np.where(self.n[line] >= least, b - a, 0)
        of = np.repeat(np.arange(len(line)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        ln, n = line[of], self.n[line][of]
        first = self.first[ln]
        with np.errstate(over="ignore"):
            end = self.up_run[first + n] - self.up_run[first + place + 1]
            rest = self.up_run[first + place] - self.up_run[first] + end * self.down[1]
            rest = mix64(rest + (n - 1).astype(_U) * _U(0x9E3779B97F4A7C15))
            same = mix64(rest ^ mix64(place.astype(_U) + _U(77)))
        itself = self.whole()[line]
        return np.concatenate([ln, ln, line]), np.concatenate([np.zeros(len(ln), np.int8), np.ones(len(ln), np.int8), np.full(len(line), 2, np.int8)]), np.concatenate([same, rest, itself])


def _order(number: Column) -> Column:
    """The order of lines as a decimal: id, hash of the text, number of the line. Null ids come first."""
    return F.coalesce(F.col("id").cast("decimal(38,0)"), F.lit(-(1 << 63)).cast("decimal(38,0)")) * F.lit(10**18).cast("decimal(19,0)") + (F.pmod("tie", F.lit(10**9)) * 10**9 + number).cast("decimal(19,0)")


def find_lines(d: DataFrame, least: int) -> DataFrame:
    """Rows (id, tie, line, h, keys) of all lines with a word: h hashes its words, keys are its first-level keys (none below least - 1 words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                x = Lines(b.column("text"))
                some = np.flatnonzero(x.n > 0)
                if not len(some):
                    continue
                line, _, _, key = x.stretch_keys(least)
                by = np.argsort(line, kind="stable")
                bounds = np.searchsorted(line[by], np.concatenate([some, [len(x.n)]]))
                doc = pa.array(x.doc[some])
                columns = [b.column("id").take(doc), b.column("tie").take(doc), pa.array(x.number[some].astype(np.int64)), pa.array(signed(x.whole()[some])), list_array(signed(key[by]), bounds)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tie", "line", "h", "keys"])

    return map_arrow(d.select("text", "id", "tie"), run, "id long, tie long, line long, h long, keys array<long>")


def near_lines(d: DataFrame, wanted: DataFrame, few: bool, least: int) -> DataFrame:
    """Second level: rows (o, h, role, k) for the lines wanted (id, tie, line, key): all variants of the stretch that the key stands for."""
    lists = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("line", "key")).alias("wanted"))  # as many as a document has lines
    lists = lists.select(F.col("id").alias("id_"), F.col("tie").alias("tie_"), "wanted")
    lists = F.broadcast(lists) if few else lists
    joined = d.join(lists, d["id"].eqNullSafe(lists["id_"]) & (d["tie"] == lists["tie_"])).select("text", "id", "tie", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                x = Lines(b.column("text"))
                line, a, e, key = x.stretch_keys(least)
                if not len(line):
                    continue
                w = b.column("wanted")
                flat = w.flatten()
                doc = np.repeat(np.arange(b.num_rows), np.diff(w.offsets.to_numpy()))
                at = np.searchsorted(x.doc, np.arange(b.num_rows))[doc] + flat.field("line").to_numpy()
                with np.errstate(over="ignore"):
                    asked = mix64(flat.field("key").to_numpy().view(_U) + at.astype(_U) * _U(_R))
                    have = mix64(key + line.astype(_U) * _U(_R))
                hit = np.isin(have, asked)
                ln, role, k = x.word_keys(line[hit], a[hit], e[hit], least)
                doc = pa.array(x.doc[ln])
                yield pa.RecordBatch.from_arrays([b.column("id").take(doc), b.column("tie").take(doc), pa.array(x.number[ln].astype(np.int64)), pa.array(signed(x.whole()[ln])), pa.array(role), pa.array(signed(k))], ["id", "tie", "line", "h", "role", "k"])

    return map_arrow(joined, run, "id long, tie long, line long, h long, role tinyint, k long").select(_order(F.col("line")).alias("o"), "h", "role", "k")


def line_words(d: DataFrame, places: DataFrame, few: bool) -> DataFrame:
    """Rows (o, words): the words of the lines at places (id, tie, line), each line once."""
    lists = places.groupBy(F.col("id").alias("id_"), F.col("tie").alias("tie_")).agg(F.collect_list("line").alias("wanted"))  # as many as a document has lines
    lists = F.broadcast(lists) if few else lists
    x = d.join(lists, d["id"].eqNullSafe(lists["id_"]) & (d["tie"] == lists["tie_"]))
    x = x.select("id", "tie", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("line"))
    words = F.filter(F.split(F.get("lines", F.col("line").cast("int")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return x.select(_order(F.col("line")).alias("o"), words.alias("words")).dropDuplicates(["o"])


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one word: inserted, deleted or another."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.zip_with(longer, shorter, lambda x, y: ~x.eqNullSafe(y))
    same = (F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)), F.size(longer) + 1) - 1).cast("int")  # words before the first that differs
    rest = lambda x, n: F.slice(x, same + 1 + n, F.size(x))
    inserted = (F.size(longer) == F.size(shorter) + 1) & (rest(longer, 1) == rest(shorter, 0))
    return inserted | (F.size(longer) == F.size(shorter)) & (rest(longer, 1) == rest(shorter, 1))


def verified(later: DataFrame, asked: DataFrame, d: DataFrame) -> DataFrame:
    """The h of those candidates later (h, o, earlier: the order of the line that has an equal variant) that are truly within the edit bound: told
    from their words, not from hashes. asked: (id, tie, line) of all lines that emitted variants."""
    every = later.select("o").unionByName(later.select(F.col("earlier").alias("o"))).distinct()
    places = materialize(asked.select("id", "tie", "line").distinct().withColumn("o", _order(F.col("line"))).join(every, "o", "left_semi"), "places")
    words = materialize(line_words(d, places, places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS), "words")
    p = later.join(words.select("o", F.col("words").alias("a")), "o").join(words.select(F.col("o").alias("earlier"), F.col("words").alias("b")), "earlier")
    return p.where(within_one(F.col("a"), F.col("b"))).select("h").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Rows (id, tie, line) of the lines that go. A line is a run of words, one at least; it goes if an equal line, or one within the edit bound
    (EDITS words inserted, deleted or others, at most share of the longer line's words), stands earlier, by id, then by a hash of the text, then in
    the text. Whether that earlier line goes itself does not matter.

    First, equal lines are counted by hash. Then each different line has STRETCHES keys of what it has outside a stretch; only lines that meet another
    line there emit the variants of that stretch with one word deleted. Equal variants are the join, least orders of each variant are the candidates:
    no pairs are made, and partial aggregates go before each exchange, so one line in a third of all rows costs no more than any other. Last, each
    candidate's words are compared with those of the earliest line that shares the variant."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("lines are ordered by an integer id")
    least = least_words(share)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    lines = materialize(find_lines(d, least), "lines")
    ordered = lines.withColumn("o", _order(F.col("line")))
    # a table of its own, so that the joins with it may be dealt anew where one line is in a third of all rows
    first = materialize(ordered.groupBy("h").agg(F.min("o").alias("first"), F.count("*").alias("times")), "first")
    met = lines.select("h", F.explode("keys").alias("key")).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    with finer_partitions(docs.sparkSession):
        met = materialize(met, "met")
    few = met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    asked = lines.select("h", "id", "tie", "line", F.explode("keys").alias("key")).join(F.broadcast(met) if few else met, "key")
    # of equal lines the earliest stands for all
    asked = materialize(asked.withColumn("o", _order(F.col("line"))).join(first, "h").where("o = first").select("id", "tie", "line", "key").distinct(), "asked")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = materialize(near_lines(d, asked, few, least).distinct(), "near")
    variants = near.groupBy("k").agg(F.count("*").alias("n"), F.min(F.when(F.col("role") == 2, F.col("o"))).alias("itself"), F.min(F.when(F.col("role") != 2, F.col("o"))).alias("cut")).where("n > 1").drop("n")
    later = near.join(variants, "k").select("h", "o", F.expr("case when role = 1 then itself else cut end").alias("earlier")).where("earlier < o").distinct()
    close = verified(materialize(later, "later"), asked, d).select("h", F.lit(True).alias("near"))
    goes = materialize(first.join(close, "h", "left").select("h", F.when(F.coalesce("near", F.lit(False)), F.lit(None)).otherwise(F.col("first")).alias("stays"), "times").where("times > 1 or stays is null"), "goes")
    few = goes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = ordered.join(F.broadcast(goes) if few else goes, "h").where("stays is null or o > stays").select("id", "tie", "line")
    return materialize(gone, "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """docs with repeated lines cut out of the text, and n_lines, n_removed, removed (line numbers from 0), emptied.

    emptied: lines were removed and none with a word is left. Lines without a word stay as they are; null texts stay null and have no lines; rows that
    repeat both id and text count as one document and share its fate; null ids are one id, before all others. An empty table gives no rows. All
    columns of docs stay (those called as the new ones are replaced)."""
    gone = repeated_lines(docs, id_col, text_col, share)
    lists = gone.distinct().groupBy("id", "tie").agg(F.array_sort(F.collect_list("line")).alias("removed_"))
    lists = lists.select(F.col("id").alias("id_"), F.col("tie").alias("tie_"), "removed_")
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    fresh = ("n_lines", "n_removed", "removed", "emptied", "id_", "tie_", "removed_")
    keep = [c for c in docs.columns if c.lower() not in fresh]
    d = docs.select(*[F.col(f"`{c}`") for c in keep])
    text = F.col(f"`{text_col}`")
    where = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("id_")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("tie_"))
    out = d.join(lists, where, "left").withColumn("removed_", F.coalesce("removed_", F.array().cast("array<bigint>")))
    lines = F.split(text, "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.array_contains(F.col("removed_"), i.cast("long")))
    cut = F.when(F.size("removed_") == 0, text).otherwise(F.array_join(left, "\n"))
    return out.select(
        *[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.size("removed_").cast("long").alias("n_removed"),
        F.col("removed_").alias("removed"), ((F.size("removed_") > 0) & ~cut.rlike("[^\\x20\\x09-\\x0D]")).alias("emptied"),
    )
