"""Quality rules whose cutoffs adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.core import Words, map_arrow, materialize, mix64, shingles, slices

#: metric: (expression over the counts, which tails are bad, the least spread that counts)
METRICS: dict[str, tuple[str, str, float]] = {
    "word_length": ("word_chars / n_words", "both", 0.5),
    "symbol_share": ("n_symbols / word_chars", "high", 0.02),
    "dup_line_share": ("n_dup_lines / n_lines", "high", 0.05),
    "repeat_share": ("n_repeat_words / n_words", "high", 0.05),
}


def _by_doc(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each document has."""
    with np.errstate(over="ignore"):
        own = mix64(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(doc[np.unique(own, return_index=True)[1]], minlength=n)


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    w = Words(texts)
    data, off = w.data, w.offsets
    space, symbol = np.zeros(256, bool), np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    symbol[list(b"#*$%&|<>")] = True

    def running(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    chars = running(~space[data] & ((data & 0xC0) != 0x80))
    symbols = running(symbol[data])
    lines = Words(texts, separators=b"\n")
    with_word = chars[lines.ends] > chars[lines.starts]
    doc_of_line = np.repeat(np.arange(n), lines.counts())[with_word]
    n_lines = np.bincount(doc_of_line, minlength=n)
    counts = w.counts()
    repeat = np.zeros(n, np.int64)
    if len(w.hashes):
        tri, _ = shingles(w.hashes, w.bounds, 3)
        per = np.where(counts >= 3, counts - 2, (counts > 0).astype(np.int64))
        doc = np.repeat(np.arange(n), per)
        with np.errstate(over="ignore"):
            own = mix64(tri + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
        at = np.repeat(w.bounds[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(len(tri))
        at = at[times[inverse] > 1]
        hit = np.zeros(len(w.hashes) + 2, bool)
        for k in range(3):
            hit[at + k] = True
        run = running(hit)
        repeat = run[w.bounds[1:]] - run[w.bounds[:-1]]
    return {"n_words": counts, "word_chars": chars[off[1:]] - chars[off[:-1]], "n_symbols": symbols[off[1:]] - symbols[off[:-1]], "n_lines": n_lines, "n_dup_lines": n_lines - _by_doc(lines.hashes[with_word], doc_of_line, n), "n_repeat_words": repeat}


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of docs, and the counts of each text (null: no words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                c = text_counts(b.column("text"))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x.astype(np.int64)) for x in c.values())], [*b.schema.names[1:], *c])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(docs.select(F.col(text_col).alias("text"), *keep), count, kinds + "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def thresholds(measured: DataFrame, by: list[str], fence: float = 3.0, weight: float = 200.0, k: int = 400) -> DataFrame:
    """Rows (*by, low and high of each metric): quartiles less and plus fence times the spread between them.

    Each group's documents that pass the base rules fill one KLL sketch a metric (partial sketches are made before the exchange, so that a source with
    a third of all rows is spread). Sketches of groups merge into those of the first key and of all. A group's quartile is the mean of its own, with
    the weight of its rows, and its first key's, with the fixed weight; that of the first key likewise with the one of all. So the less is known of a
    group, the nearer it is to what is known of more, without a step. Null keys are a group."""
    good = measured.where(~base_failed())
    sketch = [F.expr(f"kll_sketch_agg_double(cast({e} as double), {k})").alias(m) for m, (e, _, _) in METRICS.items()]
    merged = [F.expr(f"kll_merge_agg_double({m}, {k})").alias(m) for m in METRICS]
    own = materialize(good.groupBy(*by).agg(F.count("*").alias("rows"), *sketch), "sketches")
    if own.isEmpty():  # no document passes the base rules
        names = [f"{m}_high" for m in METRICS] + [f"{m}_low" for m, (_, tails, _) in METRICS.items() if tails == "both"]
        return own.select(*by, *[F.lit(None).cast("double").alias(n) for n in names])
    first = own.groupBy(by[0]).agg(F.sum("rows").alias("rows_1"), *[c.alias(f"{m}_1") for c, m in zip(merged, METRICS, strict=True)])
    every = own.agg(*merged).first()  # one sketch a metric
    first = first.withColumnRenamed(by[0], "wider_key")
    wide = own.join(first, own[by[0]].eqNullSafe(first["wider_key"])).select("*", *[F.lit(x).cast("binary").alias(f"{m}_2") for m, x in zip(METRICS, every, strict=True)])
    out = [F.col(c) for c in by]
    for m, (_, tails, least) in METRICS.items():

        def quartile(q: float, m: str = m) -> Column:
            own, first, every = (F.expr(f"kll_sketch_get_quantile_double({m}{level}, {q}d)") for level in ("", "_1", "_2"))
            toward = lambda x, rows, wider: (x * F.col(rows) + wider * weight) / (F.col(rows) + weight)
            return toward(own, "rows", toward(first, "rows_1", every))

        low, high = quartile(0.25), quartile(0.75)
        spread = F.greatest(high - low, F.lit(least)) * fence
        out.append((high + spread).alias(f"{m}_high"))
        if tails == "both":
            out.append((low - spread).alias(f"{m}_low"))
    return wide.select(*out)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", by: tuple[str, str] = ("lang", "source"), text_col: str = "text", **options: float) -> DataFrame:
    """One row per row of docs: id, lang, source, the counts, base_failed, kept, and the metrics that broke a threshold.

    The counts are written once to the shared folder; sketches and the filter read them there. A document that fails the base rules is not kept; the
    others are kept unless a metric lies beyond its group's threshold. Groups that have no document passing the base rules have no threshold. Null
    texts have no words (and fail); null languages and sources are groups of their own; repeated rows count each; extra columns are left out; an empty
    table gives no rows."""
    keys = ["key_0", "key_1"]
    m = measure(docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(text_col).alias("words_of")), ["id", *keys], "words_of")
    m = materialize(m, "counts")
    t = thresholds(m, keys, **options)
    t = materialize(t.select(*[F.col(k).alias(f"t_{k}") for k in keys], *[c for c in t.columns if c not in keys]), "thresholds")
    joined = m.join(t, m["key_0"].eqNullSafe(t["t_key_0"]) & m["key_1"].eqNullSafe(t["t_key_1"]), "left")
    broken = [F.expr(f"case when cast({e} as double) > {n}_high" + (f" or cast({e} as double) < {n}_low" if tails == "both" else "") + f" then '{n}' end") for n, (e, tails, _) in METRICS.items()]
    broken = F.when(base_failed(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken)))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return joined.withColumn("broken", broken).select(
        F.col("id").alias(id_col),
        *[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)],
        *counts,
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size("broken") == 0)).alias("kept"),
        "broken",
    )
