"""Document quality by Bradley-Terry pairwise ranking on features of the text."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.core import BROADCAST_ROWS, Words, drop_scratch, map_arrow, materialize, mix64, scratch_made, shared_dir, slices, text_bytes
from plumbline.llm.quality_rules import text_counts

#: Pairs for each document of the larger class that fit deals; train takes all pairs.
PAIRS = 8
#: Weight of the ridge in the loss.
RIDGE = 1e-2
#: Documents in a row of the table of features.
ROWS = 64
#: Strengths lie in panels of this width. In a panel a function of the strength is a polynomial through so many Chebyshev nodes; the logistic is met
#: to some 1e-12 (its poles are pi away).
WIDTH, NODES = 2.0, 16
#: Bits of a strength that a pass of the quantile settles.
DIGIT = 13

FEATURES = ("log_words", "word_length", "long_words", "symbols", "bars", "exclamations", "upper", "digits", "stops", "capital_words", "no_ascii", "lines_a_word", "dup_lines", "repeats", "stutter", "distinct", "short_text")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text: shares and logarithms, all bounded. Null and empty texts give zeros but for short_text."""
    c = text_counts(texts)
    w = Words(texts)
    n, off, data = len(texts), w.offsets, w.data

    def count(characters: bytes | np.ndarray) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(characters)] = True
        run = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return run[off[1:]] - run[off[:-1]]

    def words(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return run[w.bounds[1:]] - run[w.bounds[:-1]]

    size, m = np.maximum(np.diff(off), 1), np.maximum(c["n_words"], 1)
    upper = range(65, 91)
    doc = np.repeat(np.arange(n), w.counts())
    with np.errstate(over="ignore"):
        own = mix64(w.hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(doc[np.unique(own, return_index=True)[1]], minlength=n) if len(own) else np.zeros(n)
    same = np.zeros(len(own), bool)
    same[1:] = own[1:] == own[:-1]
    capital = np.isin(data[w.starts], np.array(list(upper), np.uint8)) if len(w.starts) else np.zeros(0, bool)
    root = lambda x: np.sqrt(np.minimum(x, 1.0))  # noqa: E731  small shares tell much
    return np.stack(
        [
            np.log1p(c["n_words"]) / 10, np.minimum(c["word_chars"] / m, 30) / 10, words(w.ends - w.starts > 20) / m, root(count(b"#*$%&<>") / size), root(count(b"|") / size), root(count(b"!") / size), root(count(bytes(upper)) / size), root(count(b"0123456789") / size), root(count(b".,;:?") / size),
            words(capital) / m, count(range(128, 256)) / size, np.minimum(c["n_lines"] / m, 1), root(c["n_dup_lines"] / np.maximum(c["n_lines"], 1)), root(c["n_repeat_words"] / m), root(words(same) / m), distinct / m, (c["n_words"] < 20).astype(float),
        ],
        axis=1,
    )


def _scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -6, 6)


def _strength(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w, a column at a time: equal rows have equal strengths to the last bit, whatever stands beside them."""
    s = np.zeros(len(z))
    for column, weight in zip(z.T, w):
        s += column * weight
    return s


@dataclass
class BradleyTerry:
    """A document's strength is weights . (features - mean) / spread; one beats another with the logistic of the difference. cut: the strength at the
    quantile of the share of class 0, scale: of the spread of strengths."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _strength(_scaled(x, self.mean, self.spread), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.cut) / self.scale, -40, 40)))


def _untrained() -> BradleyTerry:
    k = len(FEATURES)
    return BradleyTerry(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)


def _newton(loss_at: Callable, k: int, ridge: float) -> np.ndarray:
    """The weights of the least loss with its ridge, by Newton's method until a step is below 1e-8; a step that would raise the loss is halved.
    loss_at(w): the loss, its gradient, and a function that gives its Hessian."""
    w = np.zeros(k)
    loss, gradient, hessian = loss_at(w)
    while True:
        step = -np.linalg.solve(hessian() + ridge * np.eye(k), gradient + ridge * w)
        while True:
            then = loss_at(w + step)
            risen = then[0] - loss + ridge / 2 * ((w + step) @ (w + step) - w @ w)
            if risen <= 1e-10 or np.abs(step).max() < 1e-8:
                break
            step = step / 2
        w = w + step
        loss, gradient, hessian = then
        if np.abs(step).max() < 1e-8:
            return w


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> BradleyTerry:
    """For features in memory: logistic loss on feature differences of dealt preference pairs (good over bad); a difference has no intercept.

    Where a class is missing all strengths are 0 and the scores 0.5. The cut is the quantile share_bad of strengths, each class weighted to its share among all labels."""
    both = np.concatenate([good, bad])
    if not len(good) or not len(bad):
        return _untrained()
    mean, spread = both.mean(0), np.maximum(both.std(0), 1e-3)
    g, b = _scaled(good, mean, spread), _scaled(bad, mean, spread)
    rng = np.random.default_rng(seed)
    n = max(len(g), len(b)) * pairs
    deal = lambda m: np.concatenate([rng.permutation(m) for _ in range(n // m + 1)])[:n]
    d = g[deal(len(g))] - b[deal(len(b))]

    def loss_at(w: np.ndarray) -> tuple:
        p = np.exp(-np.logaddexp(0, d @ w))
        return np.logaddexp(0, -(d @ w)).mean(), -(d.T @ p) / n, lambda: (d * (p * (1 - p))[:, None]).T @ d / n

    w = _newton(loss_at, len(FEATURES), ridge)
    s = np.concatenate([_strength(g, w), _strength(b, w)])
    weight = np.concatenate([np.full(len(g), (1 - share_bad) / len(g)), np.full(len(b), share_bad / len(b))])
    order = np.argsort(s)
    # the last strength at or below the quantile, and the next
    at = min(int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-9)), len(s) - 1)
    cut = float((s[order[at]] + s[order[min(at + 1, len(s) - 1)]]) / 2)
    return BradleyTerry(mean, spread, w, cut, float(max(s.std(), 1e-6)))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> BradleyTerry:
    """Fits on all labelled documents and all pairs of a good and a bad one. Labels other than 0 and 1 are not used; an id with both is not either;
    may_learn restricts the labels. The classes' shares are counted over all labels that may be used, the model is fitted on those whose document is there.

    The features of labelled documents become a table in the shared folder; what the fit needs are sums over it, so the driver holds no documents."""
    spark = docs.sparkSession
    kept = {shared_dir(spark), *scratch_made()}
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    one = one.where(may_learn) if may_learn is not None else one
    one = one.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2").select("id", F.col("y").cast("double").alias("y"))
    one = materialize(one, "labels")
    totals = {int(r["y"]): r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = sum(totals.values()) <= BROADCAST_ROWS
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(one) if few else one, "id").select("text", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                rows = np.column_stack([b.column("y").to_numpy(zero_copy_only=False), features(b.column("text"))])
                yield pa.RecordBatch.from_arrays([pa.array([rows[i : i + ROWS].tobytes() for i in range(0, len(rows), ROWS)], pa.binary())], ["rows"])

    table = materialize(map_arrow(x, measure, "rows binary"), "features")
    try:
        return _fit_table(lambda function, add=np.add: _over(table, function, add), totals)
    finally:
        drop_scratch([path for path in scratch_made() if path not in kept])


def _over(table: DataFrame, function: Callable, add: Callable) -> dict:
    """What function gives for all rows of the table of features: it takes features and classes of some and returns named arrays, which are added up,
    those of a task in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.frombuffer(text_bytes(b.column("rows"))[0].tobytes()).reshape(-1, 1 + len(FEATURES)) for b in batches)
        total = _total((function(rows[:, 1:], rows[:, 0].astype(np.int64)) for rows in parts if len(rows)), add)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    return _total((pickle.loads(r["part"]) for r in map_arrow(table, run, "part binary").collect()), add)


def _total(parts: Iterable[dict], add: Callable) -> dict:
    total: dict = {}
    for part in parts:
        for key, value in part.items():
            total[key] = add(total[key], value) if key in total else value
    return total


def _fit_table(over: Callable, totals: dict[int, int], ridge: float = RIDGE) -> BradleyTerry:
    """The fit on all pairs, from sums over all rows; totals: the labels of each class."""
    first = over(lambda x, y: {"n": np.bincount(y, minlength=2), "x": x.sum(0)})
    if not first or not first["n"].all():
        return _untrained()
    n, rows = [int(m) for m in first["n"]], int(first["n"].sum())
    mean = first["x"] / rows
    spread = np.maximum(np.sqrt(over(lambda x, y: {"x": ((x - mean) ** 2).sum(0)})["x"] / rows), 1e-3)

    def loss_at(w: np.ndarray) -> tuple:
        charges = over(lambda x, y: {key: basis.T @ np.column_stack([np.ones(len(z)), z]) for key, basis, z in _by_panel(_scaled(x, mean, spread), y, w)})
        loss, gradient, cross, bends = _pair_sums(charges)

        def hessian() -> np.ndarray:
            def bent(x: np.ndarray, y: np.ndarray) -> dict:
                return {"h": sum((z * (basis @ bends[key])[:, None]).T @ z for key, basis, z in _by_panel(_scaled(x, mean, spread), y, w))}

            return (over(bent)["h"] - cross - cross.T) / (n[0] * n[1])

        return loss / (n[0] * n[1]), gradient / (n[0] * n[1]), hessian

    w = _newton(loss_at, len(FEATURES), ridge)
    cut, scale = _cut(over, lambda x: _strength(_scaled(x, mean, spread), w), n, totals)
    return BradleyTerry(mean, spread, w, cut, scale)


def _nodes() -> np.ndarray:
    return np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)


def _by_panel(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each panel and class (key: twice the panel, and the class): the values at their strengths of the polynomials that are 1 at one node
    and 0 at the others, and z."""
    s = _strength(z, w) / WIDTH
    panel = np.floor(s).astype(np.int64)
    to_nodes = chebvander(_nodes(), NODES - 1).T * (2 / NODES)
    to_nodes[0] /= 2
    basis = chebvander(2 * (s - panel) - 1, NODES - 1) @ to_nodes
    key = 2 * panel + y
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        yield int(key[rows[0]]), basis[rows], z[rows]


def _pair_sums(charges: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Sums over all pairs (good, bad), which the charges at the nodes stand for: the loss, its gradient, of its Hessian the part of products of a good
    and a bad row, and for each panel and class the second derivative at its nodes summed over the other class."""
    keys = {y: sorted(k for k in charges if k & 1 == y) for y in (0, 1)}
    at = {y: np.concatenate([((k >> 1) + (_nodes() + 1) / 2) * WIDTH for k in keys[y]]) for y in keys}
    bad = np.concatenate([charges[k] for k in keys[0]])
    loss, cross, bends = 0.0, 0.0, {}
    gradient, bent = np.zeros(bad.shape[1] - 1), np.zeros(len(bad))
    for i, key in enumerate(keys[1]):
        good = charges[key]
        margin = at[1][i * NODES : (i + 1) * NODES, None] - at[0]
        p = np.exp(-np.logaddexp(0, margin))
        c = p * (1 - p)
        loss += good[:, 0] @ np.logaddexp(0, -margin) @ bad[:, 0]
        gradient += bad[:, 1:].T @ (good[:, 0] @ p) - good[:, 1:].T @ (p @ bad[:, 0])
        cross = cross + good[:, 1:].T @ c @ bad[:, 1:]
        bends[key] = c @ bad[:, 0]
        bent += good[:, 0] @ c
    bends.update(zip(keys[0], bent.reshape(-1, NODES)))
    return loss, gradient, cross, bends


def _cut(over: Callable, strength: Callable, n: list[int], totals: dict[int, int]) -> tuple[float, float]:
    """The middle of the last strength at or below the quantile of the share of class 0 and the next one, each class weighted to its share among all
    labels, and the deviation of strengths. Exact: the strength is found by its bits, from the first, with whole numbers as weights."""
    weight = [totals[0] * n[1], totals[1] * n[0]]
    target = totals[0] * n[0] * n[1]
    top = np.uint64(1 << 63)

    def keys(s: np.ndarray) -> np.ndarray:
        bits = (s + 0.0).view(np.uint64)  # no negative zero
        return np.where(bits >= top, ~bits, bits | top)

    prefix, below, scale = 0, 0, 0.0
    for shift in range(64 // DIGIT * DIGIT, -1, -DIGIT):

        def count(x: np.ndarray, y: np.ndarray, shift: int = shift, prefix: int = prefix) -> dict:
            s = strength(x)
            high = keys(s) >> np.uint64(shift)
            inside = high >> np.uint64(DIGIT) == np.uint64(prefix)
            digit = (high[inside] & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
            return {"n": np.bincount(digit * 2 + y[inside], minlength=2 << DIGIT), "s": np.array([s.sum(), (s * s).sum()])}

        found = over(count)
        counts = found["n"].reshape(-1, 2).astype(object)  # whole numbers of any size
        run = np.cumsum(counts @ np.array(weight, object)) + below
        digit = int(np.argmax(run >= target))
        below = run[digit - 1] if digit else below
        prefix = prefix << DIGIT | digit
    total, squares = found["s"] / sum(n)
    scale = float(max(np.sqrt(max(squares - total**2, 0.0)), 1e-6))
    key = np.uint64(prefix)
    value = float((key ^ top if key >= top else ~key).view(np.float64))
    ties = counts[digit]
    if run[digit] - weight[1 if ties[1] else 0] >= target:  # the quantile is reached before the last of equal strengths
        return value, scale
    higher = over(lambda x, y: {"s": np.min(strength(x), where=strength(x) > value, initial=np.inf)}, np.minimum)["s"]
    return (float(value + higher) / 2 if np.isfinite(higher) else value), scale


def score(docs: DataFrame, model: BradleyTerry, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; at least 0.5 above the cut. Null texts are empty. All columns of docs stay (one called as score_col is replaced)."""
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(features(b.column(at))))], [*keep, score_col])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep]), run, f"{kinds}, `{score_col}` double")


def score_ids(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score): as score, but no text goes back to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(features(b.column("text"))))], ["id", "score"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
