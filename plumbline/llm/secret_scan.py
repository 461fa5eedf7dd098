"""Secrets: fixed patterns, and a randomness test battery with false-discovery control for what has no pattern."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.core import Words, map_arrow, materialize, slices

#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
#: What may be a random string: a run of characters of base64 or its URL form, unpadded.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Inferred encodings, the first that holds all characters: alphabet, and by how much ordinary text departs from uniformity over it (alphabet size times the sum of squared shares, less 1).
ENCODINGS = (
    ("hex", "0123456789abcdef", 3.0),
    ("HEX", "0123456789ABCDEF", 3.0),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.7),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.3),
    ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 2.2),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.4),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 2.4),
)
#: Length classes in which false discoveries are controlled apart: a short string has little evidence, and must not lend its many tests to the long.
CLASSES = (20, 24, 32, 48, 64, 128)
#: Bins a decade of p, and decades kept.
BINS, DECADES = 20, 30


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(s: str, least: float = 0.001) -> tuple[str, float]:
    """The inferred encoding and the p-value of "ordinary text": small if characters are far closer to uniform than text would have them and neither
    the runs test nor the serial correlation test (each at least) speaks against chance. Strings of no encoding, or of digits alone, have 1."""
    if s.isdigit():
        return "digits", 1.0
    for name, alphabet, departs in ENCODINGS:
        code = {c: i for i, c in enumerate(alphabet)}
        if all(c in code for c in s):
            break
    else:
        return "none", 1.0
    x = np.array([code[c] for c in s], float)
    n, k = len(x), len(alphabet)
    chi = float((np.bincount(x.astype(int), minlength=k) ** 2).sum()) * k / n - n
    mean, sd = k - 1 + n * departs, math.sqrt(2 * (k - 1) + 4 * n * departs)
    p = _normal_tail((mean - chi) / sd)
    up = x >= k / 2
    a, b = int(up.sum()), int(n - up.sum())
    if not a or not b:
        return name, 1.0
    runs = 1 + int((up[1:] != up[:-1]).sum())
    expected = 1 + 2 * a * b / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    d = x - x.mean()
    serial = float((d[1:] * d[:-1]).sum() / (d**2).sum()) * math.sqrt(n) if (d**2).sum() else math.inf
    if 2 * _normal_tail(abs(runs - expected) / math.sqrt(variance) if variance > 0 else math.inf) < least or 2 * _normal_tail(abs(serial)) < least:
        return name, 1.0
    return name, p


def _class(n: int) -> int:
    return max(i for i, least in enumerate(CLASSES) if n >= least)


def _bin(p: float) -> int:
    return min(BINS * DECADES, int(-math.log10(max(p, 1e-300)) * BINS))


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, comma-joined. spans: (start, kind's place, end)."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Fixed patterns only, over one text (the scan below finds the same from long words alone)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return out + [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base array of (kind, start, end), candidates array of (start, end, class, bin)), spans in code points.

    Only words of 16 bytes or more can hold access and hex matches and candidates; their places come from byte offsets. Assignments can only be where
    there is a colon or an equals sign."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        may = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())])
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column("text"), hashed=False)
                data, off = w.data, w.offsets
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                long = np.flatnonzero(w.ends - w.starts >= 16)
                doc = np.searchsorted(w.bounds, long, "right") - 1
                base: list[list] = [[] for _ in range(b.num_rows)]
                may_be: list[list] = [[] for _ in range(b.num_rows)]
                for d, s, e, at in zip(doc.tolist(), w.starts[long].tolist(), w.ends[long].tolist(), (points[w.starts[long]] - points[off[doc]]).tolist(), strict=True):
                    word = data[s:e].tobytes().decode("utf-8", "replace")
                    base[d] += [(2, at + m.start(), at + m.end()) for m in HEX.finditer(word)]
                    if "AKIA" in word:
                        base[d] += [(1, at + m.start(), at + m.end()) for m in ACCESS.finditer(word)]
                    for m in CANDIDATE.finditer(word):
                        p = battery(m[0])[1]
                        may_be[d].append((at + m.start(), at + m.end(), _class(len(m[0])), _bin(p)))
                marks = np.concatenate([[0], np.cumsum((data == 58) | (data == 61), dtype=np.int64)])
                for d in np.flatnonzero(marks[off[1:]] > marks[off[:-1]]).tolist():
                    text = data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
                    base[d] += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
                named = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in sorted(r, key=lambda x: (x[1], x[0]))] for r in base]
                maybe = [[dict(zip(("start", "end", "class", "bin"), x, strict=True)) for x in r] for r in may_be]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(named, pa.list_(span)), pa.array(maybe, pa.list_(may))], ["id", "base", "candidates"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), find, f"id {kind}, base array<struct<kind int, start long, end long>>, candidates array<struct<start long, end long, class int, bin int>>")


def discovery_bins(scanned: DataFrame, rate: float = 0.01) -> dict[int, int]:
    """By length class the least bin of p that counts as a discovery: Benjamini and Hochberg's step-up rule over all candidates of all documents, from
    the counts of a bounded number of bins."""
    rows = scanned.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.bin").agg(F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    for k in {r["class"] for r in rows}:
        mine = sorted(((r["bin"], r["n"]) for r in rows if r["class"] == k), reverse=True)
        total, seen = sum(n for _, n in mine), 0
        for b, n in mine:
            seen += n
            if 10 ** (-b / BINS) <= rate * seen / total:
                out[k] = b
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, comma-joined).

    rate: the share of false discoveries among random strings that is allowed in each length class. A random string that meets a base span is left
    out. Null texts are empty and have no spans; repeated rows are scanned each; extra columns are left out; an empty table gives no rows."""
    found = materialize(scan(docs, id_col, text_col), "secrets")
    least = discovery_bins(found, rate)
    is_hit = " or ".join(f"(c.class = {k} and c.bin >= {b})" for k, b in least.items()) or "false"
    free = "not exists(base, b -> b.start < c.end and c.start < b.end)"
    random = F.expr(f"transform(filter(candidates, c -> ({is_hit}) and {free}), c -> struct(3 as kind, c.start as start, c.end as end))")
    named = "element_at(array('assign', 'access', 'hex', 'random'), x.kind + 1) || ':' || x.start || ':' || x.end"
    by_place = lambda c: f"transform(array_sort(transform({c}, s -> struct(s.start as start, s.kind as kind, s.end as end))), x -> {named})"
    f = found.withColumn("random", random)
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return f.select(
        F.col("id").alias(id_col),
        *counts,
        F.size("random").cast("long").alias("n_random"),
        F.sha2(F.expr(f"array_join({by_place('base')}, ',')").cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join({by_place('concat(base, random)')}, ',')").alias("spans"),
    )
