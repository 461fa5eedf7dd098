"""What all detectors share: the smells schema, views of the facts, and small predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.extract import LINE_CLASSES

#: The public columns of a smell, in order.
SMELL_COLUMNS = ("type", "name", "description", "file_path", "module_class", "line_number", "severity")


def smells(df: DataFrame, kind: str, name: str, description: Column, *, path: str | Column = "path", owner: Column | None = None, line: Column | None = None, severity: str | Column = "medium", step: int = 0, seq: Column | None = None) -> DataFrame:
    """Rows of one smell. step and seq order a file's smells as its detectors make them."""
    none = F.lit(None)
    return df.select(
        F.lit(kind).alias("type"), F.lit(name).alias("name"), description.alias("description"), (F.col(path) if isinstance(path, str) else path).alias("file_path"), (owner if owner is not None else none).cast("string").alias("module_class"),
        (line if line is not None else none).cast("int").alias("line_number"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(step).alias("step"), (seq if seq is not None else F.lit(0)).cast("int").alias("seq"),
    )


def rows_of(facts: DataFrame, column: str, *more: str, code: bool = True) -> DataFrame:
    """One row for each entry of a list of facts, with its file's path (and more). code: of files that the code family could parse."""
    bad = "code_error" if code else "error"
    return facts.where(F.col(bad).isNull()).select("path", *more, F.inline(column))


def line_codes(lines: Column) -> Column:
    """A string of one class for each of an array of stripped lines (see functions.extract.LINE_CLASSES)."""

    def code(x: Column) -> Column:
        kind = F.when(x == "", " ")
        for start, k in LINE_CLASSES:
            kind = kind.when(x.startswith(start), k)
        return kind.otherwise("C")

    return F.array_join(F.transform(lines, code), "")


def count_of(codes: Column, classes: str) -> Column:
    """How many lines of a string of classes are of these."""
    return F.length(F.regexp_replace(codes, f"[^{classes}]", "")).cast("long")


def halves(codes: Column) -> tuple[Column, Column]:
    """The classes of lines outside and inside of documentation. A line that starts with three quotes turns it on or off, whatever else it holds; such
    lines are in neither."""
    parts = F.split(codes, "[DS]", -1)
    every = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    return every(0), every(1)


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def ends(c: Column, *suffixes: str) -> Column:
    return any_of([c.endswith(s) for s in suffixes])


def begins(c: Column, *prefixes: str) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def holds(c: Column, *parts: str) -> Column:
    return any_of([F.contains(c, F.lit(p)) for p in parts])


def dunder(c: Column) -> Column:
    return c.startswith("__") & c.endswith("__")


def decorated(decorators: Column, names: list[str], forms: list[str]) -> Column:
    """Whether a decorator of one of the forms has one of the names."""
    return F.exists(decorators, lambda d: d["form"].isin(forms) & d["name"].isin(names))


def commas(c: Column) -> Column:
    return F.array_join(c, ", ")


def nodes_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All modules of a graph with their degrees: nodes (id), edges (src, dst), each edge once. A loop counts in both."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.lit(0).cast("long").alias("n_out"), F.count("*").alias("n_in"))
    alone = nodes.select("id", F.lit(0).cast("long").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    return alone.unionByName(out).unionByName(into).groupBy("id").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
