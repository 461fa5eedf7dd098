"""Report sinks: text, CSV and JSON files, and tables for large results."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.operators.base import SMELL_COLUMNS

#: Header of the CSV report.
HEADER = ("Type", "Name", "Description", "File", "Module/Class", "Line Number", "Severity")
_ORDER = {"Structural": 0, "Code": 1, "Architectural": 2}


def ordered(smells: DataFrame) -> DataFrame:
    """Structural, code, architectural; within each by detector and file."""
    rank = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])[F.col("type")]
    by = [c for c in ("step", "file_path", "seq", "module_class", "line_number", "description") if c in smells.columns]
    return smells.orderBy(rank, *by).select(*SMELL_COLUMNS)


def _rows(smells: DataFrame) -> Iterator[Row]:
    return ordered(smells).toLocalIterator()


def write_csv(smells: DataFrame, path: str) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(HEADER)
        for r in _rows(smells):
            out.writerow(["" if x is None else x for x in r])


def write_json(smells: DataFrame, path: str) -> None:
    """One array; null stays null. Rows are written one by one."""
    with open(path, "w", encoding="utf-8") as f:
        empty = True
        f.write("[")
        for r in _rows(smells):
            f.write("\n" if empty else ",\n")
            f.write("\n".join("    " + x for x in json.dumps(r.asDict(), indent=4).split("\n")))
            empty = False
        f.write("]" if empty else "\n]")


def console_line(row: Row) -> str:
    """How a family shows a smell of its own on the console: code names and describes it, the others show all fields."""
    if row["type"] == "Code":
        return f"{row['name']}: {row['description']}"
    return f"{row['type']}Smell(" + ", ".join(f"{c}={row[c]!r}" for c in SMELL_COLUMNS[1:]) + ")"


def console(smells: DataFrame) -> Iterator[str]:
    """Lines of the console report of one family or more."""
    for row in _rows(smells):
        yield console_line(row)


def _lines(row: Row) -> Iterator[str]:
    yield f"- {row['name']}: {row['description']}"
    if row["type"] == "Structural":
        yield f"  File: {row['file_path']}"
        if row["line_number"]:
            yield f"  Line: {row['line_number']}"
        yield f"  Severity: {row['severity']}"


def render(smells: DataFrame) -> Iterator[str]:
    """Lines of the text report: a section for each family, then totals."""
    totals = {r["type"]: r["n"] for r in smells.groupBy("type").agg(F.count("*").alias("n")).collect()}
    rows = _rows(smells)
    row = next(rows, None)
    for kind in _ORDER:
        yield f"=== {kind} smells ==="
        if not totals.get(kind):
            yield f"No {kind.lower()} smells detected."
        while row is not None and row["type"] == kind:
            yield from _lines(row)
            row = next(rows, None)
        yield ""
    for kind in _ORDER:
        yield f"{kind} smells: {totals.get(kind, 0)}"
    yield f"Total smells: {sum(totals.values())}"


def write_reports(smells: DataFrame, output: str) -> list[str]:
    """output's stem with .txt, .csv and .json."""
    stem = str(Path(output).with_suffix(""))
    Path(f"{stem}.txt").write_text("\n".join(render(smells)) + "\n", encoding="utf-8")
    write_csv(smells, f"{stem}.csv")
    write_json(smells, f"{stem}.json")
    return [f"{stem}.{x}" for x in ("txt", "csv", "json")]


def write_table(smells: DataFrame, path: str, kind: str = "parquet") -> None:
    """At scale: a folder, by type. kind: parquet, json or csv."""
    w = smells.select(*SMELL_COLUMNS).write.mode("overwrite").partitionBy("type")
    (w.option("header", True) if kind == "csv" else w.option("ignoreNullFields", False)).format(kind).save(path)
