"""python -m plumbline DIRECTORY [--config FILE] [--output NAME] [--type FAMILY] [--debug] [--robust]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from plumbline.plans.config import check, load
from plumbline.plans.engine import FAMILIES, analyze
from plumbline.sources.reports import console, render, write_reports


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description="Finds code, architectural and structural smells in Python source trees.")
    p.add_argument("directory")
    p.add_argument("--config", help="YAML file of thresholds (default: the built-in set)")
    p.add_argument("--output", help="name of the report files (.txt, .csv, .json)")
    p.add_argument("--type", choices=FAMILIES, help="one family only")
    p.add_argument("--robust", action="store_true", help="go on in a file after a detector would have broken off")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--log", default="plumbline.log", help="a file that gets the log too (empty: none)")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO, handlers=[logging.StreamHandler(), *([logging.FileHandler(a.log)] if a.log else [])])
    check(load(a.config))
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    result = analyze(spark, a.directory, a.config, (a.type,) if a.type else FAMILIES, strict=not a.robust)
    smells = result.smells.persist()
    print("\n".join(console(smells) if a.type else render(smells)))
    for r in result.summary().collect():
        print(f"{r['type']}: {r['files']} files analyzed, {r['errors']} errors, success rate {r['success_rate']:.1%}")
    if a.output:
        print("Written:", ", ".join(write_reports(smells, a.output)))
    for r in result.errors.collect():  # as many as files that could not be read or parsed
        logging.getLogger("plumbline").warning("%s: %s", r["file_path"], r["message"])
    smells.unpersist()
    result.release()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
