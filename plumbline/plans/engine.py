"""Analysis of a source tree: facts once, a plan for each detector, one table of smells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.extract import FAMILIES
from plumbline.functions.extract import facts as extract_facts
from plumbline.operators import architectural, code, structural
from plumbline.operators.base import SMELL_COLUMNS
from plumbline.plans.config import Thresholds, load
from plumbline.sources.pytree import UNREADABLE, read_tree
from plumbline.sources.reports import ordered, write_csv, write_json

#: All detectors by key; the key's letter is the family.
DETECTORS = code.DETECTORS | architectural.DETECTORS | structural.DETECTORS


class AnalysisError(Exception):
    """What went wrong, and where."""

    def __init__(self, message: str, file_path: str | None = None, line_number: int | None = None, function_name: str | None = None):
        self.file_path, self.line_number, self.function_name = file_path, line_number, function_name
        super().__init__(f"{message} (file {file_path}, line {line_number}, function {function_name})")


def family_of(key: str) -> str:
    """The family of a detector, whose facts it reads."""
    return next(f for f in FAMILIES if f[0] == key[0])


def detect(facts: DataFrame, key: str, config: dict[str, Thresholds]) -> DataFrame:
    """The smells of one detector."""
    if key in code.DETECTORS:
        return code.DETECTORS[key](facts, config["code_smells"])
    if key in architectural.DETECTORS:
        return architectural.DETECTORS[key](architectural.Project.of(facts), config["architectural_smells"])
    return structural.DETECTORS[key](structural.Structure(facts), config["structural_smells"])


@dataclass
class Analysis:
    """Results of a run. smells: the public columns, family by family, each file's in the order of its detectors. errors: files that could not be read
    or parsed, by family. The facts are kept until release()."""

    facts: DataFrame
    smells: DataFrame
    errors: DataFrame
    families: tuple[str, ...]

    def release(self) -> None:
        """Gives the kept facts up; results that are read later work them out anew."""
        self.facts.unpersist()

    def summary(self) -> DataFrame:
        """Rows (type, files, errors, smells, success_rate): files are those that were analyzed."""
        n = self.facts.agg(
            F.count_if(F.col("code_error").isNull()).alias("code_ok"),
            F.count_if(F.col("code_error").isNotNull()).alias("code_bad"),
            F.count_if(F.col("error").isNull()).alias("ok"),
            F.count_if(F.col("error").isNotNull()).alias("bad"),
        )
        rows = [n.select(F.lit(f.capitalize()).alias("type"), F.col("code_ok" if f == "code" else "ok").alias("files"), F.col("code_bad" if f == "code" else "bad").alias("errors")) for f in self.families]
        found = self.smells.groupBy("type").agg(F.count("*").alias("smells"))
        out = reduce(DataFrame.unionByName, rows).join(found, "type", "left")
        return out.select("type", "files", "errors", F.coalesce("smells", F.lit(0)).alias("smells"), ((F.col("files") - F.col("errors")) / F.greatest("files", F.lit(1))).alias("success_rate"))


def analyze_sources(sources: DataFrame, config: str | dict | None = None, families: tuple[str, ...] = FAMILIES, strict: bool = True, keys: list[str] | None = None) -> Analysis:
    """Analyzes sources (path, root, content). Facts are extracted once and kept; only the facts and plans of the families asked for are made.

    strict: in the code family a file's smells end where a run of the detectors, one after another, would break off (see operators.code.aborts);
    otherwise every detector reports all it finds. keys picks single detectors."""
    thresholds = load(config)
    facts = extract_facts(sources, families).persist()
    plans: list[DataFrame] = []
    for family in families:
        own = {"code": code.DETECTORS, "architectural": architectural.DETECTORS, "structural": structural.DETECTORS}[family]
        found = [detect(facts, k, thresholds) for k in own if keys is None or k in keys]
        if not found:
            continue
        one = reduce(DataFrame.unionByName, found)
        if family == "code" and strict:
            one = code.strict(one, facts, thresholds["code_smells"])
        plans.append(one)
    smells = reduce(DataFrame.unionByName, plans) if plans else facts.sparkSession.createDataFrame([], "type string, name string, description string, file_path string, module_class string, line_number int, severity string, step int, seq int")
    bad = [facts.where(F.col(c).isNotNull()).select(F.lit(f.capitalize()).alias("type"), F.col("path").alias("file_path"), F.when(F.startswith(F.col(c), F.lit(UNREADABLE)), "read error").otherwise("parse error").alias("error_type"), F.col(c).alias("message")) for f, c in (("code", "code_error"), ("architectural", "error"), ("structural", "error")) if f in families]
    return Analysis(facts, smells.select(*SMELL_COLUMNS, "step", "seq"), reduce(DataFrame.unionByName, bad), families)


def analyze(spark: SparkSession, path: str, config: str | dict | None = None, families: tuple[str, ...] = FAMILIES, strict: bool = True) -> Analysis:
    """Analyzes the .py files below a directory (or one file). A directory without any is an error."""
    sources = read_tree(spark, path)
    if sources.isEmpty():
        raise AnalysisError("no Python files", path)
    return analyze_sources(sources, config, families, strict)


def analyze_code(spark: SparkSession, path: str, config: str | dict | None = None, strict: bool = True) -> DataFrame:
    return ordered(analyze(spark, path, config, ("code",), strict).smells)


def analyze_architecture(spark: SparkSession, path: str, config: str | dict | None = None) -> DataFrame:
    return ordered(analyze(spark, path, config, ("architectural",)).smells)


def analyze_structure(spark: SparkSession, path: str, config: str | dict | None = None, output: str | None = None) -> DataFrame:
    """output: the stem of a CSV and a JSON report, which this family writes itself."""
    smells = analyze(spark, path, config, ("structural",)).smells
    if output:
        smells = smells.persist()
        write_csv(smells, f"{output}.csv")
        write_json(smells, f"{output}.json")
    return ordered(smells)
