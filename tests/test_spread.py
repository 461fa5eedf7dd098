"""Rendered sources are dealt over tasks by their number, and parsed for the families that read them only."""

import ast

import pytest
from pyspark.sql import functions as F

from plumbline.functions import extract as x
from plumbline.plans import catalogue
from plumbline.plans.config import load
from plumbline.plans.engine import analyze_sources, detect

#: Queries over rendered sources that one task parsed, however many there were.
ONE_TASK = ["s16_long_file", "s15_fan_in", "c01_long_method", "s09_loc", "s17_too_many_branches", "s07_nocc", "c02_large_class", "s06_rfc", "k01_report_totals", "s02_wmpc", "c13_duplicate_code", "s01_nom", "s11_mpc", "k02_strict_cut", "c16_lazy_class", "s13_cyclomatic_complexity", "c08_alternative_classes", "a04_god_object", "s03_size2"]


@pytest.fixture
def tables(spark, tmp_path):
    for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        spark.range(1_000).select(F.col("id").alias(key)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("key", ONE_TASK)
def test_no_task_has_most_files(spark, tables, monkeypatch, key):
    monkeypatch.setattr(catalogue, "FILES_PER_TASK", 100, raising=False)
    dealt = []

    def facts(sources, *more):
        rows = sources.groupBy(F.spark_partition_id()).count().collect()
        dealt.append((sum(r["count"] for r in rows), max(r["count"] for r in rows)))
        return x.facts(sources, *more)

    monkeypatch.setattr(catalogue, "extract_facts", facts)
    monkeypatch.setattr("plumbline.plans.engine.extract_facts", facts)
    catalogue.QUERIES[key](spark, tables)
    assert dealt and all(n == 1_000 and most <= 200 for n, most in dealt)


def test_a_file_is_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(x.ast, "parse", lambda *a, parse=ast.parse, **k: parsed.append(a[0]) or parse(*a, **k))
    source = b"import os\nclass A:\n    def f(self):\n        return os.a.b()\n"
    whole = x.extract("/p/q/m.py", "/p", source)
    assert len(parsed) == 1 and whole["functions"] == [] and whole["classes"] and whole["code_classes"]
    for family in x.FAMILIES:
        part = x.extract("/p/q/m.py", "/p", source, families=(family,))
        assert all(v == whole[k] for k, v in part.items() if v not in ([], "", None))
    x.extract("/p/q/m.py", "/p", b"    x = 1\n    y = 2\n")  # indented, so that it is another text for the code family
    assert len(parsed) == 6


@pytest.mark.parametrize(("family", "key"), [("code", "c02_large_class"), ("architectural", "a04_god_object"), ("structural", "s01_nom")])
def test_a_family_alone_finds_the_same(spark, family, key):
    text = "".join(f"def work{i}():\n    pass\n" for i in range(22)) + "class A:\n" + "".join(f"    def m{i}(self):\n        x = {i}\n        return x\n" for i in range(17))
    sources = spark.createDataFrame([("/p/q/m.py", "/p", text.encode()), ("/p/q/n.py", "/p", b"def (:\n")], "path string, root string, content binary")
    every = detect(x.facts(sources), key, load(catalogue.EXTENDED)).collect()
    alone = analyze_sources(sources, catalogue.EXTENDED, (family,), strict=False, keys=[key])
    assert len(every) == 1 and every == alone.smells.select(*every[0].__fields__).collect()
    assert [(r["type"], r["error_type"]) for r in alone.errors.collect()] == [(family.capitalize(), "parse error")]
