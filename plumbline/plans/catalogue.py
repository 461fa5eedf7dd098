"""The registered queries of the smell detectors, and closed-form SQL for each.

Python sources are rendered from the tables by templates whose sizes are key arithmetic; the engine parses and analyzes them; the SQL says from the
keys alone what must be found. Graph detectors run on relations taken from the tables instead."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.extract import facts as extract_facts
from plumbline.operators import architectural, code, structural
from plumbline.operators.base import line_codes
from plumbline.operators.graph import cycles, inner_edges, path_counts
from plumbline.plans.config import EXTENDED, PACKAGED, load
from plumbline.plans.engine import analyze, analyze_sources, detect, family_of
from plumbline.sources.reports import write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The keys that sources are rendered from, by table.
KEYS = {"supplier": "s_suppkey", "customer": "c_custkey"}
#: Columns of a smell in a query's result.
COLUMNS = ("name", "description", "file_path", "module_class", "line_number", "severity")
#: Files that one task renders and parses, at most about; small tables are dealt over the cores, from FEW files a task on.
FILES_PER_TASK, FEW = 1_000, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(spark: SparkSession, sf_dir: str, source: str, name: str = "'m' || k", rows: str = "supplier") -> DataFrame:
    """One file for each row: source is SQL for its text over k (the key). A table of keys is small, and so one partition or few, however many files
    it stands for; the keys are dealt over tasks by their number."""
    t = table(spark, sf_dir, rows).select(F.col(KEYS[rows]).cast("long").alias("k"))
    n = t.count()
    t = t.repartition(max(-(-n // FILES_PER_TASK), min(spark.sparkContext.defaultParallelism, -(-n // FEW)), 1))
    path = F.expr(f"'/proj/pkg/' || {name} || '.py'")
    return t.select(path.alias("path"), F.lit("/proj").alias("root"), F.expr(source).cast("binary").alias("content"))


def _select(smells: DataFrame) -> DataFrame:
    return smells.select("name", "description", "file_path", "module_class", F.col("line_number").cast("long").alias("line_number"), "severity")


def render_query(key: str, source: str, oracle: str, detector: str | None = None, config: dict | None = None, rows: str = "supplier", root: str = "/proj") -> None:
    """Registers key: its detector over sources rendered from the keys of suppliers (or rows). oracle: SQL over s (k), with the columns of a smell.
    config: architectural thresholds other than the usual ones."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = rendered(spark, sf_dir, source, rows=rows).withColumn("root", F.lit(root))
        facts = extract_facts(sources, (family_of(detector or key),)).persist()  # parsed once, whatever the plan reads
        thresholds = load(EXTENDED | {"architectural_smells": EXTENDED["architectural_smells"] | (config or {})})
        found = _select(detect(facts, detector or key, thresholds))
        if found._jdf.queryExecution().analyzed().collectLeaves().size() == 1:  # read once: no need to keep them
            facts.unpersist()
        return found

    QUERIES[key] = query
    ORACLES[key] = f"with recursive s as (select cast({KEYS[rows]} as bigint) k from {rows}) {oracle}"


def _smell(name: str, said: str, where: str, owner: str, line: str = "cast(null as bigint)", severity: str = "'medium'", frm: str = "s") -> str:
    return f"select '{name}' as name, {said} as description, '/proj/pkg/m' || k || '.py' as file_path, {owner} as module_class, {line} as line_number, {severity} as severity from {frm} where {where}"


_PATH = "'/proj/pkg/m' || k || '.py'"
_LEVEL = lambda n, most: f"case when {n} > {most} * 1.5 then 'High' else 'Medium' end"


def lines(n: str, text: str) -> str:
    """SQL (Spark) for n lines of text over the line's number i."""
    return f"array_join(transform(case when ({n}) > 0 then sequence(1, cast({n} as int)) else array() end, i -> {text}), '')"


# --- code ----------------------------------------------------------------------------------------------

render_query(
    "c01_long_method",
    "'def f' || k || '():\\n' || " + lines("1 + k * 7 % 60", "'    x = ' || i || '\\n'") + " || 'class A:\\n    def g(self):\\n' || " + lines("60", "'        y = 1\\n'"),
    _smell("Long Method", f"'''f' || k || ''' has ' || (2 + k * 7 % 60) || ' lines in ' || {_PATH} || ' at line 1'", "2 + k * 7 % 60 > 45", "'f' || k", "cast(1 as bigint)"),
)
render_query(
    "c02_large_class",
    "'class A' || k || ':\\n' || "
    + lines("1 + k * 7 % 25", "'    def m' || i || '(self):\\n        x = 1\\n        return x\\n'")
    + " || '    def __len__(self):\\n        x = 1\\n        return x\\n    def t(self):\\n        return 1\\n'",
    _smell("Large Class", f"'''A' || k || ''' has ' || (1 + k * 7 % 25) || ' non-trivial methods in ' || {_PATH}", "1 + k * 7 % 25 > 15", "'A' || k", "cast(1 as bigint)"),
)
render_query(
    "c03_primitive_obsession",
    "'def f(' || array_join(transform(sequence(1, cast(1 + k % 9 as int)), i -> 'p' || i || ': int'), ', ') || case when k % 2 = 0 then ', q, r, s, t' else '' end || '):\\n    pass\\n'",
    _smell("Primitive Obsession", f"'''f'' has ' || (1 + k % 9) || ' primitive parameters in ' || {_PATH}", "1 + k % 9 > 4 and (1 + k % 9) / (1.0 + k % 9 + case when k % 2 = 0 then 4 else 0 end) > 0.7", "'f'", "cast(1 as bigint)"),
)
render_query(
    "c04_long_parameter_list",
    "'def f(self, ' || array_join(transform(sequence(1, cast(1 + k % 12 as int)), i -> 'p' || i), ', ') || case when k % 2 = 0 then ', **kw' else '' end || '):\\n    pass\\n'",
    _smell("Long Parameter List", f"'''f'' has ' || (1 + k % 12) || ' parameters in ' || {_PATH}", "1 + k % 12 > 5 + case when k % 2 = 0 then 2 else 0 end", "'f'", "cast(1 as bigint)"),
)
_CLUMP = ", ".join(f"p{i}" for i in range(1, 7))
render_query(
    "c05_data_clumps",
    f"'def f({_CLUMP}):\\n    pass\\ndef g({_CLUMP}' || case when k % 3 = 0 then ', z' else '' end || '):\\n    pass\\n' || case when k % 2 = 0 then 'def h({_CLUMP}):\\n    pass\\n' else 'def h(p1, p2):\\n    pass\\n' end",
    _smell("Data Clumps", f"'Parameters {_CLUMP} appear together in functions: f, g' || case when k % 2 = 0 then ', h' else '' end || ' in ' || {_PATH}", "true", "'f, g' || case when k % 2 = 0 then ', h' else '' end"),
)
render_query(
    "c06_switch_statements",
    "'def f(x):\\n    if x:\\n        a = 1\\n        b = 2\\n        c = 3\\n    else:\\n' || " + lines("1 + k % 6", "'        if y' || i || ':\\n            d = 1\\n'"),
    _smell("Switch Statements", f"'Complex conditional with ' || (2 + k % 6) || ' branches at line 2 in ' || {_PATH}", "2 + k % 6 > 3", "cast(null as varchar)", "cast(2 as bigint)"),
)
render_query(
    "c07_temporary_field",
    "'class A:\\n    def __init__(self' || array_join(transform(sequence(1, cast(1 + k % 5 as int)), i -> ', p' || i), '') || '):\\n        pass\\n    def g(self):\\n        return self.p1\\n'",
    _smell("Temporary Field", f"'Potentially unused fields ' || (select string_agg('p' || i, ', ' order by i) from range(2, 2 + k % 5) r(i)) || ', self in class ''A'' at line 1 in ' || {_PATH}", "1 + k % 5 >= 3", "'A'", "cast(1 as bigint)", "'low'"),
)
render_query(
    "c08_alternative_classes",
    lines("1 + k % 6", "'class A' || i || case when k % 5 = 4 and i = 1 then '(Base)' else '' end || ':\\n    def run(self):\\n        pass\\n    def stop(self):\\n        pass\\n    def _p' || i || '(self):\\n        pass\\n'"),
    _smell("Alternative Classes with Different Interfaces", f"'Classes ' || (select string_agg('A' || i, ', ' order by i) from range(1, 2 + k % 6) r(i)) || ' share similar methods run, stop in ' || {_PATH}", "1 + k % 6 >= 3 and k % 5 <> 4", "(select string_agg('A' || i, ', ' order by i) from range(1, 2 + k % 6) r(i))"),
)
render_query(
    "c09_divergent_change",
    "'class A:\\n' || " + lines("1 + k % 9", "'    def w' || i || '_x(self):\\n        pass\\n'") + " || '    def get_x(self):\\n        pass\\n    def _y(self):\\n        pass\\n'",
    _smell("Potential Divergent Change", f"'Class ''A'' has ' || (1 + k % 9) || ' different method prefixes: ' || (select string_agg('w' || i, ', ' order by i) from range(1, 2 + k % 9) r(i)) || ' in ' || {_PATH}", "1 + k % 9 > 5", "'A'", "cast(1 as bigint)"),
)
render_query(
    "c10_parallel_inheritance",
    "'class A1(P):\\n    def run(self):\\n        pass\\n' || case when k % 2 = 0 then '    def stop(self):\\n        pass\\n' else '' end || 'class A2(P):\\n    pass\\nclass B1(Q):\\n    def run(self):\\n        pass\\n' || "
    + lines("k % 4", "'    def z' || i || '(self):\\n        pass\\n'")
    + " || 'class B2(Q):\\n    pass\\n'",
    _smell("Parallel Inheritance Hierarchies", f"'Parallel hierarchies detected: A1 -> A2 and B1 -> B2 in ' || {_PATH}", "1.0 / (1 + case when k % 2 = 0 then 1 else 0 end + k % 4) > 0.3", "cast(null as varchar)", severity="'high'"),
)
render_query(
    "c11_shotgun_surgery",
    lines("1 + k % 10", "'def f' || i || '():\\n    common()\\n    print(1)\\n'"),
    _smell("Potential Shotgun Surgery", f"'Method ''common'' called in ' || (1 + k % 10) || ' different contexts across ' || (1 + k % 10) || ' locations in ' || {_PATH}", "1 + k % 10 > 5", "'common'", "cast(2 as bigint)", "'high'"),
)
render_query(
    "c12_excessive_comments",
    "'x = 1\\n' || " + lines("1 + k % 9", "repeat('# c\\n', cast(4 + k % 4 as int)) || 'y = ' || i || '\\n'"),
    _smell("Excessive Comments", f"'File has ' || printf('%.1f', 100.0 * ((1 + k % 9) * (4 + k % 4)) / (2 + k % 9)) || '% comment ratio with ' || (1 + k % 9) || ' large comment blocks in ' || {_PATH}", "1 + k % 9 > 5 and 4 + k % 4 > 5", "cast(null as varchar)", severity="'low'"),
)
_BODY = "'    a = 1\\n    b = a + 2\\n    c = b * a\\n    d = c - 1\\n    return d\\n'"
render_query(
    "c13_duplicate_code",
    lines("1 + k * 7 % 20", f"'def f' || i || '(x):\\n' || {_BODY}") + f" || 'def other(x):\\n    if x:\\n        return 2\\n' || {_BODY}",
    _smell("Duplicate Code", f"'Similar code found in functions: ' || (select string_agg('f' || i, ', ' order by i) from range(1, 2 + k * 7 % 20) r(i)) || ' (' || (5 * (1 + k * 7 % 20)) || ' total lines) in ' || {_PATH}", "1 + k * 7 % 20 >= 15", "(select string_agg('f' || i, ', ' order by i) from range(1, 2 + k * 7 % 20) r(i))", severity="'high'"),
)
render_query(
    "c14_data_class",
    "'class A' || case when k % 4 = 3 then 'DTO' else '' end || ':\\n' || "
    + lines("1 + k % 4", "'    def get_' || i || '(self):\\n        return 1\\n'")
    + " || "
    + lines("k % 3", "'    def set_' || i || '(self, v):\\n        self.v = v\\n'")
    + " || case when k % 7 = 0 then '    def run(self):\\n        pass\\n' else '' end",
    _smell("Data Class", f"'Class ''A'' has ' || (1 + k % 4) || ' getters and ' || (k % 3) || ' setters with no other methods in ' || {_PATH}", "1 + k % 4 + k % 3 >= 4 and k % 7 <> 0 and k % 4 <> 3", "'A'", "cast(1 as bigint)"),
)
render_query(
    "c15_dead_code",
    lines("1 + k % 6", "'def _f' || i || '():\\n    pass\\n'") + " || 'def g():\\n    _f1()\\n'",
    f"select 'Dead Code' as name, 'Potentially unused function ''_f' || i || ''' in ' || {_PATH} as description, {_PATH} as file_path, '_f' || i as module_class, cast(null as bigint) as line_number, 'low' as severity from s, range(2, 8) r(i) where i <= 1 + k % 6 and k % 6 >= 3",
)
render_query(
    "c16_lazy_class",
    "'class A:\\n' || " + lines("1 + k % 7", "'    def m' || i || '(self):\\n' || repeat('        x = 1\\n', cast(2 + k % 20 as int))"),
    _smell("Lazy Class", f"'Class ''A'' has only ' || (1 + k % 7) || ' non-trivial methods with ' || ((1 + k % 7) * (2 + k % 20)) || ' total lines in ' || {_PATH}", "1 + k % 7 <= 4 and (1 + k % 7) * (2 + k % 20) <= 50", "'A'", "cast(1 as bigint)", "'low'"),
)
render_query(
    "c17_speculative_generality",
    "'class A:\\n' || " + lines("1 + k % 8", "'    def m' || i || '(self):\\n        pass\\n'"),
    _smell("Speculative Generality", f"'Class ''A'' has ' || (1 + k % 8) || ' empty methods: ' || (select string_agg('m' || i, ', ' order by i) from range(1, 2 + k % 8) r(i)) || ' in ' || {_PATH}", "1 + k % 8 >= 4", "'A'", "cast(1 as bigint)"),
)
render_query(
    "c18_feature_envy",
    "'def f(self, o, p):\\n    x = 1\\n' || " + lines("1 + k % 8", "'    o.a' || i || '()\\n'") + " || " + lines("k % 3", "'    self.b' || i || '()\\n'") + " || '    p.z()\\n    logger.info(1)\\n'",
    _smell("Feature Envy", f"'Method ''f'' makes ' || (1 + k % 8) || ' calls to ''o'' but only ' || (k % 3) || ' local calls in ' || {_PATH}", "1 + k % 8 > 3 and 1 + k % 8 > 2.0 * (k % 3)", "'f'", "cast(1 as bigint)"),
)
render_query(
    "c19_inappropriate_intimacy",
    "'class A:\\n' || "
    + lines("1 + k % 8", "'    def x' || i || '(self):\\n        pass\\n'")
    + " || 'class B' || case when k % 5 = 0 then '(A)' else '' end || ':\\n    def __init__(self):\\n        self.q = 1\\n' || "
    + lines("1 + k % 6", "'        self.x' || i || ' = 1\\n'"),
    _smell("Inappropriate Intimacy", f"'Class ''A'' might be too intimate with ''B'' (' || least(1 + k % 8, 1 + k % 6) || ' shared members, ' || printf('%.1f', 100.0 * least(1 + k % 8, 1 + k % 6) / (1 + k % 8)) || '% of methods) in ' || {_PATH}", "least(1 + k % 8, 1 + k % 6) > 3 and k % 5 <> 0", "'A'"),
)
render_query(
    "c20_message_chains",
    "'def f(o):\\n    return o' || " + lines("1 + k % 7", "'.a' || i") + " || '\\n'",
    f"select 'Message Chains' as name, 'Long chain (' || n || ' calls: ' || (select string_agg('a' || i, ' -> ' order by i) from range(1, n + 1) r(i)) || ') in f at line 2 in ' || {_PATH} as description, {_PATH} as file_path, 'f' as module_class, cast(2 as bigint) as line_number, 'medium' as severity from s, range(4, 8) q(n) where n <= 1 + k % 7",
)
render_query(
    "c21_middle_man",
    "'class A:\\n    x = 1\\n    y = 2\\n' || "
    + lines("1 + k % 5", "'    def m' || i || '(self):\\n        return self.o.run()\\n'")
    + " || "
    + lines("1 + k % 4", "'    def n' || i || '(self):\\n        z = 1\\n        return z\\n'"),
    _smell("Middle Man", f"'Class ''A'' delegates ' || (1 + k % 5) || '/' || (2 + k % 5 + k % 4) || ' methods (' || printf('%.1f', 100.0 * (1 + k % 5) / (2 + k % 5 + k % 4)) || '%), mainly to self.o in ' || {_PATH}", "(1 + k % 5) / (2.0 + k % 5 + k % 4) > 0.5", "'A'", "cast(1 as bigint)"),
)

# --- architectural ---------------------------------------------------------------------------------------

render_query(
    "a04_god_object",
    lines("1 + k * 7 % 40", "'def fn' || i || '():\\n    pass\\n'") + " || 'def _p():\\n    pass\\ndef test_x():\\n    pass\\n'",
    _smell("God Object", "'Module ''pkg.m' || k || ''' has too many public functions (' || (1 + k * 7 % 40) || ')'", "1 + k * 7 % 40 > 20", "'pkg.m' || k"),
)
render_query(
    "a05_improper_api_usage",
    "'def f(api):\\n' || " + lines("1 + k % 15", "'    api.send()\\n'") + " || " + lines("k % 11", "'    api.u' || i || '()\\n'"),
    _smell("Potential Improper API Usage", "'Module ''pkg.m' || k || ''' has repetitive API calls: send(' || (1 + k % 15) || 'x)'", "1 + k % 15 + k % 11 >= 10 and 1 + k % 15 >= 3 and (1 + k % 15) / (1.0 + k % 15 + k % 11) > 0.4", "'pkg.m' || k"),
)
_IN_ONE_OF = "'/proj/pkg/m' || first || '.py'"
render_query(
    "a02_scattered_functionality",
    "'def shared' || (k % 3) || '():\\n    pass\\ndef own' || k || '():\\n    pass\\n'",
    "select 'Scattered Functionality' as name, 'Function ''shared' || g || ''' appears in ' || n || ' modules: ' || mods as description, '/proj/' || replace(split_part(mods, ', ', 1), '.', '/') || '.py' as file_path, split_part(mods, ', ', 1) as module_class, cast(null as bigint) as line_number, 'medium' as severity from (select k % 3 as g, count(*) as n, string_agg('pkg.m' || k, ', ' order by 'pkg.m' || k) as mods from s group by 1) where n >= 3",
)
render_query(
    "a03_redundant_abstractions",
    lines("5", "'def work' || i || '_' || cast(floor(k / 4) as bigint) || '():\\n    pass\\n'") + " || case when k % 2 = 0 then 'def _private():\\n    pass\\n' else '' end",
    "select 'Potential Redundant Abstractions' as name, 'Modules pkg.m' || a || ' and pkg.m' || b || ' have ' || case when (a + b) % 2 = 1 then '83.3' else '100.0' end || '% similar functionalities' as description, '/proj/pkg/m' || a || '.py' as file_path, 'pkg.m' || a as module_class, cast(null as bigint) as line_number, 'medium' as severity from (select x.k as a, y.k as b from s x join s y on x.k // 4 = y.k // 4 and ('pkg.m' || x.k) < ('pkg.m' || y.k))",
)

#: Modules of eight import in a ring, backward here and there, and some libraries; every second eight imports nothing. All imports are extracted from sources.
_RING = "case when k % 8 < 7 then k + 1 else k - 7 end"
_BACK = "case k % 8 when 1 then k - 1 when 2 then k - 2 when 5 then k - 2 end"
_LINKED = "k % 16 < 8"
_IMPORTS = (
    f"case when {_LINKED} then 'from .m' || ({_RING}) || ' import run\\nfrom registry import thing\\n' || coalesce('import pkg.m' || ({_BACK}) || '\\n', '')"
    " || case when k % 3 = 0 then 'import lib' || (k % 5) || '\\nfrom . import other\\n' else '' end else 'x = 1\\n' end"
)
_GRAPH = f"""e as (select 'pkg.m' || k as src, 'pkg.m' || ({_RING}) as dst from s where {_LINKED} union select 'pkg.m' || k, 'pkg.m' || ({_BACK}) from s where {_LINKED} and ({_BACK}) is not null
  union select 'pkg.m' || k, 'registry' from s where {_LINKED} union select 'pkg.m' || k, 'lib' || (k % 5) from s where {_LINKED} and k % 3 = 0),
  own as (select 'pkg.m' || k as id, '/proj/pkg/m' || k || '.py' as path from s),
  nodes as (select id from own union select dst from e),
  d as (select id, coalesce(o.n, 0) as n_out, coalesce(i.n, 0) as n_in, coalesce(path, 'Unknown') as file_path from nodes left join own using (id)
        left join (select src as id, count(*) n from e group by 1) o using (id) left join (select dst as id, count(*) n from e group by 1) i using (id))"""
_CYCLES = """c as (select src as first, dst as last, [src, dst] as nodes from e where src < dst
        union all select c.first, e.dst, list_append(c.nodes, e.dst) from c join e on e.src = c.last where len(c.nodes) < 5 and e.dst > c.first and not list_contains(c.nodes, e.dst)),
  cyc as (select nodes from c join e on e.src = c.last and e.dst = c.first),
  w as (select distinct nodes[i] as src, nodes[i % len(nodes) + 1] as dst from cyc, range(1, 6) r(i) where i <= len(nodes)),
  p as (select src as a, dst as b, src as start, [src, dst] as path from e where src in (select src from w) and src <> dst
        union all select p.a, e.dst, p.start, list_append(p.path, e.dst) from p join e on e.src = p.b where not list_contains(p.path, e.dst)),
  n as (select start as src, b as dst, count(*) as n from p group by 1, 2),
  strong as (select cyc.nodes as nodes, cast(sum(n.n) as bigint) as strength from cyc, range(1, 6) r(i), n
             where i <= len(cyc.nodes) and n.src = cyc.nodes[i] and n.dst = cyc.nodes[i % len(cyc.nodes) + 1] group by cyc.nodes)"""


def graph_query(key: str, oracle: str, config: dict | None = None, more: str = "") -> None:
    render_query(key, _IMPORTS, f", {_GRAPH}{more} {oracle}", config=config)


def _module_smell(name: str, said: str, where: str, severity: str = "'medium'") -> str:
    return f"select '{name}' as name, {said} as description, file_path, id as module_class, cast(null as bigint) as line_number, {severity} as severity from d where {where}"


graph_query(
    "a01_hub_like_dependency",
    _module_smell(
        "Hub-like Dependency",
        "'Module ''' || id || ''' is a potential hub with ' || (n_in + n_out) || ' connections (in: ' || n_in || ', out: ' || n_out || ', external: 0)'",
        "n_in + n_out >= 3 and (n_in + n_out) / (select count(*) from nodes) > 0.1 and not (case when n_out > 0 then n_in / n_out when n_in > 0 then 1e9 else 0 end between 0.8 and 1.2)",
        "case when n_in + n_out > 6 then 'high' else 'medium' end",
    ),
    {"MIN_HUB_CONNECTIONS": 3, "HUB_LIKE_DEPENDENCY_THRESHOLD": 0.1, "HUB_BALANCE_RATIO_MIN": 0.8, "HUB_BALANCE_RATIO_MAX": 1.2},
)
graph_query("a06_orphan_module", _module_smell("Orphan Module", "'''' || id || ''' is isolated from other modules'", "n_in + n_out = 0"))
graph_query(
    "a08_unstable_dependency",
    _module_smell(
        "Unstable Dependency",
        "'Module ''' || id || ''' has high instability (' || printf('%.2f', n_out / (n_in + n_out)) || ') with ' || n_out || ' outgoing and ' || n_in || ' incoming dependencies'",
        "n_in + n_out >= 3 and n_out / (n_in + n_out) > 0.55",
    ),
    {"MIN_DEPENDENCIES": 3, "UNSTABLE_DEPENDENCY_THRESHOLD": 0.55},
)
graph_query(
    "a07_cyclic_dependency",
    "select 'Cyclic Dependency' as name, 'Strong cyclic dependency detected: ' || array_to_string(list_append(nodes, nodes[1]), ' -> ') || chr(10) || 'Cycle strength: ' || strength || ' mutual dependencies' as description,"
    " file_path, nodes[1] as module_class, cast(null as bigint) as line_number, case when len(nodes) >= 3 and strength >= 3 then 'high' else 'medium' end as severity"
    " from (select *, row_number() over (partition by list_sort(nodes) order by strength desc, nodes desc) as r from strong) join d on d.id = nodes[1] where r = 1",
    more=f", {_CYCLES}",
)


def cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of 2 to 5 modules, each with its strength."""
    facts = extract_facts(rendered(spark, sf_dir, _IMPORTS), ("architectural",)).persist()
    inner = inner_edges(architectural.Project.of(facts).edges)
    found = cycles(inner.select("src", "dst"), 2, 5)
    edge = found.select("nodes", F.posexplode("nodes").alias("i", "src")).select("nodes", "src", F.element_at("nodes", (F.col("i") + 1) % F.size("nodes") + 1).alias("dst"))
    n = path_counts(inner, edge.select("src", "dst"))
    return edge.join(n, ["src", "dst"]).groupBy("nodes").agg(F.sum("n").alias("strength")).select(F.array_join("nodes", ">").alias("cycle"), "strength")


QUERIES["a07_cycles"] = cycle_counts
ORACLES["a07_cycles"] = f"with recursive s as (select cast(s_suppkey as bigint) k from supplier), {_GRAPH}, {_CYCLES} select array_to_string(nodes, '>') as cycle, strength from strong"

# --- structural ----------------------------------------------------------------------------------------------

_CLS = "'pkg.m' || k || '.A'"
_SAID = f"'Class ''' || {_CLS} || ''' "


def class_query(key: str, name: str, source: str, said: str, where: str, severity: str, owner: str = _CLS, line: str = "cast(null as bigint)") -> None:
    render_query(key, source, _smell(name, said, where, owner, line, severity))


class_query(
    "s01_nom",
    "High Number of Methods (NOM)",
    "'class A:\\n' || " + lines("1 + k * 7 % 25", "'    def m' || i || '(self):\\n        pass\\n'") + " || '    def __len__(self):\\n        pass\\n    @property\\n    def p(self):\\n        pass\\n'",
    _SAID + "has ' || (1 + k * 7 % 25) || ' methods (excluding special methods and properties)'",
    "1 + k * 7 % 25 > 10",
    _LEVEL("1 + k * 7 % 25", 10),
)
class_query(
    "s02_wmpc",
    "High Weighted Methods per Class (WMPC)",
    "'class A:\\n    def m(self' || array_join(transform(sequence(1, cast(1 + k % 35 as int)), i -> ', p' || i), '') || '):\\n' || "
    + lines("1 + k % 30", "'        if a and b:\\n            x = ' || i || '\\n'")
    + " || '    def n(self, q):\\n        return 1\\n'",
    _SAID + "has complex methods (WMPC1: ' || (1 + 2 * (1 + k % 30)) || ', WMPC2: ' || (1 + k % 35) || ')'",
    "1 + 2 * (1 + k % 30) > 20 or 1 + k % 35 > 20",
    "case when 1 + 2 * (1 + k % 30) > 30 or 1 + k % 35 > 30 then 'High' else 'Medium' end",
)
class_query(
    "s03_size2",
    "Large Class (SIZE2)",
    "'class A:\\n' || "
    + lines("k % 12", "'    f' || i || ' = 1\\n'")
    + " || '    _g = 1\\n    _h = 1\\n' || "
    + lines("1 + k % 17", "'    def m' || i || '(self):\\n        self._g = self._q()\\n'")
    + " || '    def _q(self):\\n        pass\\n    def _r(self):\\n        pass\\n'",
    _SAID + "has ' || (2 + k % 17 + k % 12 + 1) || ' significant members (methods: ' || (2 + k % 17) || ', fields: ' || (k % 12 + 1) || ')'",
    "3 + k % 17 + k % 12 > 15",
    _LEVEL("3 + k % 17 + k % 12", 15),
)
class_query(
    "s04_wac",
    "High Weight of a Class (WAC)",
    "'class A:\\n    CONST = 1\\n    ФОРМА = 1\\n    名 = 1\\n    Фа = 1\\n    _one = 1\\n    _two = 1\\n' || "
    + lines("1 + k % 20", "'    f' || i || ' = 1\\n'")
    + " || '    def m(self):\\n        self._two = self._two + self._one\\n'",
    _SAID + "has ' || (4 + k % 20) || ' significant attributes (excluding constants and unused private fields)'",
    "4 + k % 20 > 10",
    _LEVEL("4 + k % 20", 10),
)
_APART = "((2 + k % 8) * (1 + k % 8) / 2)"
render_query(
    "s05_lcom",
    "'class A:\\n' || " + lines("2 + k % 8", "'    def m' || i || '(self):\\n        return self.f' || i || '\\n'") + " || " + lines("k % 3", "'    def h' || i || '(self):\\n        return self.m1()\\n'"),
    "select 'High Lack of Cohesion of Methods (LCOM)' as name, 'Class ''' || 'pkg.m' || k || '.A' || ''' has LCOM of ' || (total - 2 * close) || ' (non-cohesive: ' || (total - close) || ', cohesive: ' || close || ')' as description, '/proj/pkg/m' || k || '.py' as file_path, 'pkg.m' || k || '.A' as module_class, cast(null as bigint) as line_number, case when total - 2 * close > 15 then 'High' else 'Medium' end as severity from (select k, ((2 + k % 8 + k % 3) * (1 + k % 8 + k % 3)) // 2 as total, ((1 + k % 3) * (k % 3)) // 2 as close from s) where total - 2 * close > 10",
)
class_query(
    "s06_rfc",
    "High Response for a Class (RFC)",
    "'class A:\\n' || "
    + lines("1 + k % 15", "'    def m' || i || '(self):\\n        self.m1()\\n'")
    + " || '    def n(self, o):\\n' || "
    + lines("1 + k % 20", "'        o.c' || i || '()\\n'")
    + " || '    def _p(self):\\n        pass\\n'",
    _SAID + "has RFC of ' || (3 + k % 15 + k % 20) || ' (methods: ' || (2 + k % 15) || ', external calls: ' || (1 + k % 20) || ')'",
    "3 + k % 15 + k % 20 > 20",
    _LEVEL("3 + k % 15 + k % 20", 20),
)
render_query(
    "s07_nocc",
    lines("1 + k * 7 % 30", "'class C' || i || ':\\n    def m(self):\\n        pass\\n'") + " || 'class E(MyException):\\n    pass\\nclass TestC:\\n    pass\\n'",
    _smell("High Number of Classes (NOCC)", "'Module ''pkg.m' || k || ''' has ' || (1 + k * 7 % 30) || ' significant classes (avg complexity: 0.7)'", "1 + k * 7 % 30 > 15", "'pkg.m' || k", severity=_LEVEL("1 + k * 7 % 30", 15)),
)


def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths below object of a forest over customers: the base of customer c is customer c // 3 where both are in one nation block."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    classes = t.select(
        F.concat(F.lit("c"), "k").alias("name"),
        F.when((F.col("k") % 4 != 0) & (F.col("k") >= 3), F.array(F.concat(F.lit("c"), F.floor(F.col("k") / 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("bases"),
    )
    d = structural.inheritance_depth(classes, load(EXTENDED)["structural_smells"])
    return d.select("id", F.col("depth").cast("long").alias("depth"))


QUERIES["s08_inheritance_depth"] = inheritance
ORACLES["s08_inheritance_depth"] = "with recursive d as (select c_custkey as k, 1 as depth from customer where c_custkey % 4 = 0 or c_custkey < 3 union all select c.c_custkey, d.depth + 1 from customer c join d on c.c_custkey // 3 = d.k where c.c_custkey % 4 <> 0 and c.c_custkey >= 3) select 'c' || k as id, cast(depth as bigint) as depth from d"
_CHAIN = "'class C0:\\n    pass\\n' || " + lines("1 + k % 6", "'class C' || i || '(m' || k || '.C' || (i - 1) || '):\\n    pass\\n'")
render_query(
    "s08_dit",
    _CHAIN,
    "select 'Deep Inheritance Tree (DIT)' as name, 'Class ''m' || k || '.C' || i || ''' has DIT of ' || (i + 1) || chr(10) || 'Inheritance path: object->' || (select string_agg('m' || k || '.C' || j, '->' order by j) from range(0, i + 1) q(j)) as description, '/proj/pkg/m' || k || '.py' as file_path, 'm' || k || '.C' || i as module_class, cast(null as bigint) as line_number, case when i + 1 > 4.5 then 'High' else 'Medium' end as severity from s, range(3, 7) r(i) where i <= 1 + k % 6",
    root="/proj/pkg",
)
_LOOP = "'class A(m' || k || '.B):\\n    pass\\nclass B(m' || k || '.A):\\n    pass\\nclass C(Base' || (k % 3) || '):\\n    pass\\n'"
_ALONE = "'Class ''m' || k || '.' || c || ''' is isolated from the main inheritance hierarchy'"
render_query("s08_isolated", _LOOP, _smell("Isolated Class in Inheritance Tree", _ALONE, "true", "'m' || k || '.' || c", severity="'Low'", frm="s, (values ('A'), ('B')) v(c)"), "s08_dit", root="/proj/pkg")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line classes of documents, as if they were source files: a line's class follows from how it starts; one in eleven of them turns documentation on or off."""
    x = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    mark = lambda i: F.when(i % 11 == 4, '"""').when(i % 5 == 1, "import ").when(i % 7 == 2, "# ").otherwise("")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), line_codes(F.transform(x, lambda t, i: F.concat(mark(i), F.trim(t)))).alias("codes"))
    return d.select("id", *[c.alias(k) for k, c in structural.line_counts(F.col("codes")).items()])


QUERIES["s09_line_classes"] = document_lines
ORACLES["s09_line_classes"] = """with l as (select doc_id as id, unnest(string_split(coalesce(text, ''), chr(10))) as t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
  m as (select id, i, case when i % 11 = 4 then 'turn' when i % 5 = 1 then 'imports' when i % 7 = 2 then 'comment' when trim(t) = '' then 'blank' else 'code' end as kind from l),
  p as (select *, coalesce(sum(case when kind = 'turn' then 1 else 0 end) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from m)
  select id, count(*) as total, count(*) filter (kind = 'blank') as blank, count(*) filter (kind = 'turn' or inside and kind <> 'blank') as doc, count(*) filter (kind = 'imports' and not inside) as imports, count(*) filter (kind = 'code' and not inside) as code from p group by id"""
render_query(
    "s09_loc",
    "'\"\"\"one line\"\"\"\\n\"\"\"off again\"\"\"\\nimport os\\n# note\\n\\n' || " + lines("1 + k * 37 % 400", "'x = ' || i || '\\n'"),
    _smell("High Lines of Code (LOC)", "'Module ''pkg.m' || k || ''' has ' || (1 + k * 37 % 400) || ' effective code lines' || chr(10) || '(Total: ' || (6 + k * 37 % 400) || ', Code: ' || (1 + k * 37 % 400) || ', Doc: 2, Import: 1, Blank: 1)'", "1 + k * 37 % 400 > 150", "'pkg.m' || k", severity=_LEVEL("1 + k * 37 % 400", 150)),
)
render_query(
    "s10_noc",
    "'class C' || k || case when k % 9 = 0 then 'Helper' when k % 9 = 1 then 'Abstract' when k % 9 = 2 then 'Mock' else '' end || ':\\n    pass\\nclass D' || k || ':\\n    pass\\n'",
    "select 'High Number of Classes (NOC)' as name, 'Project has ' || printf('%.1f', r + 0.5 * a + 0.3 * u) || ' weighted classes:' || chr(10) || '- Regular classes: ' || r || chr(10) || '- Abstract/Interface classes: ' || a || chr(10) || '- Utility classes: ' || u || chr(10) || '- Test classes: ' || t || ' (not counted in weighted total)' || chr(10) || 'Adjusted threshold: 7' as description, '/proj' as file_path, 'Project' as module_class, cast(null as bigint) as line_number, case when r + 0.5 * a + 0.3 * u > 10.5 then 'High' else 'Medium' end as severity from (select count(*) filter (k % 9 > 2) + count(*) as r, count(*) filter (k % 9 = 1) as a, count(*) filter (k % 9 = 0) as u, count(*) filter (k % 9 = 2) as t from s) where r + 0.5 * a + 0.3 * u > 7",
)
class_query(
    "s11_mpc",
    "High Message Passing Coupling (MPC)",
    "'class A:\\n    def m(self, o):\\n        self.n()\\n        o.get_x()\\n' || " + lines("1 + k * 7 % 40", "'        o.c' || i || '()\\n'") + " || '    def n(self, o):\\n        o.c1()\\n'",
    _SAID
    + "has weighted MPC of ' || printf('%.1f', 1.5 * (2 + k * 7 % 40) + 1) || chr(10) || '(External calls: ' || (2 + k * 7 % 40) || ', Internal calls: 1)' || chr(10) || 'Most frequent external calls: {''c1'': 2, ''c10'': 1, ''c11'': 1}'",
    "1.5 * (2 + k * 7 % 40) + 1 > 25",
    _LEVEL("1.5 * (2 + k * 7 % 40) + 1", 25),
)
class_query(
    "s12_cbo",
    "High Coupling Between Object Classes (CBO)",
    "'class A(Thing):\\n    def m(self):\\n        self.x = self.y()\\n' || " + lines("1 + k % 8", "'        o' || i || '.run()\\n'") + " || '        result.run()\\n'",
    _SAID
    + "has weighted CBO of ' || printf('%.1f', 1.5 * (3 + k % 8) + 0.5 * (2 + k % 8)) || chr(10) || 'Direct coupling: ' || (3 + k % 8) || ' classes' || chr(10) || 'Indirect coupling: ' || (2 + k % 8) || ' classes' || chr(10) || 'Most significant dependencies: [''Thing'', ''o1'', ' || case when k % 8 = 0 then '''self''' else '''o2''' end || ']'",
    "1.5 * (3 + k % 8) + 0.5 * (2 + k % 8) > 5",
    "case when 1.5 * (3 + k % 8) + 0.5 * (2 + k % 8) > 10 then 'High' when 1.5 * (3 + k % 8) + 0.5 * (2 + k % 8) > 7.5 then 'Medium' else 'Low' end",
)
class_query(
    "s13_cyclomatic_complexity",
    "High Cyclomatic Complexity",
    "'class A:\\n    def m(self, x):\\n        if x:\\n            y = 1\\n' || " + lines("k % 20", "'        elif x == ' || i || ':\\n            y = 2\\n'"),
    "'Method ''m'' has cyclomatic complexity of ' || (2 + 2 * (k % 20))",
    "2 + 2 * (k % 20) > 10",
    _LEVEL("2 + 2 * (k % 20)", 10),
    _CLS,
    "cast(2 as bigint)",
)
render_query(
    "s14_fan_out",
    "'import os\\nimport json\\n' || " + lines("1 + k * 7 % 40", "'import lib' || i || '\\n'"),
    _smell("High Fan-out", "'Module ''pkg.m' || k || ''' has ' || (1 + k * 7 % 40) || ' significant outgoing dependencies'", "1 + k * 7 % 40 > 15", "'pkg.m' || k", severity=_LEVEL("1 + k * 7 % 40", 15)),
)
render_query(
    "s15_fan_in",
    lines("1 + k % 40", "'import lib' || i || '\\n'") + " || 'import util\\n'",
    "select 'High Fan-in' as name, 'Module ''lib' || i || ''' has ' || n || ' incoming dependencies' as description, 'Unknown' as file_path, 'lib' || i as module_class, cast(null as bigint) as line_number, case when n > 22.5 then 'High' else 'Medium' end as severity from (select i, count(*) as n from s, range(1, 41) r(i) where i <= 1 + k % 40 group by i) where n > 15",
    rows="customer",
)
render_query(
    "s16_long_file",
    "'\"\"\"doc\\n# inside\\n\"\"\"\\nimport os\\n# note\\n\\n' || " + lines("1 + k * 37 % 500", "'x = ' || i || '\\n'"),
    _smell("Long File", "'File ''pkg.m' || k || ''' has ' || (2 + k * 37 % 500) || ' meaningful lines of code'", "2 + k * 37 % 500 > 250", "'pkg.m' || k", severity=_LEVEL("2 + k * 37 % 500", 250)),
)
class_query(
    "s17_too_many_branches",
    "Too Many Branches",
    "'class A:\\n    def m(self, x):\\n' || "
    + lines("1 + k % 20", "'        if x:\\n            y = ' || i || '\\n'")
    + " || '    def get_m(self, x):\\n' || "
    + lines("20", "'        if x:\\n            y = 1\\n'"),
    "'Method ''m'' has ' || (1 + k % 20) || ' branches with max nesting of ' || (1 + k % 20)",
    "1 + k % 20 > 4",
    _LEVEL("1 + k % 20", 10),
    _CLS,
    "cast(2 as bigint)",
)

# --- the engine as a whole -----------------------------------------------------------------------------------------

_MIXED = "'def f(' || array_join(transform(sequence(1, cast(1 + k % 9 as int)), i -> 'p' || i), ', ') || '):\\n    pass\\nclass A:\\n' || " + lines("1 + k % 25", "'    def m' || i || '(self):\\n        x = 1\\n        return x\\n'")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells by family and name over a run of five of the 46 detectors, at least one of each family. The SQL has four of their smells, data clumps
    have none here; k04_tree_report runs all detectors."""
    keys = ["c04_long_parameter_list", "c02_large_class", "s01_nom", "a04_god_object", "c05_data_clumps"]
    a = analyze_sources(rendered(spark, sf_dir, _MIXED), EXTENDED, strict=False, keys=keys)
    return a.smells.groupBy("type", "name").agg(F.count("*").alias("n"))


QUERIES["k01_report_totals"] = report_totals
ORACLES["k01_report_totals"] = "with s as (select cast(s_suppkey as bigint) k from supplier) select * from (select 'Code' as type, 'Long Parameter List' as name, count(*) filter (1 + k % 9 > 5) as n from s union all select 'Code', 'Large Class', count(*) filter (1 + k % 25 > 15) from s union all select 'Structural', 'High Number of Methods (NOM)', count(*) filter (1 + k % 25 > 10) from s union all select 'Architectural', 'God Object', count(*) filter (2 + k % 25 > 20) from s) where n > 0"


def strict_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict run with the packaged thresholds keeps: a lazy class ends a file's smells, so nothing from later detectors is left."""
    source = "'class A:\\n' || " + lines("1 + k % 25", "'    def m' || i || '(self):\\n        pass\\n'") + " || case when k % 2 = 0 then '@dataclass(frozen=True)\\nclass B:\\n    x: int\\n' else '' end"
    a = analyze_sources(rendered(spark, sf_dir, source), PACKAGED, ("code",), strict=True, keys=["c02_large_class", "c09_divergent_change", "c17_speculative_generality"])
    return a.smells.groupBy("name").agg(F.count("*").alias("n"))


QUERIES["k02_strict_cut"] = strict_cut
ORACLES["k02_strict_cut"] = "with s as (select cast(s_suppkey as bigint) k from supplier) select * from (select 'Large Class' as name, count(*) filter (1 + k % 25 > 15) as n from s union all select 'Potential Divergent Change', count(*) filter (1 + k % 25 > 5) from s union all select 'Speculative Generality', count(*) filter (1 + k % 25 > 4 and k % 2 = 1) from s) where n > 0"


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by family that could be parsed and could not."""
    source = "case when k % 7 = 0 then 'def (:\\n' when k % 7 = 1 then '    x = 1\\n    y = 2\\n' when k % 7 = 2 then '\ufeff' || 'x = 1\\n' else 'x = 1\\n' end"
    a = analyze_sources(rendered(spark, sf_dir, source), EXTENDED, ("code", "structural"), keys=["c04_long_parameter_list", "s01_nom"])
    return a.errors.groupBy("type").agg(F.count("*").alias("errors"))


QUERIES["k03_parse_errors"] = parse_errors
ORACLES["k03_parse_errors"] = "with s as (select cast(s_suppkey as bigint) k from supplier) select 'Code' as type, count(*) filter (k % 7 in (0, 2)) as errors from s union all select 'Structural', count(*) filter (k % 7 in (0, 1, 2)) from s"

def written_tree(spark: SparkSession, sources: DataFrame) -> str:
    """A directory, in the shared folder, that holds the sources as files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    top = f"{base.removeprefix('file://').rstrip('/')}/plumbline-tree-{uuid.uuid4().hex[:12]}"
    atexit.register(shutil.rmtree, top, ignore_errors=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(top + path), exist_ok=True)
                with open(f"{top}{path}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{top}{path}.part", top + path)
            yield b.select(["path"])

    sources.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return top


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From end to end: a source tree on disk (with a link that leads nowhere) is scanned and analyzed by all 46 detectors, smells go to a table, and
    its totals and those of the errors are read back."""
    top = written_tree(spark, rendered(spark, sf_dir, _MIXED))
    os.symlink("/nowhere/at/all.py", f"{top}/proj/pkg/gone.py")
    a = analyze(spark, f"{top}/proj", EXTENDED, strict=False)
    write_table(a.smells, f"file://{top}/table")
    errors = a.errors.groupBy("type", F.col("error_type").alias("name")).agg(F.count("*").alias("n"))
    return spark.read.parquet(f"file://{top}/table").groupBy("type", "name").agg(F.count("*").alias("n")).unionByName(errors)


QUERIES["k04_tree_report"] = tree_report
_PART = "select '{}' as type, '{}' as name, count(*) filter ({}) as n from s"
ORACLES["k04_tree_report"] = (
    "with s as (select cast(s_suppkey as bigint) k from supplier) select * from ("
    + " union all ".join(
        _PART.format(*x)
        for x in (
            ("Architectural", "Orphan Module", "true"), ("Architectural", "God Object", "2 + k % 25 > 20"), ("Code", "Lazy Class", "1 + k % 25 <= 4"), ("Code", "Long Parameter List", "1 + k % 9 > 5"),
            ("Code", "Potential Divergent Change", "1 + k % 25 > 5"), ("Code", "Large Class", "1 + k % 25 > 15"), ("Structural", "High Lack of Cohesion of Methods (LCOM)", "(1 + k % 25) * (k % 25) / 2 > 10"),
            ("Structural", "High Number of Methods (NOM)", "1 + k % 25 > 10"), ("Structural", "High Response for a Class (RFC)", "1 + k % 25 > 20"), ("Structural", "Large Class (SIZE2)", "1 + k % 25 > 15"),
        )
    )
    + " union all select 'Structural', 'High Number of Classes (NOC)', cast(count(*) > 7 as bigint) from s"
    " union all select 'Architectural', 'Scattered Functionality', count(*) from range(10, 26) r(i) where (select count(*) from s where 1 + k % 25 >= i) >= 3"
    " union all select t, 'read error', 1 from (values ('Code'), ('Architectural'), ('Structural')) v(t)) where n > 0"
)


def comment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment blocks of documents as if lines whose number has the remainder 0 to 6 of 17 were comments."""
    x = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    marked = F.transform(x, lambda t, i: F.concat(F.when(i % 17 < 7, "# ").otherwise(""), F.trim(t)))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), line_codes(marked).alias("codes"))
    return d.select("id", *[c.alias(k) for k, c in code.comment_blocks(F.col("codes")).items()])


QUERIES["c12_comment_blocks"] = comment_runs
ORACLES["c12_comment_blocks"] = """with l as (select doc_id as id, unnest(string_split(coalesce(text, ''), chr(10))) as t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
  b as (select id, i // 17 as block, count(*) as n from l where i % 17 < 7 and i >= 17 group by 1, 2)
  select l.id, cast(count(*) filter (i % 17 >= 7 and trim(t) <> '') as bigint) as code_lines, cast(coalesce((select sum(n) from b where b.id = l.id), 0) as bigint) as comment_lines, cast((select count(*) from b where b.id = l.id and n > 5) as bigint) as large_blocks from l group by l.id"""
