"""Architectural smells: modules of a project, their functions, calls and dependencies. A module is named by its folder and its file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.pyformat import py_format
from plumbline.operators.base import any_of, begins, holds, nodes_of, smells, text
from plumbline.operators.graph import cycles, inner_edges, path_counts
from plumbline.plans.config import Thresholds

KIND = "Architectural"
c = F.col


class Project:
    """Relations of the architectural family. They may be given from anywhere: nodes (id), edges (src, dst; each once), functions (module, fn; each
    once), calls (module, attr, ord), paths (module, path)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, functions: DataFrame, calls: DataFrame, paths: DataFrame):
        self.nodes, self.edges, self.functions, self.calls, self.paths = nodes, edges, functions, calls, paths

    @classmethod
    def of(cls, facts: DataFrame) -> Project:
        f = facts.where("error is null").select("path", c("arch_module").alias("module"), "arch_imports", "arch_functions", "api_calls")
        imports = f.select("module", F.inline("arch_imports"))
        edges = imports.select(c("module").alias("src"), c("target").alias("dst")).distinct()
        nodes = f.select(c("module").alias("id")).unionByName(edges.select(c("dst").alias("id"))).distinct()
        own = f.select("module", F.explode("arch_functions").alias("fn"))
        taken = imports.select(c("target").alias("module"), F.explode("names").alias("fn"))
        calls = f.select("module", "path", F.posexplode("api_calls").alias("ord", "attr"))
        return cls(nodes, edges, own.unionByName(taken).distinct(), calls, f.groupBy("module").agg(F.max("path").alias("path")))

    def smells(self, df: DataFrame, name: str, description: object, step: int, severity: object = "medium", owner: str = "module") -> DataFrame:
        p = self.paths.select(c("module").alias("owner_"), c("path").alias("path_"))
        df = df.join(p, df[owner] == c("owner_"), "left").withColumn("file_", F.coalesce("path_", F.lit("Unknown")))
        return smells(df, KIND, name, description, path="file_", owner=c(owner), severity=severity, step=step)

    def degrees(self) -> DataFrame:
        return nodes_of(self.edges, self.nodes)


def hub_like_dependency(p: Project, t: Thresholds) -> DataFrame:
    """Modules with many connections, most of them one way. External modules count as modules."""
    d = p.degrees()
    size = d.agg(F.count("*").alias("size"))  # one row
    d = d.crossJoin(F.broadcast(size)).withColumn("total", c("n_in") + c("n_out")).where(c("size") >= t.get("HUB_MIN_PROJECT_MODULES"))
    d = d.where((c("total") >= t.get("MIN_HUB_CONNECTIONS")) & (F.try_divide("total", "size") > t.get("HUB_LIKE_DEPENDENCY_THRESHOLD")) & ~holds(F.lower("id"), "util", "common", "base", "core"))
    into, out = F.try_divide("n_in", "size"), F.try_divide("n_out", "size")
    ratio = F.when(c("n_out") > 0, F.try_divide(into, out)).when(c("n_in") > 0, F.lit(float("inf"))).otherwise(0.0)
    d = d.where(~((ratio >= t.get("HUB_BALANCE_RATIO_MIN")) & (ratio <= t.get("HUB_BALANCE_RATIO_MAX"))))
    said = text("Module '", c("id"), "' is a potential hub with ", c("total"), " connections (in: ", c("n_in"), ", out: ", c("n_out"), ", external: 0)")
    return p.smells(d, "Hub-like Dependency", said, 1, F.when(c("total") > 2 * t.get("MIN_HUB_CONNECTIONS"), "high").otherwise("medium"), "id")


def scattered_functionality(p: Project, t: Thresholds) -> DataFrame:
    excluded = [x for x in t.get("SCATTERED_EXCLUDED_NAMES")]
    f = p.functions.where((F.length("fn") >= t.get("SCATTERED_MIN_FUNCTION_NAME_LENGTH")) & ~F.lower("fn").isin(*excluded) & ~c("fn").startswith("_"))
    many = f.groupBy("fn").agg(F.count("*").alias("n")).where(c("n") >= t.get("MIN_SCATTERED_OCCURRENCES"))
    g = f.join(many, "fn").groupBy("fn").agg(F.array_sort(F.collect_list("module")).alias("modules")).withColumn("module", F.get("modules", F.lit(0)))
    return p.smells(g, "Scattered Functionality", text("Function '", c("fn"), "' appears in ", F.size("modules"), " modules: ", F.array_join("modules", ", ")), 2)


def redundant_abstractions(p: Project, t: Thresholds) -> DataFrame:
    """Pairs of modules whose public functions are the same and whose functions are nearly so. Modules meet by the hash of that set only."""
    all_ = p.functions.groupBy("module").agg(F.array_sort(F.collect_set("fn")).alias("fns")).where(F.size("fns") >= t.get("REDUNDANT_MIN_FUNCTIONS"))
    public = F.filter("fns", lambda f: ~f.startswith("_") & (F.length(f) > 3) & ~F.lower(f).isin("main", "init", "setup", "test"))
    all_ = all_.withColumn("key", public).where((F.size("key") > 0) & (F.size("key") >= t.get("REDUNDANT_MIN_FUNCTIONS")))
    a = all_.select(c("module").alias("a"), c("fns").alias("fns_a"), "key")
    b = all_.select(c("module").alias("b"), c("fns").alias("fns_b"), "key")
    g = a.join(b, "key").where("a < b").withColumn("similarity", F.try_divide(F.size(F.array_intersect("fns_a", "fns_b")), F.size(F.array_union("fns_a", "fns_b")))).where(c("similarity") >= t.get("REDUNDANT_SIMILARITY_THRESHOLD"))
    return p.smells(g, "Potential Redundant Abstractions", text("Modules ", c("a"), " and ", c("b"), " have ", py_format(c("similarity"), ".1%"), " similar functionalities"), 3, owner="a")


def god_object(p: Project, t: Thresholds) -> DataFrame:
    f = p.functions.where(~c("fn").startswith("_") & ~begins(c("fn"), "test_", "setup_", "config_"))
    g = f.groupBy("module").agg(F.count("*").alias("n")).where((c("n") >= t.get("MIN_GOD_OBJECT_FUNCTIONS")) & (c("n") > t["GOD_OBJECT_FUNCTIONS"]))
    return p.smells(g, "God Object", text("Module '", c("module"), "' has too many public functions (", c("n"), ")"), 4)


def improper_api_usage(p: Project, t: Thresholds) -> DataFrame:
    each = p.calls.groupBy("module", "attr").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    again = c("n") >= t.get("API_REPETITION_MIN_COUNT")
    said = F.when(again, F.struct("first", text(c("attr"), "(", c("n"), "x)").alias("said")))
    g = each.groupBy("module").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(again, c("n"))), F.lit(0)).alias("repeated"), F.array_sort(F.collect_list(said)).alias("x"))
    g = g.where((c("total") >= t.get("MIN_API_CALLS")) & (c("repeated") > 0) & (F.try_divide("repeated", "total") > t.get("API_REPETITION_THRESHOLD")))
    return p.smells(g, "Potential Improper API Usage", text("Module '", c("module"), "' has repetitive API calls: ", F.array_join(F.transform("x", lambda x: x["said"]), ", ")), 5)


def orphan_module(p: Project, t: Thresholds) -> DataFrame:
    excluded = t.get("ORPHAN_EXCLUDED_MODULES")
    size = p.nodes.agg(F.count("*").alias("size"))  # one row
    linked = p.edges.select(c("src").alias("id")).unionByName(p.edges.select(c("dst").alias("id")))
    d = p.nodes.join(linked, "id", "left_anti").crossJoin(F.broadcast(size)).where(c("size") >= t.get("MIN_PROJECT_SIZE"))
    d = d.where(~F.substring_index("id", ".", -1).isin(*excluded) & ~any_of([F.contains(F.lower("id"), F.lit(x)) for x in excluded]))
    return p.smells(d, "Orphan Module", text("'", c("id"), "' is isolated from other modules"), 6, owner="id")


def cyclic_dependency(p: Project, t: Thresholds) -> DataFrame:
    """Of each set of modules on a cycle the strongest cycle, of equally strong ones the greatest list. Its strength is the number of simple paths
    along each of its edges, added up."""
    inner = inner_edges(p.edges)
    good = lambda x: ~any_of([F.contains(F.lower(c(x)), F.lit(name)) for name in t.get("CYCLE_EXCLUDED_MODULES")])
    loops = p.edges.where("src = dst").select("src", "dst")
    e = inner.select("src", "dst").unionByName(loops).where(good("src") & good("dst"))
    found = cycles(e, t.get("MIN_CYCLE_SIZE"), t.get("MAX_CYCLE_SIZE")).withColumn("n_nodes", F.size("nodes"))
    edge = found.select("nodes", F.posexplode("nodes").alias("i", "src")).select("nodes", "src", F.element_at("nodes", (c("i") + 1) % F.size("nodes") + 1).alias("dst"))
    n = path_counts(inner, edge.select("src", "dst"))
    strength = edge.join(n, ["src", "dst"]).groupBy("nodes").agg(F.sum("n").alias("strength"))
    best = strength.groupBy(F.array_sort("nodes").alias("key")).agg(F.max(F.struct("strength", "nodes")).alias("b")).select("b.nodes", "b.strength").withColumn("module", F.get("nodes", F.lit(0)))
    said = text("Strong cyclic dependency detected: ", F.array_join(F.concat("nodes", F.slice("nodes", 1, 1)), " -> "), "\nCycle strength: ", c("strength"), " mutual dependencies")
    high = (F.size("nodes") >= t.get("CYCLE_HIGH_MIN_SIZE")) & (c("strength") >= t.get("CYCLE_HIGH_MIN_STRENGTH"))
    return p.smells(best, "Cyclic Dependency", said, 7, F.when(high, "high").otherwise("medium"))


def unstable_dependency(p: Project, t: Thresholds) -> DataFrame:
    d = p.degrees().where(~holds(c("id"), "test_", "setup_", "__init__") & (c("n_in") + c("n_out") >= t.get("MIN_DEPENDENCIES")))
    d = d.withColumn("instability", F.try_divide(c("n_out"), c("n_in") + c("n_out"))).where(c("instability") > t["UNSTABLE_DEPENDENCY_THRESHOLD"])
    said = text("Module '", c("id"), "' has high instability (", py_format(c("instability"), ".2f"), ") with ", c("n_out"), " outgoing and ", c("n_in"), " incoming dependencies")
    return p.smells(d, "Unstable Dependency", said, 8, owner="id")


DETECTORS = {
    "a01_hub_like_dependency": hub_like_dependency, "a02_scattered_functionality": scattered_functionality, "a03_redundant_abstractions": redundant_abstractions, "a04_god_object": god_object, "a05_improper_api_usage": improper_api_usage,
    "a06_orphan_module": orphan_module, "a07_cyclic_dependency": cyclic_dependency, "a08_unstable_dependency": unstable_dependency,
}
