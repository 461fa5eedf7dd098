"""Structural smells: sizes, complexity, cohesion and coupling of classes and modules. What concerns one class is worked out within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.pyformat import py_format
from plumbline.operators.base import any_of, begins, count_of, dunder, ends, halves, holds, nodes_of, smells, text
from plumbline.operators.graph import depths, settle
from plumbline.plans.config import Thresholds

KIND = "Structural"
c = F.col


def _level(value: Column, threshold: Column | float) -> Column:
    return F.when(value > threshold * 1.5, "High").otherwise("Medium")


class Structure:
    """Relations of the structural family: facts, and the dependency graph of modules (nodes (id), edges (src, dst; each once))."""

    def __init__(self, facts: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.good = facts.where("error is null")
        self.edges = edges if edges is not None else self.good.select(c("module").alias("src"), F.explode("imports").alias("dst")).distinct()
        own = nodes if nodes is not None else self.good.select(c("module").alias("id"))
        self.nodes = own.unionByName(self.edges.select(c("dst").alias("id"))).distinct()

    def classes(self) -> DataFrame:
        return self.good.select("path", "module", "root", F.inline("classes"))

    def methods(self) -> DataFrame:
        return self.classes().select("path", c("name").alias("class_name"), c("ord").alias("class_ord"), F.inline("methods"))


def _smells(rows: DataFrame, name: str, said: Column, step: int, severity: str | Column, owner: str = "name", line: Column | None = None, path: str = "path", seq: Column | None = None) -> DataFrame:
    return smells(rows, KIND, name, said, path=path, owner=c(owner), line=line, severity=severity, step=step, seq=seq)


def _regular(methods: str = "methods") -> Column:
    return F.filter(methods, lambda m: ~dunder(m["name"]) & ~F.array_contains(m["decorators"], "property"))


def _names(methods: str | Column) -> Column:
    return F.transform(methods, lambda m: m["name"])


def _calls_by_name() -> Column:
    """Called names of a class: one entry for each name of a method and attribute it calls."""
    return F.array_distinct(F.flatten(F.transform("methods", lambda m: F.transform(m["calls"], lambda a: F.struct(m["name"].alias("method"), a.alias("attr"))))))


def nom(s: Structure, t: Thresholds) -> DataFrame:
    most = t.get("NOM_THRESHOLD") or 10
    k = s.classes().withColumn("n", F.size(_regular())).where(c("n") > most)
    return _smells(k, "High Number of Methods (NOM)", text("Class '", c("name"), "' has ", c("n"), " methods (excluding special methods and properties)"), 1, _level(c("n"), most))


def wmpc(s: Structure, t: Thresholds) -> DataFrame:
    one, two = t["WMPC1_THRESHOLD"], t["WMPC2_THRESHOLD"]
    k = s.classes().withColumn("own", F.filter("methods", lambda m: ~dunder(m["name"]) & m["branching"]))
    k = k.withColumn("n1", F.aggregate("own", F.lit(0), lambda a, m: a + m["complexity"])).withColumn("n2", F.aggregate("own", F.lit(0), lambda a, m: a + m["n_args"] - 1)).where((c("n1") > one) | (c("n2") > two))
    return _smells(
        k,
        "High Weighted Methods per Class (WMPC)",
        text("Class '", c("name"), "' has complex methods (WMPC1: ", c("n1"), ", WMPC2: ", c("n2"), ")"),
        2,
        F.when((c("n1") > one * 1.5) | (c("n2") > two * 1.5), "High").otherwise("Medium"),
    )


def size2(s: Structure, t: Thresholds) -> DataFrame:
    k = s.classes().withColumn("called", F.flatten(F.transform("methods", lambda m: m["calls"]))).withColumn("seen", F.flatten(F.transform("methods", lambda m: m["attrs"])))
    k = k.withColumn("m", F.size(F.filter("methods", lambda m: ~m["name"].startswith("_") | F.array_contains("called", m["name"])))).withColumn("f", F.size(F.filter("fields", lambda f: ~f.startswith("_") | F.array_contains("seen", f))))
    k = k.withColumn("n", c("m") + c("f")).where(c("n") > t["SIZE2_THRESHOLD"])
    return _smells(k, "Large Class (SIZE2)", text("Class '", c("name"), "' has ", c("n"), " significant members (methods: ", c("m"), ", fields: ", c("f"), ")"), 3, _level(c("n"), t["SIZE2_THRESHOLD"]))


def wac(s: Structure, t: Thresholds) -> DataFrame:
    k = s.classes().withColumn("used", F.flatten(F.transform("methods", lambda m: m["self_attrs"])))
    # some letter is upper case and none is of another case; letters without case say nothing
    constant = lambda f: f.rlike(r"\p{IsUppercase}") & ~f.rlike(r"[\p{IsLowercase}\p{IsTitlecase}]")
    k = k.withColumn("n", F.size(F.filter("fields", lambda f: ~constant(f) & (~f.startswith("_") | (F.size(F.filter("used", lambda u: u == f)) > 1))))).where(c("n") > t["WAC_THRESHOLD"])
    return _smells(k, "High Weight of a Class (WAC)", text("Class '", c("name"), "' has ", c("n"), " significant attributes (excluding constants and unused private fields)"), 4, _level(c("n"), t["WAC_THRESHOLD"]))


def close_usage(usage: DataFrame, calls: DataFrame) -> DataFrame:
    """usage (owner, method, field) with the fields of all methods that a method reaches by calls (owner, method, callee). Ways of calls double in
    length each round, until none is new."""
    reached = calls.select("owner", "method", "callee").distinct()
    hop = reached.join(reached.select("owner", c("method").alias("callee")).distinct(), ["owner", "callee"], "left_semi")
    if not hop.isEmpty():  # some callee calls on
        n, before = reached.count(), -1
        while n != before:
            before = n
            on = reached.select("owner", c("method").alias("mid"), c("callee"))
            longer = reached.select("owner", "method", c("callee").alias("mid")).join(on, ["owner", "mid"]).select("owner", "method", "callee")
            reached = settle(reached.unionByName(longer).distinct())
            n = reached.count()
    more = reached.join(usage.select("owner", c("method").alias("callee"), "field"), ["owner", "callee"]).select("owner", "method", "field")
    return usage.unionByName(more).distinct()


def lcom(s: Structure, t: Thresholds) -> DataFrame:
    """Pairs of a class's methods that share no field less pairs that do. Fields reach a method through methods it calls."""
    k = s.classes().withColumn("own", _regular()).where(F.size("own") >= 2)
    m = k.select(c("name").alias("owner"), F.inline("own"))
    usage = m.select("owner", c("name").alias("method"), F.explode(F.array_distinct("self_attrs")).alias("field"))
    calls = k.select(c("name").alias("owner"), _names("own").alias("own"), F.explode(_calls_by_name()).alias("x")).where(F.array_contains("own", c("x.attr")) & F.array_contains("own", c("x.method"))).select(
        "owner",
        c("x.method").alias("method"),
        c("x.attr").alias("callee"),
    )
    full = close_usage(usage, calls).groupBy("owner", "method").agg(F.collect_set("field").alias("fields"))
    m = m.select("owner", c("name").alias("method"), "ord").join(full, ["owner", "method"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    g = m.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("ord", "method", "fields"))).alias("x"))  # the methods of one class
    private = lambda a: a["method"].startswith("_")
    later = lambda a: F.filter("x", lambda b: (b["ord"] > a["ord"]) & ~(private(a) & private(b)))
    apart = F.aggregate("x", F.lit(0), lambda n, a: n + F.size(F.filter(later(a), lambda b: ~F.arrays_overlap(a["fields"], b["fields"]))))
    pairs = F.aggregate("x", F.lit(0), lambda n, a: n + F.size(later(a)))
    g = g.withColumn("apart", apart).withColumn("close", pairs - c("apart")).withColumn("n", F.greatest(F.lit(0), c("apart") - c("close"))).where(c("n") > t["LCOM_THRESHOLD"])
    g = g.join(k.select(c("name").alias("owner"), "path"), "owner")
    return _smells(g, "High Lack of Cohesion of Methods (LCOM)", text("Class '", c("owner"), "' has LCOM of ", c("n"), " (non-cohesive: ", c("apart"), ", cohesive: ", c("close"), ")"), 5, _level(c("n"), t["LCOM_THRESHOLD"]), owner="owner")


def rfc(s: Structure, t: Thresholds) -> DataFrame:
    k = s.classes().withColumn("m", F.size(F.filter("methods", lambda m: ~dunder(m["name"]) & (m["branching"] | ~m["name"].startswith("_")))))
    k = k.withColumn("e", F.size(F.array_except(F.flatten(F.transform("methods", lambda m: m["calls"])), _names("methods")))).withColumn("n", c("m") + c("e")).where(c("n") > t["RFC_THRESHOLD"])
    return _smells(k, "High Response for a Class (RFC)", text("Class '", c("name"), "' has RFC of ", c("n"), " (methods: ", c("m"), ", external calls: ", c("e"), ")"), 6, _level(c("n"), t["RFC_THRESHOLD"]))


def nocc(s: Structure, t: Thresholds) -> DataFrame:
    k = s.classes().where(~holds(F.lower("name"), "test") & ~F.exists("bases", lambda b: ends(b, "Exception")))
    weight = (F.size("methods") + F.size("fields") + F.aggregate("methods", F.lit(0), lambda a, m: a + m["complexity"])) / 3
    g = k.groupBy("module").agg(F.count("*").alias("n"), F.avg(weight).alias("weight"), F.first("path").alias("path"))
    most = F.lit(float(t["NOCC_THRESHOLD"])) * F.when(c("weight") < t.get("NOCC_AVG_WEIGHT_BOUND_LOW"), t.get("NOCC_MULTIPLIER_LOW")).when(c("weight") > t.get("NOCC_AVG_WEIGHT_BOUND_HIGH"), t.get("NOCC_MULTIPLIER_HIGH")).otherwise(1.0)
    g = g.withColumn("most", most).where(c("n") > c("most"))
    return _smells(g, "High Number of Classes (NOCC)", text("Module '", c("module"), "' has ", c("n"), " significant classes (avg complexity: ", py_format(c("weight"), ".1f"), ")"), 7, _level(c("n"), c("most")), owner="module")


def inheritance_depth(classes: DataFrame, t: Thresholds) -> DataFrame:
    """classes (name, bases) to rows (id, depth, path): the shortest way from object to each class or base; depth is null out of its reach. Framework
    bases, mixins, interfaces and abstract bases are no edges."""
    framework = t.get("FRAMEWORK_BASES")
    edges = classes.select(F.explode("bases").alias("src"), c("name").alias("dst"))
    last = F.substring_index("src", ".", -1)
    edges = edges.where(~last.isin(*framework) & ~holds(last, "Mixin", "Interface", "ABC", "Abstract")).distinct()
    nodes = classes.select(c("name").alias("id")).unionByName(edges.select(c("src").alias("id"))).distinct()
    roots = nodes.join(edges.select(c("dst").alias("id")), "id", "left_anti").where("id <> 'object'").select(F.lit("object").alias("src"), c("id").alias("dst"))
    return nodes.where("id <> 'object'").join(depths(edges.unionByName(roots), "object"), "id", "left")


def deep_inheritance(s: Structure, t: Thresholds) -> DataFrame:
    """Classes deep below object, and classes that it does not reach (on cycles of bases)."""
    d = inheritance_depth(s.classes().select("name", "bases"), t).withColumnRenamed("path", "way")
    owner = F.when(F.contains("id", F.lit(".")), F.regexp_extract("id", r"^(.*)\.[^.]*$", 1)).otherwise(c("id"))
    d = d.withColumn("module", owner).join(s.good.select("path", "module"), "module", "left").withColumn("file", F.coalesce("path", F.lit("Unknown")))
    deep = d.where(c("depth") > t["DIT_THRESHOLD"])
    said = text("Class '", c("id"), "' has DIT of ", c("depth"), "\nInheritance path: ", F.array_join("way", "->"))
    alone = d.where(c("depth").isNull() & ~any_of([F.contains(c("id"), F.lit(b)) for b in t.get("FRAMEWORK_BASES")]))
    a = _smells(deep, "Deep Inheritance Tree (DIT)", said, 8, _level(c("depth"), t["DIT_THRESHOLD"]), owner="id", path="file")
    b = _smells(alone, "Isolated Class in Inheritance Tree", text("Class '", c("id"), "' is isolated from the main inheritance hierarchy"), 8, "Low", owner="id", path="file")
    return a.unionByName(b)


def line_counts(codes: Column) -> dict[str, Column]:
    """total, blank, doc, imports and code lines of a file, from the classes of its lines: nothing leaves the row."""
    outside, inside = halves(codes)
    return {
        "total": F.length(codes).cast("long"), "blank": count_of(codes, " "), "doc": count_of(codes, "DS") + count_of(inside, "#IC"),
        "imports": count_of(outside, "I"), "code": count_of(outside, "C"),
    }


def loc(s: Structure, t: Thresholds) -> DataFrame:
    g = s.good.select(c("module").alias("id"), "path", *[x.alias(k) for k, x in line_counts(c("split_lines")).items()])
    busy = c("total") - c("blank")
    ratio = F.coalesce(F.try_divide(c("code"), busy), F.lit(1.0))
    tests = F.when(F.contains(F.lower("id"), F.lit("test")), t.get("LOC_TEST_FILE_MULTIPLIER")).otherwise(1.0)
    most = F.lit(float(t["LOC_THRESHOLD"])) * tests * F.when(ratio < t.get("LOC_DOC_COMPLEXITY_RATIO_BREAKPOINT"), t.get("LOC_DOC_COMPLEXITY_MULTIPLIER")).otherwise(1.0)
    g = g.withColumn("most", most).where(c("code") > c("most"))
    said = text(
        "Module '", c("id"), "' has ", c("code"), " effective code lines\n(Total: ", c("total"), ", Code: ", c("code"),
        ", Doc: ", c("doc"), ", Import: ", c("imports"), ", Blank: ", c("blank"), ")",
    )
    return _smells(g, "High Lines of Code (LOC)", said, 9, _level(c("code"), c("most")), owner="id")


def noc(s: Structure, t: Thresholds) -> DataFrame:
    """One row for the project."""
    low = F.lower("name")
    kind = F.when(holds(low, "test", "mock", "stub", "fake"), "test").when(holds(low, "util", "helper", "common", "base"), "utility").when(holds(c("name"), "Abstract", "Base", "Interface"), "abstract").otherwise("regular")
    k = s.classes().where(~holds(low, "generated")).select(kind.alias("kind"))
    n = k.agg(*[F.count_if(c("kind") == x).alias(x) for x in ("regular", "abstract", "utility", "test")])
    size = s.good.agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.max("root").alias("root"))
    base, high, mid = t["NOC_THRESHOLD"], t.get("NOC_LOC_MULTIPLIER_HIGH"), t.get("NOC_LOC_MULTIPLIER_MEDIUM")
    n = n.crossJoin(size).withColumn("n", c("regular") + c("abstract") * 0.5 + c("utility") * 0.3)
    large, middle = c("loc") > t.get("NOC_LOC_BREAKPOINT_HIGH"), c("loc") > t.get("NOC_LOC_BREAKPOINT_MEDIUM")
    n = n.withColumn("most", F.when(large, base * high).when(middle, base * mid).otherwise(float(base))).withColumn("shown", F.when(large, str(base * high)).when(middle, str(base * mid)).otherwise(str(base))).where(c("n") > c("most"))
    said = text(
        "Project has ",
        py_format(c("n"), ".1f"),
        " weighted classes:\n- Regular classes: ",
        c("regular"),
        "\n- Abstract/Interface classes: ",
        c("abstract"),
        "\n- Utility classes: ",
        c("utility"),
        "\n- Test classes: ",
        c("test"),
        " (not counted in weighted total)\nAdjusted threshold: ",
        c("shown"),
    )
    return smells(n, KIND, "High Number of Classes (NOC)", said, path="root", owner=F.lit("Project"), severity=_level(c("n"), c("most")), step=10)


def mpc(s: Structure, t: Thresholds) -> DataFrame:
    used = F.filter(_calls_by_name(), lambda x: ~begins(x["attr"], "get_", "set_", "is_", "has_", "__"))
    k = s.classes().withColumn("own", _names("methods")).withColumn("used", used).withColumn("ext", F.transform(F.filter("used", lambda x: ~F.array_contains("own", x["attr"])), lambda x: x["attr"]))
    k = k.withColumn("n_ext", F.size("ext")).withColumn("n_int", F.size(F.array_intersect(F.transform("used", lambda x: x["attr"]), "own"))).withColumn("n", c("n_ext") * F.lit(float(t.get("MPC_EXTERNAL_WEIGHT"))) + c("n_int")).where(
        c("n") > t["MPC_THRESHOLD"],
    )
    counts = F.array_sort(F.transform(F.array_distinct("ext"), lambda a: F.struct((-F.size(F.filter("ext", lambda x: x == a))).alias("n"), a.alias("attr"))))
    top = F.array_join(F.transform(F.slice(counts, 1, 3), lambda x: F.concat(F.lit("'"), x["attr"], F.lit("': "), (-x["n"]).cast("string"))), ", ")
    said = text("Class '", c("name"), "' has weighted MPC of ", py_format(c("n"), ".1f"), "\n(External calls: ", c("n_ext"), ", Internal calls: ", c("n_int"), ")\nMost frequent external calls: {", top, "}")
    return _smells(k, "High Message Passing Coupling (MPC)", said, 11, _level(c("n"), t["MPC_THRESHOLD"]))


def _coupled(names: Column) -> Column:
    low = lambda x: F.lower(x)
    return F.array_distinct(
        F.filter(names, lambda x: ~begins(x, "os", "sys", "datetime", "collections", "json", "logging", "re", "math") & ~holds(low(x), "test_", "mock_", "stub_", "fake_", "utils", "helper") & ~x.isin("object", "Exception", "dict", "list", "set")),
    )


def cbo(s: Structure, t: Thresholds) -> DataFrame:
    k = s.classes().withColumn("direct", _coupled(F.concat(F.flatten(F.transform("methods", lambda m: m["direct"])), "bases"))).withColumn("indirect", _coupled(F.flatten(F.transform("methods", lambda m: m["indirect"]))))
    k = k.withColumn("n", F.size("direct") * F.lit(float(t.get("CBO_DIRECT_WEIGHT"))) + F.size("indirect") * F.lit(float(t.get("CBO_INDIRECT_WEIGHT")))).where(c("n") > t["CBO_THRESHOLD"])
    top = F.array_join(F.transform(F.slice(F.array_sort("direct"), 1, 3), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    said = text("Class '", c("name"), "' has weighted CBO of ", py_format(c("n"), ".1f"), "\nDirect coupling: ", F.size("direct"), " classes\nIndirect coupling: ", F.size("indirect"), " classes\nMost significant dependencies: [", top, "]")
    level = F.when(c("n") > t["CBO_THRESHOLD"] * 2, "High").when(c("n") > t["CBO_THRESHOLD"] * 1.5, "Medium").otherwise("Low")
    return _smells(k, "High Coupling Between Object Classes (CBO)", said, 12, level)


def cyclomatic_complexity(s: Structure, t: Thresholds) -> DataFrame:
    m = s.methods().where(~dunder(c("name")) & (c("complexity") > t.get("CYCLOMATIC_COMPLEXITY_THRESHOLD")))
    return _smells(
        m,
        "High Cyclomatic Complexity",
        text("Method '", c("name"), "' has cyclomatic complexity of ", c("complexity")),
        13,
        _level(c("complexity"), t.get("CYCLOMATIC_COMPLEXITY_THRESHOLD")),
        owner="class_name",
        line=c("lineno"),
        seq=c("class_ord") * 10_000 + c("ord"),
    )


def _graph(s: Structure, rows: DataFrame, name: str, said: Column, step: int, most: float) -> DataFrame:
    rows = rows.join(s.good.select(c("module").alias("id"), "path"), "id", "left").withColumn("file", F.coalesce("path", F.lit("Unknown")))
    return _smells(rows, name, said, step, _level(c("n"), most), owner="id", path="file")


def fan_out(s: Structure, t: Thresholds) -> DataFrame:
    e = s.edges.where(~holds(F.lower("src"), "test") & ~begins(c("dst"), "os", "sys", "datetime", "collections", "json", "logging"))
    d = e.groupBy(c("src").alias("id")).agg(F.count("*").alias("n")).where(c("n") > t.get("MAX_FANOUT"))
    return _graph(s, d, "High Fan-out", text("Module '", c("id"), "' has ", c("n"), " significant outgoing dependencies"), 14, t.get("MAX_FANOUT"))


def fan_in(s: Structure, t: Thresholds) -> DataFrame:
    most = t.get("MAX_FANIN")
    # modules that nothing imports count only below a threshold of 0
    d = s.edges.groupBy(c("dst").alias("id")).agg(F.count("*").alias("n")) if most >= 0 else nodes_of(s.edges, s.nodes).select("id", c("n_in").alias("n"))
    d = d.where(~holds(F.lower("id"), "util", "base", "common", "interface") & (c("n") > most))
    return _graph(s, d, "High Fan-in", text("Module '", c("id"), "' has ", c("n"), " incoming dependencies"), 15, t.get("MAX_FANIN"))


def long_file(s: Structure, t: Thresholds) -> DataFrame:
    """Lines count that are neither blank, comments, nor within (or at the edge of) documentation; comments never turn it."""
    g = s.good.select(c("module").alias("id"), "path", count_of(halves(c("strict_lines"))[0], "IC").alias("n")).where(c("n") > t.get("MAX_FILE_LENGTH"))
    return _smells(g, "Long File", text("File '", c("id"), "' has ", c("n"), " meaningful lines of code"), 16, _level(c("n"), t.get("MAX_FILE_LENGTH")), owner="id")


def too_many_branches(s: Structure, t: Thresholds) -> DataFrame:
    skip = F.exists("decorators", lambda d: d.isin(*t.get("BRANCH_EXCLUDE_DECORATORS"))) | begins(c("name"), *t.get("BRANCH_EXCLUDE_METHOD_PREFIXES"))
    m = s.methods().where(~skip & ((c("branches") > t.get("MAX_BRANCHES")) | (c("nesting") > t.get("MAX_NESTING_DEPTH"))))
    return _smells(
        m,
        "Too Many Branches",
        text("Method '", c("name"), "' has ", c("branches"), " branches with max nesting of ", c("nesting")),
        17,
        _level(c("branches"), t.get("MAX_BRANCHES")),
        owner="class_name",
        line=c("lineno"),
        seq=c("class_ord") * 10_000 + c("ord"),
    )


DETECTORS = {
    "s01_nom": nom, "s02_wmpc": wmpc, "s03_size2": size2, "s04_wac": wac, "s05_lcom": lcom, "s06_rfc": rfc, "s07_nocc": nocc, "s08_dit": deep_inheritance, "s09_loc": loc, "s10_noc": noc, "s11_mpc": mpc, "s12_cbo": cbo,
    "s13_cyclomatic_complexity": cyclomatic_complexity, "s14_fan_out": fan_out, "s15_fan_in": fan_in, "s16_long_file": long_file, "s17_too_many_branches": too_many_branches,
}
