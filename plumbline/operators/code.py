"""Code smells: what is wrong within one file. Every detector takes the facts and the thresholds of its section; where the rule concerns one function
or class only, it is a filter over that row, without an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.pyformat import py_format
from plumbline.operators.base import begins, commas, count_of, decorated, dunder, ends, rows_of, smells, text
from plumbline.plans.config import Thresholds

KIND = "Code"
c = F.col
_THREE = ["name", "call", "attribute"]
_TRIVIAL = ("Return", "Assign")


def _exception(bases: Column, *more: str) -> Column:
    return F.exists(bases, lambda b: ends(b, "Exception", *more))


def _data(decorators: Column) -> Column:
    return decorated(decorators, ["dataclass"], _THREE)


def _property(decorators: Column, forms: list[str] = _THREE) -> Column:
    return decorated(decorators, ["property"], forms)


def _class(rows: DataFrame, name: str, description: Column, step: int, severity: str = "medium", line: bool = True) -> DataFrame:
    return smells(rows, KIND, name, description, owner=c("name"), line=c("lineno") if line else None, severity=severity, step=step, seq=c("ord"))


def long_method(facts: DataFrame, t: Thresholds) -> DataFrame:
    f = rows_of(facts, "functions").where(~_property(c("decorators"), ["name", "call"]) & (c("code_lines") > t["LONG_METHOD_LINES"]))
    return _class(f, "Long Method", text("'", c("name"), "' has ", c("code_lines"), " lines in ", c("path"), " at line ", c("lineno")), 1)


def large_class(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "code_classes").where(~_data(c("decorators")) & ~_exception(c("bases")))
    k = k.withColumn("n", F.size(F.filter("defined", lambda m: ~dunder(m["name"]) & ~F.coalesce(m["only"].isin(*_TRIVIAL), F.lit(False))))).where(c("n") > t["LARGE_CLASS_METHODS"])
    return _class(k, "Large Class", text("'", c("name"), "' has ", c("n"), " non-trivial methods in ", c("path")), 2)


def primitive_obsession(facts: DataFrame, t: Thresholds) -> DataFrame:
    f = rows_of(facts, "functions").where(F.size("args") > t.get("PRIMITIVE_MIN_ARGS"))
    primitive = F.filter(F.arrays_zip("args", "annotations"), lambda a: a["annotations"].isin("int", "str", "float", "bool"))
    first = F.when((F.get("args", F.lit(0)) == "self") & F.get("annotations", F.lit(0)).isin("int", "str", "float", "bool"), 1).otherwise(0)
    f = f.withColumn("n", F.size(primitive) - first).withColumn("of", F.size("args") - F.when(F.contains(F.get("args", F.lit(0)), F.lit("self")), 1).otherwise(0))
    f = f.where((c("n") > t["PRIMITIVE_OBSESSION_COUNT"]) & (F.try_divide("n", "of") > t.get("PRIMITIVE_RATIO_THRESHOLD")))
    return _class(f, "Primitive Obsession", text("'", c("name"), "' has ", c("n"), " primitive parameters in ", c("path")), 3)


def long_parameter_list(facts: DataFrame, t: Thresholds) -> DataFrame:
    f = rows_of(facts, "functions").where(c("name") != "__init__")
    f = f.withColumn("n", F.size("args") - F.when(F.get("args", F.lit(0)) == "self", 1).otherwise(0)).where(c("n") > t["LONG_PARAMETER_LIST"] + F.when(c("varargs"), 2).otherwise(0))
    return _class(f, "Long Parameter List", text("'", c("name"), "' has ", c("n"), " parameters in ", c("path")), 4)


def data_clumps(facts: DataFrame, t: Thresholds) -> DataFrame:
    """Sets of parameters that more than one function has. Functions of a file meet on parameters that they share; every set that two of them have
    lies in what the two share, so only subsets of that are counted off, as bit masks, from the size at which they are reported on. A function may
    have any number of parameters; what is reported of two that share n is 2**n sets by the rule itself."""
    least = max(t["DATA_CLUMPS_THRESHOLD"], t.get("DATA_CLUMP_MIN_COMBO_SIZE"))
    f = rows_of(facts, "functions").where((c("name") != "__init__") & ~_property(c("decorators"), ["name"]))
    f = f.select("path", "name", "ord", F.array_sort(F.array_distinct(F.filter("args", lambda a: a != "self"))).alias("params")).where(F.size("params") >= t["DATA_CLUMPS_THRESHOLD"])
    one = f.select("path", c("ord").alias("a"), c("params").alias("pa"), F.explode("params").alias("p"))
    two = f.select("path", c("ord").alias("b"), c("params").alias("pb"), F.explode("params").alias("p"))
    met = one.join(two, ["path", "p"]).where("a < b").groupBy("path", "a", "b").agg(F.count("*").alias("n")).where(c("n") >= least).select("path", "a", "b")
    by = lambda x: f.select("path", c("ord").alias(x), F.struct("ord", "name").alias(f"f{x}"), c("params").alias(f"p{x}"))
    s = met.join(by("a"), ["path", "a"]).join(by("b"), ["path", "b"]).select("path", F.array("fa", "fb").alias("fs"), F.array_sort(F.array_intersect("pa", "pb")).alias("shared"))
    # the pairs that share just the same are one
    s = s.groupBy("path", "shared").agg(F.array_distinct(F.flatten(F.collect_list("fs"))).alias("fs"))
    # the masks are the product of two generators, so no array has more than 2**16 for up to 32 shared parameters
    s = s.select("path", "fs", "shared", F.explode(F.expr("sequence(0L, shiftleft(1L, greatest(size(shared) - 16, 0)) - 1)")).alias("high"))
    s = s.select("path", "fs", "shared", "high", F.explode(F.expr("sequence(0L, shiftleft(1L, least(size(shared), 16)) - 1)")).alias("low"))
    s = s.withColumn("mask", F.expr("shiftleft(high, 16) | low")).where(F.bit_count("mask") >= least)
    s = s.select("path", "fs", F.expr("filter(shared, (p, i) -> getbit(mask, i) = 1)").alias("combo"))
    g = s.groupBy("path", "combo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fs")))).alias("x"))
    g = g.withColumn("fns", commas(F.transform("x", lambda x: x["name"])))
    said = text("Parameters ", commas(c("combo")), " appear together in functions: ", c("fns"), " in ", c("path"))
    return smells(g, KIND, "Data Clumps", said, owner=c("fns"), step=5, seq=F.get("x", F.lit(0))["ord"])


def switch_statements(facts: DataFrame, t: Thresholds) -> DataFrame:
    i = rows_of(facts, "ifs").where((c("n_orelse") > 0) & ~c("in_handler")).withColumn("n", c("n_else_ifs") + 1)
    guard, check = (c("n_body") <= 2) & (c("test") == "Compare"), (c("test") == "Call") & (c("callee") == "isinstance")
    i = i.where((c("n") > t["COMPLEX_CONDITIONAL"]) & ~guard & ~check)
    return smells(i, KIND, "Switch Statements", text("Complex conditional with ", c("n"), " branches at line ", c("lineno"), " in ", c("path")), line=c("lineno"), step=6, seq=c("ord"))


def temporary_field(facts: DataFrame, t: Thresholds) -> DataFrame:
    """Names bound in a constructor (its parameters too) that no other method reads from self; sorted."""
    k = rows_of(facts, "code_classes").where(~_data(c("decorators")) & ~_exception(c("bases")) & ~c("cached"))
    left = F.filter(F.array_except("init_names", "self_reads"), lambda x: ~x.isin("logger", "config", "cache", "_cache"))
    k = k.withColumn("left", F.array_sort(left)).where(F.size("left") >= t["TEMPORARY_FIELD_THRESHOLD"])
    return _class(k, "Temporary Field", text("Potentially unused fields ", commas(c("left")), " in class '", c("name"), "' at line ", c("lineno"), " in ", c("path")), 7, "low")


def alternative_classes(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "code_classes")
    based = k.groupBy("path", "name").agg(F.bool_or(F.size("bases") > 0).alias("based"))
    k = k.where(~decorated(c("decorators"), ["dataclass", "abstractmethod"], _THREE) & ~_exception(c("bases"), "ABC"))
    k = k.withColumn("methods", F.array_sort(F.filter(F.transform("methods", lambda m: m["name"]), lambda m: ~m.startswith("_")))).where(F.size("methods") >= 2)
    g = k.join(based, ["path", "name"]).groupBy("path", "methods").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("x"), F.bool_or("based").alias("based")).where(
        (F.size("x") >= t["ALTERNATIVE_CLASSES_THRESHOLD"]) & ~c("based"),
    )
    g = g.withColumn("all", commas(F.transform("x", lambda x: x["name"])))
    return smells(g, KIND, "Alternative Classes with Different Interfaces", text("Classes ", c("all"), " share similar methods ", commas(c("methods")), " in ", c("path")), owner=c("all"), step=8, seq=F.get("x", F.lit(0))["ord"])


def divergent_change(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "code_classes").where(~_data(c("decorators")) & ~_exception(c("bases")) & ~ends(c("name"), "Utils", "Helper", "Mixin"))
    own = F.filter("methods", lambda m: ~m["name"].startswith("_") & ~_property(m["decorators"]))
    prefixes = F.filter(F.transform(own, lambda m: F.substring_index(m["name"], "_", 1)), lambda p: ~p.isin("get", "set", "is", "has", "validate", "create", "update", "delete"))
    k = k.withColumn("prefixes", prefixes).withColumn("unique", F.array_sort(F.array_distinct("prefixes"))).where((F.size("unique") > t["DIVERGENT_CHANGE_PREFIXES"]) & (F.size("prefixes") > t["DIVERGENT_CHANGE_METHODS"]))
    return _class(k, "Potential Divergent Change", text("Class '", c("name"), "' has ", F.size("unique"), " different method prefixes: ", commas(c("unique")), " in ", c("path")), 9)


def parallel_inheritance(facts: DataFrame, t: Thresholds) -> DataFrame:
    """Pairs of hierarchies (classes with one base) whose first classes have similar public methods. The heads' names agree by construction, so the
    name test always holds. One row a file names all pairs."""
    k = rows_of(facts, "code_classes").where(~_exception(c("bases")) & ~c("name").endswith("Mixin"))
    k = k.withColumn("public", F.array_distinct(F.filter(F.transform("methods", lambda m: m["name"]), lambda m: ~m.startswith("_"))))
    last = k.where(F.size("bases") > 0).groupBy("path", "name").agg(F.max_by("public", "ord").alias("head_methods"))
    h = k.select("path", "name", "ord", F.posexplode("bases").alias("i", "base")).groupBy("path", "base").agg(F.array_sort(F.collect_list(F.struct("ord", "i", "name"))).alias("x"))
    h = h.select("path", F.get("x", F.lit(0))["ord"].alias("at"), F.get("x", F.lit(0))["i"].alias("i"), F.transform("x", lambda x: x["name"]).alias("names")).where(F.size("names") > 1)
    h = h.join(last.withColumnRenamed("name", "head"), (h["path"] == last["path"]) & (c("head") == F.get("names", F.lit(0)))).select(h["path"], "at", "i", "names", "head_methods")
    a, b = (h.select(*[c(x).alias(f"{x}_{s}") for x in h.columns]) for s in "ab")
    p = a.join(b, (c("path_a") == c("path_b")) & ((c("at_a") < c("at_b")) | (c("at_a") == c("at_b")) & (c("i_a") < c("i_b"))))
    union = F.size(F.array_union("head_methods_a", "head_methods_b"))
    similar = F.try_divide(F.size(F.array_intersect("head_methods_a", "head_methods_b")), union) > t.get("PARALLEL_INHERITANCE_SIMILARITY_THRESHOLD")
    arrow = lambda x: F.array_join(x, " -> ")
    p = p.where(similar).select(c("path_a").alias("path"), F.struct("at_a", "i_a", "at_b", "i_b", text(arrow(c("names_a")), " and ", arrow(c("names_b"))).alias("said")).alias("s"))
    g = p.groupBy("path").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return smells(g, KIND, "Parallel Inheritance Hierarchies", text("Parallel hierarchies detected: ", F.array_join(F.transform("s", lambda s: s["said"]), " and "), " in ", c("path")), severity="high", step=10)


def shotgun_surgery(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "name_calls").where(~F.lower("name").isin(*t.get("SHOTGUN_SURGERY_EXCLUDE_NAMES")))
    g = k.groupBy("path", "name").agg(F.count("*").alias("n"), F.count_distinct(F.struct(c("context").isNull(), "context")).alias("contexts"), F.min_by("lineno", "ord").alias("line"), F.min("ord").alias("ord"))
    g = g.where((c("n") > t["SHOTGUN_SURGERY_CALLS"]) & (c("contexts") > t["SHOTGUN_SURGERY_CONTEXTS"]))
    return smells(
        g,
        KIND,
        "Potential Shotgun Surgery",
        text("Method '", c("name"), "' called in ", c("contexts"), " different contexts across ", c("n"), " locations in ", c("path")),
        owner=c("name"),
        line=c("line"),
        severity="high",
        step=11,
        seq=c("ord"),
    )


def comment_blocks(codes: Column) -> dict[str, Column]:
    """code_lines, comment_lines and large_blocks of a file, from the classes of its lines: runs of comment lines, but for one at the top. Nothing leaves the row."""
    below = F.regexp_replace(codes, "^#+", "")
    return {"code_lines": count_of(codes, "SIC"), "comment_lines": count_of(below, "#"), "large_blocks": F.size(F.regexp_extract_all(below, F.lit("#{6,}"), F.lit(0))).cast("long")}


def excessive_comments(facts: DataFrame, t: Thresholds) -> DataFrame:
    g = facts.where("code_error is null").select("path", *[x.alias(k) for k, x in comment_blocks(c("lines")).items()])
    g = g.withColumn("ratio", F.try_divide(c("comment_lines"), F.greatest("code_lines", F.lit(1))))
    g = g.where((c("ratio") > t["EXCESSIVE_COMMENTS_RATIO"]) & (c("large_blocks") > t["LARGE_COMMENT_BLOCKS"]))
    said = text("File has ", py_format(c("ratio"), ".1%"), " comment ratio with ", c("large_blocks"), " large comment blocks in ", c("path"))
    return smells(g, KIND, "Excessive Comments", said, severity="low", step=12)


def normalized(code: Column) -> Column:
    """Code with all words one word, no white space, and nothing from the first # on."""
    x = F.regexp_replace(code, r"(?U)\b[a-zA-Z_]\w*\b", "VAR")
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", ""), "#.*$", "")


def duplicate_code(facts: DataFrame, t: Thresholds) -> DataFrame:
    f = rows_of(facts, "functions").where((c("n_body") >= t["DUPLICATE_CODE_MIN_LINES"]) & ~c("name").startswith("test_") & ~F.coalesce(c("only").isin(*_TRIVIAL), F.lit(False)))
    g = f.groupBy("path", normalized(c("normal")).alias("key")).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("x"), F.sum("n_body").alias("total")).where(F.size("x") >= t["DUPLICATE_CODE_THRESHOLD"])
    g = g.withColumn("all", commas(F.transform("x", lambda x: x["name"])))
    return smells(g, KIND, "Duplicate Code", text("Similar code found in functions: ", c("all"), " (", c("total"), " total lines) in ", c("path")), owner=c("all"), severity="high", step=13, seq=F.get("x", F.lit(0))["ord"])


def _accessors(facts: DataFrame) -> DataFrame:
    """Classes that the accessor rule looks at, with their getters, setters and other methods."""
    plain = F.when(F.size("decorators") > 0, ~decorated(c("decorators"), ["dataclass"], ["name"])).otherwise(~_exception(c("bases")))
    k = rows_of(facts, "code_classes").where(plain & (F.size("methods") > 0))
    own = F.filter("methods", lambda m: ~m["name"].startswith("__"))
    count = lambda prefix: F.size(F.filter(own, lambda m: m["name"].startswith(prefix) & (m["n_body"] == 1)))
    return k.withColumn("getters", count("get_")).withColumn("setters", count("set_")).withColumn("others", F.size(own) - c("getters") - c("setters"))


def data_class(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = _accessors(facts)
    least = t["DATA_CLASS_METHODS"] if "DATA_CLASS_METHODS" in t else None
    k = k.where(F.lit(False) if least is None else (c("others") == 0) & (c("getters") + c("setters") >= least) & ~ends(c("name"), "DTO", "Model", "Entity", "Record"))
    return _class(k, "Data Class", text("Class '", c("name"), "' has ", c("getters"), " getters and ", c("setters"), " setters with no other methods in ", c("path")), 14)


def dead_code(facts: DataFrame, t: Thresholds) -> DataFrame:
    """Private functions at the top of a file that nothing in it calls, where there are enough of them."""
    f = rows_of(facts, "functions", "called").where(~c("name").startswith("test_") & ~decorated(c("decorators"), ["property"], ["name", "attribute"]))
    f = f.groupBy("path", "name").agg(F.max_by("public_mark", "ord").alias("public_mark"), F.min("ord").alias("ord"), F.first("called").alias("called"))
    f = f.where(c("name").startswith("_") & ~c("name").startswith("__") & ~c("public_mark") & ~F.array_contains("called", c("name")))
    f = f.withColumn("n", F.count("*").over(Window.partitionBy("path"))).where(c("n") >= t["DEAD_CODE_THRESHOLD"])
    return smells(f, KIND, "Dead Code", text("Potentially unused function '", c("name"), "' in ", c("path")), owner=c("name"), severity="low", step=15, seq=c("ord"))


def _lazy(facts: DataFrame) -> DataFrame:
    k = rows_of(facts, "code_classes").where(~ends(c("name"), "Exception", "Error", "Mixin", "Interface", "Abstract", "Base") & ~decorated(c("decorators"), ["dataclass"], ["name"]))
    own = F.filter("methods", lambda m: ~m["name"].startswith("__") & ~F.coalesce(m["only"].isin(*_TRIVIAL), F.lit(False)))
    return k.withColumn("own", own).withColumn("n", F.size("own")).withColumn("total", F.aggregate("own", F.lit(0), lambda a, m: a + m["last"] - m["first"]))


def lazy_class(facts: DataFrame, t: Thresholds) -> DataFrame:
    least = t["LAZY_CLASS_LINES"] if "LAZY_CLASS_LINES" in t else None
    k = _lazy(facts).where(F.lit(False) if least is None else (c("n") <= t["LAZY_CLASS_METHODS"]) & (c("total") <= least))
    return _class(k, "Lazy Class", text("Class '", c("name"), "' has only ", c("n"), " non-trivial methods with ", c("total"), " total lines in ", c("path")), 16, "low")


def speculative_generality(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "code_classes").where(~F.exists("bases", lambda b: b.endswith("ABC")) & ~ends(c("name"), "Interface", "Base", "Abstract"))
    k = k.withColumn("empty", F.transform(F.filter("methods", lambda m: m["opens"] == "Pass"), lambda m: m["name"])).withColumn("unused", F.flatten(F.transform("methods", lambda m: m["unused"])))
    k = k.where((F.size("empty") >= t["SPECULATIVE_GENERALITY_THRESHOLD"]) | (F.size("unused") >= t["UNUSED_PARAMETERS_THRESHOLD"]))
    empty = F.when(F.size("empty") > 0, text("has ", F.size("empty"), " empty methods: ", commas(c("empty"))))
    unused = F.when(F.size("unused") > 0, text("has ", F.size("unused"), " unused parameters: ", commas(c("unused"))))
    return _class(k, "Speculative Generality", text("Class '", c("name"), "' ", F.concat_ws(" and ", empty, unused), " in ", c("path")), 17)


def feature_envy(facts: DataFrame, t: Thresholds) -> DataFrame:
    f = rows_of(facts, "functions").where(~_property(c("decorators")) & ~F.coalesce(c("only") == "Return", F.lit(False)))
    others = F.filter("bases_used", lambda b: (b != "self") & ~F.lower(b).isin("logger", "config", "utils", "helper"))
    f = f.withColumn("local", F.size(F.filter("bases_used", lambda b: b == "self"))).withColumn("others", others)
    counts = F.transform(F.array_distinct("others"), lambda b: F.struct(F.size(F.filter("others", lambda x: x == b)).alias("n"), b.alias("base")))
    # the first seen of the most used
    best = F.aggregate(counts, F.struct(F.lit(0).alias("n"), F.lit("").alias("base")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    f = f.withColumn("best", best).where((c("best.n") > t["FEATURE_ENVY_CALLS"]) & (c("best.n") > c("local") * t.get("FEATURE_ENVY_LOCAL_RATIO")))
    return _class(f, "Feature Envy", text("Method '", c("name"), "' makes ", c("best.n"), " calls to '", c("best.base"), "' but only ", c("local"), " local calls in ", c("path")), 18)


def inappropriate_intimacy(facts: DataFrame, t: Thresholds) -> DataFrame:
    """Pairs of a file's classes, neither based on the other, where one's methods are named like the other's fields: a join on the shared name, not on all pairs."""
    k = rows_of(facts, "code_classes").where(~_data(c("decorators")) & ~ends(c("name"), "Utils", "Helper", "Factory"))
    k = k.select(
        "path",
        "name",
        "ord",
        "bases",
        F.array_distinct(F.filter(F.transform("methods", lambda m: m["name"]), lambda m: ~m.startswith("__"))).alias("methods"),
        F.filter("instance_attrs", lambda a: ~a.startswith("_")).alias("fields"),
    )
    last = Window.partitionBy("path", "name").orderBy(F.desc("ord"))
    all_bases = k.groupBy("path", "name").agg(F.flatten(F.collect_list("bases")).alias("bases"), F.min("ord").alias("at"))
    k = k.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "bases", "ord").join(all_bases, ["path", "name"])
    a = k.select("path", c("name").alias("a"), c("bases").alias("a_bases"), F.size("methods").alias("n"), c("at").alias("a_at"), F.explode("methods").alias("member"))
    b = k.select("path", c("name").alias("b"), c("bases").alias("b_bases"), c("at").alias("b_at"), F.explode("fields").alias("member"))
    p = a.join(b, ["path", "member"]).where((c("a") != c("b")) & ~F.array_contains("a_bases", c("b")) & ~F.array_contains("b_bases", c("a")))
    g = p.groupBy("path", "a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("a_at").alias("a_at"), F.first("b_at").alias("b_at")).withColumn("ratio", F.try_divide("shared", "n"))
    g = g.where((c("shared") > t["INAPPROPRIATE_INTIMACY_SHARED"]) & (c("ratio") > t.get("INAPPROPRIATE_INTIMACY_METHOD_RATIO")))
    said = text("Class '", c("a"), "' might be too intimate with '", c("b"), "' (", c("shared"), " shared members, ", py_format(c("ratio"), ".1%"), " of methods) in ", c("path"))
    return smells(g, KIND, "Inappropriate Intimacy", said, owner=c("a"), step=19, seq=c("a_at") * 10_000 + c("b_at"))


# Attribute names whose chains are common.
COMMON_CHAIN_NAMES = ("debug", "info", "warning", "error", "critical", "parent", "name", "suffix", "stem", "assert_", "expect", "mock", "query", "filter", "order_by", "limit", "all", "first")


def message_chains(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "chains").where((F.size("names") > t["MESSAGE_CHAIN_LENGTH"]) & ~F.forall("names", lambda x: begins(x, "set_", "with_", "add_")) & ~F.exists("names", lambda x: x.isin(*COMMON_CHAIN_NAMES)))
    said = text("Long chain (", F.size("names"), " calls: ", F.array_join(F.reverse("names"), " -> "), ") in ", F.coalesce("context", F.lit("unknown context")), " at line ", c("lineno"), " in ", c("path"))
    return smells(k, KIND, "Message Chains", said, owner=c("context"), line=c("lineno"), step=20, seq=c("ord"))


def _delegates(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = rows_of(facts, "code_classes").where(~ends(c("name"), "Proxy", "Delegate", "Adapter", "Facade") & (c("n_body") > 3) & (F.size("methods") > 0))
    k = k.withColumn("calls", F.filter("methods", lambda m: m["returns_call"] & ~_property(m["decorators"]) & ~m["name"].startswith("__"))).withColumn("n", F.size("calls")).withColumn("ratio", F.try_divide(c("n"), F.size("methods")))
    k = k.withColumn("targets", F.filter(F.transform("calls", lambda m: m["delegate"]), lambda x: x.isNotNull()))
    return k.where((c("ratio") > t["MIDDLE_MAN_RATIO"]) & (F.size(F.array_distinct("targets")) <= t.get("MIDDLE_MAN_MAX_DELEGATE_TARGETS")))


def middle_man(facts: DataFrame, t: Thresholds) -> DataFrame:
    k = _delegates(facts, t).where(F.size("targets") > 0)
    counts = F.transform(F.array_distinct("targets"), lambda b: F.struct(F.size(F.filter("targets", lambda x: x == b)).alias("n"), b.alias("target")))
    best = F.aggregate(counts, F.struct(F.lit(0).alias("n"), F.lit("").alias("target")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    k = k.withColumn("best", best["target"])
    return _class(k, "Middle Man", text("Class '", c("name"), "' delegates ", c("n"), "/", F.size("methods"), " methods (", py_format(c("ratio"), ".1%"), "), mainly to ", c("best"), " in ", c("path")), 21)


def aborts(facts: DataFrame, t: Thresholds) -> DataFrame:
    """Rows (file_path, step, seq): where a strict run of the detectors over a file breaks off. Class decorators that are no names break the accessor
    rule (and the rule for lazy classes); so does a required threshold that is missing, and a class that delegates to functions only breaks the last
    rule."""
    k = rows_of(facts, "code_classes")
    at = F.array_position(F.transform("decorators", lambda d: d["form"] != "name"), True)
    ok = F.array_position(F.transform("decorators", lambda d: (d["form"] == "name") & (d["name"] == "dataclass")), True)
    odd = (at > 0) & ((ok == 0) | (at < ok))
    out = k.where(odd).select(c("path").alias("file_path"), F.lit(14).alias("step"), "ord")
    known = ends(c("name"), "Exception", "Error", "Mixin", "Interface", "Abstract", "Base")
    out = out.unionByName(k.where(odd & ~known).select(c("path").alias("file_path"), F.lit(16).alias("step"), "ord"))
    if "DATA_CLASS_METHODS" not in t:
        out = out.unionByName(_accessors(facts).where("others = 0").select(c("path").alias("file_path"), F.lit(14).alias("step"), "ord"))
    if "LAZY_CLASS_LINES" not in t:
        out = out.unionByName(_lazy(facts).where(c("n") <= t["LAZY_CLASS_METHODS"]).select(c("path").alias("file_path"), F.lit(16).alias("step"), "ord"))
    out = out.unionByName(_delegates(facts, t).where(F.size("targets") == 0).select(c("path").alias("file_path"), F.lit(21).alias("step"), "ord"))
    return out.groupBy("file_path").agg(F.min(F.struct("step", "ord")).alias("cut"))


def strict(found: DataFrame, facts: DataFrame, t: Thresholds) -> DataFrame:
    """Of the smells found those that a strict run reports: none from where a file's run breaks off."""
    cut = aborts(facts, t)
    return found.join(cut, "file_path", "left").where(c("cut").isNull() | (F.struct("step", c("seq").alias("ord")) < c("cut"))).drop("cut")


DETECTORS = {
    "c01_long_method": long_method, "c02_large_class": large_class, "c03_primitive_obsession": primitive_obsession, "c04_long_parameter_list": long_parameter_list, "c05_data_clumps": data_clumps, "c06_switch_statements": switch_statements,
    "c07_temporary_field": temporary_field, "c08_alternative_classes": alternative_classes, "c09_divergent_change": divergent_change, "c10_parallel_inheritance": parallel_inheritance, "c11_shotgun_surgery": shotgun_surgery, "c12_excessive_comments": excessive_comments,
    "c13_duplicate_code": duplicate_code, "c14_data_class": data_class, "c15_dead_code": dead_code, "c16_lazy_class": lazy_class, "c17_speculative_generality": speculative_generality, "c18_feature_envy": feature_envy,
    "c19_inappropriate_intimacy": inappropriate_intimacy, "c20_message_chains": message_chains, "c21_middle_man": middle_man,
}
