"""Small source trees and what must be found in them."""

import csv
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.extract import FACTS, extract
from plumbline.plans.config import EXTENDED, PACKAGED, check, load
from plumbline.plans.engine import AnalysisError, analyze, analyze_code
from plumbline.sources.pytree import read_tree
from plumbline.sources.reports import HEADER, write_reports


def tree(path, **files):
    for name, text in files.items():
        p = path / (name.replace("__slash__", "/") + ".py")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def found(spark, path, family, config=PACKAGED, **options):
    return sorted((r["name"], r["severity"]) for r in analyze(spark, path, config, (family,), **options).smells.collect())


def names(*args, **options):
    return [n for n, _ in found(*args, **options)]


def test_god_object(spark, tmp_path):
    assert names(spark, tree(tmp_path, big="".join(f"def func{i}(): pass\n" for i in range(26))), "architectural") == ["God Object"]


def test_scattered_functionality(spark, tmp_path):
    got = names(spark, tree(tmp_path, **{f"module{i}": "def scattered_function(): pass\n" for i in range(3)}), "architectural")
    assert got == ["Orphan Module"] * 3 + ["Scattered Functionality"]


def test_redundant_abstractions(spark, tmp_path):
    text = "".join(f"def func{i}(): pass\n" for i in range(5))
    a = analyze(spark, tree(tmp_path, module1=text, module2=text), PACKAGED, ("architectural",)).smells.collect()
    assert [r["name"] for r in a] == ["Potential Redundant Abstractions"] and "100.0%" in a[0]["description"]


def test_improper_api_usage(spark, tmp_path):
    a = analyze(spark, tree(tmp_path, calls="api.method1()\n" * 10), PACKAGED, ("architectural",)).smells.collect()
    assert [r["name"] for r in a] == ["Potential Improper API Usage"] and "method1(10x)" in a[0]["description"]


def test_large_class(spark, tmp_path):
    text = "class LargeClass:\n" + "".join(f"    def method{i}(self): pass\n" for i in range(16))
    a = analyze(spark, tree(tmp_path, large=text), EXTENDED, ("code",)).smells.orderBy("step").collect()
    assert [r["name"] for r in a] == ["Large Class", "Potential Divergent Change", "Speculative Generality"]


def test_parameters(spark, tmp_path):
    assert names(spark, tree(tmp_path / "a", f="def f(" + ", ".join(f"param{i}" for i in range(7)) + "): pass\n"), "code") == ["Long Parameter List"]
    assert names(spark, tree(tmp_path / "b", f="def f(a: int, b: str, c: float, d: bool, e: int): pass\n"), "code") == ["Primitive Obsession"]


def test_shotgun_surgery(spark, tmp_path):
    a = analyze(spark, tree(tmp_path, f="".join(f"def f{i}():\n    common_operation()\n" for i in range(7))), PACKAGED, ("code",)).smells.collect()
    assert [(r["name"], r["line_number"], r["severity"]) for r in a] == [("Potential Shotgun Surgery", 2, "high")]


def test_lines_of_code(spark, tmp_path):
    assert found(spark, tree(tmp_path, test_module="".join(f"print({i})\n" for i in range(1001))), "structural") == [("High Lines of Code (LOC)", "High"), ("Long File", "High")]


def test_number_of_classes(spark, tmp_path):
    a = analyze(spark, tree(tmp_path, **{f"module{i}": f"class Class{i}: pass\n" for i in range(101)}), PACKAGED, ("structural",)).smells.collect()
    assert [(r["name"], r["severity"], r["file_path"], r["module_class"]) for r in a] == [("High Number of Classes (NOC)", "High", str(tmp_path), "Project")] and "101.0 weighted" in a[0]["description"]


def test_methods_are_not_long_methods(spark, tmp_path):
    body = "".join(f"        x = {i}\n" for i in range(60))
    assert "Long Method" not in names(spark, tree(tmp_path / "a", m=f"class A:\n    def f(self):\n{body}"), "code")
    assert "Long Method" in names(spark, tree(tmp_path / "b", m=f"def f():\n{body}"), "code")


def test_elif_chain_is_two_branches(spark, tmp_path):
    chain = "if a:\n    x = 1\n    y = 1\n    z = 1\n" + "".join(f"elif b{i}:\n    x = 1\n" for i in range(5))
    nested = "if a:\n    x = 1\n    y = 1\n    z = 1\nelse:\n" + "".join(f"    if b{i}:\n        x = 1\n" for i in range(3))
    assert names(spark, tree(tmp_path / "a", m=chain), "code") == []
    assert names(spark, tree(tmp_path / "b", m=nested), "code") == ["Switch Statements"]


def test_constructor_parameters_are_temporary_fields(spark, tmp_path):
    a = analyze(spark, tree(tmp_path, m="class A:\n    def __init__(self, a, b):\n        self.a = a\n"), EXTENDED, ("code",)).smells.where("name = 'Temporary Field'").collect()
    assert "fields a, b, self in class 'A'" in a[0]["description"]


def test_hash_in_a_string_cuts_the_key(spark):
    from plumbline.operators.code import normalized

    code = [extract("/p/m.py", "/p", f'def f(x):\n    a = "# {i}"\n    b = {i} + {i * i}\n    return b\n'.encode())["functions"][0]["normal"] for i in (1, 2)]
    df = spark.createDataFrame([(x,) for x in code], "code string")
    assert code[0] != code[1] and df.select(normalized(df["code"])).distinct().count() == 1


def test_strict_run_ends_a_file(spark, tmp_path):
    text = "@dataclass(frozen=True)\nclass D:\n    x: int\nclass Small:\n    pass\n"
    assert names(spark, tree(tmp_path, m=text), "code", EXTENDED) == []
    assert names(spark, tree(tmp_path, m=text), "code", EXTENDED, strict=False) == ["Lazy Class", "Lazy Class"]


def test_delegating_to_functions_ends_a_file(spark, tmp_path):
    text = "class A:\n    a = 1\n" + "".join(f"    def m{i}(self):\n        return g()\n" for i in range(4))
    assert "Middle Man" not in names(spark, tree(tmp_path, m=text), "code", EXTENDED, strict=False)


def test_only_private_functions_are_dead(spark, tmp_path):
    assert names(spark, tree(tmp_path / "a", m="".join(f"def _f{i}(): pass\n" for i in range(3))), "code") == ["Dead Code"] * 3
    assert names(spark, tree(tmp_path / "b", m="".join(f"def f{i}(): pass\n" for i in range(3))), "code") == []


def test_external_modules_are_modules(spark, tmp_path):
    assert names(spark, tree(tmp_path / "pkg", m="import os\nimport sys\nimport re\nimport json\nimport math\n"), "architectural") == ["Hub-like Dependency", "Unstable Dependency"]


def test_cycle(spark, tmp_path):
    d = tmp_path / "pkg"
    a = analyze(spark, tree(d, a="import pkg.b\n", b="import pkg.c\n", c="import pkg.a\n"), PACKAGED, ("architectural",)).smells.where("name = 'Cyclic Dependency'").collect()
    assert [(r["severity"], r["description"]) for r in a] == [("high", "Strong cyclic dependency detected: pkg.a -> pkg.b -> pkg.c -> pkg.a\nCycle strength: 3 mutual dependencies")]
    b = analyze(spark, tree(tmp_path / "other" / "pkg", a="from . import b\n", b="from . import a\n"), PACKAGED, ("architectural",)).smells.where("name = 'Cyclic Dependency'").collect()
    assert b == []


def test_docstring_turns(spark, tmp_path):
    code = "".join(f"x = {i}\n" for i in range(300))
    assert names(spark, tree(tmp_path / "a", m='"""one line"""\n' + code), "structural") == []
    assert names(spark, tree(tmp_path / "b", m=code), "structural") == ["High Lines of Code (LOC)", "Long File"]


def test_counts_of_a_method():
    text = "class A:\n    def m(self):\n        if a:\n            pass\n" + "".join(f"        elif b{i}:\n            pass\n" for i in range(4))
    assert extract("/p/m.py", "/p", text.encode())["classes"][0]["methods"][0]["complexity"] == 10
    flat = "class A:\n    def m(self):\n" + "        if a:\n            pass\n" * 5
    assert extract("/p/m.py", "/p", flat.encode())["classes"][0]["methods"][0]["nesting"] == 5
    selfish = extract("/p/m.py", "/p", b"class A:\n    def m(self):\n        self.x = 1\n        self.f()\n")["classes"][0]["methods"][0]
    assert selfish["direct"] == ["self"] and selfish["indirect"] == ["self"]


def test_later_class_takes_the_place_of_an_earlier_one():
    got = extract("/p/m.py", "/p", b"class A:\n    def one(self): pass\nclass B: pass\nclass A:\n    pass\n")["classes"]
    assert [(k["name"], len(k["methods"])) for k in got] == [("m.A", 0), ("m.B", 0)]


@pytest.mark.parametrize(("content", "code", "other"), [(b"\xef\xbb\xbfx = 1\n", True, True), (b"  x = 1\n  y = 2\n", False, True), (b"def (:\n", True, True), (b"", False, False), (b"x = '\xff'\r\ny = 1\r", False, False), (b"x = '\x00'\n", True, True)])
def test_files_that_do_not_parse(content, code, other):
    row = extract("/p/m.py", "/p", content)
    assert (row["code_error"] is not None, row["error"] is not None) == (code, other)


def test_scan_sees_every_file(spark, tmp_path):
    path = tree(tmp_path, __init__="", _p="", **{".hidden__slash__x": "", "_d__slash__z": "x = 1\n"})
    (tmp_path / "note.txt").write_text("no")
    got = {r["path"][len(path) :]: bytes(r["content"]) for r in read_tree(spark, path).collect()}
    assert got == {"/__init__.py": b"", "/_p.py": b"", "/.hidden/x.py": b"", "/_d/z.py": b"x = 1\n"}
    assert [r["path"] for r in read_tree(spark, f"{path}/_d/z.py").collect()] == [f"{path}/_d/z.py"]


def test_scan_of_many_directories(spark, tmp_path, monkeypatch):
    """Beyond the directories that the driver lists, tasks do."""
    from plumbline.sources import pytree

    monkeypatch.setattr(pytree, "DRIVER_DIRECTORIES", 2)
    path = tree(tmp_path, **{f"{a}__slash__{b}__slash__m": f"x = '{a}{b}'\n" for a in "ab" for b in "cde"}, top="y = 1\n")
    parts = pytree.PyTreeReader(path).partitions()
    assert sum(p.below is not None for p in parts) > 1
    got = sorted(r[0][len(path) :] for p in parts for r in pytree.PyTreeReader(path).read(p))
    assert got == sorted(f"/{a}/{b}/m.py" for a in "ab" for b in "cde") + ["/top.py"]


def test_unreadable_files_are_errors(spark, tmp_path):
    path = tree(tmp_path / "src", ok="def f(" + ", ".join(f"p{i}" for i in range(7)) + "): pass\n", shut="x = 1\n", broken="def (:\n")
    (tmp_path / "src" / "gone.py").symlink_to(tmp_path / "nowhere.py")
    (tmp_path / "src" / "shut.py").chmod(0)
    a = analyze(spark, path, PACKAGED, ("code", "structural"))
    assert [r["name"] for r in a.smells.collect()] == ["Long Parameter List"]
    unreadable = {"gone.py"} | ({"shut.py"} if not os.access(f"{path}/shut.py", os.R_OK) else set())
    got = {(r["type"], r["file_path"].rsplit("/", 1)[1], r["error_type"]) for r in a.errors.collect()}
    assert got == {(t, n, "read error") for t in ("Code", "Structural") for n in unreadable} | {(t, "broken.py", "parse error") for t in ("Code", "Structural")}
    a.release()


def test_functions_of_very_many_parameters(spark, tmp_path):
    one, seven = ", ".join(f"p{i}" for i in range(60)), ", ".join(f"p{i}" for i in range(7))
    text = f"def wide({one}): pass\ndef other({seven}, q): pass\ndef third(a, b, c, d, e, f, g, h): pass\n"
    got = [r["description"] for r in analyze(spark, tree(tmp_path, m=text), PACKAGED, ("code",)).smells.where("name = 'Data Clumps'").collect()]
    sets = [list(x) for n in (6, 7) for x in itertools.combinations([f"p{i}" for i in range(7)], n)]
    assert sorted(got) == sorted(f"Parameters {', '.join(x)} appear together in functions: wide, other in {tmp_path}/m.py" for x in sets)


def test_data_clumps_against_all_subsets(spark):
    from plumbline.operators.code import data_clumps

    rng = random.Random(3)
    fns = {f"f{i}": sorted(rng.sample("abcdefghij", rng.randint(3, 8))) for i in range(9)}
    row = extract("/p/m.py", "/p", "".join(f"def {n}({', '.join(p)}): pass\n" for n, p in fns.items()).encode())
    facts = spark.createDataFrame([row], FACTS)
    t = load({"code_smells": {"DATA_CLUMPS_THRESHOLD": 3}})["code_smells"]
    want: dict = {}
    for n, p in fns.items():
        for size in range(3, len(p) + 1):
            for x in itertools.combinations(p, size):
                want.setdefault(x, []).append(n)
    got = {r["description"] for r in data_clumps(facts, t).collect()}
    assert got == {f"Parameters {', '.join(x)} appear together in functions: {', '.join(f)} in /p/m.py" for x, f in want.items() if len(f) > 1}


def test_line_rules(spark):
    """Classes of lines and what is counted of them, against a walk line by line."""
    from plumbline.operators.base import line_codes
    from plumbline.operators.code import comment_blocks
    from plumbline.operators.structural import line_counts

    rng = random.Random(4)
    kinds = ["# c", "", "import os", "from a import b", '"""doc', "'''", "code", 'x = """no turn', "imports"]
    texts = [[rng.choice(kinds) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    rows, wants = [], []
    for k, lines in enumerate(texts):
        rows.append((k, extract("/p/m.py", "/p", "\n".join(f"  {x} " for x in lines).encode())["lines"], lines))
        inside, n = False, dict.fromkeys(("total", "blank", "doc", "imports", "code"), 0)
        for x in lines:
            n["total"] += 1
            turn = x.startswith(('"""', "'''"))
            if not x:
                n["blank"] += 1
            elif turn or inside:
                n["doc"] += 1
            elif x.startswith(("import ", "from ")):
                n["imports"] += 1
            elif not x.startswith("#"):
                n["code"] += 1
            inside ^= turn
        runs = [(k, len(list(g))) for k, g in itertools.groupby(x.startswith("#") for x in lines)]
        runs = [size for i, (k, size) in enumerate(runs) if k and i]
        wants.append(n | {"code_lines": sum(bool(x) and not x.startswith(("#", '"""')) for x in lines), "comment_lines": sum(runs), "large_blocks": sum(r > 5 for r in runs), "same": True})
    df = spark.createDataFrame(rows, "k int, codes string, lines array<string>")
    told = [x.alias(k) for k, x in (line_counts(F.col("codes")) | comment_blocks(F.col("codes"))).items()]
    got = df.select("k", *told, (line_codes(F.col("lines")) == F.col("codes")).alias("same")).collect()
    assert [{k: v for k, v in r.asDict().items() if k != "k"} for r in sorted(got)] == wants


def test_deep_chains(spark):
    """Hierarchies and calls of any depth."""
    from plumbline.operators.structural import close_usage, inheritance_depth

    classes = spark.createDataFrame([(f"C{i}", [f"C{i - 1}"] if i else []) for i in range(130)], "name string, bases array<string>")
    d = {r["id"]: (r["depth"], len(r["path"])) for r in inheritance_depth(classes, load(EXTENDED)["structural_smells"]).collect()}
    assert d == {f"C{i}": (i + 1, i + 2) for i in range(130)}
    calls = spark.createDataFrame([("A", f"m{i}", f"m{i + 1}") for i in range(70)], "owner string, method string, callee string")
    usage = spark.createDataFrame([("A", "m70", "x")], "owner string, method string, field string")
    assert close_usage(usage, calls).count() == 71


def test_graphs_against_brute_force(spark):
    from plumbline.operators.graph import depths, strong_components

    rng = random.Random(5)
    for n, m in ((30, 36), (20, 45), (5, 0)):
        edges = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})
        ways = {}
        for i in range(n):
            start, front = f"n{i}", {f"n{i}": [f"n{i}"]}
            seen = dict(front)
            while front:
                step: dict = {}
                for s, path in front.items():
                    for a, b in edges:
                        if a == s and b not in seen:
                            step[b] = min(step.get(b, [*path, b]), [*path, b])
                seen |= step
                front = step
            ways[start] = seen
        df = spark.createDataFrame(edges, "src string, dst string")
        want = {a: min(b for b in ways if b in ways[a] and a in ways[b]) for a in ways if any(a in ways[b] and b in ways[a] and b != a for b in ways)}
        assert {r["id"]: r["part"] for r in strong_components(df).collect()} == want
        assert {r["id"]: r["path"] for r in depths(df, "n0").collect()} == ways["n0"]


def test_structural_reports_of_its_own(spark, tmp_path):
    from plumbline.plans.engine import analyze_structure
    from plumbline.sources.reports import console

    path = tree(tmp_path / "src", m="x = 1\n" * 300)
    smells = analyze_structure(spark, path, output=str(tmp_path / "own"))
    assert [r["name"] for r in json.loads((tmp_path / "own.json").read_text())] == ["High Lines of Code (LOC)", "Long File"]
    assert len(list(csv.reader((tmp_path / "own.csv").open()))) == 3
    assert [x.split("(")[0] for x in console(smells)] == ["StructuralSmell", "StructuralSmell"]


def test_empty_project(spark, tmp_path):
    with pytest.raises(AnalysisError):
        analyze(spark, str(tmp_path))


def test_reports(spark, tmp_path):
    path = tree(tmp_path / "src", f="def f(" + ", ".join(f"param{i}" for i in range(7)) + "): pass\n")
    smells = analyze_code(spark, path)
    write_reports(smells, str(tmp_path / "out.txt"))
    rows = list(csv.reader((tmp_path / "out.csv").open()))
    assert tuple(rows[0]) == HEADER and rows[1][1] == "Long Parameter List" and len(rows) == 2
    data = json.loads((tmp_path / "out.json").read_text())
    assert [d["name"] for d in data] == ["Long Parameter List"] and set(data[0]) == {"type", "name", "description", "file_path", "module_class", "line_number", "severity"}
    text = (tmp_path / "out.txt").read_text()
    assert "No structural smells detected." in text and "Total smells: 1" in text


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("code_smells:\n  LONG_METHOD_LINES:\n    value: 3\n    explanation: short\nother: {}\n")
    t = load(str(p))
    assert t["code_smells"]["LONG_METHOD_LINES"] == 3 and t["structural_smells"].get("MAX_FANIN") == 15
    with pytest.raises(KeyError):
        t["code_smells"]["LONG_PARAMETER_LIST"]
    assert any("NOM_THRESHOLD" in x for x in check(t)) and check(load(PACKAGED)) == []
    with pytest.raises(ValueError):
        load(3)


def test_stream_of_changes(spark, tmp_path):
    from plumbline.streaming.changes import code_smells

    src = tmp_path / "in"
    spark.createDataFrame([("/p/m.py", "/p", bytearray(b"def f(a, b, c, d, e, g): pass\n"))], "path string, root string, content binary").write.parquet(str(src))
    stream = spark.readStream.schema("path string, root string, content binary").parquet(str(src))
    q = code_smells(stream, str(tmp_path / "out"), str(tmp_path / "cp"), EXTENDED)
    q.processAllAvailable()
    q.stop()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Long Parameter List"]


def test_stream_and_batch_agree(spark, tmp_path):
    """A strict run ends a file's smells in both."""
    from plumbline.streaming.changes import code_smells

    text = b"@dataclass(frozen=True)\nclass D:\n    x: int\nclass Small:\n    pass\n"
    src = tmp_path / "in"
    spark.createDataFrame([("/p/m.py", "/p", bytearray(text))], "path string, root string, content binary").write.parquet(str(src))
    stream = spark.readStream.schema("path string, root string, content binary").parquet(str(src))
    for strict, want in ((True, []), (False, ["Lazy Class", "Lazy Class"])):
        q = code_smells(stream, str(tmp_path / f"out{strict}"), str(tmp_path / f"cp{strict}"), EXTENDED, strict)
        q.processAllAvailable()
        q.stop()
        assert [r["name"] for r in spark.read.parquet(str(tmp_path / f"out{strict}")).collect()] == want


def test_command_line(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    path = tree(tmp_path / "src", f="def f(" + ", ".join(f"param{i}" for i in range(7)) + "): pass\n")
    assert main([path, "--type", "code", "--output", str(tmp_path / "r"), "--log", str(tmp_path / "log")]) == 0
    out = capsys.readouterr().out
    assert "Long Parameter List" in out and "Code: 1 files analyzed, 0 errors, success rate 100.0%" in out
    assert {p.suffix for p in tmp_path.glob("r.*")} == {".txt", ".csv", ".json"} and (tmp_path / "log").exists()


def test_package_exports():
    import plumbline

    assert len(plumbline.DETECTORS) == 46 and plumbline.analyze is analyze
    with pytest.raises(AttributeError):
        plumbline.nothing
