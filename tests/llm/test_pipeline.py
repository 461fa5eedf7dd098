"""The pipeline stage by stage against brute force, on tables with planted cases."""

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import quality_model

from .test_operators import WORD, encoded, groups, prose, removed_lines, smith_waterman


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    clean = [f"{a}\n{b}" for a, b in zip(prose(rng, 120), prose(rng, 120))]
    junk = [" | ".join(x.split()) + " ### $$$" for x in prose(rng, 40)]
    items = [" ".join(x.split()[:30]) for x in prose(rng, 4, 900)]
    items = [x for x in items if len(x.split()) >= 15]
    leaks = [f"{x}\n{y}" for x, y in zip(prose(rng, len(items)), items)]

    def edited(t):
        w = t.split(" ")
        w[len(w) // 3], w[-2] = "swapped", "words"
        return " ".join(w)

    near = [edited(edited(t)) for t in clean[:10]]
    texts = [*clean, *junk, *leaks, *clean[20:25], *near, None, ""]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def stage(n):
    return corpus_pipeline.STAGES[n][1]


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, tables, tmp_path):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for n in range(4):
        before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: x[0])
        stage(n)(spark, docs, d).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        assert out.columns == columns
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if n == 0:
            model = quality_model.train(docs, spark.read.parquet(f"{d}/labels.parquet"), may_learn=None)
            assert model is not None and all(i in got for i in range(120)) and sum(i in got for i in range(120, 160)) <= 2
            assert all(got[i] == t for i, t in before if i in got)
        elif n == 1:
            gone = removed_lines(before)
            want = {}
            for i, t in before:
                left = None if t is None else [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
                if not gone[i] or any(WORD.search(x) for x in left):
                    want[i] = t if not gone[i] else "\n".join(left)
            assert got == want
        elif n == 2:
            g = groups([i for i, _ in before], [t for _, t in before], 5, 80)
            assert set(got) == {i for i, _ in before if g[i][1] == i}
        else:
            copies = set()
            for i, t in before:
                w = np.array([hash(x) for x in (t or "").split()])
                for x in items:
                    own = np.array([hash(y) for y in x.split()])
                    if len(w) and smith_waterman(own, w) >= len(own):
                        copies.add(i)
            assert set(got) == {i for i, _ in before} - copies and copies
        docs = out


def test_cut_lines_keeps_what_has_words_left(spark):
    notice = "this line is boilerplate on every page"
    texts = [notice, f"a short verse\nof few words\n{notice}\nends here", f"\n{notice}\n \t\n", f"日本語の文\n{notice}", notice]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_lines(spark, docs, "").collect()}
    left = {0: texts[0], 1: "a short verse\nof few words\nends here", 3: "日本語の文"}
    assert got == {i: (t, len(t)) for i, t in left.items()}


def test_one_row_of_each_group(spark):
    a, b, c = ("one two three four five six seven " + x for x in ("alpha beta", "x y z w v u t s r q p o", "k l m n o i j h g f e d c b a"))
    texts = [(1, a), (1, a), (2, a), (None, a), (None, a), (2, b), (None, b), (None, c), (None, c), (3, None), (3, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, a, "s0"), (2, b, "s5"), (None, c, "s7"), (3, None, "s9"), (3, None, "s10"), (None, "", "s11"), (None, "", "s12")], key=repr)


def test_run(spark, tables):
    d, _ = tables
    out = corpus_pipeline.run(spark, d).collect()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out[0].asDict())
    assert len(corpus_pipeline.STAGES) == 5 and max(r["offset"] + r["length"] for r in out) <= 1024
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    whole = {r["doc_id"] for r in out}
    assert whole <= set(docs) and {30, 40, 50} <= whole
    ids = encoded(corpus_pipeline._tokenizer(), [docs[30]], 2)[0]
    assert sum(r["length"] for r in out if r["doc_id"] == 30) == len(ids)
