"""Hashing of words and shingles, components."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import core
from plumbline.llm.core import PIECE, Words, components, shingles

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab .\n\té　", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)] == flat
    by_hash: dict = {}
    for h, x in zip(w.hashes.tolist(), flat):
        assert by_hash.setdefault(h, x) == x
    assert len(set(flat)) == len(by_hash)


@given(TEXTS, st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_shingles(texts, k):
    w = Words(pa.array(texts, pa.string()))
    g, b = shingles(w.hashes, w.bounds, k)
    seen: dict = {}
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        want = [tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)] if len(ws) >= k else [tuple(ws)] if ws else []
        got = g[b[i] : b[i + 1]].tolist()
        assert len(got) == len(want)
        for x, y in zip(got, want):
            assert seen.setdefault(x, y) == y


def test_long_texts_cross_pieces():
    text = "word " * (PIECE // 4) + "x" * (PIECE + 7) + " word"
    w = Words(pa.array(["word", text]))
    assert w.hashes[0] == w.hashes[1] == w.hashes[-1] and w.counts().tolist() == [1, PIECE // 4 + 2]


def test_case():
    w = Words(pa.array(["AbC É abc"]), lower=True)
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]


def test_sliced_and_large_arrays():
    a = pa.array(["x", "a b", None, "c"]).slice(1, 2)
    assert Words(a).counts().tolist() == [2, 0]
    assert Words(pa.array(["a b"], pa.large_string())).counts().tolist() == [2]
    assert Words(pa.array([], pa.string())).counts().tolist() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, None)], [(i, i + 1) for i in range(20)], [(0, i) for i in range(1, 40)], [(5, 9), (9, -3), (7, 8), (8, 7), (5, 9)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want: dict = {}
    for u, v in edges:
        if u is None or v is None or u == v:
            continue
        group = {x for x in want if want[x] in (want.get(u), want.get(v)) and want[x] is not None} | {u, v}
        for x in group:
            want[x] = min(group)
    assert got == want


def test_random_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2)) if a != b]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1), (1, None)], [(i, i + 1) for i in range(12)], [(2**62, -(2**62)), (5, 2**62), (7, 8)], np.random.default_rng(4).integers(-60, 60, (50, 2)).tolist()])
def test_rounds_of_joins_and_the_driver_agree(spark, monkeypatch, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    own = sorted(map(tuple, components(df).collect()))
    monkeypatch.setattr(core, "DRIVER_EDGES", -1)
    assert sorted(map(tuple, components(df).collect())) == own


def test_least_reachable_of_many_edges():
    rng = np.random.default_rng(6)
    order = rng.permutation(200_000)
    u, v = order[:-1], order[1:]
    cut = np.arange(len(u)) % 1000 != 999  # paths of 1000 nodes, dealt at random
    node, least = core.least_reachable(u[cut], v[cut])
    want = np.repeat(order.reshape(-1, 1000).min(axis=1), 1000)
    assert np.array_equal(node, np.arange(200_000)) and np.array_equal(least[order], want)
