"""Graphs of modules and classes: components, cycles, numbers of simple paths, depths. Edges are (src, dst), each once."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df with its lineage cut at a checkpoint in the shared folder that spark.checkpoint.dir names. Where none is set a temporary one does in local
    mode; on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def cycles(edges: DataFrame, least: int, most: int) -> DataFrame:
    """Simple cycles of least to most nodes, each once, from its least node on: rows (nodes). Paths grow from their least node by joins, most - 1 of them."""
    e = edges.where("src <> dst").distinct()
    step = e.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    paths = e.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"))
    out = None
    for n in range(2, most + 1):
        closed = paths.join(e, (paths["last"] == e["src"]) & (paths["first"] == e["dst"])).select("nodes")
        if n >= least:
            out = closed if out is None else out.unionByName(closed)
        if n < most:
            grown = paths.join(step, paths["last"] == step["at"]).where((F.col("to") > F.col("first")) & ~F.array_contains("nodes", F.col("to")))
            paths = grown.select("first", F.col("to").alias("last"), F.concat("nodes", F.array("to")).alias("nodes"))
    if least <= 1:
        loops = edges.where("src = dst").distinct().select(F.array("src").alias("nodes"))
        out = loops if out is None else out.unionByName(loops)
    return out if out is not None else e.select(F.array("src").alias("nodes")).limit(0)


def count_simple_paths(neighbours: dict[str, list[str]], start: str, end: str) -> int:
    """The number of simple paths from start to end; none from a node to itself."""
    if start == end:
        return 0
    n, path, seen = 0, [iter(neighbours.get(start, ()))], [start]
    on = {start}
    while path:
        for x in path[-1]:
            if x == end:
                n += 1
            elif x not in on:
                on.add(x)
                seen.append(x)
                path.append(iter(neighbours.get(x, ())))
                break
        else:
            path.pop()
            on.discard(seen.pop())
    return n


def inner_edges(edges: DataFrame) -> DataFrame:
    """Rows (part, src, dst): the edges that lie on cycles of two nodes or more, by their strongly connected component."""
    parts = strong_components(edges)
    src, dst = parts.select(F.col("id").alias("src"), "part"), parts.select(F.col("id").alias("dst"), F.col("part").alias("other"))
    return settle(edges.where("src <> dst").distinct().join(src, "src").join(dst, "dst").where("part = other").select("part", "src", "dst"))


def path_counts(inner: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (src, dst, n): how many simple paths lead from src to dst, for the edges wanted. inner: the edges on cycles, by component (see inner_edges).

    A path from src to dst, closed by the way back, never leaves their strongly connected component; so each component is counted on its own, as a
    group. The number of paths may be exponential in the component's size: that is the measure's definition."""
    asked = wanted.distinct().join(inner, ["src", "dst"]).select("part", "src", "dst", F.lit(True).alias("asked"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        neighbours: dict[str, list[str]] = {}
        for s, d in group.loc[~group["asked"], ["src", "dst"]].itertuples(index=False):
            neighbours.setdefault(s, []).append(d)
        rows = [(s, d, count_simple_paths(neighbours, s, d)) for s, d in group.loc[group["asked"], ["src", "dst"]].itertuples(index=False)]
        return pd.DataFrame(rows, columns=["src", "dst", "n"])

    return inner.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("part").applyInPandas(count, "src string, dst string, n long")


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges without those whose start nothing leads to or whose end leads nowhere, until none of them is left: they lie on no cycle. Two steps a round."""
    before = -1
    while True:
        for _ in range(2):
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = settle(e.select("src", "dst"))
        n = e.count()
        if n in (0, before):
            return e
        before = n


def _colours(edges: DataFrame) -> DataFrame:
    """Rows (id, ahead, behind): the least hash of a node that reaches a node, and the least of one that it reaches (itself included). Colours pass
    along the edges, and by way of the node that a colour names, so far ones take few rounds."""
    hashed = lambda x: F.xxhash64(x)
    links = edges.select(hashed("src").alias("u"), hashed("dst").alias("v"))
    nodes = links.select(F.col("u").alias("n")).unionByName(links.select(F.col("v").alias("n"))).distinct()
    now, before = settle(nodes.select("n", F.col("n").alias("ahead"), F.col("n").alias("behind"))), None
    none = F.lit(None).cast("long")
    while True:
        passed = links.join(now, links["u"] == now["n"]).select(F.col("v").alias("n"), "ahead", none.alias("behind"))
        passed = passed.unionByName(links.join(now, links["v"] == now["n"]).select(F.col("u").alias("n"), none.alias("ahead"), "behind"))
        far = now.select(F.col("n").alias("at"), F.col("ahead").alias("a"), F.col("behind").alias("b"))
        passed = passed.unionByName(now.join(far, now["ahead"] == far["at"]).select("n", F.col("a").alias("ahead"), none.alias("behind")))
        passed = passed.unionByName(now.join(far, now["behind"] == far["at"]).select("n", none.alias("ahead"), F.col("b").alias("behind")))
        now = settle(passed.unionByName(now).groupBy("n").agg(F.min("ahead").alias("ahead"), F.min("behind").alias("behind")))
        told = now.agg(F.sum(F.xxhash64("n", "ahead", "behind").cast("decimal(38,0)"))).first()
        if told == before:
            return now
        before = told


def strong_components(edges: DataFrame) -> DataFrame:
    """Rows (id, part) of nodes on cycles; part is the least node of the strongly connected component.

    Forward and backward colours: a node whose first ancestor by hash is also the first node that it reaches is in that node's component. Nodes of a
    component have both colours in common, so the others go on with the edges between nodes of the same colours, until there are none."""
    e, found = _trimmed(edges.where("src <> dst").select("src", "dst").distinct()), None
    while not e.isEmpty():
        colour = _colours(e)
        of = lambda x: colour.select(F.col("n").alias(f"{x}_n"), F.col("ahead").alias(f"{x}_a"), F.col("behind").alias(f"{x}_b"))
        same = e.join(of("u"), F.xxhash64("src") == F.col("u_n")).join(of("v"), F.xxhash64("dst") == F.col("v_n")).where("u_a = v_a and u_b = v_b")
        same = settle(same.select("src", "dst", F.col("u_a").alias("colour"), (F.col("u_a") == F.col("u_b")).alias("done")))
        done = same.where("done").select("colour", F.explode(F.array("src", "dst")).alias("id")).distinct()
        found = done if found is None else found.unionByName(done)
        e = _trimmed(same.where("not done").select("src", "dst"))
    if found is None:
        return e.select(F.col("src").alias("id"), F.col("dst").alias("part"))
    return found.join(found.groupBy("colour").agg(F.min("id").alias("part")), "colour").select("id", "part")


def depths(edges: DataFrame, root: str) -> DataFrame:
    """Rows (id, depth, path): the shortest way from root, the first in order among equals; nodes out of reach are left out.

    Ways from an ancestor double in length each round (so a hierarchy of depth d takes log d rounds), until none is new or shorter; of the ways
    between two nodes one is kept."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ways = settle(e.select("src", "dst", F.struct(F.lit(1).alias("depth"), F.array("src", "dst").alias("path")).alias("way")))
    before = None
    while True:
        told = ways.agg(F.count("*"), F.sum("way.depth"), F.sum(F.xxhash64("src", "dst", "way").cast("decimal(38,0)"))).first()
        if told == before:
            break
        before = told
        on = ways.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("way").alias("more"))
        path = F.concat("way.path", F.slice("more.path", F.lit(2), F.size("more.path")))
        longer = ways.join(on, ways["dst"] == on["mid"]).where("src <> to").select("src", F.col("to").alias("dst"), F.struct((F.col("way.depth") + F.col("more.depth")).alias("depth"), path.alias("path")).alias("way"))
        ways = settle(ways.unionByName(longer).groupBy("src", "dst").agg(F.min("way").alias("way")))
    start = edges.sparkSession.createDataFrame([(root, 0, [root])], "id string, depth int, path array<string>")
    return start.unionByName(ways.where(F.col("src") == root).select(F.col("dst").alias("id"), "way.depth", "way.path"))
