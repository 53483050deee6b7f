"""Graphs as tables of edges (u, v) and vertices (node), within ``keys`` that tell graphs apart.

Rounds are materialised in the shared folder; their number grows with the logarithm of the longest
path. A vertex with very many edges is never gathered: every step is an aggregate that combines on the
map side, or a join with one row per vertex. What is left of a graph once it has at most ``IN_TASK`` edges is
finished by one task; larger graphs go on in rounds, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtree.session import materialize, release

#: Edges that one task takes: some 50 MB.
IN_TASK = 500_000


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _graphs(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """A number for the graph of each row."""
    return pdf.groupby(list(keys), dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), int)


def _stars(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u, v): each node u of a component with its smallest node v < u, found in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        graph = np.r_[_graphs(pdf, keys), _graphs(pdf, keys)]
        node = np.r_[pdf["u"].to_numpy(), pdf["v"].to_numpy()]
        order = np.lexsort((node, graph))
        new = np.r_[True, (graph[order][1:] != graph[order][:-1]) | (node[order][1:] != node[order][:-1])]
        place = np.empty(len(node), np.int64)
        place[order] = np.cumsum(new) - 1
        a, b = place[: len(pdf)], place[len(pdf) :]
        root = np.arange(int(new.sum()))
        while (apart := root[a] != root[b]).any():
            low, high = np.minimum(root[a], root[b])[apart], np.maximum(root[a], root[b])[apart]
            np.minimum.at(root, high, low)
            while not np.array_equal(root, above := root[root]):
                root = above
        first = order[new]  # a row for each node, smallest first within its graph
        out = pdf[list(keys)].iloc[first % len(pdf)].reset_index(drop=True)
        out["u"], out["v"] = node[first], node[first][root]
        yield out[out["u"] != out["v"]]

    return links.coalesce(1).mapInPandas(run, _schema(links))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), in_task: int = IN_TASK) -> DataFrame:
    """keys, node, component: the smallest node that each node is connected to. Alternating star
    contractions (Kiveris et al., SoCC 2014)."""
    k = list(keys)
    links = materialize(edges.where("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        if links.count() <= in_task:
            links = _stars(links, keys)
            break
        both = links.unionByName(links.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*k, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # every larger neighbour is hung on the smallest of the neighbourhood
        large = both.join(least, [*k, "u"]).where("v > u").select(*k, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # then every smaller one, and the node itself
        low = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        hung = large.join(low, [*k, "u"])
        small = hung.select(*k, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*k, "u", F.col("m").alias("v")))
        following = materialize(small.where("u <> v").distinct())
        state = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()
        release(links)
        links = following
        if state == last:
            break
        last = state
    found = links.groupBy(*k, "u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.select(*k, "node").distinct().join(found, [*k, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def degrees(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, degree: how many ends of edges each vertex has."""
    ends = edges.select(*keys, F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, to, edge: the adjacency of an undirected graph with rows instead of lists."""
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("to"), "edge").unionByName(edges.select(*keys, F.col("v").alias("node"), F.col("u").alias("to"), "edge"))


def distinct_edges(edges: DataFrame, keys: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """One edge (u, v) each, the first or last by ``edge``."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in edges.columns if c not in (*keys, "u", "v")]
    found = edges.groupBy(*keys, "u", "v").agg(pick(F.struct(*rest), "edge").alias("r"))
    return found.select(*keys, "u", "v", "r.*")


def _lightest(live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kruskal's choice among edges between components cu and cv, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        pdf["_g"] = _graphs(pdf, keys)
        pdf = pdf.sort_values(["_g", "w", "edge"], ignore_index=True)
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def top(n: tuple[int, int]) -> tuple[int, int]:
            while (up := root.get(n, n)) != n:
                root[n] = root.get(up, up)
                n = up
            return n

        keep = np.zeros(len(pdf), bool)
        for i, (g, a, b) in enumerate(zip(pdf["_g"].tolist(), pdf["cu"].tolist(), pdf["cv"].tolist(), strict=True)):
            a, b = top((g, a)), top((g, b))
            if a != b:
                root[a] = b
                keep[i] = True
        yield pdf[keep].drop(columns="_g")

    return live.coalesce(1).mapInPandas(run, _schema(live))


def minimum_spanning_forest(edges: DataFrame, keys: Sequence[str] = (), in_task: int = IN_TASK) -> DataFrame:
    """The edges (u, v, w, edge) of the minimum spanning forest, equal weights by smaller ``edge``;
    Borůvka's rounds, each of which at least halves the trees."""
    k = list(keys)
    every = materialize(edges.where("u <> v").select(*k, "u", "v", "w", "edge"))
    live = every.select("*", F.col("u").alias("cu"), F.col("v").alias("cv"))
    chosen = None
    while left := live.count():
        if left <= in_task:
            new = _lightest(live, keys).select(*k, "u", "v", "w", "edge")
            chosen = new if chosen is None else chosen.unionByName(new)
            break
        out = live.select(*k, F.col("cu").alias("c"), "w", "edge").unionByName(live.select(*k, F.col("cv").alias("c"), "w", "edge"))
        best = out.groupBy(*k, "c").agg(F.min(F.struct("w", "edge")).alias("b")).select(*k, F.col("b.edge").alias("edge")).distinct()
        picked = materialize(live.join(best, [*k, "edge"], "left_semi"))
        new = picked.select(*k, "u", "v", "w", "edge")
        chosen = new if chosen is None else chosen.unionByName(new)
        ends = live.select(*k, F.explode(F.array("cu", "cv")).alias("node"))
        joined = materialize(connected_components(ends, picked.select(*k, F.col("cu").alias("u"), F.col("cv").alias("v")), keys, in_task))
        a = joined.select(*k, F.col("node").alias("cu"), F.col("component").alias("a"))
        b = joined.select(*k, F.col("node").alias("cv"), F.col("component").alias("b"))
        following = live.join(a, [*k, "cu"]).join(b, [*k, "cv"]).where("a <> b").select(*k, "u", "v", "w", "edge", F.col("a").alias("cu"), F.col("b").alias("cv"))
        live = materialize(following)
    return every.limit(0) if chosen is None else chosen.dropDuplicates([*k, "edge"])


def cheapest_hooks(edges: DataFrame) -> DataFrame:
    """Of connections (edge, src, dst, mode, info0, cost) between chains: of two hooks in opposite directions
    the cheaper stays, then of the hooks of one chain end the cheapest; the later of equally cheap ones."""
    order = (F.col("cost").asc(), F.col("edge").desc())
    hooks, others = edges.where("mode = 'HL'"), edges.where("mode <> 'HL'")
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    single = hooks.withColumn("_r", F.row_number().over(pair.orderBy(*order))).where("_r = 1").drop("_r")
    ends = single.withColumn("_r", F.row_number().over(Window.partitionBy("src", "info0").orderBy(*order))).where("_r = 1").drop("_r")
    return ends.unionByName(others)
