"""Skeleton forests as tables (neuron_id, node_id, node_type, x, y, z, radius, parent_id).

Relational where the result does not depend on an order of visits; passes that rewrite a tree while
walking it run on one tree at a time (``per_tree``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtree.functions.geometry import distance, vector
from voxtree.kernels import forest
from voxtree.operators.hierarchy import hierarchy
from voxtree.plans.prefix import grouped_prefix_sum
from voxtree.session import materialize

KEY = ["neuron_id", "node_id"]
_TYPES = "neuron_id bigint, node_id int, node_type int, x double, y double, z double, radius double, parent_id int"


def current_nodes(rows: DataFrame) -> DataFrame:
    """The latest row of every node; rows without an id are no nodes."""
    rest = ["parent_id", "node_type", "x", "y", "z", "radius"]
    last = rows.where("neuron_id is not null and node_id is not null").groupBy(*KEY).agg(F.max(F.struct("loaded_at", *rest)).alias("r"))
    return last.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in rest])


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is null or not a node of the neuron."""
    ids = nodes.select("neuron_id", F.col("node_id").alias("parent_id"))
    return nodes.join(ids, ["neuron_id", "parent_id"], "left_anti").select(*nodes.columns)


def somata(nodes: DataFrame, strict: bool = False, multiple: bool = True) -> DataFrame:
    """The nodes a neuron is taken to begin at: its roots, or, if ``strict``, the nodes of type 1 marked as roots (parent
    -1), of a neuron without these all that are so marked. Without ``multiple`` only the one with the smallest id."""
    found = roots(nodes)
    if strict:
        found = nodes.where("parent_id = -1")
        typed = found.where("node_type = 1")
        found = typed.unionByName(found.join(typed.select("neuron_id"), "neuron_id", "left_anti").select(*nodes.columns))
    if multiple:
        return found
    first = found.groupBy("neuron_id").agg(F.min("node_id").alias("node_id"))
    return found.join(first, KEY, "left_semi").select(*nodes.columns)


def lengths_from(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """neuron_id, node_id, length: of each given (neuron_id, node_id) the length of all links of its tree that a walk
    down from the root, children by id, meets from this node on. A node on or below a cycle has none, one that is not
    there no row."""
    walk = hierarchy(nodes.select(*KEY, "parent_id", F.lit(None).cast("timestamp").alias("loaded_at"))).where("root_id is not null")
    step = with_parent(nodes).select(*KEY, distance(vector(""), vector("q")).alias("step"))
    links = materialize(walk.select(*KEY, "root_id", "lft").join(step, KEY, "left").withColumn("step", F.coalesce("step", F.lit(0.0))))
    asked = links.join(starts.select(*KEY).distinct(), KEY, "left_semi").select("neuron_id", "node_id", "root_id", F.col("lft").alias("_from"))
    # sums of the links up to each node, so that no start is compared with all nodes behind it
    before = grouped_prefix_sum(links, ["neuron_id", "root_id"], ["lft"], "step", "earlier").select(*KEY, (F.col("earlier") + F.col("step")).alias("_upto"))
    whole = links.groupBy("neuron_id", "root_id").agg(F.sum("step").alias("_all"))
    return asked.join(before, KEY).join(whole, ["neuron_id", "root_id"]).select(*KEY, (F.col("_all") - F.col("_upto")).alias("length"))


def tips(nodes: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    parents = nodes.select("neuron_id", F.col("parent_id").alias("node_id")).where("node_id is not null")
    return nodes.join(parents, KEY, "left_anti").select(*nodes.columns)


def child_counts(nodes: DataFrame) -> DataFrame:
    """neuron_id, node_id, n_children of nodes with children."""
    return nodes.where("parent_id is not null").groupBy("neuron_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))


def bifurcations(nodes: DataFrame) -> DataFrame:
    """Nodes with two or more children."""
    return nodes.join(child_counts(nodes).where("n_children > 1").select(*KEY), KEY, "left_semi").select(*nodes.columns)


def with_parent(nodes: DataFrame) -> DataFrame:
    """Nodes that have a parent, with its position as qx, qy, qz."""
    up = nodes.select("neuron_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    return nodes.join(up, ["neuron_id", "parent_id"])


def cable_lengths(nodes: DataFrame) -> DataFrame:
    """neuron_id, n_links and the length of all links."""
    step = distance(vector(""), vector("q"))
    return with_parent(nodes).where("node_id <> parent_id").groupBy("neuron_id").agg(F.count(F.lit(1)).alias("n_links"), F.sum(step).alias("cable"))


def root_labels(rows: DataFrame) -> DataFrame:
    """neuron_id, node_id, root_id, depth from stored rows; null on and below cycles."""
    return hierarchy(rows).select(*KEY, "root_id", "depth")


def remove_spurs(nodes: DataFrame) -> DataFrame:
    """Without the tips that hang on a bifurcation, and without single nodes; one pass."""
    forks = child_counts(nodes).where("n_children > 1").select("neuron_id", F.col("node_id").alias("parent_id"))
    ends = tips(nodes)
    spurs = ends.join(forks, ["neuron_id", "parent_id"], "left_semi").select(*KEY).unionByName(roots(ends_as_roots(ends, nodes)).select(*KEY))
    return nodes.join(spurs.distinct(), KEY, "left_anti").select(*nodes.columns)


def ends_as_roots(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``ends`` that are roots of ``nodes``."""
    return ends.join(roots(nodes).select(*KEY), KEY, "left_semi").select(*nodes.columns)


def with_tree(nodes: DataFrame) -> DataFrame:
    """``nodes`` with tree_id: their root, or the smallest node of the cycle above them."""
    labels = hierarchy(nodes.select(*KEY, "parent_id", F.lit(None).cast("timestamp").alias("loaded_at")))
    return nodes.join(labels.select(*KEY, F.coalesce("root_id", "cycle_id").alias("tree_id")), KEY)


def _by_tree(nodes: DataFrame, function: Callable[[int, forest.Forest], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``function`` gives for each tree, children in the order of node ids. Trees don't touch each other, so a
    neuron with very many nodes is as many groups as it has roots; many trees share a task and an Arrow batch."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.strip().split(" ")[1]] for f in schema.split(",")]
    columns = ("node_id", "node_type", "x", "y", "z", "radius", "parent_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            neuron, tree = (table[c].to_numpy() for c in ("neuron_id", "tree_id"))
            edges = np.flatnonzero(np.r_[True, (neuron[1:] != neuron[:-1]) | (tree[1:] != tree[:-1]), True])
            ids, kinds, parents = (table[c].fill_null(d).to_numpy() for c, d in (("node_id", 0), ("node_type", 0), ("parent_id", -1)))
            at, radius = np.column_stack([table[c].fill_null(np.nan).to_numpy() for c in "xyz"]).astype(float), table["radius"].fill_null(np.nan).to_numpy()
            out: list[tuple] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                f = forest.Forest.of(ids[a:b].tolist(), kinds[a:b].tolist(), at[a:b], radius[a:b].tolist(), parents[a:b].tolist())
                out += function(int(neuron[a]), f)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = [table[c].to_numpy() for c in ("neuron_id", "tree_id")]
            # rows of a tree are together; the last tree may go on
            whole = len(last[0]) - int(np.argmax(np.r_[(last[0][::-1] != last[0][-1]) | (last[1][::-1] != last[1][-1]), True]))
            if whole:
                yield from solved(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held))

    key = ("neuron_id", "tree_id")
    rows = with_tree(nodes).select(*key, *columns)
    return rows.repartition(*key).sortWithinPartitions(*key, "node_id").mapInArrow(run, schema)


def per_tree(nodes: DataFrame, function: Callable[[forest.Forest], forest.Forest]) -> DataFrame:
    """A rewriting pass on each tree."""
    return _by_tree(nodes, lambda neuron, f: ((neuron, *row) for row in function(f).records()), _TYPES)


def remove_zigzags(nodes: DataFrame) -> DataFrame:
    return per_tree(nodes, forest.remove_zigzags)


def tune_branches(nodes: DataFrame) -> DataFrame:
    return per_tree(nodes, forest.tune_branches)


def merge_close(nodes: DataFrame, threshold: float = 0.01) -> DataFrame:
    return per_tree(nodes, lambda f: forest.merge_close(f, threshold))


def remove_overshoots(nodes: DataFrame) -> DataFrame:
    return per_tree(nodes, forest.remove_overshoots)


def downsample(nodes: DataFrame) -> DataFrame:
    return per_tree(nodes, forest.downsample)


def trunk_lengths(nodes: DataFrame) -> DataFrame:
    """neuron_id, root_id, trunk: the geodesic of the pair of ends with the largest mix of geodesic and
    straight distance. A tree's cycle, if it has one, is opened at its smallest node."""

    return _by_tree(nodes, lambda neuron, f: [(neuron, r, forest.trunk_length(f, r)) for r in f.roots()], "neuron_id bigint, root_id int, trunk double")


def remove_short_trees(nodes: DataFrame, least: int = 10) -> DataFrame:
    """Of neurons with at least ``least`` trees, the trees whose trunk is not shorter than the neuron's mean."""
    trunks = trunk_lengths(nodes).withColumnRenamed("root_id", "tree_id")
    facts = trunks.groupBy("neuron_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("trunk").alias("_mean"))
    short = trunks.join(facts, "neuron_id").where((F.col("_n") >= least) & (F.col("trunk") < F.col("_mean"))).select("neuron_id", "tree_id")
    return with_tree(nodes).join(short, ["neuron_id", "tree_id"], "left_anti").select(*nodes.columns)


def postprocess(nodes: DataFrame) -> DataFrame:
    """All passes in their order."""
    return remove_short_trees(materialize(per_tree(nodes, forest.rewrite)))  # three plans read it
