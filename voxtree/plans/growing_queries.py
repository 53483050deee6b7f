"""Queries on volumes, graphs and trees whose size follows the tables, through the plans for what no task holds.

The limits up to which one task finishes a graph or a tree are set low here, so that rounds and pointer doubling
run at every size. The graphs are built so that plain SQL can state the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtree.operators import voxels
from voxtree.operators.graphs import connected_components, minimum_spanning_forest
from voxtree.operators.hierarchy import hierarchy
from voxtree.plans.tables import table

#: Edges and rows that one task may hold in these queries.
IN_TASK = 1000


def _keys(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "orders").select(F.col("o_orderkey").alias("k"))


def chain_components(spark: SparkSession, path: str) -> DataFrame:
    """Orders in chains of a hundred; every order's component."""
    nodes = _keys(spark, path).select(F.col("k").alias("node"))
    edges = nodes.where("node % 100 <> 0").select(F.col("node").alias("u"), (F.col("node") - 1).alias("v"))
    return connected_components(nodes, edges, in_task=IN_TASK)


def ladder_mst(spark: SparkSession, path: str) -> DataFrame:
    """A light tree over all orders, each below the one of a third of its key, among heavier rungs; its spanning tree."""
    k = F.col("k")
    tree = _keys(spark, path).where("k > 0").select(F.floor(k / 3).alias("u"), k.alias("v"), k.alias("w"), (2 * k).alias("edge"))
    rungs = _keys(spark, path).where("k > 0").select((k - 1).alias("u"), k.alias("v"), (k + 10**9).alias("w"), (2 * k + 1).alias("edge"))
    return minimum_spanning_forest(tree.unionByName(rungs), in_task=IN_TASK).select("u", "v", "w")


def chain_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """All orders as one forest of chains of a hundred, the last of every ten chains bent into a cycle; the whole hierarchy by
    pointer doubling."""
    k = F.col("k")
    bent = (F.floor(k / 100) % 10 == 9) & (k % 100 == 0)
    nodes = _keys(spark, path).select(
        F.lit(1).cast("bigint").alias("neuron_id"), (k + 1).cast("int").alias("node_id"), F.when(k % 100 != 0, k).when(bent, k + 100).cast("int").alias("parent_id"), F.lit(None).cast("timestamp").alias("loaded_at")
    )
    return hierarchy(nodes, block_rows=IN_TASK).drop("neuron_id")


def deep_local_max_26(spark: SparkSession, path: str) -> DataFrame:
    """Local maxima of a volume with a slice for every hundred orders."""
    z, y, x = F.floor(F.col("l_orderkey") / 100).cast("int"), (F.col("l_suppkey") % 32).cast("int"), (F.col("l_partkey") % 32).cast("int")
    cells = table(spark, path, "lineitem").groupBy(z.alias("z"), y.alias("y"), x.alias("x")).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    depth = table(spark, path, "lineitem").agg(F.max(z)).first()[0] or 0
    grid = spark.range((depth + 1) * 1024).select(F.floor(F.col("id") / 1024).cast("int").alias("z"), (F.floor(F.col("id") / 32) % 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"))
    return voxels.local_maxima(grid.join(cells, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).alias("v")))


_CHAIN = "c AS (SELECT o_orderkey AS k, (o_orderkey // 100) * 100 AS top, (SELECT max(o_orderkey) FROM orders) AS most FROM orders), d AS (SELECT *, least(top + 99, most) AS low, (top // 100) % 10 = 9 AND top + 99 <= most AS bent FROM c)"
_DEEP = """cells AS (SELECT l_orderkey // 100 AS z, l_suppkey % 32 AS y, l_partkey % 32 AS x, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"""
_OFFSETS = "(VALUES (-1),(0),(1)) i(dz), (VALUES (-1),(0),(1)) j(dy), (VALUES (-1),(0),(1)) k(dx)"

QUERIES = {f.__name__: f for f in (chain_components, ladder_mst, chain_hierarchy, deep_local_max_26)}
ORACLES = {
    "chain_components": "SELECT o_orderkey AS node, o_orderkey - o_orderkey % 100 AS component FROM orders",
    "ladder_mst": "SELECT o_orderkey // 3 AS u, o_orderkey AS v, o_orderkey AS w FROM orders WHERE o_orderkey > 0",
    "chain_hierarchy": f"""WITH {_CHAIN}, s AS (SELECT *, CAST(sum(CASE WHEN bent THEN 0 ELSE 1 END) OVER (ORDER BY k) AS BIGINT) AS lft FROM d)
SELECT CAST(k + 1 AS INTEGER) AS node_id, CAST(CASE WHEN k > top THEN k WHEN bent THEN top + 100 END AS INTEGER) AS parent_id, CAST(CASE WHEN NOT bent THEN top + 1 END AS INTEGER) AS root_id, CAST(CASE WHEN NOT bent THEN k - top END AS INTEGER) AS depth,
  CASE WHEN NOT bent THEN lft END AS lft, CASE WHEN NOT bent THEN lft + low - k END AS rgt, CASE WHEN NOT bent THEN low - k END AS n_descendants, CAST(CASE WHEN bent THEN top + 1 END AS INTEGER) AS cycle_id FROM s""",
    "deep_local_max_26": f"""WITH {_DEEP}, near AS (SELECT c.z + dz AS z, c.y + dy AS y, c.x + dx AS x, max(CASE WHEN (dz, dy, dx) < (0, 0, 0) THEN v END) AS later, max(CASE WHEN (dz, dy, dx) > (0, 0, 0) THEN v END) AS earlier FROM cells c, {_OFFSETS} GROUP BY 1, 2, 3)
SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v FROM cells LEFT JOIN near USING (z, y, x) WHERE v > 0 AND v >= coalesce(later, 0) AND v > coalesce(earlier, 0)""",
}
