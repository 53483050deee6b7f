"""Volumes, segments, points and graphs derived from the relational tables, the same in Spark and SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtree.plans.tables import table

#: Shape (z, y, x) of the derived volume.
SHAPE = (16, 32, 32)

VOL = """cells AS (SELECT l_orderkey % 16 AS z, l_suppkey % 32 AS y, l_partkey % 32 AS x, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
vol AS (SELECT CAST(g.i // 1024 AS INT) AS z, CAST((g.i // 32) % 32 AS INT) AS y, CAST(g.i % 32 AS INT) AS x, COALESCE(c.v, 0) AS v
  FROM range(16384) g(i) LEFT JOIN cells c ON c.z = g.i // 1024 AND c.y = (g.i // 32) % 32 AND c.x = g.i % 32)"""
SEG = """seg AS (SELECT p_partkey AS id, 1.0 + p_size % 5 AS r, 0.5 + (p_partkey % 4) * 0.5 AS s, 11.0 AS len,
  (p_partkey % 31) * 0.1 AS theta, (p_partkey % 61) * 0.1 AS psi, CAST(p_partkey % 97 AS DOUBLE) AS sx, CAST(p_partkey % 89 AS DOUBLE) AS sy, CAST(p_size AS DOUBLE) AS sz FROM part),
seg2 AS (SELECT *, sin(psi)*sin(theta) AS dx, -cos(psi)*sin(theta) AS dy, cos(theta) AS dz FROM seg)"""
PTS = """pts AS (SELECT vec_id AS id, 10 + round(CAST(embedding[1] AS DOUBLE) * 20, 2) AS px, 10 + round(CAST(embedding[2] AS DOUBLE) * 20, 2) AS py, 6 + round(CAST(embedding[3] AS DOUBLE) * 10, 2) AS pz FROM embeddings)"""
NODES = """latest AS (SELECT s.neuron_id, s.node_id, s.parent_id, s.x, s.y, s.z, s.radius, row_number() OVER (PARTITION BY s.neuron_id, s.node_id
  ORDER BY s.loaded_at DESC NULLS LAST, s.parent_id DESC NULLS LAST, s.node_type DESC NULLS LAST, s.x DESC NULLS LAST, s.y DESC NULLS LAST, s.z DESC NULLS LAST, s.radius DESC NULLS LAST) AS k
  FROM swc_node s WHERE s.neuron_id IS NOT NULL AND s.node_id IS NOT NULL),
node AS (SELECT neuron_id, node_id, parent_id, x, y, z, radius FROM latest WHERE k = 1)"""
GRAPH = """pairs AS (SELECT s_nationkey AS a, CAST(s_suppkey * 7 % 61 AS INT) AS b, s_suppkey AS e FROM supplier),
edges AS (SELECT least(a, b) AS u, greatest(a, b) AS v, min(CAST((e * 37) % 1009 * 100000 + e AS BIGINT)) AS w FROM pairs WHERE a <> b GROUP BY 1, 2)"""


def volume(spark: SparkSession, path: str) -> DataFrame:
    """z, y, x, v: quantities of all line items folded into a dense volume."""
    d, h, w = SHAPE
    cells = table(spark, path, "lineitem").groupBy(
        (F.col("l_orderkey") % d).cast("int").alias("z"), (F.col("l_suppkey") % h).cast("int").alias("y"), (F.col("l_partkey") % w).cast("int").alias("x")
    ).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    grid = spark.range(d * h * w).select(
        F.floor(F.col("id") / (h * w)).cast("int").alias("z"), (F.floor(F.col("id") / w) % h).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x")
    )
    return grid.join(cells, ["z", "y", "x"], "left").select("z", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """id, r, s, len, theta, psi, start and direction of one segment for each part."""
    p = table(spark, path, "part").select(
        F.col("p_partkey").alias("id"), (1.0 + F.col("p_size") % 5).alias("r"), (0.5 + (F.col("p_partkey") % 4) * 0.5).alias("s"), F.lit(11.0).alias("len"),
        ((F.col("p_partkey") % 31) * 0.1).alias("theta"), ((F.col("p_partkey") % 61) * 0.1).alias("psi"),
        (F.col("p_partkey") % 97).cast("double").alias("sx"), (F.col("p_partkey") % 89).cast("double").alias("sy"), F.col("p_size").cast("double").alias("sz"),
    )
    t, q = F.col("theta"), F.col("psi")
    return p.select("*", (F.sin(q) * F.sin(t)).alias("dx"), (-F.cos(q) * F.sin(t)).alias("dy"), F.cos(t).alias("dz"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """id, px, py, pz from the first three components of all embeddings."""
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(spark, path, "embeddings").select(
        F.col("vec_id").alias("id"), (10 + F.round(e[0] * 20, 2)).alias("px"), (10 + F.round(e[1] * 20, 2)).alias("py"), (6 + F.round(e[2] * 10, 2)).alias("pz")
    )


def graph(spark: SparkSession, path: str) -> DataFrame:
    """u, v, w: at most 86 vertices with different weights."""
    s = table(spark, path, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") * 7 % 61).cast("int").alias("b"), F.col("s_suppkey").alias("e"))
    return s.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(
        F.min((F.col("e") * 37 % 1009 * 100000 + F.col("e")).cast("bigint")).alias("w")
    )


TWO_PI = 2 * math.pi
