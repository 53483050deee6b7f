"""The queries of the general data problems over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtree.operators.hierarchy import hierarchy
from voxtree.operators.incremental import pending
from voxtree.operators.runs import RunState
from voxtree.operators.swc_lines import parse_swc_lines
from voxtree.operators.units import file_units, foreign_units, to_micrometres
from voxtree.plans import problem_sql
from voxtree.plans.tables import table
from voxtree.session import materialize, shared_dir


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    """Rejected lines with their reason."""
    return parse_swc_lines(table(spark, path, "swc_line"), table(spark, path, "neuron")).rejected().select("neuron_id", "line_no", "reason").distinct()


def p2_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The sound lines as typed nodes."""
    return parse_swc_lines(table(spark, path, "swc_line"), table(spark, path, "neuron")).valid().withColumn("extra", F.array_join("extra", " "))


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    """What the next run must receive."""
    return pending(table(spark, path, "manifest"), table(spark, path, "run_ledger"), table(spark, path, "batch_run")).select("record_id").distinct()


def p4_replay(spark: SparkSession, path: str) -> DataFrame:
    """Five runs over the manifest as it arrived, the second killed half way, the third failed: how often each record was
    handled by a run that succeeded. The runs read again from the low watermark on, by the time of arrival."""
    records = table(spark, path, "manifest").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    start, stop = records.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    state = RunState(spark, f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}")
    step = (stop - start) / 5
    for k, end in enumerate(("succeeded", None, "failed", "succeeded", "succeeded"), 1):
        at = start + step * k if k < 5 else stop
        run = state.begin(at)
        there = records.where(F.col("loaded_at").isNull() | (F.col("loaded_at") <= F.lit(at)))
        due = materialize(state.due(there, "loaded_at"))
        state.handle(run, due if end == "succeeded" else due.where(F.pmod(F.xxhash64("record_id"), F.lit(2)) == 0), at)
        if end:
            state.end(run, at, end)
    done = state.runs().where(F.col("run_state") == "succeeded").select("run_id")
    return state.ledger().join(done, "run_id").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_handled"))


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    """Nodes whose chain of parents never ends."""
    return hierarchy(table(spark, path, "swc_node"), only_endless=True).select("neuron_id", "node_id", "cycle_id")


def p5_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Path, depth, root, nested-set range and number of descendants of every node."""
    return hierarchy(table(spark, path, "swc_node"), paths=True).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def _units(spark: SparkSession, path: str) -> DataFrame:
    return file_units(*[table(spark, path, t) for t in ("neuron", "scanner", "swc_node", "swc_line")])


def p6_found(spark: SparkSession, path: str) -> DataFrame:
    """Files and resolutions that are not in micrometres."""
    return foreign_units(_units(spark, path))


def p6_history(spark: SparkSession, path: str) -> DataFrame:
    """The unit that the changepoint search alone gives each file, beside what is stated."""
    units = _units(spark, path)
    return units.select("neuron_id", "history_unit", "swc_unit", "stated_by", (F.col("history_unit") == F.col("swc_unit")).alias("agrees"))


def p6_nodes(spark: SparkSession, path: str) -> DataFrame:
    """All nodes, of parsed files and of raw lines, in micrometres."""
    parsed = table(spark, path, "swc_node").select("neuron_id", "node_id", "x", "y", "z", "radius")
    raw = parse_swc_lines(table(spark, path, "swc_line"), table(spark, path, "neuron")).valid()
    both = parsed.select("neuron_id", "node_id", *[F.col(c).cast("double") for c in ("x", "y", "z", "radius")]).unionByName(raw.select("neuron_id", "node_id", "x", "y", "z", "radius"))
    return to_micrometres(both, _units(spark, path))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p4_found, p4_replay, p5_found, p5_hierarchy, p6_found, p6_history, p6_nodes)}
#: Each version of a record that had arrived is handled once.
P4_REPLAY = "SELECT record_id, count(*) AS n_handled FROM (SELECT DISTINCT record_id, " + ", ".join(problem_sql.version()) + " FROM manifest) GROUP BY 1"
ORACLES: dict[str, str] = {"p4_replay": P4_REPLAY, "p2_found": problem_sql.P2, "p2_nodes": problem_sql.P2_NODES, "p5_hierarchy": problem_sql.P5_HIERARCHY, "p6_nodes": problem_sql.P6_NODES, "p4_found": problem_sql.P4, "p5_found": problem_sql.P5, "p6_found": problem_sql.P6}
