from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voxtree.functions.instants import instant_micros
from voxtree.functions.paths import resolved_path
from voxtree.operators.incremental import low_watermark, pending

REC = "record_id bigint, status string, output_swc string, timestamp_utc string, v_status string, record string"
LED = "run_id int, record_id bigint, status string, output_swc string, timestamp_utc string, committed_at timestamp"
RUN = "run_id int, started_at timestamp, ended_at timestamp, run_state string"
T = datetime


def test_instants(spark):
    same = ["2026-01-05T02:04:02Z", "2026-01-05 02:04:02", "20260105T020402Z", "2026-01-05T07:34:02+05:30", "2026-01-04T21:04:02-0500", "1767578642", "1767578642000", "Mon, 05 Jan 2026 02:04:02 GMT", " 2026-01-05T02:04:02.000000Z\t", "2026-01-05T03:04:02+01"]
    bad = ["", "soon", None, "2026-13-05 00:00:00", "2026-01-05"]
    df = spark.createDataFrame([(s,) for s in same + bad], "t string").select(instant_micros(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [1767578642 * 10**6] * len(same) + [None] * len(bad)


def test_paths(spark):
    same = ["/vol/a/b 1.tif", " /vol/a/b 1.tif\t", "\\vol\\a\\b 1.tif", "/vol//a/./b 1.tif", "/vol/x/../a/b 1.tif", "file:/vol/a/b%201.tif", "file:///vol/a/b%201.tif", "FILE://host/vol/a/b 1.tif", "/../vol/a/b 1.tif"]
    other = {"/vol/a/B 1.tif": "/vol/a/B 1.tif", "/vol/a/b%201.tif": "/vol/a/b%201.tif", "file:/a%zz+b": "/a%zz+b", "a/../b": "b", "": None, None: None, "   ": None, "/": "/"}
    df = spark.createDataFrame([(s,) for s in [*same, *other]], "t string").select(resolved_path(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == ["/vol/a/b 1.tif"] * len(same) + list(other.values())


def test_pending(spark):
    runs = spark.createDataFrame([(1, T(2026, 1, 1), T(2026, 1, 2), "succeeded"), (2, T(2026, 1, 5), T(2026, 1, 6), " Succeeded "), (3, T(2026, 1, 3), T(2026, 1, 4), "succeeded"), (4, T(2026, 1, 9), None, "failed"), (5, None, None, None)], RUN)
    a = ("completed", "/o", "2026-01-01 00:00:00")
    ledger = spark.createDataFrame(
        [(1, 1, *a, None), (1, 1, *a, None), (3, 2, *a, None), (2, 2, "failed", "/o", a[2], None), (4, 3, *a, None), (1, 4, " COMPLETED", "/o", "1767225600", None), (1, 5, "completed", "", a[2], None),
         (1, 6, "x", "/o", a[2], T(2026, 1, 1)), (1, 6, *a, T(2026, 1, 2)), (9, 7, *a, None), (None, None, None, None, None, None), (1, 8, None, None, None, None), (1, 9, None, None, "soon", None)], LED)
    rows = [(1, *a), (2, *a), (3, *a), (4, *a), (5, "completed", None, a[2]), (6, *a), (7, *a), (None, *a), (8, "", "", ""), (9, None, None, "later"), (10, *a), (10, *a)]
    records = spark.createDataFrame([(*r, "clash", "clash") for r in rows], REC)
    found = pending(records, ledger, runs)
    assert found.columns == records.columns
    assert sorted(r.record_id or 0 for r in found.collect()) == [0, 2, 3, 7, 9, 10]
    # nothing is due twice: what a run has written is due no more
    assert pending(records, spark.createDataFrame([], LED), runs).count() == 11
    done = found.selectExpr("2 as run_id", "record_id", "status", "output_swc", "timestamp_utc", "timestamp'2026-02-01' as committed_at")
    assert [r.record_id for r in pending(records, ledger.unionByName(done), runs).collect()] == [None]
    assert pending(spark.createDataFrame([], REC), ledger, runs).count() == 0


def test_watermark(spark):
    runs = spark.createDataFrame([(1, T(2026, 1, 1), T(2026, 1, 8), "succeeded"), (2, T(2026, 1, 2), T(2026, 1, 3), "failed"), (3, T(2026, 1, 5), T(2026, 1, 6), "succeeded")], RUN)
    assert low_watermark(runs).first()[0] == T(2026, 1, 1)
    assert low_watermark(spark.createDataFrame([], RUN)).first()[0] is None
    records = spark.createDataFrame([(1, "a", "b", "c", None, None, T(2025, 12, 1)), (2, "a", "b", "c", None, None, T(2026, 1, 1)), (3, "a", "b", "c", None, None, None)], REC + ", changed timestamp")
    assert sorted(r.record_id for r in pending(records, spark.createDataFrame([], LED), runs, "changed").collect()) == [2, 3]


def test_runs_survive_failures(spark, tmp_path):
    from voxtree.operators.runs import RunState

    at = lambda day: datetime(2026, 1, day)
    state = RunState(spark, str(tmp_path / "state"))
    data = [(i, "completed", f"/o{i}", "2026-01-01 00:00:00", at(1), "clash") for i in range(6)] + [(None, None, None, None, None, "no id")]
    records = spark.createDataFrame(data, "record_id bigint, status string, output_swc string, timestamp_utc string, changed_at timestamp, run_id string")
    first = state.begin(at(2))
    assert state.due(records).count() == 7
    state.handle(first, records.where("record_id < 3"), at(2))  # dies here
    second = state.begin(at(3))
    assert state.due(records, "changed_at").count() == 7
    state.handle(second, records.where("record_id < 4"), at(3))
    state.handle(second, records.where("record_id < 4"), at(3))
    state.end(second, at(4))
    assert sorted(r.record_id for r in state.due(records).where("record_id is not null").collect()) == [4, 5]
    third = state.begin(at(5))
    state.handle(third, records, at(5))
    state.end(third, at(6), "failed")
    later = records.withColumn("status", F.when(F.col("record_id") == 1, "failed").otherwise(F.col("status"))).withColumn("changed_at", F.when(F.col("record_id") == 1, F.lit(at(7))).otherwise(F.col("changed_at")))
    # the first run never ended: all that changed since it began is read again, and nothing older
    assert {r.record_id for r in state.due(later, "changed_at").collect()} == {1, None}
    assert {r.record_id for r in state.due(later).collect()} == {1, 4, 5, None}
    for wrong in (second, third, 99):
        with pytest.raises(ValueError):
            state.end(wrong, at(8))
