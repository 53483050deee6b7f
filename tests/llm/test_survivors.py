from datetime import datetime

from voxtree.llm.survivors import duplicate_groups, survivors

S = "record_id bigint, input_path string, status string, timestamp_utc string, output_swc string, elapsed_seconds double, reason string, loaded_at timestamp, file string, _rank int"
ROWS = [
    (5, "/a/b", "failed", "2026-01-03 00:00:00", "/o1", 1.0, None), (2, "file:/a//b", "Completed ", "2026-01-01 00:00:00", "", None, "r"), (9, "\\a\\b", "completed", "2026-01-02 00:00:00", None, 7.0, ""), (1, "/a/./b", None, None, "/o0", None, None),
    (3, "/a/B", "skipped", None, None, None, None), (4, "/a/B ", "SKIPPED", "nonsense", "x", None, None), (6, "/c", None, None, None, None, None), (6, "/c", None, None, None, None, None), (7, None, "completed", None, None, None, None), (8, "", "completed", None, None, None, None),
    (None, "/d", "completed", None, "/lent", None, None), (10, "/d", "failed", None, None, None, None), (11, "/e", "odd", None, None, None, None), (12, "/e", None, "2027-01-01 00:00:00", None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, datetime(2026, 1, 1), "clash", 0) for r in rows], S)


def test_groups(spark):
    got = {(r.first_id, r.survivor_id) for r in duplicate_groups(frame(spark, ROWS)).collect()}
    assert got == {(1, 9), (3, 3), (11, 11)}
    assert duplicate_groups(frame(spark, [])).count() == 0


def test_fields(spark):
    got = {r.file: r for r in survivors(frame(spark, ROWS)).collect()}
    assert set(got) == {"/a/b", "/a/B", "/c", "/d", "/e"}
    a = got["/a/b"]
    assert (a.first_id, a.survivor_id, a.n_records, a.status, a.elapsed_seconds, a.output_swc, a.reason) == (1, 9, 4, "completed", 7.0, "/o1", "r")
    assert got["/d"].survivor_id == 10 and got["/d"].output_swc == "/lent"
    assert survivors(frame(spark, [])).count() == 0


def test_hot_file(spark):
    df = spark.range(30000).selectExpr("id as record_id", "'/hot' as input_path", "'completed' as status", "cast(1767225600 + id % 1000 as string) as timestamp_utc", "cast(id as string) as output_swc")
    assert [tuple(r)[:2] for r in duplicate_groups(df).collect()] == [(0, 999)]
    assert survivors(df).first().output_swc == "999"
