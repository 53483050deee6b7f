"""The queries of the training-data problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtree.llm.mixing import mixture, mixture_shares
from voxtree.llm.packing import container_fill, pack_documents
from voxtree.llm.survivors import ATTRIBUTES, duplicate_groups, survivors
from voxtree.llm.truncation import truncated, truncation_rates
from voxtree.llm.volumes import blank_runs, split_oversized
from voxtree.plans.problem_sql import micros, path as spelling, state
from voxtree.plans.tables import table


P3 = f"""WITH r AS (SELECT record_id, {spelling('input_path')} AS file, coalesce(list_position(['completed', 'skipped', 'timed_out', 'failed'], {state('status')}), 9) AS rank,
  coalesce(try_cast({micros('timestamp_utc')} AS BIGINT), -4611686018427387904) AS instant FROM manifest)
SELECT min(record_id) AS first_id, arg_min(record_id, (rank, -instant, record_id)) AS survivor_id FROM r WHERE file IS NOT NULL GROUP BY file HAVING min(record_id) <> max(record_id)"""


P1 = f"""WITH big AS (SELECT result_id, threshold, n_y * n_x AS per, lower(trim(dtype)) AS kind, hex(signal_image) AS h FROM trace_result t
  JOIN scanner s ON s.scanner_name = coalesce(t.scanner_name, regexp_extract(image_path, '^/*vol/+([^/]+)/', 1)) WHERE octet_length(signal_image) > max_image_bytes),
texts AS (SELECT result_id, threshold, per, kind, regexp_extract_all(h, CASE WHEN kind = 'u8' THEN '..' ELSE '....' END) AS v FROM big),
voxels AS (SELECT result_id, threshold, per, kind, unnest(v) AS v, unnest(range(len(v))) AS k FROM texts),
slices AS (SELECT result_id, CAST(k // per AS INTEGER) AS z, max(CAST('0x' || CASE WHEN kind = 'u16le' THEN v[3:4] || v[1:2] ELSE v END AS INTEGER)) > any_value(threshold) AS lit FROM voxels GROUP BY 1, 2),
edges AS (SELECT *, z - row_number() OVER (PARTITION BY result_id, coalesce(lit, true) ORDER BY z) AS run, max(z) OVER (PARTITION BY result_id) AS top FROM slices),
runs AS (SELECT result_id, min(z) AS z_first, max(z) AS z_last FROM edges WHERE NOT coalesce(lit, true) GROUP BY result_id, run, top HAVING min(z) > 0 AND max(z) < top)
SELECT DISTINCT result_id, z_first, z_last FROM runs UNION ALL SELECT DISTINCT result_id, -1, -1 FROM big WHERE result_id NOT IN (SELECT result_id FROM runs)"""

_TEXT = ("status", "timestamp_utc", "output_swc", "error_type", "error_message", "traceback", "reason")


def _best(name: str) -> str:
    value = f"CASE WHEN trim({name}, ' ') <> '' THEN {name} END" if name in _TEXT else name
    return f"arg_max({value}, (trust, instant, -record_id, {value})) AS {name}"


P3_SURVIVORS = f"""WITH r AS (SELECT *, {spelling('input_path')} AS file, -CASE WHEN {state('status')} IS NULL THEN 5 ELSE coalesce(list_position(['completed', 'skipped', 'timed_out', 'failed'], {state('status')}) - 1, 4) END AS trust,
  coalesce(try_cast({micros('timestamp_utc')} AS BIGINT), -4611686018427387904) AS instant FROM manifest)
SELECT file, min(record_id) AS first_id, arg_max(record_id, (trust, instant, -record_id)) AS survivor_id, count(*) AS n_records, {', '.join(_best(c) for c in ATTRIBUTES)} FROM r WHERE file IS NOT NULL GROUP BY file"""


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    """Runs of blank slices inside oversized images."""
    return blank_runs(table(spark, path, "trace_result"), table(spark, path, "scanner"))


def p1_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of oversized images, with their bytes."""
    return split_oversized(table(spark, path, "trace_result"), table(spark, path, "scanner"))


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    """Files with several records, and the record that survives."""
    return duplicate_groups(table(spark, path, "manifest")).select("first_id", "survivor_id")


def p3_survivors(spark: SparkSession, path: str) -> DataFrame:
    """One record for each file."""
    return survivors(table(spark, path, "manifest"))


def p7_pack(spark: SparkSession, path: str) -> DataFrame:
    """All documents in containers of every capacity."""
    return pack_documents(table(spark, path, "documents"), table(spark, path, "pack_capacity"))


def p7_fill(spark: SparkSession, path: str) -> DataFrame:
    """How full the containers are."""
    return container_fill(p7_pack(spark, path), table(spark, path, "pack_capacity"))


def p8_mixture(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the mixture and how often each is repeated."""
    return mixture(table(spark, path, "documents"), table(spark, path, "mix_target"))


def p8_shares(spark: SparkSession, path: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixture_shares(table(spark, path, "documents"), table(spark, path, "mix_target"))


def p9_found(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose text breaks off."""
    return truncated(table(spark, path, "documents")).select("doc_id").distinct()


def p9_rates(spark: SparkSession, path: str) -> DataFrame:
    """Share of cut texts by source."""
    return truncation_rates(table(spark, path, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_survivors, p7_pack, p7_fill, p8_mixture, p8_shares, p9_found, p9_rates)}
ORACLES: dict[str, str] = {"p1_found": P1, "p3_found": P3, "p3_survivors": P3_SURVIVORS}
