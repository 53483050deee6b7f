"""SQL of the general data problems, for comparison."""

from __future__ import annotations


def micros(t: str) -> str:
    """Microseconds of an instant, as text; unreadable text stays itself, empty is null."""
    u = f"trim({t}, ' ' || chr(9) || chr(10) || chr(13))"
    return rf"""CASE WHEN regexp_full_match({u}, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?') THEN epoch_us(CAST({u} || 'Z' AS TIMESTAMPTZ))::VARCHAR
  WHEN regexp_full_match({u}, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?Z') THEN epoch_us(CAST({u} AS TIMESTAMPTZ))::VARCHAR
  WHEN regexp_full_match({u}, '\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?[+-]\d\d:?\d\d') THEN epoch_us(CAST(regexp_replace({u}, '([+-]\d\d):?(\d\d)$', '\1:\2') AS TIMESTAMPTZ))::VARCHAR
  WHEN regexp_full_match({u}, '\d{{8}}T\d{{6}}Z') THEN epoch_us(strptime({u}, '%Y%m%dT%H%M%SZ'))::VARCHAR
  WHEN regexp_full_match({u}, '\d{{10}}') THEN (CAST({u} AS BIGINT) * 1000000)::VARCHAR WHEN regexp_full_match({u}, '\d{{13}}') THEN (CAST({u} AS BIGINT) * 1000)::VARCHAR
  WHEN regexp_full_match({u}, '[A-Z][a-z]{{2}}, \d\d [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d:\d\d GMT') THEN epoch_us(strptime({u}, '%a, %d %b %Y %H:%M:%S GMT'))::VARCHAR
  ELSE nullif(trim({t}), '') END"""


def state(t: str) -> str:
    """A state's name."""
    return f"nullif(lower(trim({t}, ' ' || chr(9) || chr(10) || chr(13))), '')"


def path(t: str) -> str:
    """A path in one spelling; up to three parts that go up."""
    u = rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
    bare = f"CASE WHEN regexp_matches({u}, '(?i)^file:') THEN url_decode(regexp_replace(regexp_replace({u}, '(?i)^file:(//[^/]*/)?', '/'), '^/+', '/')) ELSE {u} END"
    out = rf"regexp_replace(regexp_replace(replace({bare}, chr(92), '/'), '/+', '/', 'g'), '(/\.)+(/|$)', '\2', 'g')"
    for _ in range(3):
        out = rf"regexp_replace({out}, '/[^/]+/\.\./', '/')"
    return f"nullif({out}, '')"


def version() -> list[str]:
    """State, output and instant of a manifest record."""
    return [state("status"), "nullif(output_swc, '')", micros("timestamp_utc")]


_P2 = rf"""rows AS (SELECT neuron_id, line_no, raw_line, coalesce(n_cols, 7) AS n_cols FROM swc_line LEFT JOIN neuron USING (neuron_id) WHERE NOT regexp_matches(raw_line, '^[ \t\r\n]*(#|id|$)')),
parts AS (SELECT *, regexp_full_match(raw_line, '(?s)[ \t\r\n]*(("[^"]*"|[^ \t\r\n"#]+)([ \t\r\n]+|$|(#.*)))*(#.*)?') AS sound, regexp_extract(raw_line, '(?s)^(("[^"]*"|[^"#])*)', 1) AS body FROM rows),
fields AS (SELECT neuron_id, line_no, n_cols, sound, list_transform(regexp_extract_all(body, '"[^"]*"|[^ \t\r\n"]+'), lambda f: trim(f, '"')) AS f FROM parts),
judged AS (SELECT neuron_id, line_no, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> n_cols THEN 'columns'
  WHEN NOT coalesce(regexp_full_match(f[1], '[+-]?[0-9]+') AND try_cast(f[1] AS INTEGER) >= 1 AND regexp_full_match(f[2], '[+-]?[0-9]+') AND try_cast(f[2] AS INTEGER) >= 0
    AND regexp_full_match(f[7], '[+-]?[0-9]+') AND (try_cast(f[7] AS INTEGER) >= 1 OR try_cast(f[7] AS INTEGER) = -1)
    AND list_bool_and(list_transform(f[3:6], lambda v: regexp_full_match(v, '(?i)[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?[ \t]*([uµμ]m|microns?|micromet(er|re)s?|nm|nanomet(er|re)s?|mm|millimet(er|re)s?)?')
      AND coalesce(try_cast(regexp_extract(v, '(?i)^([+-]?[0-9.]+(e[+-]?[0-9]+)?)', 1) AS DOUBLE) BETWEEN -1.7e308 AND 1.7e308, false)))
    AND try_cast(regexp_extract(f[6], '(?i)^([+-]?[0-9.]+(e[+-]?[0-9]+)?)', 1) AS DOUBLE) > 0, false) THEN 'value' END AS reason, f FROM fields)"""


def _number(i: int) -> str:
    return f"CAST(regexp_extract(f[{i}], '(?i)^([+-]?[0-9.]+(e[+-]?[0-9]+)?)', 1) AS DOUBLE)"


P2 = f"WITH {_P2} SELECT DISTINCT neuron_id, line_no, reason FROM judged WHERE reason IS NOT NULL"
_SOUND = f"""sound AS (SELECT neuron_id, line_no, CAST(f[1] AS INTEGER) AS node_id, CAST(f[2] AS INTEGER) AS node_type, {_number(3)} AS x, {_number(4)} AS y, {_number(5)} AS z, {_number(6)} AS radius,
  CAST(f[7] AS INTEGER) AS parent_id, f[8:] AS extra FROM judged WHERE reason IS NULL)"""
P2_NODES = f"WITH {_P2}, {_SOUND} SELECT neuron_id, line_no, node_id, node_type, x, y, z, radius, parent_id, array_to_string(extra, ' ') AS extra FROM sound"

P4 = f"""WITH ok AS (SELECT run_id, started_at FROM batch_run WHERE {state('run_state')} = 'succeeded'),
seen AS (SELECT record_id, {state('status')} AS s, nullif(output_swc, '') AS o, {micros('timestamp_utc')} AS t, row_number() OVER (PARTITION BY record_id ORDER BY started_at DESC, run_id DESC, committed_at DESC) AS k FROM run_ledger JOIN ok USING (run_id)),
m AS (SELECT record_id, {state('status')} AS s, nullif(output_swc, '') AS o, {micros('timestamp_utc')} AS t FROM manifest)
SELECT DISTINCT m.record_id FROM m LEFT JOIN seen ON seen.record_id = m.record_id AND seen.k = 1 AND seen.s IS NOT DISTINCT FROM m.s AND seen.o IS NOT DISTINCT FROM m.o AND seen.t IS NOT DISTINCT FROM m.t WHERE seen.record_id IS NULL"""


def endless(rounds: int = 16) -> str:
    """Nodes that 2^rounds steps up do not leave, and the smallest id met on the cycle."""
    step = "".join(
        f", s{k} AS MATERIALIZED (SELECT a.neuron_id, a.node_id, b.up, least(a.low, b.low) AS low FROM s{k - 1} a JOIN s{k - 1} b ON b.neuron_id = a.neuron_id AND b.node_id = a.up)" for k in range(1, rounds + 1)
    )
    return f"""WITH latest AS (SELECT neuron_id, node_id, parent_id, row_number() OVER (PARTITION BY neuron_id, node_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS k FROM swc_node WHERE neuron_id IS NOT NULL AND node_id IS NOT NULL),
node AS (SELECT neuron_id, node_id, parent_id FROM latest WHERE k = 1),
s0 AS MATERIALIZED (SELECT n.neuron_id, n.node_id, n.parent_id AS up, n.node_id AS low FROM node n JOIN node p ON p.neuron_id = n.neuron_id AND p.node_id = n.parent_id){step}
SELECT a.neuron_id, a.node_id, b.low AS cycle_id FROM s{rounds} a JOIN s{rounds} b ON b.neuron_id = a.neuron_id AND b.node_id = a.up"""


P5 = endless()

# the order of the paths is that of the numbers in a walk down the tree
P5_HIERARCHY = f"""WITH RECURSIVE e AS ({P5}), last AS (SELECT neuron_id, node_id, parent_id, row_number() OVER (PARTITION BY neuron_id, node_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS k FROM swc_node WHERE neuron_id IS NOT NULL AND node_id IS NOT NULL),
n AS (SELECT c.neuron_id, c.node_id, p.node_id AS parent_id FROM last c LEFT JOIN last p ON p.neuron_id = c.neuron_id AND p.node_id = c.parent_id AND p.k = 1 WHERE c.k = 1),
t(neuron_id, node_id, parent_id, root_id, depth, path) AS (SELECT neuron_id, node_id, parent_id, node_id, 0, [node_id] FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.neuron_id, n.node_id, n.parent_id, t.root_id, t.depth + 1, list_append(t.path, n.node_id) FROM t JOIN n ON n.neuron_id = t.neuron_id AND n.parent_id = t.node_id),
below AS (SELECT neuron_id, a AS node_id, count(*) - 1 AS d FROM (SELECT neuron_id, unnest(path) AS a FROM t) GROUP BY 1, 2),
w AS (SELECT t.*, row_number() OVER (PARTITION BY neuron_id ORDER BY path) AS lft FROM t)
SELECT w.neuron_id, w.node_id, parent_id, root_id, depth, lft, lft + d AS rgt, d AS n_descendants, NULL::INTEGER AS cycle_id, array_to_string(path, '/') AS path FROM w JOIN below USING (neuron_id, node_id)
UNION ALL SELECT n.neuron_id, n.node_id, n.parent_id, NULL, NULL, NULL, NULL, NULL, e.cycle_id, NULL FROM n JOIN e USING (neuron_id, node_id)"""

_U = "[uµμ]m|microns?|micromet(?:er|re)s?|nm|nanomet(?:er|re)s?|mm|millimet(?:er|re)s?"
_X = "vox(?:els?)?|px|pixels?"
_N = r"[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?"
_SAYS = rf"(?i)(?:\b1\s+units?\s*(?:=|is)\s*({_N})\s*|\b(?:length_unit|units?)\s*(?:=|:)?\s*|\bcoordinates\s+in\s+|\bradii\s+given\s+in\s+|\bradius\s+are\s+|\ball\s+lengths\s+|\bpositions\s+are\s+|\bindex\s+space[^()\n]*\()\s*({_U}|{_X})(?:[^a-zµμ0-9]|$)"


def _name(t: str) -> str:
    u = f"lower(trim({t}))"
    return rf"CASE WHEN regexp_full_match({u}, '[uµμ]m|microns?|micromet(?:er|re)s?') THEN 'um' WHEN regexp_full_match({u}, 'nm|nanomet(?:er|re)s?') THEN 'nm' WHEN regexp_full_match({u}, 'mm|millimet(?:er|re)s?') THEN 'mm' WHEN regexp_full_match({u}, '{_X}') THEN 'voxel' END"


def _said(t: str) -> str:
    k, u = f"try_cast(nullif(regexp_extract({t}, '{_SAYS}', 1), '') AS DOUBLE)", _name(f"regexp_extract({t}, '{_SAYS}', 2)")
    um = f"{k} * CASE {u} WHEN 'um' THEN 1 WHEN 'nm' THEN 0.001 WHEN 'mm' THEN 1000 END"
    return f"CASE WHEN {k} IS NULL OR {u} = 'voxel' THEN {u} WHEN abs({um} - 1) < 1e-6 THEN 'um' WHEN abs({um} - 0.001) < 1e-9 THEN 'nm' WHEN abs({um} - 1000) < 1e-3 THEN 'mm' END"


_P6 = rf"""lines AS (SELECT neuron_id, line_no, {_said("CASE WHEN raw_line LIKE '%#%' THEN substr(raw_line, strpos(raw_line, '#')) END")} AS says,
  {_name(f"regexp_extract(raw_line, '(?i)[0-9.]\\s*({_U})(?:[^a-zµμ0-9]|$)', 1)")} AS carried, regexp_matches(raw_line, '^[^#]*[0-9]') AS is_row FROM swc_line),
own AS (SELECT neuron_id, coalesce(arg_min(says, line_no) FILTER (says IS NOT NULL), mode(carried) FILTER (is_row AND carried IS NOT NULL)) AS line_says FROM lines GROUP BY 1),
n AS (SELECT n.neuron_id, coalesce({_said("header_text")}, line_says, {_name("unit_text")}, {_name("default_unit")}) AS swc, nullif(trim(resolution), '') AS res, default_res_unit,
  list_distinct(list_transform(regexp_extract_all(lower(resolution), '({_U})(?:[^a-zµμ]|$)', 1), lambda u: {_name("u")})) AS us
  FROM neuron n LEFT JOIN own USING (neuron_id) LEFT JOIN scanner s ON s.scanner_name = coalesce(n.scanner_name, regexp_extract(n.image_path, '^/vol/([^/]+)/', 1)))"""

P6 = rf"""WITH {_P6} SELECT neuron_id, 'swc' AS quantity, swc AS unit FROM n WHERE swc <> 'um' UNION ALL
SELECT neuron_id, 'resolution', unit FROM (SELECT neuron_id, CASE WHEN regexp_matches(lower(res), '(?:{_X})\s*(?:/|per)\s*(?:{_U})|[0-9]\s*/\s*(?:{_U})(?:[^a-zµμ]|$)') THEN 'px_per_um' WHEN len(us) > 1 THEN 'mixed' WHEN len(us) = 1 THEN us[1] ELSE default_res_unit END AS unit FROM n WHERE res IS NOT NULL) WHERE unit <> 'um'"""

# micrometres per voxel along x, y and z: three numbers, or two as lateral and axial, or one
_PARTS = rf"""res AS (SELECT neuron_id, swc, lower(res) AS r, default_res_unit AS d, CASE WHEN regexp_matches(lower(res), '(?:{_X})\s*(?:/|per)\s*(?:{_U})|[0-9]\s*/\s*(?:{_U})(?:[^a-zµμ]|$)') THEN 'px_per_um' WHEN len(us) > 1 THEN 'mixed' WHEN len(us) = 1 THEN us[1] ELSE default_res_unit END AS unit FROM n),
num AS (SELECT *, regexp_extract_all(r, '({_N})\s*(?:(?:{_U})(?:[^a-zµμ]|$))?', 1) AS vs, list_transform(regexp_extract_all(r, '(?:{_N})\s*((?:{_U})(?:[^a-zµμ]|$))?', 1), lambda u: {_name("regexp_replace(u, '[^a-zµμ]$', '')")}) AS un FROM res),
um AS (SELECT *, list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN unit = 'px_per_um' THEN 1 / CAST(vs[i] AS DOUBLE) ELSE CAST(vs[i] AS DOUBLE) * CASE coalesce(un[i], unit) WHEN 'um' THEN 1 WHEN 'nm' THEN 0.001 WHEN 'mm' THEN 1000 END END) AS m FROM num),
vox AS (SELECT neuron_id, swc, CASE len(m) WHEN 3 THEN CASE WHEN regexp_matches(r, 'z\s*[=:]?\s*[0-9.]+[^xyz]*y\s*[=:]?\s*[0-9.]+[^xyz]*x\s*[=:]?\s*[0-9.]') THEN list_reverse(m) ELSE m END WHEN 2 THEN [m[1], m[1], m[2]] WHEN 1 THEN [m[1], m[1], m[1]] END AS v FROM um)"""


def _um(c: str, i: int) -> str:
    return f"{c} * CASE swc WHEN 'um' THEN 1 WHEN 'nm' THEN 0.001 WHEN 'mm' THEN 1000 WHEN 'voxel' THEN v[{i}] END AS {c}_um"


P6_NODES = f"""WITH {_P2}, {_SOUND}, {_P6}, {_PARTS},
allnodes AS (SELECT neuron_id, node_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, radius::DOUBLE AS radius FROM swc_node UNION ALL SELECT neuron_id, node_id, x, y, z, radius FROM sound)
SELECT a.neuron_id, node_id, x, y, z, radius, {_um("x", 1)}, {_um("y", 2)}, {_um("z", 3)}, {_um("radius", 1)} FROM allnodes a LEFT JOIN vox USING (neuron_id)"""
