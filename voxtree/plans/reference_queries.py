"""The engine's own operators over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtree.functions import geometry as g
from voxtree.operators import graphs, manifest, spatial, trees, voxels
from voxtree.plans.fixtures import GRAPH, NODES, PTS, SEG, SHAPE, VOL, graph, points, segments, volume
from voxtree.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, 6) + 0.0


def _box(source: str, column: str, how: str, out: str) -> str:
    """SQL: an aggregate of ``column`` over the 3 x 3 x 3 box."""
    return f"""{out} AS (SELECT a.z, a.y, a.x, {how}(b.{column}) AS q FROM {source} a JOIN (SELECT z + dz AS z, y + dy AS y, x + dx AS x, {column}
  FROM {source}, (VALUES (-1),(0),(1)) i(dz), (VALUES (-1),(0),(1)) j(dy), (VALUES (-1),(0),(1)) k(dx)) b USING (z, y, x) GROUP BY 1, 2, 3)"""


# ---- grey levels ----


@query(f"WITH {VOL} SELECT z, y, x, v FROM vol")
def voxel_build(spark, path):
    return volume(spark, path)


@query(f"WITH {VOL}, h AS (SELECT v AS bin, count(*) AS n FROM vol GROUP BY 1) SELECT b AS bin, COALESCE(n, 0) AS n FROM (SELECT unnest(range((SELECT min(bin) FROM h), (SELECT max(bin) + 1 FROM h))) AS b) LEFT JOIN h ON b = bin")
def background_histogram(spark, path):
    return voxels.dense_histogram(volume(spark, path))


_PEEL = """h AS (SELECT v AS bin, count(*) AS n FROM vol GROUP BY 1), e AS (SELECT min(bin) AS lo, max(bin) AS hi, sum(n) AS total FROM h),
w AS (SELECT b AS bin, COALESCE(n, 0) AS n FROM (SELECT unnest(range((SELECT lo FROM e), (SELECT hi + 1 FROM e))) AS b) LEFT JOIN h ON b = bin),
s0 AS (SELECT CASE WHEN (SELECT n FROM w WHERE bin = lo) * 1.0 / total > 0.9 THEN lo ELSE 0 END AS b, (SELECT n FROM w WHERE bin = lo) * 1.0 / total > 0.9 AS done FROM e)"""


def _peel(i: int) -> str:
    # the first bin of the slice: counted from the end where the start is below the lowest level
    first = "CASE WHEN p.b + 1 >= lo THEN p.b + 1 ELSE greatest(hi + 1 + (p.b + 1 - lo), lo) END"
    below = "CASE WHEN m.b + 1 >= lo THEN m.b + 1 ELSE greatest(hi + 1 + (m.b + 1 - lo), lo) END"
    return f"""m{i} AS (SELECT CASE WHEN p.done OR p.b + 1 > hi THEN p.b ELSE p.b + 1 + (SELECT arg_max(bin, (n, -bin)) FROM w WHERE bin >= {first}) - ({first}) END AS b, p.done OR p.b + 1 > hi AS done FROM s{i - 1} p, e),
s{i} AS (SELECT m.b, m.done OR m.b = hi OR COALESCE((SELECT sum(n) FROM w WHERE bin >= {below}), 0) * 1.0 / total < 0.5 AS done FROM m{i} m, e)"""


_LEVEL = f"{_PEEL}, {_peel(1)}, {_peel(2)}, {_peel(3)}"


@query(f"WITH {VOL}, {_LEVEL} SELECT CAST(b AS BIGINT) AS level, CAST(lo AS BIGINT) AS lowest FROM s3, e")
def background_level(spark, path):
    return voxels.background(volume(spark, path))


@query(f"WITH {VOL}, {_LEVEL} SELECT z, y, x, CAST(CASE WHEN b <= lo THEN v - b ELSE greatest(v - b, 0) END AS BIGINT) AS v FROM vol, s3, e")
def background_subtract(spark, path):
    return voxels.subtract_background(volume(spark, path))


@query(f"WITH {VOL} SELECT z, y, x, v, CAST(v > 60 AS INT) AS m FROM vol")
def threshold_mask(spark, path):
    return voxels.threshold_mask(volume(spark, path), 60)


@query(f"WITH {VOL} SELECT round(avg(CASE WHEN v > 60 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM vol")
def foreground_ratio(spark, path):
    return voxels.foreground_ratio(volume(spark, path), 60).select(r6(F.col("ratio")).alias("ratio"))


def _triangle(name: str, source: str, a: str, b: str) -> str:
    """SQL: CTEs ending in ``name``(t) with the triangle level of ``source``(v) in bins a to b."""
    return f"""{name}_h AS (SELECT bin, COALESCE(n, 0) AS n FROM (SELECT unnest(range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)) AS bin) LEFT JOIN (SELECT CAST(floor(v) AS BIGINT) AS k, count(*) AS n FROM {source} GROUP BY 1) ON k = bin),
{name}_p AS (SELECT arg_max(bin, (n, -bin)) AS pk, max(n) AS pn, min(bin) AS lo FROM {name}_h),
{name}_t AS (SELECT bin, n FROM {name}_h, {name}_p WHERE bin >= pk AND n > 0),
{name}_e AS (SELECT arg_max(bin, (-n, bin)) AS en, min(n) AS nn FROM {name}_t),
{name} AS (SELECT CASE WHEN pk = en THEN lo - 1.0 WHEN pn = nn THEN pk * 1.0 ELSE (SELECT arg_min(bin, ((n - nn) * ((en - pk) * 1.0 / (pn - nn)) + (bin - pk), bin)) * 1.0 FROM {name}_t WHERE bin <= en) END AS t FROM {name}_p, {name}_e)"""


@query(f"WITH {VOL}, pos AS (SELECT v FROM vol WHERE v > 0), {_triangle('tri', 'pos', '(SELECT min(v) FROM pos)', '(SELECT max(v) - 1 FROM pos)')} SELECT CAST(t AS DOUBLE) AS threshold FROM tri")
def triangle_threshold(spark, path):
    return voxels.triangle_threshold(volume(spark, path).where("v > 0"))


_MAXIMA = """f AS (SELECT a.z, a.y, a.x, a.v, bool_and(CASE WHEN (dz, dy, dx) > (0, 0, 0) THEN a.v >= b.v ELSE a.v > b.v END) AS ok
  FROM vol a JOIN (SELECT z - dz AS z, y - dy AS y, x - dx AS x, dz, dy, dx, v FROM vol, (VALUES (-1),(0),(1)) i(dz), (VALUES (-1),(0),(1)) j(dy), (VALUES (-1),(0),(1)) k(dx)
  WHERE NOT (dz = 0 AND dy = 0 AND dx = 0)) b USING (z, y, x) GROUP BY 1, 2, 3, 4)"""


@query(
    f"""WITH {VOL}, {_MAXIMA}, src AS (SELECT v FROM f WHERE ok AND v > 0), hi AS (SELECT max(v) AS top FROM src), {_triangle('t0', 'src', '(SELECT min(v) FROM src)', '(SELECT top - 1 FROM hi)')},
r0 AS (SELECT t AS cand, t AS cur, (SELECT avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) FROM vol) AS ratio, 0 AS k FROM t0),
{_triangle('t1', 'src', '(SELECT cand + 1 FROM r0)', '(SELECT top - 1 FROM hi)')},
r1 AS (SELECT CASE WHEN go THEN t ELSE cand END AS cand, CASE WHEN go AND (SELECT avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) FROM vol) <= ratio * CASE WHEN ratio > 0.05 THEN 0.5 ELSE 0.3 END THEN t ELSE cur END AS cur,
  CASE WHEN go AND ratio > 0.05 THEN (SELECT avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) FROM vol) ELSE 0 END AS ratio FROM (SELECT r0.*, t, ratio > 0.01 AND cand + 1 <= top - 1 AS go FROM r0, hi LEFT JOIN t1 ON true)),
{_triangle('t2', 'src', '(SELECT cand + 1 FROM r1)', '(SELECT top - 1 FROM hi)')},
r2 AS (SELECT CASE WHEN go THEN t ELSE cand END AS cand, CASE WHEN go AND (SELECT avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) FROM vol) <= ratio * 0.5 THEN t ELSE cur END AS cur,
  CASE WHEN go THEN (SELECT avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) FROM vol) ELSE 0 END AS ratio FROM (SELECT r1.*, t, ratio > 0.05 AND cand + 1 <= top - 1 AS go FROM r1, hi LEFT JOIN t2 ON true)),
{_triangle('t3', 'src', '(SELECT cand + 1 FROM r2)', '(SELECT top - 1 FROM hi)')},
r3 AS (SELECT CASE WHEN go AND (SELECT avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) FROM vol) <= ratio * 0.5 THEN t ELSE cur END AS cur FROM (SELECT r2.*, t, ratio > 0.05 AND cand + 1 <= top - 1 AS go FROM r2, hi LEFT JOIN t3 ON true))
SELECT CAST(cur AS DOUBLE) AS threshold FROM r3"""
)
def refine_threshold(spark, path):
    vol = volume(spark, path)
    return voxels.refined_threshold(vol, voxels.local_maxima(vol))


@query(
    f"""WITH RECURSIVE {VOL}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM vol), h AS (SELECT v - (SELECT lo FROM e) AS i, count(*) AS n FROM vol GROUP BY 1),
step(t, p, k) AS (SELECT CAST(floor((lo + hi) / 2.0 - lo) AS BIGINT), CAST(-1 AS BIGINT), 0 FROM e UNION ALL
  SELECT CAST(floor(((SELECT sum(i * n) * 1.0 / sum(n) FROM h WHERE i <= t) + (SELECT sum(i * n) * 1.0 / sum(n) FROM h WHERE i > t)) / 2.0) AS BIGINT), t, k + 1 FROM step, e WHERE t <> p AND t < hi - lo AND k < 500),
last AS (SELECT t FROM step ORDER BY k DESC LIMIT 1)
SELECT CAST(t + lo AS DOUBLE) AS threshold, round((SELECT sum(i * n) * 1.0 / sum(n) FROM h WHERE i <= t) + lo, 6) AS below, round((SELECT sum(i * n) * 1.0 / sum(n) FROM h WHERE i > t) + lo, 6) AS above FROM last, e"""
)
def rc_threshold(spark, path):
    return voxels.two_class_threshold(volume(spark, path)).select("threshold", r6(F.col("below")).alias("below"), r6(F.col("above")).alias("above"))


@query(f"WITH {VOL} SELECT y, x, round(ln(1 + max(v)), 6) AS v FROM vol GROUP BY 1, 2")
def mip_projection(spark, path):
    return voxels.projection(volume(spark, path), log=True).select("y", "x", r6(F.col("v")).alias("v"))


# ---- stencils ----


@query(f"WITH {VOL}, {_MAXIMA} SELECT z, y, x, v FROM f WHERE ok AND v > 0")
def local_max_26(spark, path):
    return voxels.local_maxima(volume(spark, path))


_REACH = """r(a, b) AS (SELECT id, id FROM on_ UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)"""


def _linked(source: str, reach: int, same: bool) -> str:
    value = "AND p.v = q.v" if same else ""
    return f"""on_ AS (SELECT z, y, x, v, z::BIGINT * 1099511627776 + y::BIGINT * 1048576 + x AS id FROM {source}),
l AS (SELECT p.id AS a, q.id AS b FROM on_ p JOIN (SELECT z - dz AS z, y - dy AS y, x - dx AS x, v, id FROM on_, (VALUES (-1),(0),(1)) i(dz), (VALUES (-1),(0),(1)) j(dy), (VALUES (-1),(0),(1)) k(dx)
  WHERE abs(dz) + abs(dy) + abs(dx) BETWEEN 1 AND {reach}) q ON p.z = q.z AND p.y = q.y AND p.x = q.x {value})"""


@query(
    f"""WITH RECURSIVE {VOL}, src AS (SELECT * FROM vol WHERE v <> 0), {_linked('src', 2, True)}, {_REACH}, zone AS (SELECT a AS id, min(b) AS first FROM r GROUP BY 1),
beaten AS (SELECT DISTINCT p.id FROM on_ p JOIN (SELECT z - dz AS z, y - dy AS y, x - dx AS x, v FROM vol, (VALUES (-1),(0),(1)) i(dz), (VALUES (-1),(0),(1)) j(dy), (VALUES (-1),(0),(1)) k(dx)
  WHERE abs(dz) + abs(dy) + abs(dx) BETWEEN 1 AND 2) q ON p.z = q.z AND p.y = q.y AND p.x = q.x AND q.v > p.v)
SELECT z, y, x, v FROM on_ JOIN zone USING (id) WHERE id = first AND first NOT IN (SELECT first FROM zone JOIN beaten USING (id))"""
)
def local_max_18_plateau(spark, path):
    return voxels.plateau_maxima(volume(spark, path))


_MASK = "mask AS (SELECT z, y, x, CAST(v > 60 AS INT) AS m FROM vol)"
_COUNTS = f"{_MASK}, ones AS (SELECT z, y, x, m, 1 AS o FROM mask), {_box('ones', 'm', 'sum', 'bm')}, {_box('ones', 'o', 'sum', 'bo')}, c AS (SELECT z, y, x, m, bm.q - m AS n_on, bo.q - 1 AS n_there FROM mask JOIN bm USING (z, y, x) JOIN bo USING (z, y, x))"


def _mask(spark: SparkSession, path: str, t: int = 60) -> DataFrame:
    return voxels.threshold_mask(volume(spark, path), t).drop("v")


@query(f"WITH {VOL}, {_COUNTS} SELECT z, y, x, m, CAST(n_on AS BIGINT) AS n_on, CAST(n_there AS BIGINT) AS n_there FROM c")
def neighbor_count_26(spark, path):
    return voxels.neighbour_counts(_mask(spark, path)).select("z", "y", "x", "m", F.col("n_on").cast("bigint"), F.col("n_there").cast("bigint"))


@query(f"WITH {VOL}, {_COUNTS} SELECT z, y, x, CAST(m = 1 AND n_on * 26 >= 4 * n_there AS INT) AS m FROM c")
def connectivity_filter_4(spark, path):
    return voxels.connectivity_filter(_mask(spark, path))


@query(f"WITH {VOL}, {_MASK}, {_box('mask', 'm', 'max', 'd')} SELECT z, y, x, q AS m FROM d")
def dilate_3x3x3(spark, path):
    return voxels.dilate(_mask(spark, path))


@query(f"WITH {VOL}, {_MASK}, {_box('mask', 'm', 'min', 'd')} SELECT z, y, x, q AS m FROM d")
def erode_3x3x3(spark, path):
    return voxels.erode(_mask(spark, path))


@query(f"WITH {VOL}, {_COUNTS}, k AS (SELECT z, y, x, CAST(m = 1 AND n_on * 26 >= 4 * n_there AS INT) AS m FROM c), {_box('k', 'm', 'max', 'd')}, {_box('d', 'q', 'min', 'e')} SELECT z, y, x, q AS m FROM e")
def closing_mask(spark, path):
    return voxels.closing(voxels.connectivity_filter(_mask(spark, path)))


@query(f"WITH {VOL}, {_MASK}, {_box('mask', 'm', 'min', 'd')}, {_box('d', 'q', 'max', 'e')} SELECT z, y, x, q AS m FROM e")
def opening_mask(spark, path):
    return voxels.opening(_mask(spark, path))


@query(
    f"""WITH {VOL}, {_MASK}, p1 AS (SELECT a.z, a.y, a.x, a.m, least(min(CASE WHEN b.m = 0 THEN (a.x - b.x) * (a.x - b.x) ELSE 1000000 END), (a.x + 1) * (a.x + 1), (32 - a.x) * (32 - a.x)) AS d FROM mask a JOIN mask b ON a.z = b.z AND a.y = b.y GROUP BY 1, 2, 3, 4),
p2 AS (SELECT a.z, a.y, a.x, a.m, least(min(b.d + (a.y - b.y) * (a.y - b.y)), (a.y + 1) * (a.y + 1), (32 - a.y) * (32 - a.y)) AS d FROM p1 a JOIN p1 b ON a.z = b.z AND a.x = b.x GROUP BY 1, 2, 3, 4),
p3 AS (SELECT a.z, a.y, a.x, a.m, least(min(b.d + (a.z - b.z) * (a.z - b.z)), (a.z + 1) * (a.z + 1), (16 - a.z) * (16 - a.z)) AS d FROM p2 a JOIN p2 b ON a.y = b.y AND a.x = b.x GROUP BY 1, 2, 3, 4)
SELECT z, y, x, m, CAST(CASE WHEN m = 0 THEN 0 ELSE d END AS BIGINT) AS d2 FROM p3"""
)
def edt_squared(spark, path):
    return voxels.squared_distance(_mask(spark, path)).withColumn("d2", F.when(F.col("m") == 0, 0).otherwise(F.col("d2")).cast("bigint"))


@query(f"WITH RECURSIVE {VOL}, src AS (SELECT * FROM vol WHERE v > 200), {_linked('src', 3, False)}, {_REACH} SELECT z, y, x, label FROM on_ JOIN (SELECT a AS id, min(b) AS label FROM r GROUP BY 1) USING (id)")
def components_26(spark, path):
    return voxels.components(_mask(spark, path, 200)).select("z", "y", "x", "label")


@query(f"WITH RECURSIVE {VOL}, src AS (SELECT * FROM vol WHERE v > 200), {_linked('src', 2, False)}, {_REACH} SELECT label, count(*) AS n FROM (SELECT a AS id, min(b) AS label FROM r GROUP BY 1) GROUP BY 1")
def component_sizes_18(spark, path):
    return voxels.components(_mask(spark, path, 200), neighbours=18).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VOL} SELECT z, y, x, v FROM vol WHERE z BETWEEN 1 AND 14 AND y BETWEEN 1 AND 30 AND x BETWEEN 1 AND 30")
def interior_filter(spark, path):
    return voxels.interior(volume(spark, path), SHAPE)


@query(f"WITH {VOL}, {_MAXIMA} SELECT z, y, x, v FROM f WHERE ok AND v > 0 ORDER BY abs(v - 3) DESC, x, y, z LIMIT 100")
def seed_priority_topn(spark, path):
    return voxels.local_maxima(volume(spark, path)).orderBy(F.abs(F.col("v") - 3).desc(), "x", "y", "z").limit(100)


# ---- samples ----


@query(f"""WITH {VOL}, {PTS}, c AS (SELECT id, dz, dy, dx, floor(px) AS bx, floor(py) AS by_, floor(pz) AS bz, px - floor(px) AS fx, py - floor(py) AS fy, pz - floor(pz) AS fz FROM pts, (VALUES (0),(1)) i(dz), (VALUES (0),(1)) j(dy), (VALUES (0),(1)) k(dx))
SELECT id, round(CASE WHEN count(v) = 8 THEN sum(v * (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN dz = 1 THEN fz ELSE 1 - fz END)) END, 6) AS s
FROM c LEFT JOIN vol ON z = bz + dz AND y = by_ + dy AND x = bx + dx GROUP BY 1""")
def trilinear_sample(spark, path):
    return voxels.trilinear_sample(volume(spark, path), points(spark, path), "id").select("id", F.round("s", 6).alias("s"))


@query(f"WITH {VOL}, {PTS} SELECT id, CAST(v AS DOUBLE) AS s FROM pts LEFT JOIN vol ON x = trunc(px + 0.5) AND y = trunc(py + 0.5) AND z = trunc(pz + 0.5)")
def nearest_sample(spark, path):
    return voxels.nearest_sample(volume(spark, path), points(spark, path)).select("id", "s")


_SAMPLED = f"{VOL}, {PTS}, sm AS (SELECT id, id % 10 AS k, px, py, pz, CAST(v AS DOUBLE) AS s, CASE WHEN id % 3 = 0 THEN -0.5 ELSE 0.25 * (id % 5) END AS w FROM pts LEFT JOIN vol ON x = trunc(px + 0.5) AND y = trunc(py + 0.5) AND z = trunc(pz + 0.5))"


def _sampled(spark: SparkSession, path: str) -> DataFrame:
    w = F.when(F.col("id") % 3 == 0, -0.5).otherwise(0.25 * (F.col("id") % 5))
    return voxels.nearest_sample(volume(spark, path), points(spark, path)).withColumns({"k": F.col("id") % 10, "w": w})


@query(f"WITH {_SAMPLED} SELECT k, round(sum(s * px) / sum(s), 6) AS cx, round(sum(s * py) / sum(s), 6) AS cy, round(sum(s * pz) / sum(s), 6) AS cz FROM sm WHERE s IS NOT NULL GROUP BY 1 HAVING sum(s) <> 0")
def weighted_centroid(spark, path):
    found = voxels.weighted_centroid(_sampled(spark, path), ["k"]).where("cx is not null")
    return found.select("k", *[r6(F.col(c)).alias(c) for c in ("cx", "cy", "cz")])


@query(f"""WITH {_SAMPLED}, a AS (SELECT k, sum(s) / count(*) AS ms, sum(CASE WHEN s IS NOT NULL THEN w END) / count(*) AS mw FROM sm GROUP BY 1)
SELECT k, round(sum(s * w), 6) AS dot, round(coalesce(avg(CASE WHEN w > 0 THEN s END), 0), 6) AS mean_inside, round(coalesce(avg(CASE WHEN w < 0 THEN s END), 0), 6) AS mean_outside,
round(CASE WHEN sum((s - ms) * (s - ms)) * sum((w - mw) * (w - mw)) > 0 THEN sum((s - ms) * (w - mw)) / sqrt(sum((s - ms) * (s - ms)) * sum((w - mw) * (w - mw))) ELSE 0 END, 6) AS correlation FROM sm JOIN a USING (k) WHERE s IS NOT NULL GROUP BY 1""")
def template_scores(spark, path):
    found = voxels.template_scores(_sampled(spark, path), ["k"])
    return found.select("k", *[r6(F.col(c)).alias(c) for c in ("dot", "mean_inside", "mean_outside", "correlation")])


@query("""WITH g AS (SELECT i, j, -2 + j * 0.2 AS a, -2 + i * 0.2 AS b FROM range(21) t(i), range(21) u(j))
SELECT i, j, round((1 - (a * a + b * b)) * exp(-(a * a + b * b)), 6) AS w FROM g WHERE a * a + b * b < 2.66""")
def kernel_grid(spark, path):
    side = spark.range(21)
    i, j = F.col("i"), F.col("j")
    d2 = F.pow(-2 + j * 0.2, 2) + F.pow(-2 + i * 0.2, 2)
    grid = side.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint"))).alias("j"))
    return grid.where(d2 < 2.66).select("i", "j", r6(g.kernel(d2)).alias("w"))


@query("""WITH t AS (SELECT k, 0.1 + k * 0.2 AS theta FROM range(12) r(k) WHERE 0.1 + k * 0.2 < 0.75 * pi()), s AS (SELECT k, theta, 2.0 / 11 / sin(theta) AS step FROM t)
SELECT k, count(*) AS n, round(max(q * step), 6) AS last FROM s, range(400) u(q) WHERE q * step < 2 * pi() GROUP BY 1""")
def orientation_schedule(spark, path):
    from voxtree.kernels.tube import angle_grid

    grid = spark.createDataFrame(angle_grid(11.0).tolist(), "theta double, psi double")
    return grid.groupBy(F.round((F.col("theta") - 0.1) / 0.2).cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"), r6(F.max("psi")).alias("last"))


# ---- geometry ----


def _seg_vectors(p: str = "") -> tuple[g.Vector, g.Vector]:
    return tuple(F.col(f"{p}s{a}") for a in "xyz"), tuple(F.col(f"{p}d{a}") for a in "xyz")


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """Each segment with the next one."""
    s = segments(spark, path)
    other = s.select(*[F.col(c).alias(f"o_{c}") for c in s.columns])
    return s.join(other, F.col("id") + 1 == F.col("o_id"))


_PAIRS = f"{SEG}, pr AS (SELECT a.*, b.id AS o_id, b.r AS o_r, b.s AS o_s, b.len AS o_len, b.theta AS o_theta, b.psi AS o_psi, b.sx AS o_sx, b.sy AS o_sy, b.sz AS o_sz, b.dx AS o_dx, b.dy AS o_dy, b.dz AS o_dz FROM seg2 a JOIN seg2 b ON a.id + 1 = b.id)"
# the start of the next segment in the frame of this one
_LOCAL = f"""{_PAIRS}, q AS (SELECT *, (o_sx - sx) * cos(psi) + (o_sy - sy) * sin(psi) AS x1, -(o_sx - sx) * sin(psi) + (o_sy - sy) * cos(psi) AS y1, o_sz - sz AS z1 FROM pr),
lo AS (SELECT *, x1 AS lx, y1 * cos(theta) + z1 * sin(theta) AS ly, -y1 * sin(theta) + z1 * cos(theta) AS lz FROM q)"""


@query(f"WITH {SEG} SELECT id, round(sx + 5 * dx, 6) AS cx, round(sy + 5 * dy, 6) AS cy, round(sz + 5 * dz, 6) AS cz, round(sx + 10 * dx, 6) AS ex, round(sy + 10 * dy, 6) AS ey, round(sz + 10 * dz, 6) AS ez FROM seg2")
def segment_endpoints(spark, path):
    at, axis = _seg_vectors()
    _, c, e = g.ends(at, axis, F.col("len"))
    return segments(spark, path).select("id", *[r6(v).alias(f"c{a}") for a, v in zip("xyz", c, strict=True)], *[r6(v).alias(f"e{a}") for a, v in zip("xyz", e, strict=True)])


@query(f"WITH {SEG} SELECT id, round(cos(psi) * 1 - sin(psi) * (2 * cos(theta) - 3 * sin(theta)), 6) + 0.0 AS x, round(sin(psi) * 1 + cos(psi) * (2 * cos(theta) - 3 * sin(theta)), 6) + 0.0 AS y, round(2 * sin(theta) + 3 * cos(theta), 6) + 0.0 AS z FROM seg")
def rotate_points(spark, path):
    v = g.rotate((F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("theta"), F.col("psi"))
    return segments(spark, path).select("id", *[r6(c).alias(a) for a, c in zip("xyz", v, strict=True)])


@query(f"""WITH {SEG}, k AS (SELECT id, CASE WHEN dz < 0 THEN -1 ELSE 1 END AS s, dx, dy, dz FROM seg2), a AS (SELECT id, round(acos(least(1, greatest(-1, s * dz))), 6) AS theta, atan2(s * dx, -s * dy) AS p, dx, dy FROM k)
SELECT id, theta, CASE WHEN abs(dx) + abs(dy) > 1e-9 THEN round(CASE WHEN p < -5e-7 THEN p + 2 * pi() ELSE greatest(p, 0) END, 5) % round(2 * pi(), 5) END AS psi FROM a""")
def direction_angles(spark, path):
    """An axis along z has any psi."""
    axis = _seg_vectors()[1]
    theta, psi = g.angles(axis)
    turned = F.round(F.when(psi > 2 * 3.141592653589793 - 5e-7, 0.0).otherwise(psi), 5) % F.round(F.lit(2 * 3.141592653589793), 5)
    return segments(spark, path).select("id", r6(theta).alias("theta"), F.when(F.abs(axis[0]) + F.abs(axis[1]) > 1e-9, turned).alias("psi"))


@query(f"WITH {_LOCAL} SELECT id, (lx / (r * s)) ** 2 + (ly / r) ** 2 <= 1 AND lz >= -0.5 AND lz <= len - 0.5 AS inside FROM lo")
def point_in_segment(spark, path):
    at, _ = _seg_vectors()
    other, _ = _seg_vectors("o_")
    c = F.col
    return _pairs(spark, path).select("id", g.inside_segment(other, at, c("theta"), c("psi"), c("r"), c("s"), c("len")).alias("inside"))


@query(f"""WITH {_LOCAL}, n AS (SELECT *, sqrt((lx / (r * s)) ** 2 + (ly / r) ** 2) AS nm, lz - greatest(0, least(lz, len - 1)) AS cap FROM lo)
SELECT id, round(CASE WHEN nm <= 1 AND lz >= -0.5 AND lz <= len THEN 0 ELSE sqrt((CASE WHEN nm > 1 THEN sqrt(lx * lx + ly * ly) * (1 - 1 / nm) ELSE 0 END) ** 2 + cap ** 2) END, 6) AS d FROM n""")
def point_surface_distance(spark, path):
    at, _ = _seg_vectors()
    other, _ = _seg_vectors("o_")
    c = F.col
    return _pairs(spark, path).select("id", r6(g.surface_distance(other, at, c("theta"), c("psi"), c("r"), c("s"), c("len"))).alias("d"))


def _point_line(p: str, a: str, b: str) -> str:
    ab = [f"({b}{k} - {a}{k})" for k in "xyz"]
    ap = [f"({p}{k} - {a}{k})" for k in "xyz"]
    t = f"least(1, greatest(0, ({' + '.join(f'{u} * {v}' for u, v in zip(ap, ab, strict=True))}) / ({' + '.join(f'{u} * {u}' for u in ab)})))"
    return "sqrt(" + " + ".join(f"({p}{k} - {a}{k} - {t} * {ab[i]}) ** 2" for i, k in enumerate("xyz")) + ")"


@query(
    f"""WITH {_PAIRS}, q AS (SELECT id, sx AS ax, sy AS ay, sz AS az, sx + 10 * dx AS gx, sy + 10 * dy AS gy, sz + 10 * dz AS gz, o_sx AS cx, o_sy AS cy, o_sz AS cz, o_sx + 10 * o_dx AS ex, o_sy + 10 * o_dy AS ey, o_sz + 10 * o_dz AS ez,
  100.0 * (dx * dx + dy * dy + dz * dz) AS a, 100.0 * (dx * o_dx + dy * o_dy + dz * o_dz) AS b, 100.0 * (o_dx * o_dx + o_dy * o_dy + o_dz * o_dz) AS c,
  10.0 * (dx * (sx - o_sx) + dy * (sy - o_sy) + dz * (sz - o_sz)) AS d, 10.0 * (o_dx * (sx - o_sx) + o_dy * (sy - o_sy) + o_dz * (sz - o_sz)) AS e, dx, dy, dz, o_dx, o_dy, o_dz FROM pr),
f AS (SELECT *, CASE WHEN a * c - b * b > 1e-9 THEN (b * e - c * d) / (a * c - b * b) END AS s, CASE WHEN a * c - b * b > 1e-9 THEN (a * e - b * d) / (a * c - b * b) END AS t FROM q)
SELECT id, round(CASE WHEN s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN sqrt((ax + s * 10 * dx - cx - t * 10 * o_dx) ** 2 + (ay + s * 10 * dy - cy - t * 10 * o_dy) ** 2 + (az + s * 10 * dz - cz - t * 10 * o_dz) ** 2)
  ELSE least({_point_line('a', 'c', 'e')}, {_point_line('g', 'c', 'e')}, {_point_line('c', 'a', 'g')}, {_point_line('e', 'a', 'g')}) END, 6) AS d FROM f"""
)
def segment_segment_distance(spark, path):
    a, da = _seg_vectors()
    c, dc = _seg_vectors("o_")
    return _pairs(spark, path).select("id", r6(g.segment_distance(a, g.plus(a, da, 10.0), c, g.plus(c, dc, 10.0))).alias("d"))


@query(f"WITH {_PAIRS} SELECT id, dx * o_dx + dy * o_dy + dz * o_dz <= 0 AS sharp, round(atan2(sqrt((dy * o_dz - dz * o_dy) ** 2 + (dz * o_dx - dx * o_dz) ** 2 + (dx * o_dy - dy * o_dx) ** 2), dx * o_dx + dy * o_dy + dz * o_dz), 6) AS angle FROM pr")
def segment_turn(spark, path):
    _, a = _seg_vectors()
    _, b = _seg_vectors("o_")
    return _pairs(spark, path).select("id", (g.dot(a, b) <= 0).alias("sharp"), r6(g.turn_angle(a, b)).alias("angle"))


@query(f"WITH {SEG} SELECT id, CAST(round(least(r * 1.5, r + 3), 6) AS DOUBLE) AS radius, round(least(r * s * 1.5, r * s + 3) / least(r * 1.5, r + 3), 6) AS scale, round(sqrt((r * greatest(s, 1)) ** 2 + len * len) / 2, 6) AS ball, round(0.3 * (1 + 1 / (2 + exp(4 - r * sqrt(s)))), 6) AS least_score FROM seg")
def segment_dilate(spark, path):
    r, s = F.col("r"), F.col("s")
    radius, scale = g.dilated(r, s)
    return segments(spark, path).select("id", r6(radius).alias("radius"), r6(scale).alias("scale"), r6(g.ball_radius(r, s, F.col("len"))).alias("ball"), r6(g.least_score(0.3, r, s)).alias("least_score"))


@query(f"WITH {SEG} SELECT id, round((pi() - theta + 2 * pi()) % (2 * pi()), 6) AS theta, round((psi + pi()) % (2 * pi()), 6) AS psi FROM seg")
def segment_flip(spark, path):
    theta, psi = g.flipped(F.col("theta"), F.col("psi"))
    return segments(spark, path).select("id", r6(theta).alias("theta"), r6(psi).alias("psi"))


@query(f"WITH {VOL} SELECT a.z, a.y, a.x, round(1 / (1 + exp((a.v - 60.0) / 5)) + 1 / (1 + exp((b.v - 60.0) / 5)) + 1e-5, 6) AS w FROM vol a JOIN vol b ON a.z = b.z AND a.y = b.y AND a.x + 1 = b.x")
def voxel_edge_weight(spark, path):
    vol = volume(spark, path)
    w = Window.partitionBy("z", "y").orderBy("x")
    return vol.withColumn("b", F.lead("v").over(w)).where("b is not null").select("z", "y", "x", r6(g.voxel_weight(F.lit(1.0), F.col("v"), F.col("b"), F.lit(60.0), F.lit(5.0))).alias("w"))


@query(f"WITH {VOL} SELECT z, y, x, CAST(x + 32 * y + 1024 * z AS BIGINT) AS i, CAST(CASE WHEN x + 1 > 31 THEN -1 ELSE x + 1 + 32 * y + 1024 * z END AS BIGINT) AS j FROM vol")
def raster_index(spark, path):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    d, h, w = SHAPE
    return volume(spark, path).select("z", "y", "x", g.raster_index(x, y, z, w, h, d).cast("bigint").alias("i"), g.raster_index(x + 1, y, z, w, h, d).cast("bigint").alias("j"))


# ---- spatial joins ----

_BOXES = f"""{SEG}, bx AS (SELECT id, r, s, least(sx, sx + 10 * dx) - r * greatest(s, 1) AS x0, greatest(sx, sx + 10 * dx) + r * greatest(s, 1) AS x1, least(sy, sy + 10 * dy) - r * greatest(s, 1) AS y0, greatest(sy, sy + 10 * dy) + r * greatest(s, 1) AS y1,
  least(sz, sz + 10 * dz) - r * greatest(s, 1) AS z0, greatest(sz, sz + 10 * dz) + r * greatest(s, 1) AS z1 FROM seg2)"""


@query(f"WITH {_BOXES} SELECT a.id AS i, b.id AS j FROM bx a JOIN bx b ON a.id < b.id AND greatest(b.x0 - a.x1, a.x0 - b.x1, 0) ** 2 + greatest(b.y0 - a.y1, a.y0 - b.y1, 0) ** 2 + greatest(b.z0 - a.z1, a.z0 - b.z1, 0) ** 2 <= 1.0")
def grid_candidate_pairs(spark, path):
    return spatial.boxes_within(spatial.segment_boxes(segments(spark, path)), 1.0)


@query(f"WITH {_BOXES} SELECT a.id, round(sqrt(greatest(b.x0 - a.x1, a.x0 - b.x1, 0) ** 2 + greatest(b.y0 - a.y1, a.y0 - b.y1, 0) ** 2 + greatest(b.z0 - a.z1, a.z0 - b.z1, 0) ** 2), 6) AS gap, round(2 * sqrt(a.r * a.r + 25) + 11, 6) AS reach FROM bx a JOIN bx b ON a.id + 1 = b.id")
def aabb_reject(spark, path):
    b = spatial.segment_boxes(segments(spark, path))
    other = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
    both = b.join(other, F.col("id") + 1 == F.col("o_id"))
    sides = lambda p: [(F.col(f"{p}{a}0"), F.col(f"{p}{a}1")) for a in "xyz"]
    return both.select("id", r6(g.box_gap(sides(""), sides("o_"))).alias("gap"), r6(g.connection_reach(F.col("r"))).alias("reach"))


@query(f"WITH {_PAIRS} SELECT id, round(1 / (1 + exp(-sqrt((o_sx - sx) ** 2 + (o_sy - sy) ** 2 + (o_sz - sz) ** 2) / 100)), 6) AS cost FROM pr")
def connection_cost(spark, path):
    a, _ = _seg_vectors()
    b, _ = _seg_vectors("o_")
    return _pairs(spark, path).select("id", r6(g.connection_cost(g.distance(a, b))).alias("cost"))


@query(f"WITH {PTS}, {SEG}, d AS (SELECT p.id, q.id AS seg, (px - sx) ** 2 + (py - sy) ** 2 + (pz - sz) ** 2 AS d2 FROM pts p, seg q WHERE abs(px - sx) <= 10 AND abs(py - sy) <= 10 AND abs(pz - sz) <= 10) SELECT id, arg_min(seg, (d2, seg)) AS nearest FROM d WHERE d2 <= 100 GROUP BY 1")
def nearest_center(spark, path):
    return spatial.nearest_within(points(spark, path), segments(spark, path).select("id", F.col("sx").alias("px"), F.col("sy").alias("py"), F.col("sz").alias("pz")), 10.0)


# ---- graphs ----

_HOOKS = f"""{_PAIRS}, e AS (SELECT id AS edge, id % 40 AS src, (id * 7 + 3) % 40 AS dst, CASE WHEN id % 5 = 0 THEN 'LINK' ELSE 'HL' END AS mode, CAST(id % 2 AS INT) AS info0, CAST((id * 31) % 17 AS DOUBLE) / 10 AS cost FROM pr)"""


def _hooks(spark: SparkSession, path: str) -> DataFrame:
    i = F.col("id")
    return _pairs(spark, path).select(
        i.alias("edge"), (i % 40).alias("src"), ((i * 7 + 3) % 40).alias("dst"), F.when(i % 5 == 0, "LINK").otherwise("HL").alias("mode"), (i % 2).cast("int").alias("info0"), ((i * 31) % 17).cast("double").alias("c")
    ).withColumn("cost", F.col("c") / 10).drop("c")


@query(f"""WITH {_HOOKS}, a AS (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY cost, edge DESC) AS k FROM e WHERE mode = 'HL'),
b AS (SELECT *, row_number() OVER (PARTITION BY src, info0 ORDER BY cost, edge DESC) AS k2 FROM a WHERE k = 1)
SELECT edge, src, dst, mode, info0, cost FROM b WHERE k2 = 1 UNION ALL SELECT edge, src, dst, mode, info0, cost FROM e WHERE mode <> 'HL'""")
def edge_dedupe(spark, path):
    return graphs.cheapest_hooks(_hooks(spark, path)).select("edge", "src", "dst", "mode", "info0", "cost")


@query(f"WITH {GRAPH} SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1")
def degree_count(spark, path):
    return graphs.degrees(graph(spark, path))


@query(f"""WITH RECURSIVE {GRAPH}, r(e, a) AS (SELECT w, u FROM edges UNION SELECT r.e, CASE WHEN r.a = x.u THEN x.v ELSE x.u END FROM r JOIN edges x ON x.w < r.e AND (x.u = r.a OR x.v = r.a))
SELECT u, v, w FROM edges WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.e = edges.w AND r.a = edges.v)""")
def mst_edges(spark, path):
    return graphs.minimum_spanning_forest(graph(spark, path).withColumn("edge", F.col("w"))).select("u", "v", "w")


# ---- trees ----


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return trees.current_nodes(table(spark, path, "swc_node"))


@query(f"WITH {NODES} SELECT neuron_id, node_id FROM node n WHERE NOT EXISTS (SELECT 1 FROM node p WHERE p.neuron_id = n.neuron_id AND p.node_id = n.parent_id)")
def tree_roots(spark, path):
    return trees.roots(_nodes(spark, path)).select("neuron_id", "node_id")


@query(f"WITH {NODES} SELECT neuron_id, node_id FROM node n WHERE NOT EXISTS (SELECT 1 FROM node p WHERE p.neuron_id = n.neuron_id AND p.parent_id = n.node_id)")
def tree_tips(spark, path):
    return trees.tips(_nodes(spark, path)).select("neuron_id", "node_id")


@query(f"WITH {NODES} SELECT n.neuron_id, n.node_id FROM node n JOIN node p ON p.neuron_id = n.neuron_id AND p.parent_id = n.node_id GROUP BY 1, 2 HAVING count(*) > 1")
def tree_bifurcations(spark, path):
    return trees.bifurcations(_nodes(spark, path)).select("neuron_id", "node_id")


@query(f"""WITH {NODES} SELECT n.neuron_id, count(*) AS n_links, round(sum(sqrt((n.x::DOUBLE - p.x) ** 2 + (n.y::DOUBLE - p.y) ** 2 + (n.z::DOUBLE - p.z) ** 2)), 3) AS cable
FROM node n JOIN node p ON p.neuron_id = n.neuron_id AND p.node_id = n.parent_id WHERE n.node_id <> n.parent_id GROUP BY 1""")
def tree_cable_length(spark, path):
    return trees.cable_lengths(_nodes(spark, path)).select("neuron_id", "n_links", F.round("cable", 3).alias("cable"))


@query(f"""WITH RECURSIVE {NODES}, t(neuron_id, node_id, root_id, depth) AS (SELECT neuron_id, node_id, node_id, 0 FROM node n WHERE NOT EXISTS (SELECT 1 FROM node p WHERE p.neuron_id = n.neuron_id AND p.node_id = n.parent_id)
UNION ALL SELECT n.neuron_id, n.node_id, t.root_id, t.depth + 1 FROM t JOIN node n ON n.neuron_id = t.neuron_id AND n.parent_id = t.node_id AND n.node_id <> n.parent_id)
SELECT n.neuron_id, n.node_id, t.root_id, t.depth FROM node n LEFT JOIN t USING (neuron_id, node_id)""")
def tree_root_label(spark, path):
    return trees.root_labels(table(spark, path, "swc_node"))


@query(f"""WITH {NODES}, kids AS (SELECT neuron_id, parent_id AS node_id, count(*) AS k FROM node WHERE parent_id IS NOT NULL GROUP BY 1, 2)
SELECT n.neuron_id, n.node_id FROM node n LEFT JOIN kids k USING (neuron_id, node_id) LEFT JOIN kids pk ON pk.neuron_id = n.neuron_id AND pk.node_id = n.parent_id
LEFT JOIN node p ON p.neuron_id = n.neuron_id AND p.node_id = n.parent_id WHERE k.k IS NOT NULL OR (p.node_id IS NOT NULL AND pk.k = 1)""")
def tree_spur_removal(spark, path):
    return trees.remove_spurs(_nodes(spark, path)).select("neuron_id", "node_id")


@query(f"WITH {NODES} SELECT neuron_id, node_id, concat_ws(' ', regexp_replace(format('{{:.3f}}', x::DOUBLE), '\\.?0+$', ''), regexp_replace(format('{{:.3f}}', radius::DOUBLE), '\\.?0+$', ''), coalesce(parent_id, -1)::VARCHAR) AS line FROM node")
def swc_format_rows(spark, path):
    from voxtree.sources.swc import number_text

    return _nodes(spark, path).select("neuron_id", "node_id", F.concat_ws(" ", number_text("x"), number_text("radius"), F.coalesce("parent_id", F.lit(-1)).cast("string")).alias("line"))


@query()
def tree_trunk_lengths(spark, path):
    return trees.trunk_lengths(_nodes(spark, path))


@query()
def tree_remove_short(spark, path):
    return trees.remove_short_trees(_nodes(spark, path))


@query()
def tree_remove_zigzag(spark, path):
    return trees.remove_zigzags(_nodes(spark, path))


@query()
def tree_tune_branch(spark, path):
    return trees.tune_branches(_nodes(spark, path))


@query()
def tree_merge_close(spark, path):
    return trees.merge_close(_nodes(spark, path))


@query()
def tree_remove_overshoot(spark, path):
    return trees.remove_overshoots(_nodes(spark, path))


@query()
def tree_optimal_downsample(spark, path):
    return trees.downsample(_nodes(spark, path))


@query()
def tree_postprocess(spark, path):
    return trees.postprocess(_nodes(spark, path))


# ---- batch ----


@query("SELECT lower(trim(status, ' ' || chr(9))) AS status, count(*) AS n, round(avg(elapsed_seconds), 6) AS mean_seconds FROM manifest GROUP BY 1")
def manifest_status_counts(spark, path):
    return manifest.status_counts(table(spark, path, "manifest")).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("SELECT result_id, image_path FROM trace_result t WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.output_swc = t.output_swc AND lower(trim(m.status)) = 'completed')")
def skip_existing_outputs(spark, path):
    return manifest.without_output(table(spark, path, "trace_result"), table(spark, path, "manifest")).select("result_id", "image_path")


@query(r"SELECT image_path, CASE WHEN regexp_matches(lower(image_path), '\.tiff?$') THEN 'tiff' WHEN regexp_matches(lower(image_path), '\.(v3draw|raw)$') THEN 'v3draw' WHEN regexp_matches(lower(image_path), '\.v3dpbd$') THEN 'v3dpbd' WHEN regexp_matches(lower(image_path), '\.nii(\.gz)?$') THEN 'nifti' WHEN regexp_matches(lower(image_path), '\.(nrrd|nhdr)$') THEN 'nrrd' END AS format, count(*) AS n FROM neuron GROUP BY 1, 2")
def format_detection(spark, path):
    from voxtree.sources.formats import format_name

    return table(spark, path, "neuron").groupBy("image_path", format_name(F.col("image_path")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


# ---- tracing ----


def _traced(spark: SparkSession, path: str, until: str, strategy: str = "lazy") -> DataFrame:
    from voxtree.operators.tracing import spread, stored_images, trace_images

    return trace_images(spread(stored_images(table(spark, path, "trace_result"))), until=until, strategy=strategy)


@query()
def trace_preprocess(spark, path):
    return _traced(spark, path, "preprocess").select("id", "status", "error_message", "threshold", "n_foreground")


@query()
def seed_scoring(spark, path):
    from voxtree.operators.tracing import seeds_of

    return seeds_of(_traced(spark, path, "seeds", "eager"))


@query()
def chain_tracing(spark, path):
    from voxtree.operators.tracing import tubes_of

    return tubes_of(_traced(spark, path, "chains"))


@query()
def chain_filter(spark, path):
    from voxtree.operators.tracing import chain_stats, filter_chains, tubes_of

    return filter_chains(chain_stats(tubes_of(_traced(spark, path, "chains"))))


@query()
def trace_volume_end_to_end(spark, path):
    from voxtree.operators.tracing import nodes_of

    return nodes_of(_traced(spark, path, "nodes"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS since, event_type AS stage, CAST(max(user_id) AS BIGINT) AS current, count(*) AS n_events FROM events GROUP BY 1, 2")
def progress_windows(spark, path):
    from voxtree.streaming.watch import progress_by_stage

    e = table(spark, path, "events").select(F.lit("all").alias("input_path"), F.col("event_type").alias("stage"), F.col("user_id").alias("current"), F.lit(1).alias("total"), F.col("ts").cast("timestamp").alias("at"))
    return progress_by_stage(e, "1 hour").select(F.col("since").cast("timestamp_ntz").alias("since"), "stage", "current", "n_events")


@query()
def chain_connect(spark, path):
    """The connections between chains of every image."""
    return _links_of(spark, path)


def _links_of(spark: SparkSession, path: str) -> DataFrame:
    from voxtree.operators.tracing import connections, spread, stored_images

    return connections(spread(stored_images(table(spark, path, "trace_result"))))


@query()
def geodesic_path(spark, path):
    """The cheapest way from the brightest voxel of the first slice to that of the last, of every image."""
    from voxtree.operators.tracing import end_to_end_paths, spread, stored_images

    return end_to_end_paths(spread(stored_images(table(spark, path, "trace_result"))))


# ---- more shapes ----

_SIX = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]


@query(f"""WITH {VOL}, n AS (SELECT z - dz AS z, y - dy AS y, x - dx AS x, max(v) AS best FROM vol, (VALUES (0,0,1),(0,0,-1),(0,1,0),(0,-1,0),(1,0,0),(-1,0,0)) o(dz, dy, dx) GROUP BY 1, 2, 3)
SELECT z, y, x, v FROM vol LEFT JOIN n USING (z, y, x) WHERE v > 0 AND (best IS NULL OR v > best)""")
def max_filter_6(spark, path):
    return voxels.maximum_filter(volume(spark, path), _SIX)


@query(f"""WITH {VOL}, o AS (SELECT dz, dy, dx FROM (VALUES (-1),(0),(1)) i(dz), (VALUES (-1),(0),(1)) j(dy), (VALUES (-1),(0),(1)) k(dx) WHERE (dz, dy, dx) > (0, 0, 0))
SELECT a.z::BIGINT * 1099511627776 + a.y::BIGINT * 1048576 + a.x AS u, b.z::BIGINT * 1099511627776 + b.y::BIGINT * 1048576 + b.x AS v,
round(sqrt(abs(dz) + abs(dy) + abs(dx)) * (1 / (1 + exp((a.v - 60.0) / 5)) + 1 / (1 + exp((b.v - 60.0) / 5)) + 1e-5), 6) AS w FROM vol a, o JOIN vol b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx""")
def lattice_edges(spark, path):
    return voxels.lattice_edges(volume(spark, path), 60.0, 5.0).select("u", "v", r6(F.col("w")).alias("w"))


@query(f"WITH {VOL} SELECT z, y, x, v, CAST((z IN (0, 15))::INT + (y IN (0, 31))::INT + (x IN (0, 31))::INT AS INT) AS faces FROM vol WHERE z IN (0, 15) OR y IN (0, 31) OR x IN (0, 31)")
def face_voxels(spark, path):
    return voxels.face_voxels(volume(spark, path), SHAPE)


@query(f"""WITH {SEG}, g AS (SELECT id, theta, psi, sx, sy, sz, i AS gx, j AS gy, k AS gz FROM seg, range(-11, 12) a(i), range(-6, 7) b(j), range(11) c(k) WHERE (i / (r * s)) ** 2 + (j / r) ** 2 <= 1)
SELECT DISTINCT id, CAST(round_even(gx * cos(psi) - (gy * cos(theta) - gz * sin(theta)) * sin(psi) + sx, 0) AS INT) AS x, CAST(round_even(gx * sin(psi) + (gy * cos(theta) - gz * sin(theta)) * cos(psi) + sy, 0) AS INT) AS y,
CAST(round_even(gy * sin(theta) + gz * cos(theta) + sz, 0) AS INT) AS z FROM g""")
def rasterize_segments(spark, path):
    return voxels.segment_voxels(segments(spark, path))


@query(f"""WITH {SEG}, d AS (SELECT id // 50 AS chain, sqrt((sx - lag(sx) OVER w) ** 2 + (sy - lag(sy) OVER w) ** 2 + (sz - lag(sz) OVER w) ** 2) AS d FROM seg WINDOW w AS (PARTITION BY id // 50 ORDER BY id))
SELECT chain, round(coalesce(sum(d), 0), 6) AS length FROM d GROUP BY 1""")
def chain_path_length(spark, path):
    s = segments(spark, path).select(F.floor(F.col("id") / 50).alias("chain"), "id", *[F.col(f"s{a}").alias(f"p{a}") for a in "xyz"])
    return voxels.path_lengths(s, ["chain"], "id").select("chain", r6(F.col("length")).alias("length"))


@query(f"""WITH {SEG}, t AS (SELECT id, (theta * 5) % (2 * pi()) AS t, psi * 3 AS p FROM seg)
SELECT id, round(CASE WHEN t > pi() THEN 2 * pi() - t ELSE t END, 6) AS theta, round((p + CASE WHEN t > pi() THEN pi() ELSE 0 END) % (2 * pi()), 6) AS psi FROM t""")
def normalize_angles(spark, path):
    theta, psi = g.normal_angles(F.col("theta") * 5, F.col("psi") * 3)
    return segments(spark, path).select("id", r6(theta).alias("theta"), r6(psi).alias("psi"))


@query(f"WITH {SEG} SELECT min(sx) AS x0, max(sx) AS x1, min(sy) AS y0, max(sy) AS y1, CAST(floor(min(sz) - 1.5) AS BIGINT) AS z0, CAST(ceil(max(sz) + 1.5) AS BIGINT) AS z1 FROM seg")
def bounding_box(spark, path):
    box = spatial.bounding_box(segments(spark, path), ("sx", "sy", "sz"))
    return box.select(
        F.col("sx0").alias("x0"), F.col("sx1").alias("x1"), F.col("sy0").alias("y0"), F.col("sy1").alias("y1"),
        F.floor(F.col("sz0") - 1.5).cast("bigint").alias("z0"), F.ceil(F.col("sz1") + 1.5).cast("bigint").alias("z1"),
    )
