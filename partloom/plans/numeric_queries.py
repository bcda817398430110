"""Queries over point clouds, face graphs, ensembles and repeated parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions.numbers import rounded
from partloom.operators import cloud, ensemble
from partloom.operators.features import mesh_density
from partloom.operators.greedy import repetition_groups as group_repeats
from partloom.plans.adapters import ctes, table, view

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


PTS = ctes("fx_points")


def _points(spark, sf_dir):
    return view(spark, sf_dir, "fx_points").withColumn("pid", F.col("pid").cast("long"))


@query(f"""{PTS}, c AS (SELECT sample_id, pid, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM fx_points WINDOW w AS (PARTITION BY sample_id)), s AS (SELECT sample_id, max(sqrt(x * x + y * y + z * z)) AS s FROM c GROUP BY 1)
SELECT c.sample_id, pid, round(x / s, 9) AS x, round(y / s, 9) AS y, round(z / s, 9) AS z FROM c JOIN s ON s.sample_id = c.sample_id""")
def unit_sphere(spark, sf_dir):
    return cloud.unit_sphere(_points(spark, sf_dir)).select("sample_id", "pid", *[F.round(k, 9).alias(k) for k in "xyz"])


@query(f"""{PTS}, n AS (SELECT c.sample_id, c.pid AS cid, p.pid, row_number() OVER (PARTITION BY c.sample_id, c.pid ORDER BY p.pid) AS rn FROM fx_points c JOIN fx_points p ON p.sample_id = c.sample_id WHERE (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z) <= 1.5e-1 * 1.5e-1),
f AS (SELECT sample_id, cid, list(pid ORDER BY pid) AS ids FROM n WHERE rn <= 8 GROUP BY 1, 2) SELECT sample_id, cid, array_to_string(list_concat(ids, list_transform(range(8 - len(ids)), lambda i: ids[1])), ',') AS ids FROM f""")
def ball_query(spark, sf_dir):
    p = _points(spark, sf_dir)
    centres = p.select("sample_id", F.col("pid").alias("cid"), "x", "y", "z")
    return cloud.ball_query(centres, p, 0.15, 8).select("sample_id", "cid", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"""{PTS}, d AS (SELECT q.sample_id, q.pid AS qid, p.pid, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2, p.x + p.y AS v FROM fx_points q JOIN fx_points p ON p.sample_id = q.sample_id),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, qid ORDER BY d2, pid) AS rn FROM d) SELECT sample_id, qid, round(sum(v / (d2 + 1e-8)) / sum(1e0 / (d2 + 1e-8)), 9) AS v FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def knn_interpolate(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.select("sample_id", F.col("pid").alias("qid"), "x", "y", "z")
    known = p.withColumn("v", F.col("x") + F.col("y"))
    return cloud.interpolate(q, known, "v").withColumn("v", F.round("v", 9))


@query(f"{PTS}, f AS (SELECT * FROM fx_points) SELECT a.sample_id, a.pid AS i, b.pid AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS d FROM f a JOIN f b ON b.sample_id = a.sample_id AND a.pid < b.pid")
def centroid_distance(spark, sf_dir):
    faces = _points(spark, sf_dir).withColumnRenamed("pid", "i")
    return cloud.centroid_distances(faces).withColumn("d", rounded(F.col("d"), 9))


@query("SELECT l_orderkey, l_linenumber, CAST(least(31, floor(ln(1e0 + greatest(0e0, least(l_quantity * 4e0, 1e2))) / (ln(101e0) / 32e0))) AS INT) AS bucket FROM lineitem")
def distance_buckets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cloud.distance_bucket(F.col("l_quantity") * 4.0).alias("bucket"))


PICK = "first_value(pid) OVER w AS pick, first_value(x) OVER w AS px, first_value(y) OVER w AS py, first_value(z) OVER w AS pz"


@query(f"""{PTS.replace('WITH', 'WITH RECURSIVE', 1)}, fp AS (SELECT 0 AS step, sample_id, pid, x, y, z, CAST('infinity' AS DOUBLE) AS d, {PICK} FROM fx_points WINDOW w AS (PARTITION BY sample_id ORDER BY pid)
UNION ALL SELECT step + 1, sample_id, pid, x, y, z, d, {PICK} FROM (SELECT step, sample_id, pid, x, y, z, least(d, (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS d FROM fp WHERE step < 7) WINDOW w AS (PARTITION BY sample_id ORDER BY d DESC, pid))
SELECT DISTINCT sample_id, step, pick AS pid FROM fp""")
def farthest_point_sample(spark, sf_dir):
    return cloud.farthest_points(_points(spark, sf_dir), 8)


# The covariance squared over and over tends to the projection on its main axis.
@query(f"""{PTS.replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT sample_id, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM fx_points GROUP BY 1),
q AS (SELECT 0 AS k, sample_id, xx / (xx + yy + zz) AS xx, xy / (xx + yy + zz) AS xy, xz / (xx + yy + zz) AS xz, yy / (xx + yy + zz) AS yy, yz / (xx + yy + zz) AS yz, zz / (xx + yy + zz) AS zz FROM c
UNION ALL SELECT k + 1, sample_id, xx / t, xy / t, xz / t, yy / t, yz / t, zz / t FROM (SELECT k, sample_id, xx * xx + xy * xy + xz * xz AS xx, xx * xy + xy * yy + xz * yz AS xy, xx * xz + xy * yz + xz * zz AS xz, xy * xy + yy * yy + yz * yz AS yy, xy * xz + yy * yz + yz * zz AS yz, xz * xz + yz * yz + zz * zz AS zz,
  xx * xx + 2 * xy * xy + 2 * xz * xz + yy * yy + 2 * yz * yz + zz * zz AS t FROM q WHERE k < 40)),
v AS (SELECT sample_id, CASE WHEN xx >= yy AND xx >= zz THEN [xx, xy, xz] WHEN yy >= zz THEN [xy, yy, yz] ELSE [xz, yz, zz] END AS v FROM q WHERE k = 40),
a AS (SELECT sample_id, v[1] / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS ax, v[2] / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS ay, v[3] / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS az FROM v),
d AS (SELECT p.sample_id, x - mx AS x, y - my AS y, z - mz AS z, ax, ay, az, (x - mx) * ax + (y - my) * ay + (z - mz) * az AS t FROM fx_points p JOIN c ON c.sample_id = p.sample_id JOIN a ON a.sample_id = p.sample_id)
SELECT sample_id, round(max(t) - min(t), 6) AS length, round(2 * max(sqrt((x - t * ax) ** 2 + (y - t * ay) ** 2 + (z - t * az) ** 2)), 6) AS diameter FROM d GROUP BY 1""")
def pca_axis(spark, sf_dir):
    p = _points(spark, sf_dir)
    return cloud.axis_measures(p, cloud.principal_axis(p)).select("sample_id", F.round("length", 6).alias("length"), F.round("diameter", 6).alias("diameter"))


EF = "ef AS (SELECT l_orderkey % 400 AS sample_id, l_partkey % 97 AS edge_index, l_suppkey % 30 AS face_index FROM lineitem)"
NORMALS = "nm AS (SELECT sample_id, face_index, cos(t) AS nx, sin(t) AS ny, 0e0 AS nz FROM (SELECT l_orderkey % 400 AS sample_id, l_suppkey % 30 AS face_index, CAST(min(l_partkey) % 31 AS DOUBLE) * 1e-1 AS t FROM lineitem GROUP BY 1, 2))"


def _face_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ef = li.select((F.col("l_orderkey") % 400).alias("sample_id"), (F.col("l_partkey") % 97).alias("edge_index"), (F.col("l_suppkey") % 30).alias("face_index"))
    normals = li.groupBy((F.col("l_orderkey") % 400).alias("sample_id"), (F.col("l_suppkey") % 30).alias("face_index")).agg((F.min("l_partkey") % 31).cast("double").alias("turn"))
    t = F.col("turn") * 0.1
    return cloud.face_adjacency(ef, normals.select("sample_id", "face_index", F.cos(t).alias("nx"), F.sin(t).alias("ny"), F.lit(0.0).alias("nz")))


ADJ = f"WITH RECURSIVE {EF}, {NORMALS}, adj AS (SELECT DISTINCT a.sample_id, a.face_index AS i, b.face_index AS j FROM ef a JOIN ef b ON a.sample_id = b.sample_id AND a.edge_index = b.edge_index AND a.face_index < b.face_index)"


@query(ADJ + " SELECT d.sample_id, d.i, d.j, round(acos(greatest(-1e0, least(1e0, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz))), 7) AS angle FROM adj d JOIN nm a ON a.sample_id = d.sample_id AND a.face_index = d.i JOIN nm b ON b.sample_id = d.sample_id AND b.face_index = d.j")
def face_adjacency(spark, sf_dir):
    return _face_edges(spark, sf_dir).withColumn("angle", F.round("angle", 7))


@query(ADJ + """, e AS (SELECT sample_id, i, j FROM adj UNION SELECT sample_id, j, i FROM adj), nodes AS (SELECT DISTINCT sample_id, i FROM e), walk AS (SELECT sample_id, i, i AS j, 0 AS d FROM nodes UNION SELECT w.sample_id, w.i, e.j, w.d + 1 FROM walk w JOIN e ON e.sample_id = w.sample_id AND e.i = w.j WHERE w.d < 29)
SELECT sample_id, i, j, CAST(min(d) AS DOUBLE) AS d FROM walk GROUP BY 1, 2, 3""")
def shortest_paths(spark, sf_dir):
    return cloud.shortest_paths(_face_edges(spark, sf_dir))


# Paths through faces 0 .. k - 1 only, for k up to 30.
@query(ADJ + """, e AS (SELECT d.sample_id, d.i, d.j, acos(greatest(-1e0, least(1e0, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz))) AS w FROM adj d JOIN nm a ON a.sample_id = d.sample_id AND a.face_index = d.i JOIN nm b ON b.sample_id = d.sample_id AND b.face_index = d.j),
both_ AS (SELECT sample_id, i, j, w FROM e UNION ALL SELECT sample_id, j, i, w FROM e), fw AS (SELECT 0 AS k, sample_id, i, j, min(w) AS d FROM (SELECT * FROM both_ UNION ALL SELECT DISTINCT sample_id, i, i, 0e0 FROM both_) GROUP BY 2, 3, 4
UNION ALL SELECT k + 1, sample_id, i, j, min(d) FROM (SELECT k, sample_id, i, j, d FROM fw UNION ALL SELECT a.k, a.sample_id, a.i, b.j, a.d + b.d FROM fw a JOIN fw b ON a.sample_id = b.sample_id AND a.j = a.k AND b.i = a.k) WHERE k < 30 GROUP BY 1, 2, 3, 4)
SELECT sample_id, i, j, round(d, 6) AS d, round(d, 6) AS edge_path FROM fw WHERE k = 30""")
def angular_paths(spark, sf_dir):
    paths = cloud.shortest_paths(_face_edges(spark, sf_dir), weighted=True).withColumn("d", F.round("d", 6))
    return paths.withColumn("edge_path", F.col("d"))


@query(f"{PTS} SELECT sample_id, max(x) AS x, max(y) AS y, max(z) AS z FROM fx_points GROUP BY sample_id")
def max_pool(spark, sf_dir):
    return cloud.max_pool(_points(spark, sf_dir), ["sample_id"], ["x", "y", "z"])


# In order: a part that isn't taken seeds the later free parts near it.
@query(f"""{ctes('fx_dims').replace('WITH', 'WITH RECURSIVE', 1)}, p AS MATERIALIZED (SELECT part_id, bcyl_d AS d, bcyl_l AS l, CASE WHEN part_id % 3 = 0 THEN 0e0 ELSE bcyl_d * bcyl_l * (1e0 + 15e-3 * CAST(part_id % 5 AS DOUBLE)) END AS v, row_number() OVER (ORDER BY part_id) AS i FROM fx_dims WHERE bcyl_d > 0 AND bcyl_l > 0),
near AS MATERIALIZED (SELECT s.i, list(b.i ORDER BY b.i) AS js FROM p s JOIN p b ON b.i > s.i AND abs(s.d - b.d) / s.d <= 2e-2 AND abs(s.l - b.l) / s.l <= 2e-2 AND CASE WHEN s.v > 0 AND b.v > 0 THEN abs(s.v - b.v) / s.v <= 2e-2 ELSE true END GROUP BY s.i),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS own
UNION ALL SELECT i + 1, CASE WHEN len(own) > 0 THEN list_concat(list_append(taken, i + 1), own) ELSE taken END, own FROM (SELECT g.i, g.taken, CASE WHEN n.js IS NULL OR list_contains(g.taken, g.i + 1) THEN CAST([] AS BIGINT[]) ELSE list_filter(n.js, lambda j: NOT list_contains(g.taken, j)) END AS own FROM g LEFT JOIN near n ON n.i = g.i + 1 WHERE g.i < (SELECT max(i) FROM p))),
m AS (SELECT i AS seed, unnest(list_append(own, i)) AS i, len(own) + 1 AS repetition FROM g WHERE len(own) > 0)
SELECT p.part_id, s.part_id AS seed_id, m.repetition FROM m JOIN p ON p.i = m.i JOIN p s ON s.i = m.seed""")
def repetition_groups(spark, sf_dir):
    f, k = view(spark, sf_dir, "fx_dims"), F.col("part_id")
    volume = F.when(k % 3 == 0, 0.0).otherwise(F.col("bcyl_d") * F.col("bcyl_l") * (1.0 + 0.015 * (k % 5).cast("double")))
    return group_repeats(f.select("part_id", k.alias("ord"), F.col("bcyl_d").alias("diameter"), F.col("bcyl_l").alias("length"), volume.alias("volume")))


RULE_TYPES = ("unclassified", "hex_bolt", "possible_hex_nut", "flat_washer")
ML_TYPES = ("unclassified", "likely_hex_bolt", "non_fastener", "hex_nut", "likely_flat_washer")


def _ensemble(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    part = lambda m, d: (k * m % d).cast("double") / float(d)
    return p.select(
        k.alias("part_id"), pick(RULE_TYPES, k % 4).alias("rule_type"), F.when(k % 4 == 0, 0.0).otherwise(part(37, 101)).alias("rule_conf"),
        pick(ML_TYPES, k % 5).alias("ml_label"), F.when(k % 5 == 0, 0.0).otherwise(part(53, 103)).alias("ml_conf"), part(17, 29).alias("p_non"),
    )


ENSEMBLE = f"""e AS (SELECT p_partkey AS part_id, [{", ".join(f"'{x}'" for x in RULE_TYPES)}][p_partkey % 4 + 1] AS rule_type, CASE WHEN p_partkey % 4 = 0 THEN 0e0 ELSE CAST(p_partkey * 37 % 101 AS DOUBLE) / 101e0 END AS r,
[{", ".join(f"'{x}'" for x in ML_TYPES)}][p_partkey % 5 + 1] AS ml_label, CASE WHEN p_partkey % 5 = 0 THEN 0e0 ELSE CAST(p_partkey * 53 % 103 AS DOUBLE) / 103e0 END AS m, CAST(p_partkey * 17 % 29 AS DOUBLE) / 29e0 AS pn FROM part),
b AS (SELECT *, replace(rule_type, 'possible_', '') AS rb, replace(ml_label, 'likely_', '') AS mb FROM e),
c AS (SELECT *, CASE WHEN rb = 'unclassified' AND mb = 'unclassified' THEN 1 WHEN rb = mb THEN 2 WHEN rb = 'unclassified' AND mb <> 'non_fastener' AND (m < 4e-1 OR m < pn) THEN 3 WHEN mb = 'non_fastener' AND rb <> 'unclassified' AND r >= 5e-1 THEN 4 WHEN m > r THEN 5 ELSE 6 END AS merge_case FROM b)"""


@query(f"""WITH {ENSEMBLE} SELECT part_id, merge_case, CASE merge_case WHEN 1 THEN 'unclassified' WHEN 2 THEN rb WHEN 3 THEN 'unclassified' WHEN 5 THEN ml_label ELSE rule_type END AS merged_type,
CASE merge_case WHEN 1 THEN 0e0 WHEN 2 THEN round(least(1e0, r + 3e-1 * m), 4) WHEN 3 THEN 0e0 WHEN 5 THEN m ELSE r END AS merged_conf FROM c""")
def ensemble_merge(spark, sf_dir):
    return ensemble.merged(_ensemble(spark, sf_dir)).select("part_id", "merge_case", "merged_type", "merged_conf")


class AspectModel:
    """A model small enough to be told in SQL: the further a part's length over diameter is from a class's own, the less likely."""

    classes = ("washer", "nut", "screw", "rod")
    centres = (0.25, 1.0, 4.0, 16.0)

    def __call__(self, features):
        import numpy as np

        gap = np.abs(features["aspect"].to_numpy(float)[:, None] - np.array(self.centres))
        raw = 1.0 / (1.0 + gap)
        return raw / (raw[:, :1] + raw[:, 1:2] + raw[:, 2:3] + raw[:, 3:])


@query(f"""{ctes('fx_dims')}, r AS (SELECT part_id, c, name, 1e0 / (1e0 + abs(aspect - centre)) AS raw FROM fx_dims, (VALUES (0, 'washer', 25e-2), (1, 'nut', 1e0), (2, 'screw', 4e0), (3, 'rod', 16e0)) m(c, name, centre)),
s AS (SELECT part_id, sum(raw) AS total FROM r GROUP BY 1), p AS (SELECT r.part_id, c, name, raw / total AS prob FROM r JOIN s ON s.part_id = r.part_id)
SELECT part_id, CAST(row_number() OVER (PARTITION BY part_id ORDER BY round(prob, 12) DESC, c) - 1 AS INT) AS rank, name AS cls, round(prob, 9) AS prob FROM p""")
def scored_parts(spark, sf_dir):
    parts = view(spark, sf_dir, "fx_dims").select("part_id", "aspect")
    found = ensemble.scored_by(parts, AspectModel, AspectModel.classes)
    return found.select("part_id", F.posexplode("scores").alias("rank", "s")).select("part_id", "rank", "s.cls", F.round("s.prob", 9).alias("prob"))


CLASSES = ("washers", "screws", "nuts", "non_fastener", "pins", "spacers")


def _model(spark, sf_dir):
    f = view(spark, sf_dir, "fx_dims")
    k, s = F.col("part_id"), F.array_sort(F.array("dx", "dy", "dz"))
    name = lambda i: F.get(F.array(*map(F.lit, CLASSES)), ((k + i) % 6).cast("int"))
    top3 = F.array(*[F.struct(name(i).alias("cls"), F.lit(p).alias("prob")) for i, p in enumerate((0.5, 0.3, 0.2))])
    few = lambda n: F.filter(F.array(F.col("bcyl_d") / 2, F.col("head_d") / 2), lambda r: r.isNotNull()) if n else F.array().cast("array<double>")
    return f.select(
        k.alias("sample_id"), top3.alias("top3"), "aspect", s[0].alias("d0"), s[1].alias("d1"), s[2].alias("d2"), few(1).alias("ext"), F.when(f.kind.isin(3, 4), F.array(F.col("bcyl_d") / 4)).otherwise(few(0)).alias("internal"),
        (k % 9).cast("int").alias("n_plane"), F.when(k % 4 == 0, 2).otherwise(0).alias("n_cone"), F.when(k % 8 == 0, 1).otherwise(0).alias("n_torus"), F.lit(0).alias("n_sphere"), (k % 40 + 6).cast("int").alias("num_faces"), "cyl_ratio", "bcyl_d", "bcyl_l", "head_d",
    )


MODEL = f"""{ctes('fx_dims')}, g AS (SELECT part_id AS k, aspect AS a, list_sort([dx, dy, dz])[1] / list_sort([dx, dy, dz])[3] AS f, kind, CASE WHEN head_d IS NULL THEN 1 ELSE 2 END AS ne, CASE WHEN kind IN (3, 4) THEN 1 ELSE 0 END AS ni,
part_id % 4 = 0 AS shaped, coalesce(head_d >= 13e-1 * bcyl_d AND (head_d - bcyl_d) / bcyl_d > 5e-2, false) AS stepped, CAST(part_id % 40 + 6 AS INT) AS num_faces FROM fx_dims),
t AS (SELECT g.*, i.i, [{", ".join(f"'{x}'" for x in CLASSES)}][(k + i.i) % 6 + 1] AS cls FROM g CROSS JOIN (SELECT unnest(range(3)) AS i) i),
s AS (SELECT *, NOT coalesce(CASE cls WHEN 'washers' THEN NOT (f <= 35e-2 AND a <= 15e-1) WHEN 'pins' THEN (f <= 3e-1 AND ne <= 2) OR (shaped AND a < 2)
 WHEN 'screws' THEN (f <= 25e-2 AND a <= 15e-1) OR (ne = 0 AND ni >= 1) OR (a >= 2 AND NOT shaped AND NOT stepped) WHEN 'nuts' THEN a > 3 OR (ni = 0 AND ne >= 1) WHEN 'spacers' THEN f > 6e-1 AND a < 1 ELSE false END, false) AS ok FROM t),
w AS (SELECT k, any_value(num_faces) AS num_faces, max(ok) FILTER (i = 0) AS ok0, max(ok AND cls <> 'non_fastener') FILTER (i = 1) AS ok1, max(ok AND cls <> 'non_fastener') FILTER (i = 2) AS ok2, max(cls) FILTER (i = 0) AS c0, max(cls) FILTER (i = 1) AS c1, max(cls) FILTER (i = 2) AS c2 FROM s GROUP BY k),
r AS (SELECT *, CASE WHEN ok0 THEN 0 WHEN c1 = 'non_fastener' THEN -1 WHEN ok1 THEN 1 WHEN ok2 THEN 2 ELSE -1 END AS rank FROM w)"""


@query(MODEL + " SELECT k AS sample_id, CASE rank WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE 'unclassified' END AS ml_type, CASE rank WHEN 0 THEN 5e-1 WHEN 1 THEN 3e-1 WHEN 2 THEN 2e-1 ELSE 0e0 END AS ml_conf, CASE rank WHEN 0 THEN 'top1_pass' WHEN -1 THEN 'demoted' ELSE 'recovered' END AS ml_action FROM r")
def topk_recovery(spark, sf_dir):
    return ensemble.recovered(_model(spark, sf_dir)).select("sample_id", "ml_type", "ml_conf", "ml_action")


@query(MODEL + """, h AS (SELECT *, k % 5 = 0 AND CAST(k * 37 % 101 AS DOUBLE) / 101e0 >= 9e-1 AS sure, k % 7 = 0 AS no_model FROM r) SELECT k AS sample_id,
CASE WHEN sure THEN 'screws' WHEN no_model THEN 'non_fastener' WHEN num_faces > 40 THEN c0 WHEN rank = 0 THEN c0 WHEN rank = 1 THEN c1 WHEN rank = 2 THEN c2 ELSE 'non_fastener' END AS pred,
CASE WHEN sure THEN 'rules' WHEN no_model THEN 'none' ELSE 'ml' END AS stage, CASE WHEN sure OR no_model THEN NULL WHEN num_faces > 40 THEN 'face_cap' WHEN rank = 0 THEN 'top1_pass' WHEN rank = -1 THEN 'demoted' ELSE 'recovered' END AS action FROM h""")
def hybrid_cascade(spark, sf_dir):
    m = _model(spark, sf_dir)
    k = F.col("sample_id")
    rules = m.select("sample_id", F.lit("screws").alias("rule_cls"), F.when(k % 5 == 0, (k * 37 % 101).cast("double") / 101.0).otherwise(0.0).alias("rule_conf"), F.lit(None).cast("string").alias("rule_error"))
    return ensemble.hybrid_cascade(rules, m.where(k % 7 != 0).select("sample_id", "top3"), m.drop("top3"), face_cap=40)


@query("SELECT p_partkey, CASE WHEN d <= 5e-2 THEN 'ultra' WHEN d <= 15e-2 THEN 'high' WHEN d <= 5e-1 THEN 'medium' WHEN d <= 15e-1 THEN 'low' WHEN d <= 3e0 THEN 'lowpoly' ELSE 'potato' END AS density FROM (SELECT p_partkey, least(p_size / 1e1, p_partkey % 100 / 1e1) AS d FROM part)")
def mesh_density_label(spark, sf_dir):
    d = mesh_density(F.col("p_size") / 10.0, F.col("p_partkey") % 100 / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", d["density"].alias("density"))
