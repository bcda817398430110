"""Queries over parts, standards, holes and joints."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import features as ft
from partloom.operators import joints, standards
from partloom.operators.plumbing import canonical_parts, dedup_summary
from partloom.operators.signature import with_signature
from partloom.plans.adapters import ctes, table, view
from partloom.tables import dealt

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


ISO_VALUES = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else (f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)) for x in r) + ")" for r in standards.standard_rows())
ISO = f"iso(std_ord, variant_ord, standard, type, variant, ref_shaft, ref_head, ref_height, ref_pitch) AS (VALUES {ISO_VALUES})"
BOLT, NUT, WASH = (", ".join(f"'{k}'" for k in kinds) for kinds in (standards.BOLTS, standards.NUTS, standards.WASHERS))


def _grade(diff: str, full: str, part: str) -> str:
    return f"coalesce(CASE WHEN {diff} <= 5e-1 THEN {full} WHEN {diff} <= 15e-1 THEN {part} * (1e0 - {diff} / 15e-1) END, 0e0)"


SCORED = f"""scored AS (
SELECT f.*, i.*, {_grade("abs(f.bcyl_d - i.ref_shaft)", "3e-1", "15e-2")} + {_grade("abs(f.head_d - i.ref_head)", "2e-1", "1e-1")}
  + {_grade("abs(f.head_h - i.ref_height)", "15e-2", "7e-2")} + CASE WHEN i.ref_pitch > 0 AND f.has_thread THEN 5e-2 ELSE 0e0 END
  + CASE WHEN i.type IN ({BOLT}) AND f.aspect BETWEEN 15e-1 AND 15e0 THEN 1e-1 WHEN i.type IN ({NUT}) AND f.aspect BETWEEN 3e-1 AND 15e-1 THEN 1e-1
         WHEN i.type IN ({WASH}) AND f.aspect BETWEEN 5e-2 AND 5e-1 THEN 1e-1 ELSE 0e0 END
  + CASE WHEN f.cyl_ratio > 5e-1 THEN 5e-2 ELSE 0e0 END AS score
FROM fx_dims f CROSS JOIN iso i WHERE f.cyl_ratio >= 15e-2 AND f.aspect >= 2e-2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY score DESC, std_ord, variant_ord) AS rn FROM scored WHERE score > 0) WHERE rn = 1)"""
MATCH = f"{ctes('fx_dims')}, {ISO}, {SCORED}"


def _eligible(spark, sf_dir):
    return view(spark, sf_dir, "fx_dims").where("cyl_ratio >= 0.15D and aspect >= 0.02D")


def _scored(spark, sf_dir):
    return standards.score_all(_eligible(spark, sf_dir), standards.standards(spark))


@query(MATCH + " SELECT part_id, standard, variant, type, score, CASE WHEN score < 6e-1 THEN 'unclassified' WHEN score < 9e-1 THEN 'possible_' || type ELSE type END AS band FROM best")
def iso_best_match(spark, sf_dir):
    best = standards.best_of(_eligible(spark, sf_dir))
    return best.select("part_id", "standard", "variant", "type", "score", standards.confidence_band(F.col("type"), F.col("score")).alias("band"))


@query(MATCH + " SELECT part_id, standard, variant, score FROM scored")
def iso_score_all(spark, sf_dir):
    return _scored(spark, sf_dir).select("part_id", "standard", "variant", "score")


@query(MATCH + " SELECT standard, variant, count(*) AS n FROM best GROUP BY 1, 2")
def iso_standard_histogram(spark, sf_dir):
    return standards.best_counts(_eligible(spark, sf_dir)).groupBy("standard", "variant").agg(F.sum("n").alias("n"))


@query(f"{ctes('fx_dims')}, s AS (SELECT part_id, list_sort([dx, dy, dz]) AS d FROM fx_dims) SELECT part_id, (d[1] + d[2]) / 2 AS bcyl_d, d[3] AS bcyl_l, CASE WHEN (d[1] + d[2]) / 2 > 1e-12 THEN d[3] / ((d[1] + d[2]) / 2) ELSE 0e0 END AS aspect FROM s")
def bounding_cylinder(spark, sf_dir):
    return ft.bounding_cylinder(view(spark, sf_dir, "fx_dims").select("part_id", "dx", "dy", "dz")).select("part_id", "bcyl_d", "bcyl_l", "aspect")


@query(f"{ctes('fx_dims')}, s AS (SELECT part_id, list_sort([dx, dy, dz]) AS d FROM fx_dims) SELECT part_id, d[1] / d[3] AS disc_aspect, d[1] / d[3] <= 4e-1 AND d[2] / d[3] >= 8e-1 AS is_disc FROM s")
def disc_shape(spark, sf_dir):
    return ft.disc_shape(view(spark, sf_dir, "fx_dims").select("part_id", "dx", "dy", "dz")).select("part_id", "disc_aspect", "is_disc")


@query(f"{ctes('fx_cylinders')} SELECT part_id, count(*) AS n_cyl, count(DISTINCT round(radius, 2)) AS n_radii, count(*) > 6 AND CAST(count(*) AS DOUBLE) / count(DISTINCT round(radius, 2)) > 3 AS has_thread FROM fx_cylinders GROUP BY part_id")
def thread_flag(spark, sf_dir):
    return ft.thread_flag(view(spark, sf_dir, "fx_cylinders"))


@query(f"""{ctes('fx_cylinders')}, t AS (SELECT part_id, max(radius) AS mr, median(radius) AS md FROM fx_cylinders GROUP BY part_id)
SELECT c.part_id, 2 * max(c.radius) AS head_d, arg_min(c.length, c.face_index) AS head_h FROM fx_cylinders c JOIN t ON t.part_id = c.part_id WHERE c.radius = t.mr AND t.mr > 13e-1 * t.md GROUP BY c.part_id""")
def head_detect(spark, sf_dir):
    return ft.head_detect(view(spark, sf_dir, "fx_cylinders"))


@query(f"""{ctes('fx_cylinders')} SELECT part_id, {", ".join(f"CAST(count(*) FILTER (stype = '{k}') AS INT) AS n_{k}" for k in ("plane", "cylinder", "cone", "sphere", "torus", "nurbs"))}, CAST(count(*) AS INT) AS num_faces,
round(sum(length * radius), 6) AS area, round(coalesce(sum(CASE WHEN stype = 'cylinder' THEN 2e0 * pi() * radius * length ELSE 0e0 END), 0) / greatest(sum(length * radius), 1e-12), 6) AS cyl_ratio FROM fx_cylinders GROUP BY part_id""")
def face_histogram(spark, sf_dir):
    faces = view(spark, sf_dir, "fx_cylinders").withColumn("area", F.col("length") * F.col("radius"))
    return ft.face_histogram(faces).withColumn("area", F.round("area", 6)).withColumn("cyl_ratio", F.round("cyl_ratio", 6))


@query(f"""{ctes('fx_cylinders')}, r AS (SELECT part_id, radius, row_number() OVER (PARTITION BY part_id ORDER BY radius) AS i FROM fx_cylinders),
walk AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT part_id, i, radius, radius AS head, 0 AS c FROM r WHERE i = 1
  UNION ALL SELECT r.part_id, r.i, r.radius, CASE WHEN (r.radius - w.head) / greatest(w.head, 1e-9) <= 5e-2 THEN w.head ELSE r.radius END, CASE WHEN (r.radius - w.head) / greatest(w.head, 1e-9) <= 5e-2 THEN w.c ELSE w.c + 1 END
  FROM w JOIN r ON r.part_id = w.part_id AND r.i = w.i + 1) SELECT * FROM w))
SELECT part_id, CAST(c AS INT) AS cluster, median(radius) AS median_r, CAST(count(*) AS INT) AS n FROM walk GROUP BY part_id, c""")
def radius_clusters(spark, sf_dir):
    radii = view(spark, sf_dir, "fx_cylinders").groupBy("part_id").agg(F.collect_list("radius").alias("rs"))
    c = radii.select("part_id", F.posexplode(ft.radius_clusters(F.col("rs"))).alias("cluster", "c"))
    return c.select("part_id", "cluster", F.col("c.median").alias("median_r"), F.col("c.n").alias("n"))


@query(f"""{ctes('fx_cylinders')} SELECT part_id, face_index, radius, length, is_internal FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY is_internal, length DESC, face_index) AS rn FROM fx_cylinders) WHERE rn = 1""")
def principal_shaft(spark, sf_dir):
    return joints.principal_shaft(view(spark, sf_dir, "fx_cylinders")).select("part_id", "face_index", "radius", "length", "is_internal")


def _sig_features(spark, sf_dir):
    d, r = view(spark, sf_dir, "fx_dims"), view(spark, sf_dir, "fx_radii")
    radii = r.groupBy("part_id").agg(F.collect_list(F.when(~F.col("inner_"), F.col("r"))).alias("ext"), F.collect_list(F.when(F.col("inner_"), F.col("r"))).alias("internal"))
    s = F.array_sort(F.array("dx", "dy", "dz"))
    k = F.col("part_id")
    counts = {"n_plane": k % 9, "n_cone": F.when(k % 4 == 0, 2).otherwise(0), "n_torus": F.when(k % 8 == 0, 1).otherwise(0), "n_sphere": F.lit(0), "num_faces": k % 40 + 6}
    return d.join(radii, "part_id").withColumns({"d0": s[0], "d1": s[1], "d2": s[2], "volume": F.col("bcyl_d") * F.col("bcyl_l"), **{n: v.cast("int") for n, v in counts.items()}})


# Clusters of radii by a walk in rising order; then the decision list, the first rule that holds.
SIGNED = f"""{ctes('fx_dims', 'fx_radii').replace('WITH', 'WITH RECURSIVE', 1)}, placed AS (SELECT part_id, inner_, r, row_number() OVER (PARTITION BY part_id, inner_ ORDER BY r) AS i FROM fx_radii),
stepped AS (SELECT part_id, inner_, i, r, r AS head, 0 AS c FROM placed WHERE i = 1
  UNION ALL SELECT p.part_id, p.inner_, p.i, p.r, CASE WHEN (p.r - w.head) / greatest(w.head, 1e-9) <= 5e-2 THEN w.head ELSE p.r END, CASE WHEN (p.r - w.head) / greatest(w.head, 1e-9) <= 5e-2 THEN w.c ELSE w.c + 1 END
  FROM stepped w JOIN placed p ON p.part_id = w.part_id AND p.inner_ = w.inner_ AND p.i = w.i + 1),
clusters AS (SELECT part_id, inner_, c, median(r) AS m, count(*) AS n FROM stepped GROUP BY 1, 2, 3),
of_clusters AS (SELECT part_id, count(*) FILTER (NOT inner_) AS nec, count(*) FILTER (inner_) AS nic, arg_min(m, c) FILTER (NOT inner_) AS first_, arg_max(m, c) FILTER (NOT inner_) AS last_, arg_max(m, n * 1000e0 + m) FILTER (NOT inner_) AS common FROM clusters GROUP BY 1),
of_radii AS (SELECT part_id, count(*) FILTER (NOT inner_) AS ne, count(*) FILTER (inner_) AS ni, max(r) FILTER (inner_) AS mi, min(r) FILTER (inner_) AS li, min(r) FILTER (NOT inner_) AS me, max(r) FILTER (NOT inner_) AS top_e, median(r) FILTER (NOT inner_) AS med_e, median(r) FILTER (inner_) AS med_i FROM fx_radii GROUP BY 1),
wide AS (SELECT f.*, list_sort([dx, dy, dz]) AS d, r.* EXCLUDE (part_id), c.* EXCLUDE (part_id), CAST(f.part_id % 9 AS INT) AS np, CASE WHEN f.part_id % 4 = 0 THEN 2 ELSE 0 END AS nco, CASE WHEN f.part_id % 8 = 0 THEN 1 ELSE 0 END AS nto, CAST(f.part_id % 40 + 6 AS INT) AS nf FROM fx_dims f JOIN of_radii r ON r.part_id = f.part_id JOIN of_clusters c ON c.part_id = f.part_id),
x AS (SELECT *, aspect AS a, d[1] / d[3] AS f, nco + nto >= 1 OR coalesce(head_d > 0, false) OR coalesce(nec >= 2 AND last_ >= 13e-1 * first_, false) AS h FROM wide),
ruled AS (SELECT *, CASE WHEN d[3] > 5e2 OR bcyl_d * bcyl_l > 5e5 OR coalesce(ne > 0 AND me > 30, false) THEN 0
 WHEN coalesce(f <= 4e-1 AND d[2] / d[3] >= 8e-1 AND ni >= 1 AND ne >= 1 AND np >= 2 AND nf <= 60 AND nto <= 4 AND top_e > 115e-2 * li, false) THEN 1
 WHEN coalesce(a BETWEEN 2e-1 AND 18e-1 AND ni >= 1 AND np >= 6 AND mi > 0 AND (NOT coalesce(top_e > 12e-1 * med_i, false) OR a < 8e-1), false) THEN 2
 WHEN coalesce(a BETWEEN 1e0 AND 15e0 AND ne >= 2 AND ni >= 1 AND nec >= 2 AND last_ >= 13e-1 * first_ AND mi > 0 AND mi < 11e-1 * first_ AND first_ <= 30, false) THEN 3
 WHEN coalesce(a BETWEEN 12e-1 AND 15e0 AND ne >= 1 AND h AND np >= 6 AND (ni = 0 OR mi < 6e-1 * me), false) THEN CASE WHEN common > 30 THEN 0 ELSE 4 END
 WHEN coalesce(a >= 5 AND f <= 25e-2 AND nco >= 1 AND ne >= 3 AND ni >= 1, false) THEN CASE WHEN med_e > 15 THEN 0 ELSE 5 END
 WHEN coalesce(a >= 3 AND f <= 35e-2 AND ne >= 1 AND NOT h AND np <= 10 AND (ni = 0 OR mi < 5e-1 * me), false) THEN CASE WHEN med_e > 30 THEN 0 ELSE 6 END
 WHEN coalesce(a BETWEEN 4e-1 AND 10e0 AND f <= 5e-1 AND ne >= 1 AND NOT h AND ni = 0 AND np <= 4 AND med_e BETWEEN 4e-1 AND 10e0, false) THEN 7
 WHEN coalesce(a BETWEEN 4e-1 AND 30e0 AND f <= 5e-1 AND ne >= 2 AND nec >= 2 AND ni = 0 AND np <= 6 AND first_ BETWEEN 4e-1 AND 30e0 AND last_ / first_ BETWEEN 11e-1 AND 3e0, false) THEN 8
 WHEN coalesce(a BETWEEN 5e-1 AND 25e-1 AND f BETWEEN 4e-1 AND 1e0 AND ni >= 1 AND np BETWEEN 4 AND 6 AND mi > 0 AND med_i BETWEEN 1e0 AND 20e0, false) THEN 9
 WHEN coalesce(a BETWEEN 7e-1 AND 22e-1 AND f <= 7e-1 AND ni >= 3 AND ne >= 6 AND nec = 1 AND nic <= 3 AND mi > 0 AND nco >= 2 AND np >= 2 AND med_i BETWEEN 15e-1 AND 15e0 AND last_ > 115e-2 * med_i, false) THEN 10
 WHEN coalesce(a BETWEEN 5e-1 AND 4e0 AND f <= 4e-1 AND ne >= 1 AND NOT h AND ni >= 1 AND mi > 0 AND mi < 9e-1 * me, false) THEN CASE WHEN med_e > 30 THEN 0 ELSE 11 END ELSE 0 END AS sig_rule FROM x),
signed AS (SELECT *, ['flat_washer', 'hex_nut', 'socket_head_cap_screw', 'hex_bolt', 'wood_screw', 'threaded_stud', 'dowel_pin', 'dowel_pin', 'square_nut', 'threaded_insert', 'set_screw'][nullif(sig_rule, 0)] AS sig_type, [9e-1, 9e-1, 88e-2, 85e-2, 75e-2, 8e-1, 78e-2, 78e-2, 82e-2, 78e-2, 75e-2][nullif(sig_rule, 0)] AS sig_conf,
 CASE sig_rule WHEN 1 THEN 2 * li WHEN 3 THEN 2 * first_ WHEN 8 THEN 2 * first_ WHEN 4 THEN 2 * common WHEN 2 THEN 2 * med_i WHEN 9 THEN 2 * med_i WHEN 10 THEN 2 * med_i WHEN 0 THEN NULL ELSE 2 * med_e END AS sig_shaft,
 CASE sig_rule WHEN 1 THEN 2 * top_e WHEN 2 THEN greatest(d[2], 3 * med_i) WHEN 3 THEN 2 * last_ WHEN 4 THEN 2 * CASE WHEN last_ <= 11e-1 * common THEN bcyl_d / 2 ELSE last_ END WHEN 5 THEN 2 * top_e WHEN 8 THEN 2 * last_ WHEN 9 THEN d[2] WHEN 10 THEN 2 * last_ WHEN 0 THEN NULL ELSE 2 * med_e END AS sig_head,
 nco + nto >= 1 OR coalesce(nec >= 2 AND last_ >= 13e-1 * first_, false) OR coalesce(bcyl_d > 0 AND head_d >= 13e-1 * bcyl_d, false) AS strict_head FROM ruled)"""


@query(SIGNED + " SELECT part_id, sig_rule, sig_type, sig_conf, round(sig_shaft, 9) AS sig_shaft, round(sig_head, 9) AS sig_head, strict_head FROM signed")
def part_signature(spark, sf_dir):
    return with_signature(_sig_features(spark, sf_dir)).select("part_id", "sig_rule", "sig_type", "sig_conf", F.round("sig_shaft", 9).alias("sig_shaft"), F.round("sig_head", 9).alias("sig_head"), "strict_head")


FAMILY = f"CASE WHEN sig_type IN ('hex_bolt', 'socket_head_cap_screw', 'threaded_stud', 'set_screw', 'wood_screw', 'dowel_pin') THEN i.type IN ({BOLT}) WHEN sig_type IN ('hex_nut', 'square_nut', 'threaded_insert') THEN i.type IN ({NUT}) WHEN sig_type = 'flat_washer' THEN i.type IN ({WASH}) ELSE true END"
MEASURED = "coalesce(sig_shaft > 0, false)"
SHAFT_GAP = f"least(CASE WHEN {MEASURED} THEN abs(sig_shaft - i.ref_shaft) END, CASE WHEN {MEASURED} AND sig_type = 'hex_nut' THEN abs(sig_shaft + 15e-1 - i.ref_shaft) END, CASE WHEN NOT {MEASURED} AND bcyl_d > 0 THEN abs(bcyl_d - i.ref_shaft) END)"
HEAD_GAP = "least(CASE WHEN sig_head > 0 THEN abs(sig_head - i.ref_head) END, abs(head_d - i.ref_head))"


@query(f"""{SIGNED}, {ISO}, graded AS (SELECT s.part_id, i.*, {_grade(SHAFT_GAP, "3e-1", "15e-2")} + {_grade(HEAD_GAP, "2e-1", "1e-1")} + {_grade("abs(head_h - i.ref_height)", "15e-2", "7e-2")} + CASE WHEN i.ref_pitch > 0 AND has_thread THEN 5e-2 ELSE 0e0 END
  + CASE WHEN i.type IN ({BOLT}) AND aspect BETWEEN 15e-1 AND 15e0 THEN 1e-1 WHEN i.type IN ({NUT}) AND aspect BETWEEN 3e-1 AND 15e-1 THEN 1e-1 WHEN i.type IN ({WASH}) AND aspect BETWEEN 5e-2 AND 5e-1 THEN 1e-1 ELSE 0e0 END + CASE WHEN cyl_ratio > 5e-1 THEN 5e-2 ELSE 0e0 END AS score
  FROM signed s JOIN iso i ON {FAMILY} WHERE cyl_ratio >= 15e-2 AND (aspect >= 2e-2 OR nto > 0)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY score DESC, std_ord, variant_ord) AS rn FROM graded WHERE score > 0) WHERE rn = 1),
j AS (SELECT s.*, cyl_ratio >= 15e-2 AND (aspect >= 2e-2 OR nto > 0) AS cand, b.type, b.standard, b.variant, least(coalesce(b.score, 0e0), 1e0) AS sc, CAST(s.part_id % 4 + 1 AS INT) AS repetition, d[3] > 5e2 OR bcyl_d * bcyl_l * 3e0 > 5e5 AS big FROM signed s LEFT JOIN best b ON b.part_id = s.part_id),
k AS (SELECT *, sig_type IS NOT NULL AND sig_conf >= 75e-2 AND sc < 4e-1 AS by_sign, sig_type IS NOT NULL AND sc >= 4e-1 AS both_, NOT cand OR sig_type IS NULL AND (big OR coalesce(type IN ({BOLT}), false) AND NOT strict_head) AS out_ FROM j),
c AS (SELECT *, CASE WHEN out_ THEN 'unclassified' WHEN by_sign OR both_ THEN sig_type ELSE coalesce(type, 'unclassified') END AS base, CASE WHEN out_ THEN 0e0 WHEN by_sign THEN sig_conf * 85e-2 WHEN both_ THEN least(1e0, 4e-1 * sig_conf + 6e-1 * sc + 2e-1) ELSE sc END AS c0, NOT out_ AND NOT by_sign AND sc >= 3e-1 AS sized FROM k),
e AS (SELECT *, round(CASE WHEN cand AND repetition >= 3 THEN least(c0 + 1e-1, 1e0) ELSE c0 END, 9) AS confidence FROM c)
SELECT part_id, CASE WHEN confidence < 6e-1 THEN 'unclassified' WHEN confidence < 9e-1 THEN 'possible_' || base ELSE base END AS fastener_type, CASE WHEN sized AND confidence >= 6e-1 THEN standard END AS standard, CASE WHEN sized AND confidence >= 6e-1 THEN variant END AS variant, confidence FROM e""")
def classify_parts(spark, sf_dir):
    signed = with_signature(_sig_features(spark, sf_dir))
    f = signed.withColumns({"max_bbox": F.greatest("dx", "dy", "dz"), "volume": F.col("bcyl_d") * F.col("bcyl_l") * 3.0, "repetition": (F.col("part_id") % 4 + 1).cast("int")})
    return standards.classify(f, standards.standards(spark)).withColumn("confidence", F.round("confidence", 9))


EDGES = f"""{ctes('fx_shafts', 'fx_holes')}, met AS (
SELECT s.part_id AS fastener_id, h.hole_id, h.host_id, s.length AS sl, h.diameter - 2e0 * s.radius AS gap, s.confidence AS conf, abs(s.dx * h.dx + s.dy * h.dy + s.dz * h.dz) AS align,
  s.ox - h.ox AS vx, s.oy - h.oy AS vy, s.oz - h.oz AS vz, h.dx AS hx, h.dy AS hy, h.dz AS hz, (h.ox - s.ox) * s.dx + (h.oy - s.oy) * s.dy + (h.oz - s.oz) * s.dz AS ta,
  (h.ox + h.dx * h.length - s.ox) * s.dx + (h.oy + h.dy * h.length - s.oy) * s.dy + (h.oz + h.dz * h.length - s.oz) * s.dz AS tb
FROM fx_shafts s JOIN fx_holes h ON s.part_id <> h.host_id AND h.diameter - 2e0 * s.radius BETWEEN -15e-1 AND 2e0 AND abs(s.dx * h.dx + s.dy * h.dy + s.dz * h.dz) >= 95e-2),
gated AS (SELECT *, vx * hx + vy * hy + vz * hz AS va, least(ta, tb) AS t0, greatest(ta, tb) AS t1 FROM met),
aside AS (SELECT *, sqrt((vx - va * hx) * (vx - va * hx) + (vy - va * hy) * (vy - va * hy) + (vz - va * hz) * (vz - va * hz)) AS off, least(t1, sl) - greatest(t0, 0e0) AS overlap FROM gated),
passed AS (SELECT * FROM aside WHERE off <= 5e-1 AND overlap > 0),
edge AS (SELECT *, CASE WHEN gap <= 2e-1 THEN 'tap' WHEN gap <= 6e-1 THEN 'slip' ELSE 'clearance' END AS fit_class,
  4e-1 * align + 3e-1 * (1e0 - off / 5e-1) + 2e-1 * CASE WHEN gap BETWEEN -12e-1 AND 8e-1 THEN 1e0 WHEN gap < -12e-1 THEN (gap + 15e-1) / 3e-1 ELSE (2e0 - gap) / 12e-1 END + 1e-1 * overlap / greatest(sl, 1e-6) AS score FROM passed),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY fastener_id ORDER BY t1, hole_id, host_id, gap) - 1 AS INT) AS bolt_order FROM edge)"""


def _edges(spark, sf_dir, strategy="grid"):
    return joints.screwed_into(view(spark, sf_dir, "fx_shafts"), view(spark, sf_dir, "fx_holes"), strategy=strategy, decimals=9)


def _edge_counts(spark, sf_dir):
    return joints.edge_counts(view(spark, sf_dir, "fx_shafts"), view(spark, sf_dir, "fx_holes"))


@query(EDGES + " SELECT fastener_id, hole_id, host_id, bolt_order, fit_class, round(gap, 9) AS gap, round(score, 9) AS score, round(least(1e0, score * conf), 9) AS confidence FROM ordered")
def screwed_into(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(EDGES + " SELECT fit_class, count(*) AS n FROM ordered GROUP BY fit_class")
def fit_class_counts(spark, sf_dir):
    return _edge_counts(spark, sf_dir).groupBy("fit_class").agg(F.sum("n").alias("n"))


@query(EDGES + """ SELECT count(*) AS n_edges, count(*) FILTER (fit_class = 'tap') AS n_tap, count(*) FILTER (fit_class = 'slip') AS n_slip, count(*) FILTER (fit_class = 'clearance') AS n_clearance,
count(DISTINCT fastener_id) AS n_matched, round(count(DISTINCT fastener_id) / greatest(1e0, (SELECT CAST(count(*) AS DOUBLE) FROM fx_shafts)), 3) AS match_rate FROM ordered""")
def match_rate(spark, sf_dir):
    return joints.match_totals(_edge_counts(spark, sf_dir), view(spark, sf_dir, "fx_shafts").count())


def _hole_parts(spark, sf_dir):
    p = view(spark, sf_dir, "fx_parts")
    return p.select("part_id", F.when(F.col("part_id") % 4 == 0, 1).otherwise(0).alias("n_cone"), *[F.lit(0.0).alias(f"b{k}0") for k in "xyz"], F.lit(30.0).alias("bx1"), F.lit(30.0).alias("by1"), F.lit(8.0).alias("bz1"))


# First fit in face order: ``walk`` carries the first member of each cluster of a part from face to face.
CLUSTERS = f"""{ctes('fx_cylinders', 'fx_parts').replace('WITH', 'WITH RECURSIVE', 1)}, inner_ AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY face_index, ox, oy, oz, dx, dy, dz, radius, length) AS i FROM fx_cylinders WHERE is_internal),
walk AS (SELECT part_id, i, face_index, [struct_pack(a := ox, b := oy, c := oz, x := dx, y := dy, z := dz)] AS firsts, 0 AS cluster FROM inner_ WHERE i = 1
UNION ALL SELECT part_id, i, face_index, CASE WHEN k IS NULL THEN list_append(firsts, own) ELSE firsts END, coalesce(k - 1, len(firsts)) FROM (
  SELECT n.part_id, n.i, n.face_index, w.firsts, struct_pack(a := n.ox, b := n.oy, c := n.oz, x := n.dx, y := n.dy, z := n.dz) AS own,
    nullif(list_position(list_transform(list_transform(w.firsts, lambda f: struct_pack(f := f, u := n.ox - f.a, v := n.oy - f.b, w := n.oz - f.c, cosine := abs(n.dx * f.x + n.dy * f.y + n.dz * f.z))),
      lambda q: q.cosine >= 999e-3 AND sqrt(greatest(0e0, q.u * q.u + q.v * q.v + q.w * q.w - (q.u * q.f.x + q.v * q.f.y + q.w * q.f.z) ** 2)) < 5e-2), true), 0) AS k
  FROM walk w JOIN inner_ n ON n.part_id = w.part_id AND n.i = w.i + 1)),
clustered AS (SELECT n.*, w.cluster FROM inner_ n JOIN walk w ON w.part_id = n.part_id AND w.i = n.i)"""
HOLES = f"""{CLUSTERS}, anchor AS (SELECT part_id, cluster, ox AS ax, oy AS ay, oz AS az, dx AS ux, dy AS uy, dz AS uz FROM (SELECT *, row_number() OVER (PARTITION BY part_id, cluster ORDER BY length DESC, i) AS rn FROM clustered) WHERE rn = 1),
along AS (SELECT c.*, ax, ay, az, ux, uy, uz, (ox - ax) * ux + (oy - ay) * uy + (oz - az) * uz AS t0 FROM clustered c JOIN anchor a ON a.part_id = c.part_id AND a.cluster = c.cluster),
g AS (SELECT part_id, cluster, any_value(ax) AS ax, any_value(ay) AS ay, any_value(az) AS az, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz, least(min(t0), min(t0 + length)) AS lo, greatest(max(t0), max(t0 + length)) AS hi, min(radius) AS r0, max(radius) AS r1, max(length) AS longest, CAST(count(*) AS INT) AS n FROM along GROUP BY part_id, cluster),
hole AS (SELECT g.part_id || '#' || g.cluster AS hole_id, g.part_id AS host_id, 2e0 * r0 AS diameter, ax + hi * ux AS tx, ay + hi * uy AS ty, az + hi * uz AS tz, ax + lo * ux AS bx, ay + lo * uy AS by_, az + lo * uz AS bz, ux, uy, uz, n AS n_members,
  CASE WHEN n >= 2 AND (r1 - r0) / r0 > 15e-2 THEN 'counterbore' WHEN g.part_id % 4 = 0 AND n = 1 THEN 'countersink' WHEN longest >= 9e-1 * (abs(ux) * 3e1 + abs(uy) * 3e1 + abs(uz) * 8e0) THEN 'through' ELSE 'blind' END AS kind FROM g JOIN fx_parts p ON p.part_id = g.part_id)"""


def _clustered(spark, sf_dir):
    return joints.coaxial_clusters(view(spark, sf_dir, "fx_cylinders").where("is_internal").drop("stype"))


def _holes(spark, sf_dir):
    return joints.synthesise_holes(_clustered(spark, sf_dir), _hole_parts(spark, sf_dir))


PLACES = {"top_x": "tx", "top_y": "ty", "top_z": "tz", "bottom_x": "bx", "bottom_y": "by", "bottom_z": "bz", "axis_x": "dx", "axis_y": "dy", "axis_z": "dz"}


@query(HOLES + " SELECT hole_id, host_id, diameter, round(tx, 7) AS top_x, round(ty, 7) AS top_y, round(tz, 7) AS top_z, round(bx, 7) AS bottom_x, round(by_, 7) AS bottom_y, round(bz, 7) AS bottom_z, ux AS axis_x, uy AS axis_y, uz AS axis_z, kind, n_members FROM hole")
def hole_synthesis(spark, sf_dir):
    return _holes(spark, sf_dir).select("hole_id", "host_id", "diameter", *[F.round(c, 7).alias(k) for k, c in PLACES.items()], "kind", "n_members")


@query(HOLES + " SELECT kind, count(*) AS n FROM hole GROUP BY kind")
def hole_kind_counts(spark, sf_dir):
    return _holes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(CLUSTERS + " SELECT part_id, face_index, cluster FROM clustered")
def coaxial_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).select("part_id", "face_index", "cluster")


@query(f"{ctes('fx_parts')} SELECT 'contained_in' AS kind, part_id AS subject_id, part_id // 3 AS target_id, 1 AS depth, CAST(1 AS DOUBLE) AS confidence, false AS inferred FROM fx_parts WHERE part_id > 20 AND kind <= 2")
def contained_in(spark, sf_dir):
    k = F.col("part_id")
    parts = view(spark, sf_dir, "fx_parts").withColumn("parent_id", F.when(k > 20, F.floor(k / 3)))
    return joints.contained_in(parts, parts.where("kind <= 2"))


@query("""WITH own AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), first_ AS (SELECT h, min(doc_id) AS canonical_id FROM own GROUP BY h)
SELECT doc_id AS part_id, canonical_id FROM own JOIN first_ ON own.h = first_.h""")
def canonical_part(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("part_id"), F.col("doc_id").alias("ord"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("topology_hash"))
    return canonical_parts(d).select("part_id", "canonical_id")


@query("SELECT count(*) AS n_parts, count(DISTINCT sha256(coalesce(text, ''))) AS n_unique FROM documents")
def topology_hash_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("part_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("topology_hash"))
    return dedup_summary(d)


@query(f"""{ctes('fx_parts')} SELECT part_id, CASE WHEN kind <= 2 THEN 48 WHEN kind = 3 THEN 14 ELSE 34 END AS n_vertices, CASE WHEN kind <= 2 THEN 88 WHEN kind = 3 THEN 24 ELSE 64 END AS n_faces FROM fx_parts""")
def proxy_mesh_counts(spark, sf_dir):
    kind = F.when(F.col("kind") <= 2, "hex_bolt").when(F.col("kind") == 3, "hex_nut").otherwise("flat_washer")
    size = ft.proxy_mesh_size(kind, F.lit(16))
    return view(spark, sf_dir, "fx_parts").select("part_id", size["n_vertices"].alias("n_vertices"), size["n_faces"].alias("n_faces"))


@query(f"""{ctes('fx_parts')} SELECT part_id, round(16 * m / 2 * m / 2 * sin(2 * pi() / 16) + 32 * (m / 2) * sin(pi() / 16) * (m * (2e0 + s5)), 6) AS area,
round(8 * (m / 2) * (m / 2) * sin(2 * pi() / 16) * (m * (2e0 + s5)), 6) AS volume, CAST(34 AS BIGINT) AS n_vertices, CAST(64 AS BIGINT) AS n_faces FROM fx_parts""")
def mesh_area_volume(spark, sf_dir):
    shapes = view(spark, sf_dir, "fx_parts").select(F.col("part_id").alias("mesh_id"), (F.col("m") / 2).alias("radius"), (F.col("m") * (2.0 + F.col("s5"))).alias("height"))
    out = ft.mesh_measures(*ft.cylinder_mesh(dealt(shapes, "mesh_id"), 16))
    return out.select(F.col("mesh_id").alias("part_id"), F.round("area", 6).alias("area"), F.round("volume", 6).alias("volume"), "n_vertices", "n_faces")
