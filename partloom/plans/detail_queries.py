"""Queries over single operators: geometry, meshes, labels, gates, checks, reports and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import geometry as g
from partloom.functions import text as tx
from partloom.operators import cloud, ensemble, joints
from partloom.operators import evalstats as es
from partloom.operators import features as ft
from partloom.operators import labels as lb
from partloom.operators import plumbing as pl
from partloom.operators import quality as ql
from partloom.operators import reconcile as rc
from partloom.operators import summaries as sm
from partloom.plans.adapters import ctes, table, view
from partloom.tables import dealt, merged

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


LINE = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_quantity AS q, l_tax * 1e2 AS t, CAST(l_linenumber AS DOUBLE) AS n, l_suppkey AS s, l_orderkey AS o FROM lineitem)"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", F.col("l_quantity").cast("double").alias("q"), (F.col("l_tax").cast("double") * 100.0).alias("t"), F.col("l_linenumber").cast("double").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"))


def _three(*xs):
    return tuple(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs)


@query(f"WITH {LINE} SELECT id, q >= 2e0 AND (CASE s % 3 WHEN 0 THEN -1e0 WHEN 1 THEN 1e0 ELSE 0e0 END) * q < 0 AS concave FROM l")
def concave_faces(spark, sf_dir):
    l = _lines(spark, sf_dir).where("q >= 0")  # noqa: E741
    normal = _three(F.when(F.col("s") % 3 == 0, -1.0).when(F.col("s") % 3 == 1, 1.0).otherwise(0.0), 0, 0)
    return l.select("id", ft.concave(normal, _three(F.col("q"), 0, F.col("n")), _three(0, 0, 0), _three(0, 0, 1), F.when(F.col("q") >= 2, F.col("q")).otherwise(0.0)).alias("concave"))


@query(f"WITH {LINE} SELECT id, 1e-1 * q AS ux, -1e-1 * t AS uy, 1e-1 * n AS uz, 1e-3 * q AS gx, 1e-3 * n AS gy, -1e-3 * t AS gz, round(q, 9) AS bx, round(t, 9) AS by_, round(n, 9) AS bz, -2e0 * t + 5 AS mx, 2e0 * q + 6 AS my, 2e0 * n + 7 AS mz FROM l")
def coordinate_systems(spark, sf_dir):
    p = g.triple("", "qtn")
    u, v = g.canonical_to_engine(p), g.canonical_to_gltf(p)
    back = g.gltf_to_canonical(v)
    m = [F.lit(float(x)) for x in (0, -2, 0, 5, 2, 0, 0, 6, 0, 0, 2, 7, 0, 0, 0, 1)]
    at = g.apply_matrix(m, p)
    names = {**dict(zip(("ux", "uy", "uz"), u, strict=True)), **dict(zip(("gx", "gy", "gz"), v, strict=True)), **{k: F.round(c, 9) for k, c in zip(("bx", "by_", "bz"), back, strict=True)}, **dict(zip(("mx", "my", "mz"), at, strict=True))}
    return _lines(spark, sf_dir).select("id", *[(c + 0.0).alias(k) for k, c in names.items()])


@query(f"""WITH {LINE}, r AS (SELECT id, q, t, n, CAST(s % 4 AS INT) AS quarter FROM l) SELECT id, q AS tx, t AS ty, n AS tz, 2e0 AS sx, 2e0 AS sy, n AS sz, 0e0 AS qx, 0e0 AS qy,
round([0e0, sqrt(5e-1), 1e0, -sqrt(5e-1)][quarter + 1], 9) AS qz, round([1e0, sqrt(5e-1), 0e0, sqrt(5e-1)][quarter + 1], 9) AS qw FROM r""")
def matrix_parts(spark, sf_dir):
    quarter = F.col("s") % 4
    c, s = F.when(quarter == 0, 1.0).when(quarter == 2, -1.0).otherwise(0.0), F.when(quarter == 1, 1.0).when(quarter == 3, -1.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = [2 * c, -2 * s, zero, F.col("q"), 2 * s, 2 * c, zero, F.col("t"), zero, zero, F.col("n"), F.col("n"), zero, zero, zero, one]
    d = g.decompose(m)
    return _lines(spark, sf_dir).select("id", *[(F.round(c, 9) + 0.0).alias(k) if k[0] == "q" else c.alias(k) for k, c in d.items()])


def _cylinders(spark, sf_dir):
    shapes = view(spark, sf_dir, "fx_parts").select(F.col("part_id").alias("mesh_id"), (F.col("m") / 2).alias("radius"), (F.col("m") * (2.0 + F.col("s5"))).alias("height"))
    return dealt(shapes, "mesh_id")


#: Corners of the k-th side's four triangles, j the next side, w which of the four.
FLIPPED = "CAST(CASE w WHEN 0 THEN k WHEN 1 THEN j WHEN 2 THEN 32 ELSE 33 END AS INT) AS a, CAST(CASE w WHEN 2 THEN k WHEN 3 THEN j + 16 ELSE k + 16 END AS INT) AS b, CAST(CASE w WHEN 0 THEN j WHEN 1 THEN j + 16 WHEN 2 THEN j ELSE k + 16 END AS INT) AS c"


@query(f"""{ctes('fx_parts')}, t AS (SELECT part_id AS mesh_id, CAST(unnest(range(64)) AS INT) AS fid FROM fx_parts), k AS (SELECT *, fid // 4 AS k, (fid // 4 + 1) % 16 AS j, fid % 4 AS w FROM t)
SELECT mesh_id, CAST(fid AS BIGINT) AS fid, {FLIPPED} FROM k""")
def flipped_triangles(spark, sf_dir):
    _, triangles = ft.cylinder_mesh(_cylinders(spark, sf_dir), 16)
    return ft.flip_winding(triangles).select("mesh_id", F.col("fid").cast("long").alias("fid"), "a", "b", "c")


@query(f"""{ctes('fx_parts')}, s AS (SELECT part_id AS mesh_id, m / 2e0 AS r, m * (2e0 + s5) AS h FROM fx_parts),
v AS (SELECT mesh_id, CAST(i + 16 * l AS INT) AS vid, r * cos(i * pi() / 8e0) AS x, r * sin(i * pi() / 8e0) AS y, h * l AS z FROM s, unnest(range(16)) AS u(i), unnest([0, 1]) AS w(l) UNION ALL SELECT mesh_id, CAST(32 + l AS INT), 0e0, 0e0, h * l FROM s, unnest([0, 1]) AS w(l)),
k AS (SELECT mesh_id, i // 4 AS k, (i // 4 + 1) % 16 AS j, i % 4 AS w FROM s, unnest(range(64)) AS u(i)), t AS (SELECT mesh_id, {FLIPPED} FROM k),
f AS (SELECT t.*, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, c.x - a.x AS qx, c.y - a.y AS qy, c.z - a.z AS qz FROM t JOIN v a ON a.mesh_id = t.mesh_id AND a.vid = t.a JOIN v b ON b.mesh_id = t.mesh_id AND b.vid = t.b JOIN v c ON c.mesh_id = t.mesh_id AND c.vid = t.c),
n AS (SELECT mesh_id, unnest([a, b, c]) AS vid, qy * pz - qz * py AS nx, qz * px - qx * pz AS ny, qx * py - qy * px AS nz FROM f),
m AS (SELECT mesh_id, vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM n GROUP BY 1, 2)
SELECT mesh_id, vid, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0e0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0e0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0e0 AS nz FROM m""")
def cap_normals(spark, sf_dir):
    n = ft.vertex_normals(*ft.cylinder_mesh(_cylinders(spark, sf_dir), 16))
    return n.select("mesh_id", "vid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query(f"{ctes('fx_parts')} SELECT part_id AS mesh_id, round(m * (2e0 + s5), 6) AS bcyl_l, round(m, 6) AS bcyl_d, round(2e0 + s5, 6) AS aspect, round(32 * (m / 2) * sin(pi() / 16) * (m * (2e0 + s5)) / (16 * m / 2 * m / 2 * sin(2 * pi() / 16) + 32 * (m / 2) * sin(pi() / 16) * (m * (2e0 + s5))), 6) AS cyl_ratio FROM fx_parts")
def mesh_features(spark, sf_dir):
    vertices, triangles = ft.cylinder_mesh(_cylinders(spark, sf_dir), 16)
    flat = vertices.select("mesh_id", "vid", (F.col("x") / F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), F.lit(1e-9))).alias("nx"), (F.col("y") / F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), F.lit(1e-9))).alias("ny"), F.when(F.col("vid") >= 32, 1.0).otherwise(0.0).alias("nz"))
    axes = vertices.select("mesh_id").distinct().select("mesh_id", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"))
    out = ft.mesh_features(vertices, triangles, flat, axes)
    # a cap triangle has corners leaning 0, 0 and 1: a mean of 1/3, not cylindrical
    return out.select("mesh_id", *[F.round(c, 6).alias(c) for c in ("bcyl_l", "bcyl_d", "aspect", "cyl_ratio")])


KEYS = "k AS (SELECT l_orderkey AS part_id, count(*) AS n, list_reverse(list_sort(list(l_quantity))) AS a, list_reverse(list_sort(list(l_extendedprice))) AS e FROM lineitem GROUP BY 1)"


def _listed(column, n):
    return f"array_to_string(list_transform({column}[1:{n}], lambda v: printf('%.4f', CAST(v AS DOUBLE))), ',')"


@query(f"""WITH {KEYS}, b AS (SELECT *, 'F' || n || '|E' AS head, '|FA:' || {_listed('a', 50)} AS fa, '|EL:' || {_listed('e', 50)} AS el FROM k)
SELECT part_id, sha256(head || 2 * n || '|V' || 3 * n || fa) AS exchange_key, sha256(head || 2 * n || '|V' || 3 * n || fa || el) AS shape_key, sha256(head || '0|V' || 3 * n || fa) AS mesh_key FROM b""")
def topology_keys(spark, sf_dir):
    # Dealt by count: a row costs far more to print than its bytes say, so tasks must not be put together by their bytes.
    lines = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("part_id"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p")), "part_id")
    k = lines.groupBy("part_id").agg(F.count("*").alias("n"), F.collect_list("q").alias("a"), F.collect_list("p").alias("e"))
    n = F.col("n")
    key = lambda kind: ft.shape_key(kind, n.cast("string"), (2 * n).cast("string"), (3 * n).cast("string"), F.col("a"), F.col("e"))
    return k.select("part_id", *[key(kind).alias(f"{kind}_key") for kind in ("exchange", "shape", "mesh")])


@query(f"{ctes('fx_dims')} SELECT part_id, CAST(c AS INT) AS corner, CASE WHEN c & 1 > 0 THEN dx ELSE 0e0 END AS x, CASE WHEN c & 2 > 0 THEN dy ELSE 0e0 END AS y, CASE WHEN c & 4 > 0 THEN dz ELSE 0e0 END AS z FROM fx_dims CROSS JOIN (SELECT unnest(range(8)) AS c)")
def box_corners(spark, sf_dir):
    b = view(spark, sf_dir, "fx_dims").select("part_id", *[F.lit(0.0).alias(f"{k}0") for k in "xyz"], *[F.col(f"d{k}").alias(f"{k}1") for k in "xyz"])
    return ft.box_corners(b).select("part_id", "corner", "x", "y", "z")


@query(f"{ctes('fx_dims')} SELECT part_id, round(bcyl_d, 3) AS shaft, round(head_d, 3) AS head, coalesce(round(head_d, 3), round(bcyl_d, 3), 6e0) AS first, CASE WHEN head_h IS NULL THEN 2 ELSE 3 END - CASE WHEN head_d IS NULL THEN 1 ELSE 0 END + 0 * part_id AS n FROM fx_dims")
def measured_dims(spark, sf_dir):
    d = view(spark, sf_dir, "fx_dims").withColumn("dims", sm.measured_dims(shaft_d=F.col("bcyl_d"), head_d=F.col("head_d"), head_h=F.col("head_h")))
    at = lambda k: F.try_element_at("dims", F.lit(k))
    return d.select("part_id", at("shaft_d").alias("shaft"), at("head_d").alias("head"), sm.dimension(F.col("dims"), "head_d", "shaft_d", default=6.0).alias("first"), F.size("dims").cast("long").alias("n"))


KIND_NAMES = ("hex_bolt", "socket_head_cap_screw", "thin_hex_nut", "flat_washer", "dowel_pin", "gear", "possible_rivet")
KINDS = f"k AS (SELECT p_partkey, p_size, [{', '.join(repr(x) for x in KIND_NAMES)}][p_partkey % 7 + 1] AS kind, CAST(p_size AS DOUBLE) / 50 AS conf FROM part)"


def _kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_size", F.element_at(F.array(*map(F.lit, KIND_NAMES)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("kind"), (F.col("p_size").cast("double") / 50).alias("conf"))


@query(f"WITH {KINDS} SELECT p_partkey, CASE WHEN kind IN ('hex_bolt', 'socket_head_cap_screw') THEN 'screws' WHEN kind = 'thin_hex_nut' THEN 'nuts' WHEN kind = 'flat_washer' THEN 'washers' WHEN kind = 'dowel_pin' THEN 'pins' ELSE 'non_fastener' END AS subtype, CASE WHEN kind IN ('gear', 'possible_rivet') THEN 'non_fastener' ELSE 'fastener' END AS two FROM k")
def subtypes(spark, sf_dir):
    k = _kinds(spark, sf_dir).withColumn("subtype", lb.subtype(F.col("kind")))
    return k.select("p_partkey", "subtype", sm.binary_class(F.col("subtype")).alias("two"))


@query(f"WITH {KINDS}, b(bucket) AS (VALUES ('bolt'), ('nut'), ('washer'), ('insert')), c AS (SELECT CASE WHEN kind IN ('hex_bolt', 'socket_head_cap_screw') THEN 'bolt' WHEN kind = 'thin_hex_nut' THEN 'nut' WHEN kind = 'flat_washer' THEN 'washer' END AS bucket, conf FROM k) SELECT b.bucket, count(c.conf) AS n, round(avg(c.conf), 9) AS mean_confidence FROM b LEFT JOIN c ON c.bucket = b.bucket GROUP BY 1")
def bucket_tally(spark, sf_dir):
    buckets = {"hex_bolt": "bolt", "socket_head_cap_screw": "bolt", "thin_hex_nut": "nut", "flat_washer": "washer", "threaded_insert": "insert"}
    t = lb.tally(_kinds(spark, sf_dir).withColumn("confidence", F.col("conf")), buckets, F.col("kind"))
    return t.select("bucket", "n", F.round("mean_confidence", 9).alias("mean_confidence"))


@query(f"WITH {KINDS} SELECT p_partkey, status, CASE status WHEN 'TP' THEN '#2ca02c' WHEN 'FP' THEN '#d62728' WHEN 'FN' THEN '#ff7f0e' WHEN 'TN' THEN '#7f7f7f' ELSE '#1f77b4' END AS colour FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'UNK' WHEN p_size % 3 = 1 THEN CASE WHEN conf > 5e-1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN conf > 5e-1 THEN 'FP' ELSE 'TN' END END AS status FROM k)")
def status_colours(spark, sf_dir):
    truth = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("p_size") % 3 == 1)
    k = _kinds(spark, sf_dir).withColumn("status", lb.status(truth, F.col("conf") > 0.5))
    table_ = F.create_map(*[F.lit(x) for kv in lb.STATUS_COLOURS.items() for x in kv])
    return k.select("p_partkey", "status", F.element_at(table_, F.col("status")).alias("colour"))


@query(f"WITH {KINDS}, r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY conf DESC, p_partkey) AS rn FROM k) SELECT p_size AS file, kind AS pred, conf AS confidence FROM r WHERE rn = 1")
def best_per_file(spark, sf_dir):
    k = _kinds(spark, sf_dir).select(F.col("p_size").alias("file"), F.col("p_partkey").alias("ord"), F.col("kind").alias("pred"), F.col("conf").alias("confidence"))
    return lb.best_per_file(k)


@query(f"WITH {KINDS} SELECT p_partkey, CASE WHEN kind = 'gear' THEN 'missed' WHEN p_size % 2 = 0 AND kind IN ('hex_bolt', 'dowel_pin') THEN 'correct' ELSE 'wrong' END AS verdict FROM k")
def folder_verdicts(spark, sf_dir):
    k = _kinds(spark, sf_dir).select("p_partkey", (F.col("p_size") % 2).alias("folder"), F.when(F.col("kind") == "gear", "unclassified").otherwise(F.col("kind")).alias("pred"))
    accepted = spark.createDataFrame([(0, ["hex_bolt", "dowel_pin"])], "folder int, types array<string>")
    return lb.folder_score(k, accepted).select("p_partkey", "verdict")


NAMED = ("DIN912-M3#2", "DIN125 A", "ISO14581_x", "M1_NUT", "IOBC_DB_SPACER9", "761_M05", "plate", "my ISO 4017", "miso 4")


@query(f"WITH n AS (SELECT p_partkey, [{', '.join(repr(x) for x in NAMED)}][p_partkey % 9 + 1] AS name, CAST(p_partkey % 9 AS INT) AS i FROM part) SELECT p_partkey, ['screws', 'washers', 'screws', 'nuts', 'spacers', 'washers', NULL, NULL, NULL][i + 1] AS cls, CASE WHEN i < 4 THEN 'iso_din' WHEN i < 6 THEN 'journal_verified' END AS source, i IN (0, 1, 2, 7) AS standard FROM n")
def named_truth(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, NAMED)), (F.col("p_partkey") % 9 + 1).cast("int")).alias("name"))
    truth = lb.named_truth(F.col("name"))
    return n.select("p_partkey", truth["cls"].alias("cls"), truth["source"].alias("source"), lb.names_standard(F.col("name")).alias("standard"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber % 2 = 0) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_shared, count(*) FILTER (b.k IS NULL) AS n_a_only, count(*) FILTER (a.k IS NULL) AS n_b_only FROM a FULL JOIN b ON a.k = b.k")
def key_overlap(spark, sf_dir):
    return pl.overlap(*_sides(spark, sf_dir), "k")


def _sides(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda n: li.where(F.col("l_linenumber") % 2 == n).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").cast("double").alias("score"))
    return side(1), side(0)


SIDES = "a AS (SELECT l_partkey AS k, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), b AS (SELECT l_partkey AS k, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)"


@query(f"WITH {SIDES} SELECT a.k, a.score, b.score AS b_score FROM a JOIN b ON a.k = b.k WHERE a.k % 7 <> 0")
def paired_rows(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return pl.paired_without(a, b, "k", a.where("k % 7 = 0"))


@query(f"WITH {SIDES} SELECT a.k, a.score, coalesce(p.p_type, '_unknown') AS kind, coalesce(p.p_name, '_unknown') AS name FROM a LEFT JOIN part p ON p.p_partkey = a.k AND p.p_partkey % 3 = 0")
def looked_up_rows(spark, sf_dir):
    a, _ = _sides(spark, sf_dir)
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    return pl.looked_up(a, p, "k")


@query(f"WITH {SIDES}, u AS (SELECT k FROM a UNION SELECT k FROM b), i AS (SELECT k FROM a INTERSECT SELECT k FROM b) SELECT 'union' AS kind, k FROM u UNION ALL SELECT 'common', k FROM i")
def key_sets(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(pl.union_keys(a, b, "k"), "union").union(tag(pl.common_keys(a, b, "k"), "common"))


@query("SELECT l_orderkey AS sample_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 4) >= 3")
def complete_samples(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") % 4).alias("kind"))
    return pl.complete_samples(a)


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS kind, doc_id // 2 AS key FROM documents), i AS (SELECT o_orderkey AS key, o_custkey AS path, o_orderstatus AS root FROM orders), f AS (SELECT r.doc_id, min((i.root, i.path)) AS best FROM r JOIN i ON i.key = r.key AND (r.kind = 'a' AND i.path % 3 > 0 OR r.kind = 'b' AND i.path % 3 < 2) GROUP BY 1)
SELECT r.doc_id AS sample_id, r.kind, r.key, i.path FROM r JOIN i ON i.key = r.key WHERE r.kind = 'a' AND i.path % 3 > 0 OR r.kind = 'b' AND i.path % 3 < 2""")
def source_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("kind"), F.floor(F.col("doc_id") / 2).alias("key"))
    i = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("root_ord"))
    return pl.resolve_sources(r, {"a": i.where("path % 3 > 0"), "b": i.where("path % 3 < 2")}).select("sample_id", "kind", "key", "path")


@query("SELECT p_type AS key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def most_common(spark, sf_dir):
    return es.most_common(table(spark, sf_dir, "part").withColumnRenamed("p_type", "key"), "key", 10)


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY abs(l_extendedprice - 5e4) DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def largest_solid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return pl.first_by(li, ["l_partkey"], F.abs(F.col("l_extendedprice").cast("double") - 50000.0).desc(), "l_orderkey", "l_linenumber").select("l_partkey", "l_orderkey", "l_linenumber")


@query(f"{ctes('fx_pred')}, w AS (SELECT y5, doc_id, row_number() OVER (PARTITION BY y5 ORDER BY doc_id) AS rn FROM fx_pred WHERE y5 <> p5) SELECT y5, doc_id FROM w WHERE rn <= 5")
def wrong_examples(spark, sf_dir):
    wrong = view(spark, sf_dir, "fx_pred").where("y5 <> p5")
    return pl.export_cap(wrong, "y5", "doc_id", 5).where("status = 'staged'").select("y5", "doc_id")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN 0 WHEN contains(p_name, 'ring') THEN 1 WHEN contains(p_name, 'p') THEN 2 ELSE 10000 END AS priority, p_name AS slug FROM part")
def family_order(spark, sf_dir):
    return pl.family_order(table(spark, sf_dir, "part"), F.col("p_name"), ["bolt", "ring", "p"]).select("p_partkey", "priority", "slug")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), d AS (SELECT d.doc_id, d.source, -ln(greatest(CAST('0x' || substr(md5('sample:' || d.doc_id), 1, 8) AS BIGINT) / 4294967295e0, 1e-10)) * s.n AS place FROM documents d JOIN s ON s.source IS NOT DISTINCT FROM d.source) SELECT doc_id, source FROM d ORDER BY place, doc_id LIMIT 200""")
def class_weighted_sample(spark, sf_dir):
    return pl.class_weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 200)


@query("""WITH l AS (SELECT l_orderkey, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_quantity)[1:4] AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_concat(v, list_transform(range(4 - len(v)), lambda i: 0e0)), ',') AS vals, len(v) AS n_real FROM l""")
def padded_batches(spark, sf_dir):
    p = pl.padded(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 4)
    return p.select("l_orderkey", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("vals"), F.size(F.filter("mask", lambda m: ~m)).cast("long").alias("n_real"))


@query(f"{ctes('fx_points')}, d AS (SELECT sample_id, count(*) AS n FROM fx_points GROUP BY 1) SELECT sample_id, CAST(64 AS BIGINT) AS n, least(64, n) AS distinct_points FROM d")
def resampled_clouds(spark, sf_dir):
    r = cloud.resample(view(spark, sf_dir, "fx_points").withColumn("pid", F.col("pid").cast("long")), 64)
    return r.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("distinct_points"))


@query(f"{ctes('fx_points')} SELECT sample_id, count(*) AS n, true AS near, true AS again FROM fx_points GROUP BY 1")
def augmented_clouds(spark, sf_dir):
    p = view(spark, sf_dir, "fx_points").withColumn("pid", F.col("pid").cast("long"))
    a, b = cloud.augment(p, 3), cloud.augment(p, 3)
    r = lambda d, q="": F.sqrt(F.col(f"{d}x{q}") * F.col(f"{d}x{q}") + F.col(f"{d}y{q}") * F.col(f"{d}y{q}") + F.col(f"{d}z{q}") * F.col(f"{d}z{q}"))
    j = p.join(a.select("sample_id", "pid", *[F.col(k).alias(f"a{k}") for k in "xyz"]), ["sample_id", "pid"]).join(b.select("sample_id", "pid", *[F.col(k).alias(f"b{k}") for k in "xyz"]), ["sample_id", "pid"])
    near = (r("a") <= 1.2 * (r("") + 0.09)) & (r("a") >= 0.8 * (r("") - 0.09))
    same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("az") == F.col("bz"))
    return j.groupBy("sample_id").agg(F.count("*").alias("n"), F.bool_and(near).alias("near"), F.bool_and(same).alias("again"))


@query(f"{ctes('fx_parts')} SELECT part_id AS mesh_id, CAST(32 AS BIGINT) AS n, true AS inside FROM fx_parts")
def surface_points(spark, sf_dir):
    shapes = _cylinders(spark, sf_dir)
    v, t = ft.cylinder_mesh(shapes, 16)
    tri = ft.cornered(t, v)
    s = merged(cloud.surface_samples(tri, 32)).join(merged(shapes), "mesh_id")
    inside = (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) <= F.col("radius") + 1e-6) & F.col("z").between(-1e-6, F.col("height") + 1e-6)
    return s.groupBy("mesh_id").agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"))


FACES = "f AS (SELECT l_orderkey % 200 AS mesh_id, (l_orderkey * 10 + l_linenumber) * 3 + l_suppkey % 3 AS fid, CAST(l_suppkey % 3 AS INT) AS d FROM lineitem)"


@query(f"WITH {FACES}, u AS (SELECT DISTINCT mesh_id, fid, d FROM f), k AS (SELECT mesh_id, d, min(fid) AS first_ FROM u GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY first_) - 1 AS segment FROM k) SELECT u.mesh_id, u.fid, CAST(s.segment AS INT) AS segment FROM u JOIN s ON s.mesh_id = u.mesh_id AND s.d = u.d")
def normal_segments(spark, sf_dir):
    li, d = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 3
    f = li.select((F.col("l_orderkey") % 200).alias("mesh_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 3 + d).alias("fid"), d.alias("d")).distinct()
    one = lambda k: F.when(F.col("d") == k, F.when(F.col("fid") % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    return cloud.normal_segments(f.select("mesh_id", "fid", one(0).alias("nx"), one(1).alias("ny"), one(2).alias("nz")))


@query(f"{ctes('fx_dims')} SELECT part_id, bcyl_d BETWEEN 1e0 AND 3e1 AND bcyl_l BETWEEN 2e0 AND 8e1 AND cyl_ratio >= 4e-1 AND aspect BETWEEN 3e-1 AND 12e0 AND part_id % 40 + 6 BETWEEN 8 AND 100 AND part_id % 9 >= 3 AND part_id % 4 = 0 AS screw FROM fx_dims")
def screw_shapes(spark, sf_dir):
    k = F.col("part_id")
    d = view(spark, sf_dir, "fx_dims").withColumns({"num_faces": k % 40 + 6, "n_plane": k % 9, "n_cone": F.when(k % 4 == 0, 2).otherwise(0), "n_torus": F.when(k % 8 == 0, 1).otherwise(0), "n_sphere": F.lit(0)})
    return d.select("part_id", ensemble.looks_like_screw().alias("screw"))


@query("SELECT p_partkey, CASE WHEN c >= 85e-2 THEN 'nuts' WHEN c >= 4e-1 THEN 'likely_nuts' ELSE 'unclassified' END AS label, CASE WHEN c >= 9e-1 THEN 'rules' WHEN p_partkey % 900 > 600 THEN 'fallback' ELSE 'primary' END AS route FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS c FROM part)")
def model_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("double") / 50).alias("confidence"), (F.col("p_partkey") % 900).alias("num_faces"))
    return ensemble.route(p).select("p_partkey", ensemble.banded(F.lit("nuts"), F.col("confidence")).alias("label"), "route")


RULE, ML = ("unclassified", "unclassified", "hex_bolt"), ("non_fastener", "likely_washers", "nuts", "unclassified")
GATES = f"""{ctes('fx_dims')}, e AS (SELECT part_id AS k, bcyl_d, bcyl_l, cyl_ratio, aspect, greatest(dx, dy, dz) AS max_dim, part_id % 40 + 6 AS nf, part_id % 9 AS np, part_id % 4 = 0 AS shaped, part_id % 8 = 0 AS torus,
[{', '.join(repr(x) for x in RULE)}][part_id % 3 + 1] AS rule_type, [{', '.join(repr(x) for x in ML)}][part_id % 4 + 1] AS merged, CAST(part_id % 10 AS DOUBLE) / 10 AS mc, CASE WHEN part_id % 2 = 0 THEN 3e-1 ELSE 1e-1 END AS p2 FROM fx_dims),
s AS (SELECT *, rule_type = 'unclassified' AS silent, replace(merged, 'likely_', '') AS base FROM e),
o AS (SELECT *, silent AND base IN ('non_fastener', 'washers', 'unclassified') AND bcyl_d BETWEEN 1e0 AND 3e1 AND bcyl_l BETWEEN 2e0 AND 8e1 AND cyl_ratio >= 4e-1 AND aspect BETWEEN 3e-1 AND 12e0 AND nf BETWEEN 8 AND 100 AND np >= 3 AND shaped AS screw FROM s),
d AS (SELECT *, CASE WHEN screw THEN 'likely_screws' ELSE merged END AS t, CASE WHEN screw THEN 6e-1 ELSE mc END AS c, NOT screw AND silent AND base = 'non_fastener' AND (torus OR cyl_ratio >= 5e-1) AS doubt FROM o),
r AS (SELECT *, CASE WHEN doubt AND p2 >= 2e-1 THEN 'likely_nuts' WHEN doubt THEN 'unclassified' ELSE t END AS t2, CASE WHEN doubt AND p2 >= 2e-1 THEN p2 WHEN doubt THEN 0e0 ELSE c END AS c2, CASE WHEN screw THEN 'screw' WHEN doubt AND p2 >= 2e-1 THEN 'rescued' WHEN doubt THEN 'demoted' END AS g FROM d),
z AS (SELECT *, (max_dim > 2e2 OR max_dim < 1e0) AND replace(t2, 'likely_', '') NOT IN ('unclassified', 'non_fastener') AS odd FROM r)
SELECT k AS part_id, CASE WHEN odd THEN 'unclassified' ELSE t2 END AS final_type, CASE WHEN odd THEN 0e0 ELSE c2 END AS final_conf, CASE WHEN odd THEN 'size' ELSE g END AS gate FROM z"""


@query(GATES)
def gates_after_merge(spark, sf_dir):
    k = F.col("part_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    second = F.when(k % 2 == 0, 0.3).otherwise(0.1)
    top = F.array(F.struct(F.lit("non_fastener").alias("cls"), F.lit(0.6).alias("prob")), F.struct(F.lit("nuts").alias("cls"), second.alias("prob")))
    d = view(spark, sf_dir, "fx_dims").withColumns({
        "num_faces": k % 40 + 6, "n_plane": k % 9, "n_cone": F.when(k % 4 == 0, 2).otherwise(0), "n_torus": F.when(k % 8 == 0, 1).otherwise(0), "n_sphere": F.lit(0), "max_dim": F.greatest("dx", "dy", "dz"),
        "rule_type": pick(RULE, 3), "merged_type": pick(ML, 4), "merged_conf": (k % 10).cast("double") / 10, "top3": top,
    })
    return ensemble.gated(d).select("part_id", "final_type", "final_conf", "gate")


@query(f"WITH {KINDS} SELECT b.p_partkey AS part_id, a.kind, a.conf AS confidence FROM k b JOIN k a ON a.p_partkey = (SELECT min(c.p_partkey) FROM k c WHERE c.p_size = b.p_size)")
def spread_labels(spark, sf_dir):
    k = _kinds(spark, sf_dir)
    parts = k.select(F.col("p_partkey").alias("part_id"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("string").alias("topology_hash"))
    labels = k.select(F.col("p_partkey").alias("part_id"), "kind", F.col("conf").alias("confidence"))
    return pl.spread_labels(pl.canonical_parts(parts), labels).select("part_id", "kind", "confidence")


@query(f"WITH {KINDS} SELECT p_partkey, kind <> 'non_fastener' AS strict FROM (SELECT p_partkey, CASE kind WHEN 'gear' THEN 'unclassified' WHEN 'possible_rivet' THEN 'non_fastener' ELSE kind END AS kind, conf FROM k) WHERE kind <> 'unclassified' AND conf >= 6e-1")
def fastener_set(spark, sf_dir):
    base = F.when(F.col("kind") == "gear", "unclassified").when(F.col("kind") == "possible_rivet", "non_fastener").otherwise(F.col("kind"))
    labels = _kinds(spark, sf_dir).select("p_partkey", base.alias("base_type"), F.col("conf").alias("confidence"))
    strict = joints.fasteners_of(labels, strict=True).select("p_partkey", F.lit(True).alias("s"))
    return joints.fasteners_of(labels).join(strict, "p_partkey", "left").select("p_partkey", F.coalesce("s", F.lit(False)).alias("strict"))


@query("""WITH c AS (SELECT s_suppkey AS k, s_suppkey % 4 AS f, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END AS left_, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 2 END AS healed FROM supplier),
d AS (SELECT *, array_to_string(list_filter([CASE WHEN left_ > 0 THEN left_ || ' unhealable from source' END, CASE WHEN greatest(0, f - left_) > 0 THEN greatest(0, f - left_) || ' introduced by conversion' END, CASE WHEN healed > 0 THEN healed || ' source solid(s) auto-healed' END], lambda x: x IS NOT NULL), '; ') AS named FROM c)
SELECT k AS path, f = 0 AS passed, CASE WHEN f = 0 THEN 1e0 ELSE 0e0 END AS score, CASE WHEN f = 0 THEN CASE WHEN healed > 0 THEN 'all solids pass (' || healed || ' healed before writing)' ELSE 'all solids pass' END ELSE f || ' solids failed' || CASE WHEN left_ IS NULL THEN '' WHEN named = '' THEN ' (source unknown)' ELSE ' (' || named || ')' END END AS detail FROM d""")
def topology_check(spark, sf_dir):
    k = F.col("s_suppkey")
    known = lambda c: F.when(k % 3 > 0, c)
    files = table(spark, sf_dir, "supplier").select(k.alias("path"), (k % 4).alias("n_failed"), known(k % 2).alias("healed"), known(k % 3).alias("remaining_invalid"))
    return ql.topology_check(files)


@query("""WITH f AS (SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS bad FROM documents), p AS (SELECT count(*) AS n, count(*) FILTER (l_partkey % 3 = 0) AS o FROM lineitem)
SELECT 'schema' AS "check", count(*) FILTER (bad) = 0 AS passed, 1e0 - CAST(count(*) FILTER (bad) AS DOUBLE) / greatest(count(*), 1) AS score, count(*) FILTER (bad) AS failures FROM f
UNION ALL SELECT 'pmi_audit', false, 1e0 - CAST(o AS DOUBLE) / n, o + 5 FROM p UNION ALL SELECT 'round_trip_stability', true, 1e0, 0 UNION ALL SELECT 'visual_diff', true, 1e0, 0
UNION ALL SELECT 'topology', false, 1e0 - CAST(sum(l_linenumber % 2) AS DOUBLE) / sum(l_linenumber), sum(l_linenumber % 2) FROM lineitem""")
def more_checks(spark, sf_dir):
    k = F.col("doc_id")
    marks = "".join(ql.STEP_MARKS)
    files = table(spark, sf_dir, "documents").select(k.alias("path"), F.when(k % 3 == 0, F.lit("HEADER;")).otherwise(F.lit(marks)).alias("content"), F.when(k % 5 == 0, F.lit("{")).otherwise(F.lit("{}")).alias("manifest"))
    li = table(spark, sf_dir, "lineitem")
    pmi = li.select(F.col("l_partkey").alias("target_id"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("part_id"))
    stats = li.select(F.col("l_linenumber").alias("before"), (F.col("l_linenumber") % 2).alias("after"))
    nation = table(spark, sf_dir, "nation")
    return ql.report([ql.schema_check(files), ql.pmi_audit(pmi, parts, pmi.count() + 5), ql.round_trip(nation), ql.visual_placeholder(spark), ql.topology_attribution(stats)])


@query("SELECT l_returnflag AS kind, CAST(count(*) FILTER (l_linenumber > 1) AS BIGINT) AS lost FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def lost_annotations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kept = (F.col("l_returnflag") == "N") | (F.col("l_linenumber") == 1)
    return ql.count_losses(li.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("before"), F.sum(kept.cast("long")).alias("after")))


@query("SELECT doc_id FROM documents WHERE doc_id >= 0")
def guarded_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return pl.guard_holdout(d, spark.createDataFrame([(-1,)], d.schema), "doc_id")


SNAP = ctes("fx_old", "fx_new")


def _snapshots(spark, sf_dir):
    return view(spark, sf_dir, "fx_new"), view(spark, sf_dir, "fx_old")


@query(f"""{SNAP} SELECT n.part_id, CASE WHEN n.topology_hash <> o.topology_hash OR abs(n.volume - o.volume) / greatest(n.volume, o.volume, 1e-10) >= 1e-3 THEN CASE WHEN o.volume > 0 THEN printf('Geometry changed (volume %+.1f%%)', round((n.volume - o.volume) / o.volume * 100, 6)) ELSE 'Geometry changed' END
WHEN abs(n.tx - o.tx) > 1e-2 THEN printf('Moved %.2fmm (dx=%.1f, dy=%.1f, dz=%.1f)', sqrt((n.tx - o.tx) ** 2), n.tx - o.tx, 0e0, 0e0) WHEN n.name <> o.name THEN 'Renamed: ''' || o.name || ''' → ''' || n.name || '''' ELSE 'No changes detected' END AS details FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id""")
def change_details(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    j = rc.sided(new, "new").join(rc.sided(old, "old"), F.col("new_part_id") == F.col("old_part_id")).withColumn("change_type", rc.change_type())
    return j.select(F.col("new_part_id").alias("part_id"), rc.change_details().alias("details"))


@query(f"{SNAP}, m AS (SELECT n.part_id FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id WHERE n.part_id % 5 <> 0) SELECT 'kept' AS kind, part_id FROM m UNION ALL SELECT 'new', part_id FROM fx_new WHERE part_id NOT IN (SELECT part_id FROM m) UNION ALL SELECT 'old', part_id FROM fx_old WHERE part_id NOT IN (SELECT part_id FROM m)")
def rejected_matches(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    m = rc.uuid_matches(new, old)
    left = rc.resolve(m, m.where("new_id % 5 = 0"))
    tag = lambda df, kind, c="part_id": df.select(F.lit(kind).alias("kind"), F.col(c).alias("part_id"))
    return tag(left, "kept", "new_id").union(tag(rc.unmatched(new, left, "new"), "new")).union(tag(rc.unmatched(old, left, "old"), "old"))


@query(f"{SNAP} SELECT n.part_id, coalesce(o.name, n.name) AS name, n.volume, n.tx FROM fx_new n LEFT JOIN fx_old o ON o.part_id = n.part_id")
def merged_parts(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return rc.merged_parts(new, old, rc.uuid_matches(new, old), ["name"]).select("part_id", "name", "volume", "tx")


@query(f"""{SNAP}, c AS (SELECT n.part_id AS new_id, o.part_id AS old_id FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id UNION SELECT n.part_id, o.part_id FROM fx_new n JOIN fx_old o ON o.part_id = n.part_id + 1 WHERE n.part_id % 10 = 1)
SELECT 'split' AS kind, old_id AS id, count(*) AS n, array_to_string(list(new_id ORDER BY new_id), ',') AS ids FROM c GROUP BY old_id HAVING count(*) > 1 UNION ALL SELECT 'merge', new_id, count(*), array_to_string(list(old_id ORDER BY old_id), ',') FROM c GROUP BY new_id HAVING count(*) > 1""")
def splits_and_merges(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    extra = new.where("part_id % 10 = 1").select(F.col("part_id").alias("new_id"), (F.col("part_id") + 1).alias("old_id")).join(old.select(F.col("part_id").alias("old_id")), "old_id", "left_semi")
    claims = rc.uuid_matches(new, old).unionByName(extra.withColumn("confidence", F.lit(0.7)))
    flat = lambda df, kind, by, ids: df.select(F.lit(kind).alias("kind"), F.col(by).alias("id"), "n", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))
    return flat(rc.splits(claims), "split", "old_id", "new_ids").union(flat(rc.merges(claims), "merge", "new_id", "old_ids"))


@query(f"""WITH r AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS h, CAST(p_partkey % 50 + 100 AS DOUBLE) AS v, CAST(p_size % 4 AS DOUBLE) + 10 AS s FROM part), t AS (SELECT * FROM r WHERE k % 100 = 7),
j AS (SELECT t.k AS target_id, r.k AS part_id, t.h = r.h AS same, abs(r.v - t.v) / greatest(r.v, t.v) AS gap, abs(r.s - t.s) <= 1e-1 * greatest(r.s, t.s) AS box FROM t CROSS JOIN r),
c AS (SELECT target_id, part_id, CASE WHEN same THEN CASE WHEN gap <= 1e-2 THEN 95e-2 ELSE 8e-1 END WHEN box AND gap <= 1e-2 THEN 85e-2 WHEN box AND gap <= 5e-2 THEN 6e-1 ELSE 0e0 END AS confidence FROM j)
SELECT target_id, part_id, confidence, CAST(row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, part_id) AS INT) AS rank FROM c WHERE confidence > 0""")
def registry_lookup(spark, sf_dir):
    k = F.col("p_partkey")
    side = (F.col("p_size") % 4).cast("double") + 10.0
    r = table(spark, sf_dir, "part").select(k.alias("part_id"), k.alias("ord"), F.col("p_size").cast("string").alias("topology_hash"), (k % 50 + 100).cast("double").alias("volume"), *[side.alias(c) for c in ("sx", "sy", "sz")])
    return rc.registry_lookup(r, r.where("part_id % 100 = 7"))


STRINGS = "n AS (SELECT s_suppkey, s_name || ' M' || s_nationkey || 'x20.step' AS name FROM supplier)"


@query(f"""WITH {STRINGS} SELECT s_suppkey, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS safe, regexp_replace(name, '[<>:"/|?*]', '_', 'g') AS file,
regexp_extract(s_suppkey || 'T' || (s_suppkey % 7), '^(\\d+[A-Za-z]+)\\d+$', 1) AS stem, CASE WHEN s_suppkey % 3 = 0 THEN 1e0 WHEN s_suppkey % 3 = 1 THEN 95e-2 ELSE 8e-1 END AS alike, regexp_matches(name, 'M\\d+x\\d+') AS sized FROM n""")
def names_and_patterns(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" M"), F.col("s_nationkey").cast("string"), F.lit("x20.step")).alias("name"))
    k = F.col("s_suppkey")
    other = F.when(k % 3 == 0, F.col("name")).when(k % 3 == 1, F.upper("name")).otherwise(F.concat(F.lit("a "), "name"))
    stem = tx.family_stem(F.concat(k.cast("string"), F.lit("T"), (k % 7).cast("string")))
    return n.select("s_suppkey", tx.slugify(F.col("name")).alias("slug"), tx.safe_name(F.col("name")).alias("safe"), tx.safe_filename(F.col("name")).alias("file"), stem.alias("stem"), tx.name_similarity(F.col("name"), other).alias("alike"), F.col("name").rlike("M\\d+x\\d+").alias("sized"))
