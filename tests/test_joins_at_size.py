"""Rows that a query multiplies must not be broadcast: the optimizer sizes them by the bytes of the table they come from."""

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from partloom.functions import numbers
from partloom.operators import cloud, greedy, joints, meshes, reconcile, standards
from partloom.plans import adapters

SMALL = "/root/testdata/sf0.001"


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Join" in line and "Exchange" not in line]


@pytest.mark.parametrize("name", ["mesh_features", "cap_normals", "mesh_area_volume", "surface_points"])
def test_triangles_meet_their_corners_without_a_broadcast(spark, name):
    found = joins(__spark_entry__.queries()[name](spark, SMALL))
    assert found and not [x for x in found if "Broadcast" in x]


@pytest.mark.parametrize("name", ["segment_planes", "boundary_loops", "topology_failures", "glb_nodes"])
def test_vertices_loops_and_documents_meet_without_a_broadcast(spark, name):
    found = joins(__spark_entry__.queries()[name](spark, SMALL))
    # What is left are the counters of six, two and two that a part's corners come from.
    assert found and not [x for x in found if "BroadcastHashJoin" in x]


def test_snapshots_meet_without_a_broadcast(spark):
    new, old = (adapters.view(spark, SMALL, name) for name in ("fx_new", "fx_old"))
    pairs = reconcile.name_position_candidates(new, old)
    greedily = greedy.greedy_one_to_one(pairs)
    report = __spark_entry__.queries()["snapshot_report"](spark, SMALL)
    for df in (pairs, greedily, report, reconcile.uuid_matches(new, old)):
        found = joins(df)
        assert found and not [x for x in found if "Broadcast" in x]


def test_flatness_is_exact_where_it_lies_between_two_roundings(spark):
    # A flat box whose variances are 27 to 3200: no division by the number of points may round it off.
    corners = [(i, x, y, z) for i, (x, y, z) in enumerate((x, y, z) for x in (-40.0, 40.0) for y in (-30.0, 30.0) for z in (-1.5, 1.5))]
    v = spark.createDataFrame([(1, *c) for c in corners], "part_id int, v int, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 0, 3, 4, 5), (1, 0, 6, 7, 0)], "part_id int, segment int, a int, b int, c int")
    assert meshes.segment_planes(v, f).first().flatness == 2.25 / 1600


def test_targets_of_one_shape_share_a_list_that_is_ranked_once(spark, monkeypatch):
    seen = []
    real = reconcile.ranked
    monkeypatch.setattr(reconcile, "ranked", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k), raising=False)
    parts = spark.range(200).selectExpr("id AS part_id", "id AS ord", "CASE WHEN id % 2 = 0 THEN 'a' END AS topology_hash", "100D AS volume", "1D AS sx", "1D AS sy", "1D AS sz")
    got = reconcile.registry_lookup(parts, parts.where("id % 10 < 2")).collect()
    evens, odds = [2 * i for i in range(100)], [2 * i + 1 for i in range(100)]
    for target in (0, 1, 90):
        row = sorted((r.rank, r.part_id, r.confidence) for r in got if r.target_id == target)
        # Shapes without a hash are no match to each other, but resemble those that have one.
        want = [(p, 0.95) for p in evens] + [(p, 0.85) for p in odds] if target % 2 == 0 else [(p, 0.85) for p in evens]
        assert row == [(i + 1, *w) for i, w in enumerate(want)]
    assert seen == [300]


def test_edges_are_counted_as_they_would_be_listed_but_copies_meet_once(spark, monkeypatch):
    met = []
    real = joints._scored
    shafts = spark.range(60).selectExpr("id AS part_id", "25D * (id % 3) AS ox", "0D AS oy", "0D AS oz", "0D AS dx", "0D AS dy", "1D AS dz", "3D AS radius", "10D AS length", "0.9D AS confidence")
    holes = spark.range(90).selectExpr("id AS hole_id", "id % 70 AS host_id", "25D * (id % 4) AS ox", "0D AS oy", "1D AS oz", "0D AS dx", "0D AS dy", "1D AS dz", "6D + (id % 5) / 4D AS diameter", "4D AS length")
    listed = {(r[0], r[1]): r[2] for r in joints.screwed_into(shafts, holes).groupBy("fastener_id", "fit_class").count().collect()}
    monkeypatch.setattr(joints, "_scored", lambda pairs, p: met.append(pairs.count()) or real(pairs, p))
    assert {(r[0], r[1]): r[2] for r in joints.edge_counts(shafts, holes).collect()} == listed
    assert len(listed) == 180 and met == [15]
    whole = joints.match_totals(joints.edge_counts(shafts, holes), 60).first()
    assert (whole.n_edges, whole.n_matched, whole.match_rate) == (sum(listed.values()), 60, 1.0)


def test_faces_that_touch_an_edge_again_and_again_count_once(spark):
    touched = spark.range(3000).selectExpr("1L AS sample_id", "id % 2 AS edge_index", "id % 3 AS face_index")
    normals = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (1, 1, 0.0, 1.0, 0.0), (1, 2, 1.0, 0.0, 0.0)], "sample_id long, face_index long, nx double, ny double, nz double")
    found = cloud.face_adjacency(touched, normals)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # On both sides of the join, and on its result.
    assert sum("Aggregate [" in line for line in plan) == 3
    assert sorted((r.i, r.j, round(r.angle, 6)) for r in found.collect()) == [(0, 1, 1.570796), (0, 2, 0.0), (1, 2, 1.570796)]


def test_parts_of_equal_measures_are_scored_once(spark, monkeypatch):
    seen = []
    real = standards.best_of
    monkeypatch.setattr(standards, "best_of", lambda features, *a: seen.append(features.count()) or real(features, *a))
    found = __spark_entry__.queries()["iso_standard_histogram"](spark, SMALL)
    monkeypatch.undo()
    listed = __spark_entry__.queries()["iso_best_match"](spark, SMALL).groupBy("standard", "variant").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, listed.collect()))
    assert seen[0] < __spark_entry__.queries()["iso_best_match"](spark, SMALL).count()


def test_holes_are_listed_once_for_fasteners_of_one_shaft(spark, monkeypatch):
    # 40 fasteners of one shaft, of which 7 have two holes each; one fastener of two shafts, one without a partner
    shafts = spark.range(40).selectExpr("id AS part_id", "0e0 AS ox", "0e0 AS oy", "-5e0 AS oz", "0e0 AS dx", "0e0 AS dy", "1e0 AS dz", "3e0 AS radius", "40e0 AS length", "0.5e0 + id / 100e0 AS confidence")
    more = spark.sql("SELECT 50L, 0e0, 0e0, -5e0, 0e0, 0e0, 1e0, 3e0, 40e0, 0.9e0 UNION ALL SELECT 50L, 0e0, 0e0, -4e0, 0e0, 0e0, 1e0, 2.8e0, 40e0, 0.7e0 UNION ALL SELECT 51L, 99e0, 0e0, -4e0, 0e0, 0e0, 1e0, 2.8e0, 40e0, 0.7e0")
    shafts = shafts.union(more)
    holes = spark.range(30).selectExpr("id AS hole_id", "CASE WHEN id < 14 THEN id % 7 WHEN id = 29 THEN NULL ELSE 100 + id END AS host_id", "0e0 AS ox", "0e0 AS oy", "id * 7 % 30 / 1e0 AS oz", "0e0 AS dx", "0e0 AS dy", "1e0 AS dz", "6.5e0 AS diameter", "2e0 AS length")
    seen = []
    real = joints.ranked if hasattr(joints, "ranked") else None
    monkeypatch.setattr(joints, "ranked", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k), raising=False)
    monkeypatch.setattr(joints, "SLICE", 4, raising=False)
    monkeypatch.setattr(joints, "CROWD", 8, raising=False)
    got = sorted(map(tuple, joints.screwed_into(shafts, holes).collect()))
    assert got == sorted(map(tuple, joints.screwed_into(shafts, holes, strategy="exact").collect()))
    assert len(got) == 40 * 29 - 14 + 2 * 29 and seen == [3 * 29]


def test_lines_to_print_are_dealt_by_count_and_printed_alike_near_ties(spark):
    plan = __spark_entry__.queries()["topology_keys"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    values = [s * (k + f) / 10**4 for s in (1, -1) for k in (0, 3, 12345, 9999, 2**39, 2**40, 2**41) for f in (0.0, 0.4989, 0.4991, 0.49999999, 0.5, 0.5000001, 0.501, 0.99999)] + [0.0, -0.0, -1e-9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.printed(F.col("x"), 4).alias("s")).collect()
    assert [r.s for r in got] == ["%.4f" % r.x for r in got]


def test_a_centre_in_a_crowd_meets_only_the_first_points(spark, monkeypatch):
    # Sample 1: a crowd and stragglers; sample 2: all in one place; sample 3: sorted along a line, and a point without a place.
    import random

    r = random.Random(8)
    rows = [(1, i, r.gauss(0, 0.1), r.gauss(0, 0.1), r.gauss(0, 0.3)) for i in range(600)] + [(2, i, 1.0, 1.0, 1.0) for i in range(300)] + [(3, i, i / 50, 0.0, 0.0) for i in range(200)] + [(3, 900, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "sample_id long, pid long, x double, y double, z double")
    monkeypatch.setattr(cloud, "FIRST", 12, raising=False)
    monkeypatch.setattr(cloud, "PIECE", 16, raising=False)
    met = []
    real = cloud.written
    monkeypatch.setattr(cloud, "written", lambda df, label: (lambda t: met.append(t.selectExpr("size(_met)").groupBy().sum().first()[0]) or t if label == "pieces" else t)(real(df, label)))
    got = {(x.sample_id, x.cid): x.ids for x in cloud.ball_query(p.withColumnRenamed("pid", "cid"), p, 0.15, 8).collect()}
    want = {}
    for s, c, *a in rows[:-1]:
        ids = [q for t, q, *b in rows[:-1] if t == s and sum((u - v) * (u - v) for u, v in zip(b, a, strict=True)) <= 0.15 * 0.15][:8]
        want[s, c] = ids + ids[:1] * (8 - len(ids))
    assert got == want
    assert len(met) > 2  # in rounds, of which the first has at most 12 points for each cell


def test_queries_of_one_box_go_down_together(spark, monkeypatch):
    seen = []
    real = cloud._near
    monkeypatch.setattr(cloud, "_near", lambda pairs, k: seen.append(pairs.select("gid" if "gid" in pairs.columns else "qid").distinct().count()) or real(pairs, k))
    p = spark.range(800).selectExpr("1 AS sample_id", "id AS pid", "id * 37 % 101 / 10e0 AS x", "id * 53 % 97 / 10e0 AS y", "0e0 AS z")
    found = cloud.nearest(p.withColumnRenamed("pid", "qid"), p, 1)
    assert found.where("qid = pid and d2 = 0 and rank = 1").count() == 800
    assert seen and max(seen) < 200


def test_pairs_of_one_large_sample_are_dealt_over_tasks(spark, monkeypatch):
    # Sample 1 is large, two faces of it are alike and two lie nowhere; the others are small, or known by nothing.
    rows = [(1, i, i * 37 % 101 / 10, i * 53 % 97 / 10, float(i % 7)) for i in range(160)] + [(1, 40, 0.0, 0.0, 0.0), (1, 901, None, 0.0, 0.0), (1, 902, float("nan"), 0.0, 0.0)]
    rows += [(2, i, float(i), 0.0, 0.0) for i in (3, -1, 7)] + [(3, 1, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0, 0.0)]
    monkeypatch.setattr(cloud, "FACES", 16, raising=False)
    monkeypatch.setattr(cloud, "RUN", 4, raising=False)
    faces = spark.createDataFrame(rows, "sample_id int, i long, x double, y double, z double").coalesce(1)
    found = cloud.centroid_distances(faces)
    assert found.dtypes == [("sample_id", "int"), ("i", "bigint"), ("j", "bigint"), ("d", "double")]
    far = lambda a, b: None if None in (*a, *b) else sum((u - v) ** 2 for u, v in zip(a, b, strict=True)) ** 0.5
    want = [(s, i, j, far(a, b)) for s, i, *a in rows if s and i is not None for t, j, *b in rows if t == s and j is not None and i < j]
    text = lambda r: (*r[:3], None if r[3] is None else round(r[3], 9))
    assert sorted(map(repr, map(text, found.collect()))) == sorted(map(repr, map(text, want)))
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 1 and max(shares) < 0.6 * len(want)


def test_values_beside_a_tie_are_rounded_as_in_sql(spark, tmp_path):
    values = [s * float(f"{k}.{(k * 7919) % 10**9:09d}5") for s in (1, -1) for k in range(2000)] + [0.0, 0.5, 2.5e-9, 3.5e-9, 0.49999999999999994e-9, 123456789012345.6]

    def plain(x):
        product = abs(x) * 1e9
        whole = int(product)
        return (whole + (product - whole >= 0.5)) / 1e9 * (1 if x >= 0 else -1)

    rows = [(2 * k, k, [0.0, 0.0, 0.0]) for k in range(2000)] + [(2 * k + 1, k, [values[k], 0.0, 0.0]) for k in range(2000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {x.sample_id: x.d for x in __spark_entry__.queries()["centroid_distance"](spark, str(tmp_path)).collect()}
    assert found == {k: plain((values[k] * values[k]) ** 0.5) for k in range(2000)}
    r = spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.rounded(F.col("x"), 9).alias("r")).collect()
    assert [v.r for v in r] == [plain(v.x) for v in r]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),), (1e300,)], "x double").select(numbers.rounded(F.col("x"), 9).cast("string").alias("r")).collect()
    assert [v.r for v in odd] == [None, "NaN", "-Infinity", "1.0E300"]
