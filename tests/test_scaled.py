"""Neighbours, paths, farthest points, surface draws, exact decimals, Poisson resampling and keyed streams against plain versions."""

import heapq
import json
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partloom.functions.numbers import printed
from partloom.operators import cloud
from partloom.operators import evalstats as es
from partloom.operators import standards
from partloom.streaming import events

POINTS = "sample_id string, pid long, x double, y double, z double"


def clustered(seed, n=700):
    rng = random.Random(seed)
    rows = [("a", i, rng.gauss(5, 1e-3), rng.gauss(5, 1e-3), 5.0) for i in range(n)]  # a dense place
    rows += [("a", n + i, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(60)]
    rows += [("a", 5000 + i, 1.0, 1.0, 1.0) for i in range(90)]  # copies of one place
    rows += [("b", i, float(i % 5), float(i // 5 % 5), 0.0) for i in range(25)] + [("c", 1, 0.0, 0.0, 0.0)]
    return rows


@pytest.mark.parametrize(("k", "leaf"), [(1, 4), (3, 8), (5, 32)])
def test_nearest_equals_all_pairs_on_clustered_points(spark, k, leaf):
    rows = clustered(k)
    queries = [("a", i, *p[2:]) for i, p in enumerate(rows[::9])] + [("a", 900, 50.0, -3.0, 5.0), ("b", 0, 2.5, 2.5, 0.0), ("c", 0, 1.0, 1.0, 1.0), ("none", 0, 0.0, 0.0, 0.0), ("a", 901, None, 0.0, 0.0)]
    q = spark.createDataFrame(queries, "sample_id string, qid long, x double, y double, z double")
    df = spark.createDataFrame([*rows, ("a", 9999, None, 1.0, 1.0)], POINTS)
    got = {(r.sample_id, r.qid, r["rank"]): (r.pid, r.d2) for r in cloud.nearest(q, df, k, leaf).collect()}
    want = {}
    for s, i, x, y, z in queries:
        if x is not None:
            near = sorted(((p[2] - x) ** 2 + (p[3] - y) ** 2 + (p[4] - z) ** 2, p[1]) for p in rows if p[0] == s)[:k]
            want |= {(s, i, n): (pid, d) for n, (d, pid) in enumerate(near, 1)}
    assert {x: p for x, (p, _) in got.items()} == {x: p for x, (p, _) in want.items()}
    assert all(got[x][1] == pytest.approx(want[x][1]) for x in want)


def test_no_query_meets_a_whole_sample(spark):
    df = spark.createDataFrame([r for r in clustered(1, 3000) if r[0] == "a"], POINTS)
    placed, boxes = cloud._leaves(df, 16)
    sizes = placed.groupBy("sample_id", "level", "_x", "_y", "_z").agg(F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("places"))
    assert sizes.where("n > 16 and places > 1").isEmpty() and placed.count() == df.count()
    assert boxes.where("level = 0").first().n == df.count()


def test_paths_over_ten_thousand_faces(spark):
    """A round graph of 10,000 faces, from two of them: hops by rings, angles by plain relaxation."""
    n, jumps = 10_000, (1, 7, 60, 500, 3000)
    edges = [(i, (i + k) % n, 0.25 * (1 + i % 4)) for i in range(n) for k in jumps]
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["i", "j", "angle"])).withColumn("sample_id", F.lit("s"))
    sources = spark.createDataFrame([("s", 0), ("s", 77), ("s", 123_456)], "sample_id string, i long")
    graph = {}
    for i, j, w in edges:
        graph.setdefault(i, []).append((j, w))
        graph.setdefault(j, []).append((i, w))
    for weighted in (False, True):
        got = {(r.i, r.j): r.d for r in cloud.shortest_paths(df, weighted, sources).collect()}
        want = {}
        for start in (0, 77):
            best, heap = {start: 0.0}, [(0.0, start)]
            while heap:
                d, at = heapq.heappop(heap)
                for to, w in graph[at] if d == best[at] else ():
                    if d + (w if weighted else 1.0) < best.get(to, math.inf):
                        best[to] = d + (w if weighted else 1.0)
                        heapq.heappush(heap, (best[to], to))
            want |= {(start, j): d for j, d in best.items()}
        assert got == want


def test_farthest_points_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cloud, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [("a", int(i), *map(float, rng.integers(0, 6, 3))) for i in rng.permutation(150)] + [("b", i, 1.0, 1.0, 1.0) for i in range(3)]
    got = Counter((r.sample_id, r.step, r.pid) for r in cloud.farthest_points(spark.createDataFrame(rows, POINTS), 6, start=4).collect())
    want = Counter()
    for s in "ab":
        own = sorted(r for r in rows if r[0] == s)
        x, pids = np.array([r[2:] for r in own]), [r[1] for r in own]
        d, at = np.full(len(x), np.inf), min(4, len(x) - 1)
        for step in range(min(6, len(x))):
            want[s, step, pids[at]] += 1
            d = np.minimum(d, ((x - x[at]) ** 2).sum(axis=1))
            at = int(d.argmax())
    assert got == want


def test_surface_draws_follow_areas_without_a_range_join(spark):
    """A mesh of one large triangle and very many small ones: every draw has one triangle, in proportion to area."""
    big = ("m", 0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0)
    small = [("m", i, 0.0, 0.0, 5.0, 0.1, 0.0, 5.0, 0.0, 0.1, 5.0) for i in range(1, 2001)]
    flat = ("m", 5000, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)
    names = ", ".join(f"{k}{a} double" for k in "abc" for a in "xyz")
    df = spark.createDataFrame([big, *small, flat, ("none", 0, *[0.0] * 9)], f"mesh_id string, fid long, {names}")
    found = cloud.surface_samples(df, 4000).collect()
    assert len(found) == len({r.draw for r in found}) == 4000 and all(r.fid != 5000 for r in found)
    share = sum(r.fid == 0 for r in found) / 4000
    assert share == pytest.approx(50 / 60, abs=0.03)
    assert all(abs(r.z - (0.0 if r.fid == 0 else 5.0)) < 1e-9 and r.x >= -1e-12 and r.y >= -1e-12 and r.x + r.y <= (10.0 if r.fid == 0 else 0.1) + 1e-9 for r in found)


def test_printed_equals_c(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    x = np.concatenate([rng.random(n) * 1e4, np.round(rng.random(n) * 1e3, 5), (rng.integers(0, 10**7, n) * 2 + 1) / 2.0 ** rng.integers(1, 20, n), 10.0 ** rng.uniform(-20, 34, n) * rng.choice([-1, 1], n), [0.0, -0.0, np.inf, -np.inf, 0.5, 1.5, 2.5, 0.00005, 0.99995, 1e22, 1e23, 2.0**53, -0.00001]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for decimals in (0, 4, 12):
        got = df.select("x", printed(F.col("x"), decimals).alias("s")).toPandas()
        assert all(s == f"{v:.{decimals}f}" for v, s in zip(got.x, got.s, strict=True))
    odd = spark.range(1).select(printed(F.lit(float("nan")), 2).alias("a"), printed(F.lit(None).cast("double"), 2).alias("b"), printed(F.lit(1e36), 2).alias("c")).first()
    assert tuple(odd) == ("nan", None, None)


def test_poisson_bootstrap_covers_and_agrees_with_itself(spark):
    df = spark.range(600).select("id", (F.col("id") % 3 > 0).alias("a"), (F.col("id") % 2 == 0).alias("b")).repartition(5)
    r = es.poisson_bootstrap(df, F.col("id"), F.col("a"), F.col("b"), 300).first()
    assert r.replicates == 300 and r.low < 1 / 6 < r.high and r.mean == pytest.approx(1 / 6, abs=0.01)
    assert r == es.poisson_bootstrap(df.repartition(2), F.col("id"), F.col("a"), F.col("b"), 300).first()
    assert sum(math.exp(-1) / math.factorial(k) for k in range(13)) == pytest.approx(es.POISSON_STEPS[-1])
    assert es.poisson_bootstrap(df.limit(0), F.col("id"), F.col("a"), F.col("b"), 10).first().replicates == 0


def test_best_of_equals_the_best_of_all_scores(spark):
    rng = random.Random(1)
    pick = lambda *v: rng.choice([None, *v])
    kinds = [None, *standards.FAMILY_OF_SIGNATURE, "unknown"]
    rows = [(i, pick(3.0, 4.1, 5.2, 8.0), pick(3.0, 6.0), pick(5.5, 7.0, 13.0), pick(3.0, 4.0), pick(True, False), pick(0.1, 1.0, 3.0), pick(0.4, 0.8), rng.choice(kinds), pick(0.0, 4.0, 8.0), pick(7.0, 13.0)) for i in range(150)]
    schema = "part_id long, bcyl_d double, median_d double, head_d double, head_h double, has_thread boolean, aspect double, cyl_ratio double, sig_type string, sig_shaft double, sig_head double"
    df = spark.createDataFrame(rows, schema)
    for features in (df, df.drop("sig_type", "sig_shaft", "sig_head")):
        slow = standards.best_match(standards.score_all(features, standards.standards(spark)))
        fast = standards.best_of(features)
        columns = ["part_id", "standard", "variant", "type", "score"]
        assert sorted(map(tuple, fast.select(*columns).collect())) == sorted(map(tuple, slow.select(*columns).collect()))
        plan = fast._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Exchange" not in plan and "Sort" not in plan


def test_a_stream_keeps_its_keys_as_state(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    put = lambda name, *ids: (src / name).write_text("".join(json.dumps({"event": "e", "id": i}) + "\n" for i in ids))
    reads = []

    def score(batch):
        plan = batch._jdf.queryExecution().optimizedPlan().toString()
        reads.append("epoch=" in plan or "anti" in plan.lower())
        return batch.select("id", F.lit(1).alias("score"))

    run = lambda ck: events.run_resumable(events.read_events(spark, str(src)).where("id is not null"), score, out, str(tmp_path / ck), "id").awaitTermination()
    put("1.json", "a", "b", "b")
    run("ck")
    put("2.json", "b", "c", "a")
    run("ck")
    put("3.json", "c", "d")
    run("ck")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
    assert not any(reads)  # earlier output isn't read again
    put("4.json", "e")
    run("new")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d", "e"]


def test_a_model_is_plugged_in_and_its_shape_checked(spark):
    from partloom.operators import ensemble

    class Model:
        classes = ("a", "b")

        def __call__(self, features):
            return np.stack([features["x"], 1 - features["x"]], axis=1)

    class Wrong(Model):
        def __call__(self, features):
            return np.zeros((1, 3))

    parts = spark.createDataFrame([("p", 0.25), ("q", 0.5)], "part_id string, x double")
    got = {r.part_id: [(s.cls, s.prob) for s in r.scores] for r in ensemble.scored_by(parts, Model, ("a", "b"), rows=1).collect()}
    assert got == {"p": [("b", 0.75), ("a", 0.25)], "q": [("a", 0.5), ("b", 0.5)]}
    for model, classes in ((Wrong, ("a", "b")), (Model, ("b", "a"))):
        with pytest.raises(Exception, match="the model"):
            ensemble.scored_by(parts, model, classes).collect()
