"""Reconciliation, greedy steps, quality checks, readers, sinks and streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from partloom.operators import cloud, greedy, labels, plumbing, quality
from partloom.operators import reconcile as rc
from partloom.sources import readers, sinks
from partloom.streaming import events

PART = "part_id string, ord long, name string, topology_hash string, volume double, sx double, sy double, sz double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def part(pid, o, name="n", h="h", v=1000.0, tx=0.0):
    return (pid, o, name, h, v, 10.0, 10.0, 10.0, tx, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def brute_greedy(new, old, score, least):
    used, out = set(), {}
    for n in new:
        best, at = 0.0, None
        for o in old:
            s = score(n, o)
            if o[0] not in used and s > best:
                best, at = s, o
        if at is not None and best >= least:
            used.add(at[0])
            out[n[0]] = (at[0], best)
    return out


def test_match_passes_in_order(spark):
    old = [part("a", 0), part("b", 1, "bolt", "hb", 50.0), part("c", 2, "cover plate", "hc", 700.0, 100.0), part("d", 3, "gone", "hd", 9.0, 9e6)]
    new = [part("a", 0, tx=5.0), part("x", 1, "renamed", "hb", 50.0), part("y", 2, "cover-plate", "other", 9999.0, 130.0), part("z", 3, "fresh", "hz", 123456.0, -9e6)]
    o, n = spark.createDataFrame(old, PART), spark.createDataFrame(new, PART)
    m = rc.match(n, o)
    got = {r.new_id: (r.old_id, r.stage, r.ambiguous) for r in m.collect()}
    assert got == {"a": ("a", "uuid", False), "x": ("b", "fingerprint", False), "y": ("c", "name_position", True)}
    changes = {r.part_id: r.change_type for r in rc.diff(n, o, m).collect()}
    assert changes == {"a": "moved", "x": "renamed", "y": "reshaped", "z": "added", "d": "deleted"}
    assert {r.change_type: r.n for r in rc.diff_summary(rc.diff(n, o, m)).collect()}["recolored"] == 0
    assert rc.splits(m).count() == 0 and rc.merges(m).count() == 0


def test_greedy_uses_up_weak_matches(spark):
    cols = "new_part_id long, new_ord long, old_part_id long, old_ord long, confidence double"
    pairs = [(1, 0, 10, 0, 0.6), (2, 1, 10, 0, 0.95), (2, 1, 11, 1, 0.6), (3, 2, 12, 2, 0.85), (3, 2, 13, 3, 0.85)]
    got = sorted(map(tuple, greedy.greedy_one_to_one(spark.createDataFrame(pairs, cols)).collect()))
    assert got == [(1, 10, 0.6), (2, 11, 0.6), (3, 12, 0.85)]


def test_fingerprints_match_brute_force(spark):
    import random

    r = random.Random(3)
    old = [part(f"o{i}", i, "n", f"h{r.randrange(12)}", r.choice([100.0, 100.05, 103.0, 200.0, 201.0]) * (1 + i % 3)) for i in range(30)]
    new = [part(f"n{i}", i, "n", f"h{r.randrange(12)}", r.choice([100.0, 100.05, 103.0, 200.0, 201.0]) * (1 + i % 3)) for i in range(30)]

    def score(n, o):
        gap = abs(n[4] - o[4]) / max(n[4], o[4], 1e-10)
        if n[3] == o[3]:
            return 0.95 if gap <= 0.001 else 0.85 if gap <= 0.01 else 0.80
        return 0.85 if gap <= 0.001 else 0.70 if gap <= 0.01 else 0.60 if gap <= 0.05 else 0.0

    got = {x.new_id: (x.old_id, x.confidence) for x in greedy.greedy_one_to_one(rc.fingerprint_candidates(spark.createDataFrame(new, PART), spark.createDataFrame(old, PART))).collect()}
    assert got == brute_greedy(new, old, score, 0.60)


def test_repetitions_are_seeded_in_order(spark):
    rows = [("a", 0, 6.0, 30.0, 0.0), ("b", 1, 6.1, 30.2, 0.0), ("c", 2, 6.2, 30.4, 0.0), ("d", 3, 10.0, 40.0, 0.0), ("e", 4, 6.05, 30.0, 0.0)]
    df = spark.createDataFrame(rows, "part_id string, ord long, diameter double, length double, volume double")
    got = {r.part_id: (r.seed_id, r.repetition) for r in greedy.repetition_groups(df).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "e": ("a", 3)}


def test_revalidation(spark):
    box = "part_id string, tx double, ty double, tz double, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"
    new = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 10.0), ("b", 11.5, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 10.0), ("c", 500.0, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 10.0)], box)
    m = spark.createDataFrame([(x, x) for x in "abc"], "new_id string, old_id string")
    e = spark.createDataFrame([("fastener", "a", "b"), ("fastener", "a", "c"), ("mate", "a", "b"), ("contact", "a", "c"), ("weld", "a", "c"), ("weld", "a", "gone")], "kind string, subject_id string, target_id string")
    got = {(r.kind, r.target_id): r.broken for r in rc.revalidate(e, m, new).collect()}
    assert got == {("fastener", "b"): False, ("fastener", "c"): True, ("mate", "b"): False, ("contact", "c"): True, ("weld", "c"): False, ("weld", "gone"): True}


def test_names_and_archive(spark):
    names = ["M3 hex bolt.step", "bracket_01", "Assembly top", "pinion", "DIN125 M4", "unnamed solid 3", "x m4 x 20"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [(r.l.label, r.l.subtype) for r in df.select(labels.harvest_label(F.col("n")).alias("l")).collect()]
    assert got[0] == ("fastener", "hex_bolt") and got[1][0] == "non_fastener" and got[2][0] == "assembly" and got[3][0] == "unknown" and got[4] == ("fastener", "washer") and got[5][0] == "unknown" and got[6] == ("fastener", "metric_fastener")
    m = spark.createDataFrame([("z", 0, "../escape.step", 5), ("z", 1, "ok.step", 5), ("z", 2, "note.txt", 5), ("z", 3, "big.step", 500), ("z", 4, "trip.step", 96), ("z", 5, "late.step", 1)], "archive string, pos int, name string, size long")
    got = {r.name: r.status for r in plumbing.archive_scan(m, (".step",), 100, 100).collect()}
    assert got == {"../escape.step": "skipped_unsafe_path", "ok.step": "staged", "big.step": "skipped_member_too_large", "trip.step": "skipped_archive_too_large", "late.step": "skipped_archive_too_large"}


def test_holdout_guard_fails_the_query(spark):
    rows, held = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",)], "k string")
    assert plumbing.guard_holdout(rows, held.where("k = 'z'"), "k").count() == 2
    with pytest.raises(Exception, match="holdout row"):
        plumbing.guard_holdout(rows, held, "k").collect()


def test_textures_and_normals(spark):
    f = spark.createDataFrame([("b.png", bytearray(b"\x89PNG1")), ("a.png", bytearray(b"\x89PNG1")), ("c.jpg", bytearray(b"\xff\xd8\xff"))], "path string, content binary")
    assert [tuple(r) for r in quality.duplicate_textures(f).collect()] == [("b.png", "a.png")]
    assert [r.x for r in f.orderBy("path").select(quality.texture_format(F.col("content")).alias("x")).collect()] == ["png", "png", "jpg"]
    p = spark.createDataFrame([("s", 0.0, 0.0, 1.0), ("s", 0.0, 0.0, 1.0), ("t", 0.0, 1.0, 0.0), ("t", 0.0, 0.0, 1.0)], "sample_id string, nx double, ny double, nz double")
    assert [r.sample_id for r in quality.degenerate_normals(p).collect()] == ["s"]


def test_farthest_points_and_axis(spark):
    pts = [("s", i, float(i), 0.1 * (i % 2), 0.0) for i in range(10)]
    df = spark.createDataFrame(pts, "sample_id string, pid long, x double, y double, z double")
    assert [r.pid for r in cloud.farthest_points(df, 3).orderBy("step").collect()] == [0, 9, 4]
    a = cloud.principal_axis(df).first()
    assert a.ax == pytest.approx(1.0, abs=1e-3)
    m = cloud.axis_measures(df, cloud.principal_axis(df)).first()
    assert m.length == pytest.approx(9.0, abs=0.05)
    assert cloud.resample(df, 25).count() == 25 and cloud.resample(df, 4).count() == 4


def glb(doc, blob):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    body = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(blob), 0x004E4942) + blob
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


def test_readers(spark, tmp_path):
    xyz = struct.pack("<9f", 0, 0, 0, 1, 0, 0, 0, 1, 0)
    doc = {
        "nodes": [{"name": "root", "children": [1]}, {"name": "leaf", "mesh": 0, "extras": {"part_uuid": "u1"}}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}] * 2}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 3}],
        "bufferViews": [{"byteOffset": 0}, {"byteOffset": 36}],
    }
    (tmp_path / "a.glb").write_bytes(glb(doc, xyz + struct.pack("<3H", 0, 1, 2)))
    nodes = {r.name: (r.parent, r.part_id) for r in readers.read_gltf_nodes(spark, f"{tmp_path}/a.glb").collect()}
    assert nodes == {"root": (None, None), "leaf": (0, "u1")}
    t = readers.read_gltf_triangles(spark, f"{tmp_path}/a.glb").orderBy("a").collect()
    assert [(r.a, r.b, r.c, r.bx) for r in t] == [(0, 1, 2, 1.0), (3, 4, 5, 1.0)]
    (tmp_path / "m.udsmesh").write_bytes(struct.pack("<II", 3, 3) + xyz + struct.pack("<3I", 0, 1, 2))
    assert [(r.n_vertices, r.n_faces) for r in readers.read_udsmesh(spark, f"{tmp_path}/m.udsmesh").collect()] == [(3, 1)]
    (tmp_path / "urls.txt").write_text("# head\n\nhttp://a/x, note\nhttp://b/y\n")
    assert [r.url for r in readers.read_url_manifest(spark, f"{tmp_path}/urls.txt").collect()] == ["http://a/x", "http://b/y"]
    (tmp_path / "p.step").write_text("x\n#1 = PRODUCT ( 'Bolt' ,'','');")
    (tmp_path / "q.step").write_text("nothing")
    assert sorted(r.name for r in readers.product_names(spark, f"{tmp_path}/*.step").collect()) == ["Bolt", "q"]
    (tmp_path / "scene.xml").write_text('<S><StaticMeshActor Name="m1" Label="L" Mesh="x"><Transform tx="1" ty="2" tz="3"/></StaticMeshActor><Actor Name="a1"/></S>')
    got = readers.read_datasmith(spark, f"{tmp_path}/scene.xml").orderBy("source_ord").collect()
    assert [(r.element, r.part_id, r.name) for r in got] == [("Actor", "a1", "a1"), ("StaticMeshActor", "m1", "L")] and got[1].translation == [10.0, -20.0, 30.0]


def test_manifest_round_trip(spark, tmp_path):
    meta = spark.createDataFrame([("m", "1.0", "mm")], "manifest_id string, version string, units string")
    parts = spark.createDataFrame([("m", 1, "u2", "b"), ("m", 0, "u1", "a")], "manifest_id string, ord int, uuid string, name string")
    rel = spark.createDataFrame([("m", 0, "fastener", "u1", "u2")], "manifest_id string, ord int, kind string, subject_uuid string, target_uuid string")
    sinks.manifest_json(meta, parts, rel).select("value").coalesce(1).write.text(f"{tmp_path}/out")
    back = readers.read_manifests(spark, f"{tmp_path}/out")
    assert [(r.ord, r.uuid) for r in back["parts"].orderBy("ord").collect()] == [(0, "u1"), (1, "u2")]
    assert back["relationships"].first().kind == "fastener" and back["meta"].first().units == "mm"


def test_sinks(spark):
    parts = spark.createDataFrame([("r", None, "Root part", 0), ("c", "r", "9bolt", 1), ("d", "r", "9bolt", 2), ("o", "missing", "orphan", 3)], "part_id string, parent_id string, name string, ord int")
    got = {r.part_id: r.path for r in sinks.scene_prims(parts).collect()}
    assert got == {"r": "/Root_part", "c": "/Root_part/p_9bolt", "d": "/Root_part/p_9bolt_1", "o": "/orphan"}
    nodes = {r.part_id: (r.children, r.root) for r in sinks.gltf_nodes(parts).collect()}
    assert nodes["r"] == ([1, 2], True) and nodes["o"] == (None, True)
    text = "\n".join(r.line for r in sinks.exchange_text(parts.limit(1)).orderBy("pos").collect())
    assert text.startswith("ISO-10303-21;") and "#1 = PRODUCT('Root part'" in text
    assert sinks.next_version(spark.createDataFrame([(1,), (4,)], "version int")).first().label == "v0005"


def test_stream_resumes_and_replay_adds_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"event":"e","id":"a"}\n{"event":"e","id":"b"}\nbroken\n')
    run = lambda ck: events.run_resumable(events.read_events(spark, str(src)).where("id is not null"), lambda b: b.select("id", F.lit(1).alias("score")), out, str(tmp_path / ck), "id").awaitTermination()
    run("ck")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    (src / "2.json").write_text('{"event":"e","id":"b"}\n{"event":"e","id":"c"}\n')
    run("ck")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_fingerprint_match_by_shapes(spark):
    import random

    r = random.Random(8)
    shapes = [(f"h{r.randrange(5)}", r.choice([100.0, 100.05, 103.0, 0.0, -1.0, 4.5e-11, 5.2e-11])) for _ in range(9)]
    old = [part(f"o{i}", i, "n", *r.choice(shapes)) for i in range(50)]
    new = [part(f"n{i}", i, "n", *r.choice(shapes)) for i in range(50)]

    def score(n, o):
        gap = abs(n[4] - o[4]) / max(n[4], o[4], 1e-10)
        if n[3] == o[3]:
            return 0.95 if gap <= 0.001 else 0.85 if gap <= 0.01 else 0.80
        return 0.85 if gap <= 0.001 else 0.70 if gap <= 0.01 else 0.60 if gap <= 0.05 else 0.0

    got = {x.new_id: (x.old_id, x.confidence) for x in rc.fingerprint_match(spark.createDataFrame(new, PART), spark.createDataFrame(old, PART)).collect()}
    assert got == brute_greedy(new, old, score, 0.60)


def test_tables_are_scoped_and_refuse_local_folders(spark, monkeypatch):
    import os

    from partloom import tables

    with tables.scope(spark) as outer:
        inside = tables.written(spark.range(5), "inside")
        kept = tables.kept(inside.where("id > 1"), "kept", outer)
        path = inside.inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and kept.count() == 3

    class Far:
        master = "spark://far:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Far()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_fingerprint_match_walks_volumes_that_meet_in_few_rounds(spark, monkeypatch):
    """Parts that all want the same old ones, across the edges of slabs: a round for each of them before."""
    import random

    from partloom.operators import fingerprints

    r = random.Random(5)
    tables, real = [], fingerprints.written
    monkeypatch.setattr(fingerprints, "written", lambda df, label: tables.append(label) or real(df, label))
    old = [part(f"o{i}", i, "n", r.choice([None, "a", "b", f"h{i}"]), 100.0 * 1.5 ** r.random()) for i in range(150)]
    new = [part(f"n{i}", i, "n", r.choice([None, "a", "b", f"k{i}"]), r.choice([None, -1.0, *[100.0 * 1.5 ** r.random() for _ in range(8)]])) for i in range(120)]

    def score(n, o):
        same = n[3] is not None and n[3] == o[3]
        if n[4] is None:
            return 0.80 if same else 0.0
        gap = abs(n[4] - o[4]) / max(n[4], o[4], 1e-10)
        if same:
            return 0.95 if gap <= 0.001 else 0.85 if gap <= 0.01 else 0.80
        return 0.85 if gap <= 0.001 else 0.70 if gap <= 0.01 else 0.60 if gap <= 0.05 else 0.0

    got = {x.new_id: (x.old_id, x.confidence) for x in rc.fingerprint_match(spark.createDataFrame(new, PART), spark.createDataFrame(old, PART)).collect()}
    assert got == brute_greedy(new, old, score, 0.60)
    assert tables.count("made") <= 30


@pytest.mark.parametrize("few", [0, 64])
def test_a_slab_is_walked_with_a_few_numbers_for_each_part(monkeypatch, few):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from partloom.operators import fingerprints

    monkeypatch.setattr(fingerprints, "FEW", few)
    n, r = 20000, np.random.default_rng(3)
    kind = np.arange(n) % 8 == 0
    rows = {"kind": (~kind).astype("int32"), "place": np.arange(n), "volume": np.exp(r.uniform(0, 0.2, n)), "code": r.integers(-1, 3000 if few else 40, n), "held": np.where(~kind & (np.arange(n) % 50 == 1), np.arange(n) + 900, -1), "b0": np.arange(n), "b1": np.arange(n)}
    table = pa.table(rows | {k: np.ones(n) for k in ("sx", "sy", "sz")})
    tracemalloc.start()
    found = fingerprints._walk(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n // 8 and len({x["o"] for x in found}) == n // 8
    assert peak < n * (300 if few else 500)
    # The first new part meets all old ones free, but for those held by earlier parts: there are none.
    best, v = found[0], rows["volume"]
    gap = abs(v - v[0]) / np.maximum(v, v[0])
    same = ~kind & (rows["code"] == rows["code"][0]) & (rows["code"][0] >= 0)
    near = np.flatnonzero(same & (gap <= 0.001)) if (same & (gap <= 0.001)).any() else np.flatnonzero(~kind & (gap <= 0.001) | same & (gap <= 0.01))
    assert (best["n"], best["o"]) == (0, near[0])


def test_diff_by_id_is_one_join_of_rows_dealt_by_count(spark):
    old = spark.sql("SELECT id AS part_id, 'p' || id AS name, 'h' AS topology_hash, 5e0 AS volume, 1e0 AS tx, 0e0 AS ty, 0e0 AS tz, 0e0 AS qx, 0e0 AS qy, 0e0 AS qz, 1e0 AS qw FROM range(40)")
    old = old.union(old.limit(1).withColumn("part_id", F.lit(None).cast("long")))
    new = old.where("part_id is null or part_id > 4").withColumn("name", F.expr("CASE WHEN part_id % 5 = 1 THEN 'other' ELSE name END")).withColumn("tx", F.expr("CASE WHEN part_id % 5 = 2 THEN 9e0 ELSE tx END"))
    new = new.withColumn("volume", F.expr("CASE WHEN part_id % 5 = 3 THEN 8e0 WHEN part_id % 5 = 4 THEN NULL ELSE volume END")).union(old.where("part_id = 7").withColumn("part_id", F.lit(99).cast("long")))
    found = rc.diff_by_id(new, old)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(key, found.collect())) == sorted(map(key, rc.diff(new, old, rc.uuid_matches(new, old)).collect()))
    plan = __import__("__spark_entry__").queries()["uuid_match_diff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and sum("Join" in line for line in plan.splitlines()) == 1
