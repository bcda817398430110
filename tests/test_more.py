"""Operators that no query of the catalogue uses."""

import json
import math

import pytest
from pyspark.sql import functions as F

from partloom.functions import geometry as g
from partloom.functions import text as tx
from partloom.operators import cloud, ensemble, evalstats, features, labels, plumbing, quality, summaries
from partloom.operators import reconcile as rc
from partloom.sources import readers, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lits(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def test_geometry(spark):
    r = one(spark, concave=features.concave(lits(-1, 0, 0), lits(2, 0, 5), lits(0, 0, 0), lits(0, 0, 1), F.lit(2.0)), off=g.off_axis(lits(3, 4, 9), lits(0, 0, 0), lits(0, 0, 1)), angle=g.angle_between(lits(1, 0, 0), lits(0, 1, 0)))
    assert r.concave and r.off == 5.0 and r.angle == pytest.approx(math.pi / 2)
    for there, back in ((g.canonical_to_engine, g.engine_to_canonical), (g.canonical_to_gltf, g.gltf_to_canonical)):
        p = one(spark, **dict(zip("xyz", back(there(lits(1, 2, 3))), strict=True)))
        assert (p.x, p.y, p.z) == (pytest.approx(1), pytest.approx(2), pytest.approx(3))
    turn = [0, -2, 0, 5, 2, 0, 0, 6, 0, 0, 2, 7, 0, 0, 0, 1]  # a quarter turn about z, scale 2
    m = one(spark, **g.decompose([F.lit(float(x)) for x in turn]))
    assert (m.tx, m.ty, m.tz, m.sx, m.sy, m.sz) == (5, 6, 7, 2, 2, 2)
    assert (m.qx, m.qy, m.qz, m.qw) == (0, 0, pytest.approx(math.sqrt(0.5)), pytest.approx(math.sqrt(0.5)))
    half = one(spark, **g.decompose([F.lit(float(x)) for x in (1, 0, 0, 0, 0, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1)]))
    assert (half.qx, half.qw) == (1.0, 0.0)
    p = one(spark, **dict(zip("xyz", g.apply_matrix([F.lit(float(x)) for x in turn], lits(1, 0, 0)), strict=True)))
    assert (p.x, p.y, p.z) == (5.0, 8.0, 7.0)


def test_keys_and_names(spark):
    k = lambda areas: features.topology_key(F.lit(6), F.lit(12), F.lit(8), F.array(*map(F.lit, areas)))
    r = one(spark, a=k([1.0, 2.0]), b=k([2.0, 1.0]), c=k([2.0, 1.1]))
    assert r.a == r.b != r.c and len(r.a) == 64
    r = one(spark, stem=tx.family_stem(F.lit("8822T912")), slug=tx.slugify(F.lit(" Hex Bolt/M6 ")), safe=tx.safe_name(F.lit("a b/ü-1")), prim=tx.prim_name(F.lit("9 x")), base=tx.base_type(F.lit("possible_hex_bolt")), h=tx.hash_fraction(F.lit("seed:abc")), con=tx.safe_filename(F.lit("con.txt")), bad=tx.safe_filename(F.lit("a:b?. ")))
    assert (r.stem, r.slug, r.safe, r.prim, r.base, r.con, r.bad) == ("8822T", "hex_bolt_m6", "a_b_ü-1", "p_9_x", "hex_bolt", "_con.txt", "a_b_")
    assert r.h == pytest.approx(0.8297474556206138)
    s = lambda a, b: tx.name_similarity(F.lit(a), F.lit(b))
    r = one(spark, a=s("x", "x"), b=s("X ", "x"), c=s("bolt", "big bolt"), d=s("a b c", "a-c d"), e=s("q", "z"))
    assert (r.a, r.b, r.c, r.d, r.e) == (1.0, 0.95, 0.8, pytest.approx(2 / 3), 0.0)


def test_boxes_segments_samples(spark):
    b = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 2.0, 0.0, 3.0)], "box_id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    assert {(r.x, r.y, r.z) for r in features.box_corners(b).collect()} == {(x, y, z) for x in (0, 1) for y in (0, 2) for z in (0, 3)}
    f = spark.createDataFrame([("m", 0, 0.0, 0.0, 1.0), ("m", 1, 1.0, 0.0, 0.0), ("m", 2, 0.0, 0.1, 0.995)], "mesh_id string, fid long, nx double, ny double, nz double")
    assert {r.fid: r.segment for r in cloud.normal_segments(f).collect()} == {0: 0, 1: 1, 2: 0}
    t = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), ("m", 1, 5.0, 0.0, 0.0, 8.0, 0.0, 0.0, 5.0, 3.0, 0.0)], "mesh_id string, fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    s = cloud.surface_samples(t, 400).collect()
    assert len(s) == 400 and 20 <= sum(r.fid == 0 for r in s) <= 65
    p = spark.createDataFrame([("s", i, float(i), 0.0, 0.0) for i in range(5)], "sample_id string, pid long, x double, y double, z double")
    a, again = cloud.augment(p, 3).collect(), cloud.augment(p, 3).collect()
    assert a == again and len(a) == 5


GEO = "sample_id string, top3 array<struct<cls:string,prob:double>>, aspect double, d0 double, d1 double, d2 double, ext array<double>, internal array<double>, n_cone int, n_torus int, n_sphere int, n_plane int, num_faces int, cyl_ratio double, bcyl_d double, bcyl_l double, head_d double, rule_type string, merged_type string, merged_conf double, max_dim double"


def test_gates_after_the_merge(spark):
    top = [("non_fastener", 0.6), ("nuts", 0.3), ("pins", 0.1)]
    base = ("s", top, 3.0, 5.0, 5.0, 15.0, [2.0], [], 0, 1, 0, 2, 5, 0.6, 5.0, 15.0, None)
    rows = [(*base, "unclassified", "non_fastener", 0.6, 15.0), (*base, "hex_bolt", "non_fastener", 0.6, 15.0), (*base, "unclassified", "nuts", 0.9, 300.0)]
    screw = ("s", top, 3.0, 5.0, 5.0, 15.0, [2.0], [], 1, 0, 0, 4, 12, 0.6, 5.0, 15.0, None)
    rows.append((*screw, "unclassified", "likely_washers", 0.7, 15.0))
    got = [(r.final_type, r.final_conf, r.gate) for r in ensemble.gated(spark.createDataFrame(rows, GEO).coalesce(1)).collect()]
    assert got == [("likely_nuts", 0.3, "rescued"), ("non_fastener", 0.6, None), ("unclassified", 0.0, "size"), ("likely_screws", 0.6, "screw")]
    r = one(spark, a=ensemble.banded(F.lit("nuts"), F.lit(0.9)), b=ensemble.banded(F.lit("nuts"), F.lit(0.5)), c=ensemble.banded(F.lit("nuts"), F.lit(0.1)))
    assert (r.a, r.b, r.c) == ("nuts", "likely_nuts", "unclassified")
    routed = ensemble.route(spark.createDataFrame([(0.95, 9), (0.5, 9), (0.5, 900)], "confidence double, num_faces int").coalesce(1))
    assert [r.route for r in routed.collect()] == ["rules", "primary", "fallback"]


def test_labels_by_folder_and_file(spark):
    df = spark.createDataFrame([("f", 0, "d", "nut", 0.8), ("f", 1, "d", "bolt", 0.8), ("g", 0, "d", "unclassified", 0.1), ("h", 0, "x", "bolt", 0.9)], "file string, ord int, folder string, pred string, confidence double")
    assert {r.file: r.pred for r in labels.best_per_file(df).collect()} == {"f": "nut", "g": "unclassified", "h": "bolt"}
    accepted = spark.createDataFrame([("d", ["nut"])], "folder string, types array<string>")
    assert sorted(r.verdict for r in labels.folder_score(df, accepted).collect()) == ["correct", "missed", "wrong", "wrong"]
    r = one(spark, a=labels.named_truth(F.lit("DIN912-M3#2")), b=labels.named_truth(F.lit("x")), c=labels.names_standard(F.lit("my ISO 4017")), d=labels.names_standard(F.lit("miso 4")), e=labels.subtype(F.lit("square_nut")), f=labels.subtype(F.lit("?")))
    assert (r.a.cls, r.b, r.c, r.d, r.e, r.f) == ("screws", None, True, False, "nuts", "non_fastener")
    t = labels.tally(df, {"nut": "nuts", "bolt": "bolts", "pin": "pins"}, F.col("pred"))
    assert {r.bucket: r.n for r in t.collect()} == {"nuts": 1, "bolts": 2, "pins": 0}


def test_more_quality(spark):
    ok = "ISO-10303-21;HEADER;FILE_SCHEMA;DATA;ENDSEC;END-ISO-10303-21;"
    f = spark.createDataFrame([("a", ok, "{}"), ("b", ok, "{"), ("c", "no", "{}")], "path string, content string, manifest string")
    assert quality.schema_check(f).first().failures == 2
    assert quality.round_trip(f).first().passed
    pmi, parts = spark.createDataFrame([("p",), ("q",)], "target_id string"), spark.createDataFrame([("p",)], "part_id string")
    r = quality.pmi_audit(pmi, parts, 5).first()
    assert (r.passed, r.score, r.failures) == (False, 0.5, 4)
    t = quality.topology_attribution(spark.createDataFrame([("p", 4, 1)], "part_id string, before int, after int")).first()
    assert (t.passed, t.score) == (False, 0.75)
    r = one(spark, a=quality.looks_like_html(F.lit(" <!DOCTYPE html>")), b=quality.unsafe_path(F.lit("a/../b")), c=quality.unsafe_path(F.lit("a..b/c")))
    assert (r.a, r.b, r.c) == (True, True, False)
    assert quality.outside_domain(f, "path", ("a", "b")).count() == 1


def test_more_reconciliation(spark):
    cols = "part_id string, ord long, topology_hash string, volume double, sx double, sy double, sz double"
    reg = spark.createDataFrame([("a", 0, "h", 100.0, 1.0, 1.0, 1.0), ("b", 1, "g", 100.5, 1.0, 1.0, 1.05), ("c", 2, "k", 500.0, 9.0, 9.0, 9.0), ("d", 3, "h", 300.0, 1.0, 1.0, 1.0)], cols)
    target = spark.createDataFrame([("t", 0, "h", 100.0, 1.0, 1.0, 1.0)], cols)
    got = [(r.part_id, r.confidence, r["rank"]) for r in rc.registry_lookup(reg, target).orderBy("rank").collect()]
    assert got == [("a", 0.95, 1), ("b", 0.85, 2), ("d", 0.80, 3)]
    m = spark.createDataFrame([("n1", "o1"), ("n2", "o2")], "new_id string, old_id string")
    assert rc.resolve(m, m.where("new_id = 'n1'")).count() == 1
    new, old = (spark.createDataFrame([(i, x)], "part_id string, tag string") for i, x in (("n1", "fresh"), ("o1", "kept")))
    assert rc.merged_parts(new, old, m, ["tag"]).first().tag == "kept"
    row = spark.createDataFrame([("moved", 3.0, 0.0, 4.0, 0.0, 0.0, 0.0, 2.0, 1.0, "a", "b"), ("reshaped", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.1, 1.0, "a", "b"), ("renamed", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, "new", "old")], "change_type string, new_tx double, old_tx double, new_ty double, old_ty double, new_tz double, old_tz double, new_volume double, old_volume double, new_name string, old_name string").coalesce(1)
    assert [r.d for r in row.select(rc.change_details().alias("d")).collect()] == ["Moved 5.00mm (dx=3.0, dy=4.0, dz=0.0)", "Geometry changed (volume +10.0%)", "Renamed: 'old' → 'new'"]


def test_more_plumbing(spark):
    req = spark.createDataFrame([("s", "a", "k"), ("t", "b", "k")], "sample_id string, kind string, key string")
    index = spark.createDataFrame([("k", "late", 1), ("k", "early", 0)], "key string, path string, root_ord int")
    assert {r.sample_id: r.path for r in plumbing.resolve_sources(req, {"a": index, "b": index}).collect()} == {"s": "early", "t": "early"}
    log = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "sample_id string, t int, status string")
    assert plumbing.last_results(log, "sample_id", "t").first().status == "y"
    art = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "a")], "sample_id string, kind string")
    assert [r.sample_id for r in plumbing.complete_samples(art).collect()] == ["s"]
    assert [r.priority for r in plumbing.family_order(spark.createDataFrame([("hex-nut",), ("pin",)], "s string").coalesce(1), F.col("s"), ["bolt", "nut"]).collect()] == [1, 10000]
    d = one(spark, m=summaries.measured_dims(shaft=F.lit(6.12345), head=F.lit(None).cast("double")))
    assert d.m == {"shaft": 6.123}
    assert one(spark, x=summaries.dimension(F.create_map(F.lit("b"), F.lit(2.0)), "a", "b", default=6.0)).x == 2.0
    assert [tuple(r) for r in evalstats.most_common(log, "status", 1).collect()] == [("x", 1)]


def test_more_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"parts": [{"uuid": "u", "name": "n", "transform": {"translation": [1, 2, 3]}, "mesh_ref": "m.bin"}]}))
    assert readers.read_unreal_bundle(spark, f"{tmp_path}/b.json").first().translation == [10.0, -20.0, 30.0]
    (tmp_path / "split.json").write_text(json.dumps({"train": [f"s{i}" for i in range(200)], "test": ["t"]}))
    got = [r.split for r in readers.split_file(spark, f"{tmp_path}/split.json").collect()]
    assert got.count("test") == 1 and 5 < got.count("val") < 45
    (tmp_path / "root/train/bolt").mkdir(parents=True)
    (tmp_path / "root/train/bolt/x1.npy").write_bytes(b"1")
    r = readers.scan_samples(spark, f"{tmp_path}/root").first()
    assert (r.split, r["class"], r.name) == ("train", "bolt", "x1")
    solids = spark.createDataFrame([("f", 0, "A", 1), ("f", 1, "A", 1), ("f", 2, None, 1), ("f", 3, "B", 0)], "file string, ord int, name string, n_solids int")
    assert sorted(r.name for r in readers.flat_parts(solids).collect()) == ["A", "A_1", "Part_003"]
    assert readers.fallback_part(spark.createDataFrame([("/x/y.step",)], "path string")).first().name == "y"
    p = spark.createDataFrame([("u", "n", [10.0, 20.0, 30.0])], "part_id string, name string, translation array<double>")
    sinks.write_datasmith(p, f"{tmp_path}/scene")
    assert readers.read_datasmith(spark, f"{tmp_path}/scene").where("part_id = 'u'").first().translation == [pytest.approx(10.0), pytest.approx(20.0), pytest.approx(30.0)]
    assert json.loads(sinks.event_lines(p.select("part_id", F.lit(None).cast("int").alias("x"))).first().value) == {"part_id": "u"}


def test_paths_of_deep_trees_and_of_cycles(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(100)], "part_id long, parent_id long, name string")
    got = {r.id: (r.path, r.depth) for r in plumbing.assembly_paths(df).collect()}
    assert got == {i: ("/".join(f"n{j}" for j in range(i + 1)), i + 1) for i in range(100)}
    ring = spark.createDataFrame([(1, 3, "a"), (2, 1, "b"), (3, 2, "c"), (4, None, "d")], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        plumbing.assembly_paths(ring)
