"""Mesh topology, components, ordered loops and GLB documents against plain walks."""

import json
import random
import struct

import pytest

from partloom.operators import graphs, meshes
from partloom.sources import glb, readers

CUBE = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
TRIANGLES = "part_id string, t long, a long, b long, c long"


def rows(name, faces, shift=0):
    return [(name, i, *(x + shift for x in f)) for i, f in enumerate(faces)]


def test_closed_open_turned_and_doubled_cubes_are_told_apart(spark):
    turned = [FACES[0][::-1], *FACES[1:]]
    data = rows("closed", FACES) + rows("open", FACES[1:]) + rows("turned", turned) + rows("double", [*FACES, FACES[0]]) + rows("two", FACES) + rows("two", FACES, 8) + rows("flat", [(0, 0, 1)]) + rows("mixed", [*FACES, (3, 3, 4)])
    df = spark.createDataFrame(data, TRIANGLES)
    got = {(r.part_id, r.component): tuple(r)[2:] for r in meshes.mesh_topology(df).collect()}
    assert got["closed", 0] == got["mixed", 0] == got["two", 0] == got["two", 8] == (8, 18, 12, 0, 0, 0, 2, True)
    assert got["open", 0] == (8, 18, 11, 3, 0, 0, 1, False)
    assert got["turned", 0] == (8, 18, 12, 0, 0, 3, 2, False)
    assert got["double", 0] == (8, 18, 13, 0, 3, 0, 3, False)
    assert not any(k[0] == "flat" for k in got)
    verdict = {r.part_id: (r.solids, r.n_failed, r.degenerate, r.passed) for r in meshes.topology_failures(df).collect()}
    assert verdict == {"closed": (1, 0, 0, True), "open": (1, 1, 0, False), "turned": (1, 1, 0, False), "double": (1, 1, 0, False), "two": (2, 0, 0, True), "flat": (0, 0, 1, False), "mixed": (1, 0, 1, True)}
    assert meshes.mesh_topology(spark.createDataFrame([], TRIANGLES)).count() == 0


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(2)
    edges = [("path", i, i + 1) for i in range(40)] + [("star", 7, i) for i in range(30)] + [("loop", 3, 3)]
    order = list(range(60))
    rng.shuffle(order)
    edges += [("shuffled", order[i], order[i + 1]) for i in range(59)] + [("random", rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    got = {(r.g, r.node): r.component for r in graphs.components(spark.createDataFrame(edges, "g string, a long, b long")).collect()}
    of = {x: x for g, a, b in edges for x in ((g, a), (g, b))}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for g, a, b in edges:
        x, y = top((g, a)), top((g, b))
        of[max(x, y)] = min(x, y)
    assert got == {x: top(x)[1] for x in of}


@pytest.mark.parametrize("length", [1, 2, 3, 8, 33])
def test_rings_in_order_and_chains_left_out(spark, length):
    nodes = list(range(length))
    random.Random(length).shuffle(nodes)
    steps = [("ring", nodes[i], nodes[(i + 1) % length]) for i in range(length)] + [("chain", i, i + 1) for i in range(9)]
    got = {(r.g, r.pos): (r.ring, r.node) for r in graphs.ring_order(spark.createDataFrame(steps, "g string, a long, b long")).collect()}
    at = nodes.index(0)
    assert got == {("ring", k): (0, nodes[(at + k) % length]) for k in range(length)}


def test_loops_and_planes_of_a_cube(spark):
    side = {i: i // 2 for i in range(12)}
    data = [("cube", side[i], *f) for i, f in enumerate(FACES)] + [("bow", 0, 0, 1, 2), ("bow", 0, 0, 3, 4)]
    faces = spark.createDataFrame(data, "part_id string, segment long, a long, b long, c long")
    loops = {}
    for r in sorted(meshes.boundary_loops(faces).collect(), key=lambda r: r.pos):
        loops.setdefault((r.part_id, r.segment, r.loop, r.loop_to), []).append(r.vertex)
    cube = {k: v for k, v in loops.items() if k[0] == "cube"}
    assert len(cube) == 6 and all(len(v) == 4 for v in cube.values())
    assert cube["cube", 0, 0, 1] == [0, 1, 3, 2]
    # Two triangles that share a vertex only: both borders together, each edge once.
    assert sorted(len(v) for k, v in loops.items() if k[0] == "bow") in ([3, 3], [6])
    points = spark.createDataFrame([("cube", i, *p) for i, p in enumerate(CUBE)] + [("bow", i, float(i), float(i * i), 0.0) for i in range(5)], "part_id string, v long, x double, y double, z double")
    planes = {(r.part_id, r.segment): r for r in meshes.segment_planes(points, faces).collect()}
    assert all(r.planar and r.flatness == pytest.approx(0, abs=1e-12) for r in planes.values())
    top = planes["cube", 0]
    assert (top.nx, top.ny, top.nz) == pytest.approx((1, 0, 0)) and (top.cx, top.cy, top.cz) == pytest.approx((0, 0.5, 0.5))


def test_a_document_has_exact_bytes_bounds_normals_and_materials(spark):
    pieces = glb.PIECE
    glb.PIECE = 5
    try:
        made = spark.createDataFrame([("d", "m2", 2, "second", "u2", ("red", [1.0, 0.0, 0.0, 1.0], 0.5, 0.25)), ("d", "m1", 1, "first é", "u1", None), ("e", "m1", 1, "other", "u3", None), ("d", "none", 3, "no vertices", "u4", None)], "document string, mesh string, ord int, name string, part_id string, material struct<name: string, base_color: array<double>, metallic: double, roughness: double>")
        v = [(d, m, 10 * i, 1000 * x + k, 1000 * y, 1000 * z, 0.0, 1.0, 0.0) for k, (d, m) in enumerate((("d", "m1"), ("d", "m2"), ("e", "m1"))) for i, (x, y, z) in enumerate(CUBE)]
        t = [(d, m, i, *(10 * c for c in f)) for d, m in (("d", "m1"), ("d", "m2"), ("e", "m1")) for i, f in enumerate(FACES)] + [("d", "m1", 99, 0, 10, 12345)]
        vertices = spark.createDataFrame(v, "document string, mesh string, v long, x double, y double, z double, nx double, ny double, nz double")
        triangles = spark.createDataFrame(t, "document string, mesh string, t long, a long, b long, c long")
        files = {r.document: bytes(r.content) for r in glb.glb_documents(made, vertices, triangles).collect()}
    finally:
        glb.PIECE = pieces
    assert set(files) == {"d", "e"}
    for name, content in files.items():
        magic, version, total, size, kind = struct.unpack_from("<5I", content)
        assert (magic, version, total, kind, size % 4) == (0x46546C67, 2, len(content), 0x4E4F534A, 0)
        doc = json.loads(content[20 : 20 + size])
        length, kind = struct.unpack_from("<2I", content, 20 + size)
        assert kind == 0x004E4942 and length % 4 == 0 and length == doc["buffers"][0]["byteLength"] == len(content) - 28 - size
        assert [m["name"] for m in doc["meshes"]] == (["first é", "second"] if name == "d" else ["other"])
        parsed, blob = readers.split_glb(content)
        for k, m in enumerate(doc["meshes"]):
            p = m["primitives"][0]
            xyz = readers.accessor(parsed, blob, p["attributes"]["POSITION"])
            shift = {"first é": 0, "second": 1, "other": 2}[m["name"]]
            want = [((1000 * x + shift) * 0.001, z, -y) for x, y, z in CUBE]
            assert xyz.tolist() == [[struct.unpack("<f", struct.pack("<f", c))[0] for c in w] for w in want]
            a = parsed["accessors"][p["attributes"]["POSITION"]]
            assert a["min"] == xyz.min(axis=0).astype(float).tolist() and a["max"] == xyz.max(axis=0).astype(float).tolist()
            assert readers.accessor(parsed, blob, p["indices"]).reshape(-1, 3).tolist() == [list(f) for f in FACES]
            assert readers.accessor(parsed, blob, p["attributes"]["NORMAL"]).tolist() == [[0.0, 0.0, -1.0]] * 8
            assert doc["materials"][p["material"]]["name"] == ("red" if m["name"] == "second" else "default")
            assert k == p["material"] - 1


def test_documents_are_decoded_where_they_are_asked_for_and_joined_in_runs(spark, monkeypatch):
    doc = {"asset": {"version": "2.0"}, "nodes": [{"name": f"é, ]{i}", "mesh": i, "children": [[], {}]} for i in range(3)], "scenes": [], "n": -1.5}
    found = readers.decoded_document(memoryview((json.dumps(doc, indent=1) + "  ").encode()))
    assert not isinstance(found["nodes"], list) and {k: list(v) if k in ("nodes", "scenes") else v for k, v in found.items()} == doc
    for bad in ('{"a":[1,]}', '{"a":[1 2]}', '{"a":1,}', '{"a":1} x', '{"a":[1', "{1:2}"):
        with pytest.raises(ValueError):
            readers.decoded_document(bad.encode())
    n = 23
    made = spark.range(n).selectExpr("'d' AS document", "id AS mesh", "-id AS ord", "'name ' || id AS name", "'u' || id AS part_id")
    vertices = spark.range(3 * n).selectExpr("'d' AS document", "id div 3 AS mesh", "id AS v", "id * 1000D AS x", "id % 3 * 1000D AS y", "0D AS z")
    triangles = spark.range(n).selectExpr("'d' AS document", "id AS mesh", "0 AS t", "3 * id AS a", "3 * id + 1 AS b", "3 * id + 2 AS c")
    whole = [bytes(glb.glb_documents(made, vertices, triangles).first().content)]
    monkeypatch.setattr(glb, "RUN", 4)
    monkeypatch.setattr(glb, "STRETCH", 64)
    files = glb.glb_documents(made, vertices, triangles)
    assert [bytes(files.first().content)] == whole
    monkeypatch.setattr(readers, "NODES", 5)
    nodes = readers.gltf_nodes_of(files.select(files.document.alias("path"), "content"), bounds=True).orderBy("node").collect()
    assert [(r.node, r.name, r.part_id, r.low[0], r.high[0]) for r in nodes] == [(i, f"name {n - 1 - i}", f"u{n - 1 - i}", 3.0 * (n - 1 - i), 3.0 * (n - 1 - i) + 2) for i in range(n)]
