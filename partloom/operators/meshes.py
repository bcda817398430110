"""Triangle meshes as tables: half-edge topology, planes and boundary loops of segments.

vertices (part_id, v, x, y, z) and triangles (part_id, t, a, b, c), where a, b, c name vertices of the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions import geometry as g
from partloom.operators.graphs import components, paired_steps, ring_order
from partloom.tables import merged, written


def half_edges(triangles: DataFrame) -> DataFrame:
    """The three directed edges of each triangle: the columns of triangles but for a, b, c, and a, b."""
    rest = [c for c in triangles.columns if c not in ("a", "b", "c")]
    pairs = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])
    return triangles.select(*rest, F.explode(pairs).alias("e")).select(*rest, "e.a", "e.b")


def _sound() -> Column:
    return (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c"))


def mesh_topology(triangles: DataFrame) -> DataFrame:
    """triangles -> a row per part and component: part_id, component (its least vertex), vertices, edges, faces, boundary, non_manifold, inconsistent, euler, closed.

    An edge between two vertices is on the boundary if one triangle has it, non
    manifold if more than two have it, and inconsistent if two have it in the
    same direction. euler is vertices - edges + faces; closed says that there is
    none of the three. Triangles that name a vertex twice count nowhere (see
    ``topology_failures``).
    """
    sound = triangles.where(_sound())
    label = components(half_edges(sound).select(F.col("part_id").alias("g"), "a", "b"))
    label = written(label.select(F.col("g").alias("part_id"), "node", "component"), "components")
    of = label.select("part_id", F.col("node").alias("a"), "component")
    way = F.when(F.col("a") < F.col("b"), 1).otherwise(0)
    edges = half_edges(sound).select("part_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), way.alias("up")).groupBy("part_id", "a", "b").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    count = lambda c: F.sum(c.cast("long"))
    by_edge = edges.join(merged(of), ["part_id", "a"]).groupBy("part_id", "component").agg(
        F.count("*").alias("edges"), count(F.col("n") == 1).alias("boundary"), count(F.col("n") > 2).alias("non_manifold"), count((F.col("n") == 2) & (F.col("up") != 1)).alias("inconsistent")
    )
    by_face = sound.join(merged(of), ["part_id", "a"]).groupBy("part_id", "component").agg(F.count("*").alias("faces"))
    by_vertex = label.groupBy("part_id", "component").agg(F.count("*").alias("vertices"))
    out = merged(by_vertex).join(merged(by_edge), ["part_id", "component"]).join(merged(by_face), ["part_id", "component"])
    euler = F.col("vertices") - F.col("edges") + F.col("faces")
    closed = (F.col("boundary") == 0) & (F.col("non_manifold") == 0) & (F.col("inconsistent") == 0)
    return out.select("part_id", "component", "vertices", "edges", "faces", "boundary", "non_manifold", "inconsistent", euler.alias("euler"), closed.alias("closed"))


def topology_failures(triangles: DataFrame) -> DataFrame:
    """triangles -> part_id, solids, n_failed, degenerate, detail: a part's components that aren't closed, oriented solids, and why.

    Parts without a sound triangle have no solid and don't pass.
    """
    found = mesh_topology(triangles)
    flat = triangles.groupBy("part_id").agg(F.sum((~_sound()).cast("long")).alias("degenerate"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = found.groupBy("part_id").agg(F.count("*").alias("solids"), F.sum((~F.col("closed")).cast("long")).alias("n_failed"), total("boundary"), total("non_manifold"), total("inconsistent"))
    say = lambda c, words: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))
    why = F.concat_ws("; ", say("boundary", " free edges"), say("non_manifold", " edges of more than two faces"), say("inconsistent", " edges of faces turned against each other"))
    out = merged(flat).join(merged(sums), "part_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select("part_id", n("solids").alias("solids"), n("n_failed").alias("n_failed"), "degenerate", ((n("solids") > 0) & (n("n_failed") == 0)).alias("passed"), F.coalesce(why, F.lit("")).alias("detail"))


def _planes(tolerance: float):
    """Rows of moments -> least direction and flatness, a batch at a time."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            m = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            # Not divided by n: the ratio needs no scale, and each division would round.
            least = 1e-10 * np.maximum(pdf["n"].to_numpy() - 1, 1)
            values, axes = np.linalg.eigh(m)
            normal, few = axes[:, :, 0], pdf["n"].to_numpy() < 3
            normal[few] = (0.0, 0.0, 1.0)
            lead = np.argmax(np.abs(normal) > 1e-9, axis=1)
            normal = normal * np.where(normal[np.arange(len(normal)), lead] < 0, -1.0, 1.0)[:, None]
            flatness = np.where(few, 0.0, np.maximum(values[:, 0], 0.0) / np.maximum(values[:, 2], least))
            out = pdf[["part_id", "segment", "n", "cx", "cy", "cz"]].rename(columns={"n": "n_vertices"})
            yield out.assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], flatness=flatness, planar=flatness < tolerance)

    return run


def segment_planes(vertices: DataFrame, faces: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """faces (part_id, segment, a, b, c) -> part_id, segment, n_vertices, cx, cy, cz, nx, ny, nz, flatness, planar.

    The plane of a segment's distinct vertices: their mean, and the direction in
    which they vary least, with its first component that isn't 0 positive.
    flatness is the least over the greatest variance; below ``tolerance`` a
    segment is planar. Of fewer than three vertices the plane is level. Only the
    six moments of a segment reach Python.
    """
    key = ["part_id", "segment"]
    corner = faces.select(*key, F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    p = merged(written(merged(corner).join(merged(vertices), ["part_id", "v"]), "corners"))
    mean = p.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(k).alias(f"c{k}") for k in "xyz"])
    off = {k: F.col(k) - F.col(f"c{k}") for k in "xyz"}
    moments = p.join(merged(mean), key).groupBy(*key, "n", "cx", "cy", "cz").agg(*[F.sum(off[k[0]] * off[k[1]]).alias(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")])
    kinds = [f"{k} {faces.schema[k].dataType.simpleString()}" for k in key]
    numbers = ", ".join(f"{c} double" for c in ("cx", "cy", "cz", "nx", "ny", "nz", "flatness"))
    return moments.mapInPandas(_planes(tolerance), f"{kinds[0]}, {kinds[1]}, n_vertices long, {numbers}, planar boolean")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """faces (part_id, segment, a, b, c) -> part_id, segment, loop, loop_to, pos, vertex: the border of each segment as ordered rings.

    A directed edge is on the border if the segment lacks its reverse. Rings
    follow the triangles' direction and start at their least edge, from loop to
    loop_to. Where several
    border edges leave a vertex, the k-th that comes in (by its start) goes on
    as the k-th that leaves (by its end).
    """
    e = half_edges(faces.select(F.struct("part_id", "segment").alias("g"), "a", "b", "c").where(_sound())).distinct()
    border = e.join(merged(e.select("g", F.col("b").alias("a"), F.col("a").alias("b"))), ["g", "a", "b"], "left_anti").withColumn("edge", F.struct("a", "b"))
    border = written(border, "border")
    rings = ring_order(paired_steps(border))
    return rings.select("g.part_id", "g.segment", F.col("ring.a").alias("loop"), F.col("ring.b").alias("loop_to"), "pos", F.col("node.a").alias("vertex"))
