"""What kind of fastener a part's geometry suggests: an ordered decision list, the first match wins.

Four rules end the list without a signature when their shaft is too large.
Rule ids go up in the order of the list; 0 stands for no signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.operators.features import median_of, radius_clusters

# Type and confidence of each rule.
KINDS = {
    1: ("flat_washer", 0.90), 2: ("hex_nut", 0.90), 3: ("socket_head_cap_screw", 0.88), 4: ("hex_bolt", 0.85), 5: ("wood_screw", 0.75), 6: ("threaded_stud", 0.80),
    7: ("dowel_pin", 0.78), 8: ("dowel_pin", 0.78), 9: ("square_nut", 0.82), 10: ("threaded_insert", 0.78), 11: ("set_screw", 0.75),
}


def _last(clusters: Column) -> Column:
    return F.try_element_at(clusters, F.lit(-1))


def has_head(part: dict[str, Column]) -> Column:
    ec = part["ec"]
    stepped = (F.size(ec) >= 2) & (_last(ec)["median"] >= 1.3 * F.get(ec, 0)["median"])
    return (part["n_cone"] + part["n_torus"] + part["n_sphere"] >= 1) | F.coalesce(part["head_d"] > 0, F.lit(False)) | F.coalesce(stepped, F.lit(False))


def with_signature(features: DataFrame) -> DataFrame:
    """Adds sig_rule, sig_type, sig_conf, sig_shaft, sig_head, sig_length and strict_head.

    features: d0 <= d1 <= d2 (sorted extents), volume, aspect, bcyl_d, bcyl_l, head_d, ext and internal (arrays
    of external and internal cylinder radii), n_plane, n_cone, n_torus, n_sphere, num_faces.
    """
    df = features.withColumn("_ec", radius_clusters(F.col("ext"))).withColumn("_ic", radius_clusters(F.col("internal")))
    c = F.col
    a, f = c("aspect"), F.when(c("d2") < 1e-9, 1.0).otherwise(c("d0") / c("d2"))
    ne, ni, ec = F.size("ext"), F.size("internal"), c("_ec")
    mi, me = F.array_max("internal"), F.array_min("ext")
    med_e, med_i, top_e = median_of(c("ext")), median_of(c("internal")), F.array_max("ext")
    first, last = F.get(ec, 0)["median"], _last(ec)["median"]
    head = has_head({"ec": ec, **{k: c(k) for k in ("n_cone", "n_torus", "n_sphere", "head_d")}})
    df = df.withColumn("_head", head)
    H = c("_head")
    yes = lambda x: F.coalesce(x, F.lit(False))
    disc = (c("d2") >= 1e-9) & (f <= 0.4) & (c("d1") / c("d2") >= 0.8)
    common = F.array_max(F.transform(ec, lambda x: F.struct(x["n"], x["median"])))["median"]
    # Conditions of rule 1..11, and for four of them the shaft beyond which the list ends.
    rules = {
        1: disc & (ni >= 1) & (ne >= 1) & (c("n_plane") >= 2) & (c("num_faces") <= 60) & (c("n_torus") <= 4) & (top_e > 1.15 * F.array_min("internal")),
        2: a.between(0.2, 1.8) & (ni >= 1) & (c("n_plane") >= 6) & (mi > 0) & (~yes(F.exists("ext", lambda r: r > 1.2 * med_i)) | (a < 0.8)),
        3: a.between(1.0, 15.0) & (ne >= 2) & (ni >= 1) & (F.size(ec) >= 2) & (last >= 1.3 * first) & (mi > 0) & (mi < 1.1 * first) & (first <= 30),
        4: a.between(1.2, 15.0) & (ne >= 1) & H & (c("n_plane") >= 6) & ((ni == 0) | (mi < 0.6 * me)),
        5: (a >= 5) & (f <= 0.25) & (c("n_cone") >= 1) & (ne >= 3) & (ni >= 1),
        6: (a >= 3) & (f <= 0.35) & (ne >= 1) & ~H & (c("n_plane") <= 10) & ((ni == 0) | (mi < 0.5 * me)),
        7: a.between(0.4, 10.0) & (f <= 0.5) & (ne >= 1) & ~H & (ni == 0) & (c("n_plane") <= 4) & med_e.between(0.4, 10.0),
        8: a.between(0.4, 30.0) & (f <= 0.5) & (ne >= 2) & (F.size(ec) >= 2) & (ni == 0) & (c("n_plane") <= 6) & first.between(0.4, 30.0) & (last / first).between(1.1, 3.0),
        9: a.between(0.5, 2.5) & f.between(0.4, 1.0) & (ni >= 1) & c("n_plane").between(4, 6) & (mi > 0) & med_i.between(1.0, 20.0),
        10: a.between(0.7, 2.2) & (f <= 0.7) & (ni >= 3) & (ne >= 6) & (F.size(ec) == 1) & (F.size("_ic") <= 3) & (mi > 0) & (c("n_cone") >= 2) & (c("n_plane") >= 2) & med_i.between(1.5, 15.0) & (last > 1.15 * med_i),
        11: a.between(0.5, 4.0) & (f <= 0.4) & (ne >= 1) & ~H & (ni >= 1) & (mi > 0) & (mi < 0.9 * me),
    }
    ends = {4: common > 30, 5: med_e > 15, 6: med_e > 30, 11: med_e > 30}
    guard = (c("d2") > 500) | (c("volume") > 500000.0) | ((ne > 0) & (me > 30))
    rule = F.when(yes(guard), 0)
    for k, cond in rules.items():
        if k in ends:
            rule = rule.when(yes(cond) & yes(ends[k]), 0)
        rule = rule.when(yes(cond), k)
    df = df.withColumn("sig_rule", rule.otherwise(0))
    knurl = last
    bolt_head = F.when(last <= 1.1 * common, c("bcyl_d") / 2).otherwise(last)
    shaft = {1: 2 * F.array_min("internal"), 2: 2 * med_i, 3: 2 * first, 4: 2 * common, 5: 2 * med_e, 6: 2 * med_e, 7: 2 * med_e, 8: 2 * first, 9: 2 * med_i, 10: 2 * med_i, 11: 2 * med_e}
    wide = {1: 2 * top_e, 2: F.greatest(c("d1"), 1.5 * 2 * med_i), 3: 2 * last, 4: 2 * bolt_head, 5: 2 * top_e, 6: 2 * med_e, 7: 2 * med_e, 8: 2 * last, 9: c("d1"), 10: 2 * knurl, 11: 2 * med_e}
    choose = lambda arms: _by_rule(arms)
    strict = (c("n_cone") + c("n_torus") + c("n_sphere") >= 1) | yes((F.size(ec) >= 2) & (last >= 1.3 * first)) | yes((c("bcyl_d") > 0) & (c("head_d") >= 1.3 * c("bcyl_d")))
    out = df.withColumns({
        "sig_type": choose({k: F.lit(v[0]) for k, v in KINDS.items()}),
        "sig_conf": choose({k: F.lit(v[1]) for k, v in KINDS.items()}),
        "sig_shaft": choose(shaft),
        "sig_head": choose(wide),
        "sig_length": F.when(c("sig_rule") > 0, c("bcyl_l")),
        "strict_head": strict,
    })
    return out.drop("_ec", "_ic", "_head")


def _by_rule(arms: dict[int, Column]) -> Column:
    out = None
    for k, value in arms.items():
        out = F.when(F.col("sig_rule") == k, value) if out is None else out.when(F.col("sig_rule") == k, value)
    return out
