"""Model labels, geometric sanity, and their merge with rule labels.

Columns used: ml top-3 as ``top3`` array<struct<cls, prob>>, rule labels as rule_type, rule_conf; features aspect,
d0 <= d1 <= d2, ext, internal, n_cone, n_torus, n_sphere, n_plane, num_faces, cyl_ratio, bcyl_d, bcyl_l, head_d.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import base_type
from partloom.operators.features import radius_clusters

NON = "non_fastener"


class Scorer(Protocol):
    """A model: rows of part features -> for each row the probability of every class, as an array of (rows, classes)."""

    classes: tuple[str, ...]

    def __call__(self, features: pd.DataFrame) -> np.ndarray: ...


def scored_by(parts: DataFrame, load: Callable[[], Scorer], classes: tuple[str, ...], key: str = "part_id", rows: int = 1024) -> DataFrame:
    """parts (key, features...) -> key, scores: array<struct<cls, prob>>, from the most likely class down, ties in the order of classes.

    ``load`` makes the model, once for each task, where it runs; ``rows`` parts are scored at a time. A model that
    gives other classes or another number of rows fails the query.
    """
    kind = parts.schema[key].dataType.simpleString()

    def run(batches):
        model = load()
        if tuple(model.classes) != tuple(classes):
            raise ValueError(f"the model has classes {model.classes}, expected {classes}")
        names = np.array(classes, dtype=object)
        for whole in batches:
            for lo in range(0, len(whole), rows):
                pdf = whole.iloc[lo : lo + rows]
                prob = np.asarray(model(pdf), dtype=float)
                if prob.shape != (len(pdf), len(classes)):
                    raise ValueError(f"the model gave {prob.shape} for {len(pdf)} parts")
                order = np.argsort(-prob, axis=1, kind="stable")
                scores = [[{"cls": c, "prob": p} for c, p in zip(names[o], q[o].tolist(), strict=True)] for o, q in zip(order, prob, strict=True)]
                yield pd.DataFrame({key: pdf[key].to_numpy(), "scores": scores})

    return parts.mapInPandas(run, f"{key} {kind}, scores array<struct<cls: string, prob: double>>")


def banded(cls: Column, prob: Column, threshold: float = 0.40, sure: float = 0.85) -> Column:
    return F.when(prob >= sure, cls).when(prob >= threshold, F.concat(F.lit("likely_"), cls)).otherwise("unclassified")


def sane(cls: Column) -> Column:
    """Whether the part's shape allows the class; unknown shapes and unlisted classes are allowed."""
    c = F.col
    kind = F.replace(F.lower(cls), F.lit("-"), F.lit("_"))
    a, f = c("aspect"), c("d0") / c("d2")
    ne, ni, ec = F.size("ext"), F.size("internal"), radius_clusters(c("ext"))
    last, first = F.try_element_at(ec, F.lit(-1))["median"], F.get(ec, 0)["median"]
    stepped = F.coalesce((F.size(ec) >= 2) & (last >= 1.3 * first), F.lit(False))
    shaped = c("n_cone") + c("n_torus") + c("n_sphere") >= 1
    reject = (
        F.when(kind.isin("washers", "washer", "flat_washer", "spring_washer", "lock_washer"), ~((f <= 0.35) & (a <= 1.5)))
        .when(kind.isin("pins", "cylindrical_pin", "dowel_pin"), ((f <= 0.3) & (ne <= 2)) | (shaped & (a < 2)))
        .when(kind.isin("screws", "hex_bolt", "socket_head_cap_screw", "button_head_screw", "countersunk_socket_screw", "wood_screw", "thin_hex_nut"), ((f <= 0.25) & (a <= 1.5)) | ((ne == 0) & (ni >= 1)) | ((a >= 2) & ~shaped & ~stepped))
        .when(kind.isin("nuts", "hex_nut", "square_nut", "threaded_insert"), (a > 3) | ((ni == 0) & (ne >= 1)))
        .when(kind.isin("threaded_rods", "threaded_stud"), ((f > 0.5) & (a < 2)) | (shaped & (a < 5)))
        .when(kind == "rivets", a > 8)
        .when(kind == "spacers", (f > 0.6) & (a < 1))
        .otherwise(False)
    )
    return c("d2").isNull() | (c("d2") < 1e-9) | ~F.coalesce(reject, F.lit(False))


def recovered(df: DataFrame) -> DataFrame:
    """Adds ml_type, ml_conf, ml_action: the first of the top three that the shape allows.

    A non_fastener of probability .25 met on the way means unclassified; so does no sane class at all.
    """
    cls = lambda i: F.get("top3", i)["cls"]
    prob = lambda i: F.get("top3", i)["prob"]
    ok = lambda i: F.coalesce(sane(cls(i)), F.lit(False)) & cls(i).isNotNull()
    stop = lambda i: F.coalesce((cls(i) == NON) & (prob(i) >= 0.25), F.lit(False))
    second = ok(1) & (cls(1) != NON)
    third = ok(2) & (cls(2) != NON)
    rank = F.when(cls(0).isNull(), -1).when(ok(0), 0).when(stop(1), -1).when(second, 1).when(stop(2), -1).when(third, 2).otherwise(-1)
    df = df.withColumn("_rank", rank)
    pick = lambda what, none: F.when(F.col("_rank") == 0, what(0)).when(F.col("_rank") == 1, what(1)).when(F.col("_rank") == 2, what(2)).otherwise(none)
    action = F.when(F.col("_rank") == 0, "top1_pass").when(F.col("_rank") > 0, "recovered").otherwise("demoted")
    return df.withColumn("ml_type", pick(cls, F.lit("unclassified"))).withColumn("ml_conf", pick(prob, F.lit(0.0))).withColumn("ml_action", action).drop("_rank")


def merged(df: DataFrame) -> DataFrame:
    """rule_type, rule_conf, ml_label, ml_conf, p_non (probability of non_fastener) -> merged_type, merged_conf.

    In order: both unclassified; the same base type (min(1, r + .3 m)); rules silent and a weak or doubtful model; the
    model says non_fastener but rules are at .5 or more; else the surer of the two, rules on ties.
    """
    rb, mb = base_type(F.col("rule_type")), base_type(F.col("ml_label"))
    r, m = F.col("rule_conf"), F.col("ml_conf")
    none = F.lit("unclassified")
    silent = (rb == none) & (mb != NON) & ((m < 0.40) | (m < F.coalesce("p_non", F.lit(0.0))))
    veto = (mb == NON) & (rb != none) & (r >= 0.5)
    kind = F.when((rb == none) & (mb == none), none).when(rb == mb, rb).when(silent, none).when(veto, F.col("rule_type")).when(m > r, F.col("ml_label")).otherwise(F.col("rule_type"))
    conf = F.when((rb == none) & (mb == none), 0.0).when(rb == mb, F.round(F.least(F.lit(1.0), r + 0.3 * m), 4)).when(silent, 0.0).when(veto, r).when(m > r, m).otherwise(r)
    case = F.when((rb == none) & (mb == none), 1).when(rb == mb, 2).when(silent, 3).when(veto, 4).when(m > r, 5).otherwise(6)
    return df.withColumn("merged_type", kind).withColumn("merged_conf", conf).withColumn("merge_case", case)


def looks_like_screw() -> Column:
    c = F.col
    return (
        c("bcyl_d").between(1.0, 30.0) & c("bcyl_l").between(2.0, 80.0) & (c("cyl_ratio") >= 0.40) & c("aspect").between(0.30, 12.0)
        & c("num_faces").between(8, 100) & (c("n_plane") >= 3) & (c("n_cone") + c("n_torus") + c("n_sphere") >= 1)
    )


def gated(df: DataFrame) -> DataFrame:
    """merged_* with rule_type, top3 and box extents max_dim -> final_type, final_conf, gate.

    A screw shape overrides doubtful classes; a non_fastener of fastener-like shape falls back to a class of the top
    three with .20 or to unclassified; sizes outside 1 to 200 mm unclassify. All need silent rules, but for the last.
    """
    silent = F.col("rule_type") == "unclassified"
    b = base_type(F.col("merged_type"))
    override = silent & b.isin(NON, "washers", "pins", "threaded-rods", "unclassified") & looks_like_screw()
    df = df.withColumn("_t", F.when(override, "likely_screws").otherwise(F.col("merged_type"))).withColumn("_c", F.when(override, 0.60).otherwise(F.col("merged_conf")))
    fastener_like = (F.col("n_torus") > 0) | (F.col("cyl_ratio") >= 0.50)
    doubtful = silent & (base_type(F.col("_t")) == NON) & fastener_like
    rescue = F.get(F.filter("top3", lambda x: ~x["cls"].isin(NON, "non-fastener") & (x["prob"] >= 0.20)), 0)
    t = F.when(doubtful & rescue.isNotNull(), F.concat(F.lit("likely_"), rescue["cls"])).when(doubtful, "unclassified").otherwise(F.col("_t"))
    conf = F.when(doubtful & rescue.isNotNull(), F.round(rescue["prob"], 4)).when(doubtful, 0.0).otherwise(F.col("_c"))
    gate = F.when(override, "screw").when(doubtful & rescue.isNotNull(), "rescued").when(doubtful, "demoted")
    df = df.withColumn("_t2", t).withColumn("_c2", conf).withColumn("_g", gate)
    odd = ((F.col("max_dim") > 200.0) | (F.col("max_dim") < 1.0)) & ~base_type(F.col("_t2")).isin("unclassified", NON)
    out = df.withColumn("final_type", F.when(odd, "unclassified").otherwise(F.col("_t2"))).withColumn("final_conf", F.when(odd, 0.0).otherwise(F.col("_c2")))
    return out.withColumn("gate", F.when(odd, "size").otherwise(F.col("_g"))).drop("_t", "_c", "_t2", "_c2", "_g")


def hybrid_cascade(rules: DataFrame, model: DataFrame, geometry: DataFrame, accept: float = 0.90, face_cap: int = 600) -> DataFrame:
    """Three left joins by sample: rules where sure, else the model's class with its top-k recovery.

    rules: sample_id, rule_cls, rule_conf, rule_error. model: sample_id, top3. geometry: the columns of ``sane``.
    stage is rules, ml or none; action is no_geom, face_cap, top1_pass, recovered or demoted.
    """
    j = rules.join(model, "sample_id", "left").join(geometry, "sample_id", "left")
    sure = F.col("rule_error").isNull() & (F.col("rule_conf") >= accept)
    j = recovered(j)
    capped = F.col("num_faces") > face_cap
    action = F.when(sure, F.lit(None)).when(F.col("top3").isNull(), F.lit(None)).when(F.col("d2").isNull(), "no_geom").when(capped, "face_cap").otherwise(F.col("ml_action"))
    stage = F.when(sure, "rules").when(F.col("top3").isNotNull(), "ml").otherwise("none")
    plain = F.get("top3", 0)["cls"]
    pred = F.when(sure, F.col("rule_cls")).when(F.col("top3").isNull(), NON).when(F.col("d2").isNull() | capped, plain).when(F.col("ml_type") == "unclassified", NON).otherwise(F.col("ml_type"))
    return j.select("sample_id", pred.alias("pred"), stage.alias("stage"), action.alias("action"))


def route(labels: DataFrame, sure: float = 0.90, face_cap: int = 600) -> DataFrame:
    """Which model an uncertain part goes to: none above the threshold, the fallback beyond the face cap."""
    return labels.withColumn("route", F.when(F.col("confidence") >= sure, "rules").when(F.col("num_faces") > face_cap, "fallback").otherwise("primary"))
