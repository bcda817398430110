"""Queries over paired predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import evalstats as es
from partloom.plans.adapters import ctes, table, view

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


P = ctes("fx_pred")
A, B = "CAST(pa >= 5e-1 AS INT)", "CAST(pb >= 5e-1 AS INT)"


def _pred(spark, sf_dir):
    return view(spark, sf_dir, "fx_pred").withColumn("a", (F.col("pa") >= 0.5).cast("int")).withColumn("b", (F.col("pb") >= 0.5).cast("int"))


def _cells(spark, sf_dir):
    return es.confusion(view(spark, sf_dir, "fx_pred"), "y5", "p5")


@query(f"{P} SELECT y5 AS y, p5 AS pred, count(*) AS n FROM fx_pred GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"""{P}, c AS (SELECT unnest(range(6)) AS cls) SELECT CAST(t.cls AS INT) AS y, CAST(p.cls AS INT) AS pred, (SELECT count(*) FROM fx_pred f WHERE f.y5 = t.cls AND CASE WHEN f.p5 = 3 THEN 5 ELSE f.p5 END = p.cls) AS n FROM c t CROSS JOIN c p""")
def dense_confusion(spark, sf_dir):
    classes = spark.createDataFrame([(i,) for i in range(6)], "cls int")
    p = view(spark, sf_dir, "fx_pred").withColumn("p5", F.when(F.col("p5") == 3, 99).otherwise(F.col("p5")))
    return es.dense_confusion(p, classes, "y5", "p5", fallback=5)


PER_CLASS = f"""{P}, t AS (SELECT y5 AS cls, count(*) AS support, count(*) FILTER (y5 = p5) AS tp FROM fx_pred GROUP BY 1), p AS (SELECT p5 AS cls, count(*) AS named FROM fx_pred GROUP BY 1),
j AS (SELECT cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(named, 0) AS named FROM t FULL JOIN p USING (cls)),
k AS (SELECT *, CASE WHEN named > 0 THEN CAST(tp AS DOUBLE) / named ELSE 0e0 END AS precision, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0e0 END AS recall FROM j),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM k)"""


@query(PER_CLASS + " SELECT cls, tp, named - tp AS fp, support - tp AS fn, support, precision, recall, f1 FROM m")
def per_class_prf(spark, sf_dir):
    return es.per_class(_cells(spark, sf_dir))


@query(PER_CLASS + """ SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(precision * support) / sum(support), 9) AS weighted_precision,
round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM m""")
def macro_weighted_f1(spark, sf_dir):
    out = es.averages(es.per_class(_cells(spark, sf_dir)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"""{P}, c AS (SELECT count(*) FILTER (y = 0 AND {A} = 0) AS tp, count(*) FILTER (y <> 0 AND {A} = 0) AS fp, count(*) FILTER (y = 0 AND {A} <> 0) AS fn, count(*) FILTER (y <> 0 AND {A} <> 0) AS tn FROM fx_pred),
d AS (SELECT *, CAST(tp AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(fn AS DOUBLE) AS c, CAST(tn AS DOUBLE) AS e FROM c), f AS (SELECT *, (a + e) / (a + b + c + e) AS accuracy, a / (a + b) AS precision, a / (a + c) AS recall,
(a * e - b * c) / sqrt((a + b) * (a + c) * (e + b) * (e + c)) AS mcc, ((a + b) * (a + c) + (c + e) * (b + e)) / ((a + b + c + e) * (a + b + c + e)) AS pe FROM d)
SELECT tp, fp, fn, tn, accuracy, precision, recall, round(2 * precision * recall / (precision + recall), 12) AS f1, round(mcc, 12) AS mcc, round((accuracy - pe) / (1 - pe), 12) AS kappa FROM f""")
def binary_metrics(spark, sf_dir):
    return es.binary_summary(_pred(spark, sf_dir), "y", "a").withColumns({c: F.round(c, 12) for c in ("f1", "mcc", "kappa")})


@query(f"""{P}, t AS (SELECT y5 AS k, CAST(count(*) AS DOUBLE) AS t FROM fx_pred GROUP BY 1), p AS (SELECT p5 AS k, CAST(count(*) AS DOUBLE) AS p FROM fx_pred GROUP BY 1),
j AS (SELECT coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM t FULL JOIN p USING (k)), s AS (SELECT sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp, sum(t) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM fx_pred WHERE y5 = p5) AS c FROM j)
SELECT round((c * n - tp) / (sqrt(n * n - tt) * sqrt(n * n - pp)), 12) AS mcc, round((c / n - tp / (n * n)) / (1 - tp / (n * n)), 12) AS kappa FROM s""")
def mcc_multiclass(spark, sf_dir):
    out = es.multiclass_agreement(_cells(spark, sf_dir))
    return out.select(*[F.round(c, 12).alias(c) for c in ("mcc", "kappa")])


RANK = "rank() OVER ({g}ORDER BY pa) + (count(*) OVER ({g}ORDER BY pa RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2e0"


@query(f"""{P}, r AS (SELECT y, {RANK.format(g='')} AS r FROM fx_pred), s AS (SELECT sum(r) FILTER (y = 1) AS rs, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y <> 1) AS DOUBLE) AS q FROM r)
SELECT (rs - p * (p + 1) / 2) / (p * q) AS auroc FROM s""")
def auroc(spark, sf_dir):
    return es.auroc(_pred(spark, sf_dir), "pa", F.col("y") == 1)


@query(f"""{P}, x AS (SELECT c.k, f.y5 = c.k AS hit, abs(f.pa - c.k / 5e0) AS pa FROM fx_pred f CROSS JOIN (SELECT unnest(range(5)) AS k) c), r AS (SELECT k, hit, {RANK.format(g='PARTITION BY k ')} AS r FROM x),
s AS (SELECT k, sum(r) FILTER (hit) AS rs, CAST(count(*) FILTER (hit) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT hit) AS DOUBLE) AS q FROM r GROUP BY k) SELECT round(avg((rs - p * (p + 1) / 2) / (p * q)), 12) AS auroc FROM s WHERE p > 0 AND q > 0""")
def auroc_ovr(spark, sf_dir):
    each = _pred(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("s", F.abs(F.col("pa") - F.col("k") / 5.0))
    return es.auroc(each, "s", F.col("y5") == F.col("k"), ["k"]).agg(F.round(F.avg("auroc"), 12).alias("auroc"))


@query(f"{P} SELECT round(avg((pa - y) * (pa - y)), 12) AS brier FROM fx_pred")
def brier(spark, sf_dir):
    return es.brier(_pred(spark, sf_dir), "pa", "y").select(F.round("brier", 12).alias("brier"))


PROBS = "[pa / 2, pb / 2, (1 - pa) / 2, (1 - pb) / 4, (1 - pb) / 4]"


def _probs(spark, sf_dir):
    return _pred(spark, sf_dir).withColumn("probs", F.array(F.col("pa") / 2, F.col("pb") / 2, (1 - F.col("pa")) / 2, (1 - F.col("pb")) / 4, (1 - F.col("pb")) / 4))


@query(f"{P} SELECT round(avg(list_sum(list_transform({PROBS}, lambda p, i: (p - CASE WHEN i - 1 = y5 THEN 1e0 ELSE 0e0 END) * (p - CASE WHEN i - 1 = y5 THEN 1e0 ELSE 0e0 END)))), 12) AS brier FROM fx_pred")
def brier_multiclass(spark, sf_dir):
    return es.brier_multiclass(_probs(spark, sf_dir), "probs", "y5").select(F.round("brier", 12).alias("brier"))


@query(f"{P}, q AS (SELECT y5, {PROBS} AS p FROM fx_pred) SELECT avg(CASE WHEN len(list_filter(p, lambda x, i: x > p[y5 + 1] OR (x = p[y5 + 1] AND i - 1 < y5))) < 3 THEN 1e0 ELSE 0e0 END) AS accuracy FROM q")
def topk_accuracy(spark, sf_dir):
    return es.top_k_accuracy(_probs(spark, sf_dir), "probs", "y5", 3)


BINS = ", ".join(f"({i}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))" for i, (lo, hi) in enumerate(zip(es.edges(), es.edges()[1:], strict=False)))
RELIABLE = f"""{P}, bins(bin, lo, hi) AS (VALUES {BINS}), r AS (SELECT CAST(bin AS INT) AS bin, count(*) AS n, avg(pa) AS mean_confidence, avg(CAST({A} = y AS INT)) AS accuracy FROM fx_pred JOIN bins ON pa > lo AND pa <= hi GROUP BY bin)"""


@query(RELIABLE + " SELECT bin, n, round(mean_confidence, 12) AS mean_confidence, round(accuracy, 12) AS accuracy FROM r")
def reliability_bins(spark, sf_dir):
    return es.reliability(_pred(spark, sf_dir), "pa", F.col("a") == F.col("y")).withColumns({c: F.round(c, 12) for c in ("mean_confidence", "accuracy")})


@query(RELIABLE + " SELECT round(sum(CAST(n AS DOUBLE) / (SELECT count(*) FROM fx_pred) * abs(accuracy - mean_confidence)), 12) AS ece FROM r")
def ece10(spark, sf_dir):
    return es.ece(_pred(spark, sf_dir), "pa", F.col("a") == F.col("y")).select(F.round("ece", 12).alias("ece"))


CELLS = f"count(*) FILTER ({A} = y AND {B} <> y) AS a_only, count(*) FILTER ({A} <> y AND {B} = y) AS b_only, count(*) FILTER ({A} = y AND {B} = y) AS both, count(*) FILTER ({A} <> y AND {B} <> y) AS neither"
CHI2 = "CASE WHEN a_only + b_only = 0 THEN 0e0 ELSE (abs(a_only - b_only) - 1e0) * (abs(a_only - b_only) - 1e0) / (a_only + b_only) END AS chi2, CAST(a_only - b_only AS DOUBLE) / (a_only + b_only + \"both\" + neither) AS delta"
CELLS = CELLS.replace("AS both", 'AS "both"')


def _rights(df):
    return df, F.col("a") == F.col("y"), F.col("b") == F.col("y")


@query(f'{P}, c AS (SELECT {CELLS} FROM fx_pred) SELECT a_only, b_only, "both", neither, {CHI2} FROM c')
def mcnemar_chi2(spark, sf_dir):
    return es.mcnemar(*_rights(_pred(spark, sf_dir)))


# erfc by the series of erf below 2.5 and by its continued fraction beyond.
TAIL = f"""{P.replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT source, {CELLS} FROM fx_pred GROUP BY source UNION ALL SELECT 'all', {CELLS} FROM fx_pred), m AS (SELECT source, {CHI2} FROM c), z AS (SELECT source, chi2, sqrt(chi2 / 2e0) AS z FROM m),
series AS (SELECT 0 AS n, source, z, z AS term, z AS total FROM z UNION ALL SELECT n + 1, source, z, term * 2e0 * z * z / (2e0 * n + 3e0), total + term * 2e0 * z * z / (2e0 * n + 3e0) FROM series WHERE n < 80),
fraction AS (SELECT 120 AS k, source, z, 0e0 AS t FROM z UNION ALL SELECT k - 1, source, z, (k / 2e0) / (z + t) FROM fraction WHERE k > 0)
SELECT z.source, round(chi2, 9) AS chi2, round(CASE WHEN z.z < 25e-1 THEN 1e0 - 2e0 * exp(-z.z * z.z) / sqrt(pi()) * s.total ELSE exp(-z.z * z.z) / sqrt(pi()) / (z.z + f.t) END, 9) AS p
FROM z JOIN series s ON s.source IS NOT DISTINCT FROM z.source AND s.n = 80 JOIN fraction f ON f.source IS NOT DISTINCT FROM z.source AND f.k = 0"""


@query(TAIL)
def mcnemar_p(spark, sf_dir):
    df, a, b = _rights(_pred(spark, sf_dir))
    every = es.mcnemar(df, a, b, ["source"]).unionByName(es.mcnemar(df, a, b).withColumn("source", F.lit("all")))
    return every.select("source", F.round("chi2", 9).alias("chi2"), F.round(es.chi2_p(F.col("chi2")), 9).alias("p"))


@query(f'{P}, c AS (SELECT lang, {CELLS} FROM fx_pred GROUP BY lang) SELECT lang, a_only, b_only, "both", neither, {CHI2} FROM c')
def mcnemar_by_class(spark, sf_dir):
    return es.mcnemar(*_rights(_pred(spark, sf_dir)), ["lang"])


@query(f"""{P}, s AS (SELECT count(*) FILTER ({A} = y) AS ra, count(*) FILTER ({B} = y) AS rb, count(*) AS n FROM fx_pred), t AS (SELECT *, abs(ra - rb) AS d, least(ra + rb, 2 * n - ra - rb) AS most FROM s)
SELECT CASE WHEN most = 0 THEN 0e0 ELSE (d - 1e0) * (d - 1e0) / most END AS min_chi2, CASE WHEN d = 0 THEN 0e0 ELSE (d - 1e0) * (d - 1e0) / d END AS max_chi2 FROM t""")
def mcnemar_bounds(spark, sf_dir):
    df, a, b = _rights(_pred(spark, sf_dir))
    s = df.agg(es.total(a).alias("ra"), es.total(b).alias("rb"), F.count("*").alias("n"))
    x = es.mcnemar_bounds(F.col("ra"), F.col("rb"), F.col("n"))
    return s.select(x["min_chi2"].alias("min_chi2"), x["max_chi2"].alias("max_chi2"))


PAIRS = " UNION ALL ".join(
    f"SELECT '{x}' AS cfg_a, '{y}' AS cfg_b, count(*) FILTER ({cx} AND NOT ({cy})) AS a_only, count(*) FILTER (NOT ({cx}) AND {cy}) AS b_only, count(*) AS n FROM fx_pred"
    for x, y, cx, cy in (("pa", "pb", f"{A} = y", f"{B} = y"), ("pa", "ones", f"{A} = y", "y = 1"), ("pb", "ones", f"{B} = y", "y = 1"))
)


@query(f"{P}, c AS ({PAIRS}) SELECT cfg_a, cfg_b, a_only, b_only, CASE WHEN a_only + b_only = 0 THEN 0e0 ELSE (abs(a_only - b_only) - 1e0) * (abs(a_only - b_only) - 1e0) / (a_only + b_only) END AS chi2, CAST(a_only - b_only AS DOUBLE) / n AS delta FROM c")
def mcnemar_pairwise(spark, sf_dir):
    df, a, b = _rights(_pred(spark, sf_dir))
    return es.pairwise(df, {"pa": a, "pb": b, "ones": F.col("y") == 1})


@query(f"{P} SELECT count(*) AS n, avg(CAST({A} = {B} AS INT)) AS agree, {CELLS} FROM fx_pred")
def agreement4(spark, sf_dir):
    df, a, b = _rights(_pred(spark, sf_dir))
    return df.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"), es.total(a & ~b).alias("a_only"), es.total(~a & b).alias("b_only"), es.total(a & b).alias("both"), es.total(~a & ~b).alias("neither"))


@query(
    f"""{P}, r AS (SELECT CAST(doc_id AS VARCHAR) AS key, CAST({A} = y AS INT) - CAST({B} = y AS INT) AS gain FROM fx_pred),
drawn AS (SELECT b.b, gain, CAST('0x' || substr(md5('boot-1:' || CAST(b.b AS VARCHAR) || ':' || key), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM r, (SELECT unnest(range(1000)) AS b) b),
counted AS (SELECT b, gain, {" + ".join(f"CAST(u >= {x!r} AS INT)" for x in es.POISSON_STEPS)} AS n FROM drawn),
sums AS (SELECT b, sum(n) AS n, sum(n * gain) AS gain FROM counted GROUP BY b),
deltas AS (SELECT CAST(gain AS DOUBLE) / CAST(n AS DOUBLE) AS delta FROM sums WHERE n > 0)
SELECT count(*) AS replicates, round(avg(delta), 9) AS mean, round(quantile_cont(delta, 25e-3), 9) AS low, round(quantile_cont(delta, 975e-3), 9) AS high FROM deltas"""
)
def bootstrap_ci(spark, sf_dir):
    df, a, b = _rights(_pred(spark, sf_dir))
    found = es.poisson_bootstrap(df, F.col("doc_id"), a, b, replicates=1000)
    return found.select("replicates", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(f"{P} SELECT source, count(*) AS n, avg(CAST({A} = y AS INT)) AS acc_a, avg(CAST({B} = y AS INT)) AS acc_b FROM fx_pred GROUP BY source")
def per_source_accuracy(spark, sf_dir):
    df, a, b = _rights(_pred(spark, sf_dir))
    return es.grouped_accuracy(df, {"a": a, "b": b}, ["source"])


@query(f"{P} SELECT lang, source, count(*) AS n, avg(CAST({A} = y AS INT)) AS accuracy, CAST(grouping(lang) AS INT) AS all_lang, CAST(grouping(source) AS INT) AS all_source FROM fx_pred GROUP BY GROUPING SETS ((), (lang), (source))")
def subset_grouping_sets(spark, sf_dir):
    df, a, _ = _rights(_pred(spark, sf_dir))
    return es.subset_accuracy(df, a, ["lang", "source"])


@query(f"{P}, s AS (SELECT CASE WHEN pa >= 9e-1 THEN 'rules' WHEN pb >= 5e-1 THEN 'ml' ELSE 'none' END AS stage, {A} = y AS right_ FROM fx_pred) SELECT stage, count(*) AS n, avg(CAST(right_ AS INT)) AS acc_final FROM s GROUP BY stage")
def stage_attribution(spark, sf_dir):
    df, a, _ = _rights(_pred(spark, sf_dir))
    stage = F.when(F.col("pa") >= 0.9, "rules").when(F.col("pb") >= 0.5, "ml").otherwise("none")
    return es.grouped_accuracy(df.withColumn("stage", stage), {"final": a}, ["stage"])


@query(f"""{P}, t(threshold) AS (VALUES (3e-1), (5e-1), (7e-1), (9e-1)), c AS (SELECT threshold, count(*) FILTER (pa >= threshold AND y = 1) AS tp, count(*) FILTER (pa >= threshold AND y <> 1) AS fp, count(*) FILTER (pa < threshold AND y = 1) AS fn FROM fx_pred CROSS JOIN t GROUP BY threshold),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM d""")
def threshold_sweep(spark, sf_dir):
    return es.threshold_sweep(_pred(spark, sf_dir), "pa", F.lit(True), F.col("y") == 1, [0.3, 0.5, 0.7, 0.9])


@query(f"{P}, n AS (SELECT source AS cls, count(*) AS n FROM fx_pred GROUP BY 1), s AS (SELECT sum(n) AS t, count(*) AS k FROM n) SELECT cls, n, CAST(t AS DOUBLE) / (k * n) AS weight, sqrt(CAST(t AS DOUBLE) / (k * n)) AS sqrt_weight, 1e0 / sqrt(CAST(n AS DOUBLE)) AS sample_weight FROM n CROSS JOIN s")
def class_weights(spark, sf_dir):
    return es.class_weights(_pred(spark, sf_dir), "source")


@query(f"{P}, c AS (SELECT y5 AS y, p5 AS pred, count(*) AS n FROM fx_pred WHERE y5 <> p5 GROUP BY 1, 2) SELECT * FROM c ORDER BY n DESC, y, pred LIMIT 30")
def top_confused(spark, sf_dir):
    return es.top_confused(_cells(spark, sf_dir))


@query("""WITH l AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), u AS (SELECT vec_id, unnest(p) AS prob, unnest(range(8)) AS cls FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, cls) AS rank FROM u)
SELECT vec_id, CAST(rank AS INT) AS rank, CAST(cls AS INT) AS cls, round(prob, 9) AS prob FROM r WHERE rank <= 3""")
def softmax_top3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("z"))
    t = e.select("vec_id", F.posexplode(es.top3(es.softmax(F.col("z")))).alias("rank", "t"))
    return t.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("t.cls").alias("cls"), F.round("t.prob", 9).alias("prob"))
