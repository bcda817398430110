"""Statistics over tables of predictions. Where a quantity is undefined it is 0, unless a function says otherwise."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.operators.prefix import running


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or missing."""
    b = b.cast("double")
    return F.coalesce(F.when(b != 0, a.cast("double") / b), F.lit(0.0))


def total(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def dense_confusion(df: DataFrame, classes: DataFrame, y: str = "y", pred: str = "pred", fallback=None) -> DataFrame:
    """A row for every pair of classes (a small fixed list); unknown predictions count as ``fallback``."""
    known = classes.select(F.col("cls").alias(pred), F.lit(True).alias("known"))
    named = df.join(F.broadcast(known), pred, "left").withColumn("p", F.when(F.col("known"), F.col(pred)).otherwise(F.lit(fallback)))
    grid = classes.select(F.col("cls").alias("y")).crossJoin(classes.select(F.col("cls").alias("pred")))
    counts = named.groupBy(F.col(y).alias("y"), F.col("p").alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["y", "pred"], "left").na.fill(0, ["n"])


def per_class(cells: DataFrame) -> DataFrame:
    """cells (y, pred, n) -> cls, tp, fp, fn, support, precision, recall, f1, from sums over the cells."""
    by_true = cells.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("named"))
    j = by_true.join(by_pred, "cls", "full_outer").na.fill(0)
    j = j.withColumn("fp", F.col("named") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    j = j.withColumn("precision", ratio(F.col("tp"), F.col("named"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return j.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("cls", "tp", "fp", "fn", "support", "precision", "recall", "f1")


def averages(classes: DataFrame) -> DataFrame:
    """Macro means over all classes, weighted means by support, balanced accuracy (mean recall over supported classes)."""
    n = F.sum("support")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), n)
    return classes.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
    )


def binary_summary(df: DataFrame, y: str = "y", pred: str = "pred", positive: int = 0) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1, mcc and kappa; ``positive`` is the code of the wanted class."""
    t, p = F.col(y) == positive, F.col(pred) == positive
    cells = df.agg(total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"), total(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = cells.withColumn("accuracy", ratio(tp + tn, n)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    out = out.withColumn("mcc", ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    pe = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return out.withColumn("kappa", F.when(pe >= 1, 0.0).otherwise(ratio(F.col("accuracy") - pe, 1 - pe)))


def multiclass_agreement(cells: DataFrame) -> DataFrame:
    """Gorodkin's MCC and Cohen's kappa from the cells of a confusion matrix."""
    t = cells.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("t"))
    p = cells.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("p"))
    j = t.join(p, "k", "full_outer").na.fill(0)
    d = lambda c: F.col(c).cast("double")
    sums = j.agg(F.sum(d("t") * d("p")).alias("tp"), F.sum(d("t") * d("t")).alias("tt"), F.sum(d("p") * d("p")).alias("pp"), F.sum(d("t")).alias("n"))
    right = cells.agg(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).cast("double").alias("right"))
    x = sums.crossJoin(right)
    c, n = F.col("right"), F.col("n")
    vt, vp = n * n - F.col("tt"), n * n - F.col("pp")
    pe = ratio(F.col("tp"), n * n)
    return x.select(
        F.when((vt > 0) & (vp > 0), (c * n - F.col("tp")) / (F.sqrt(vt) * F.sqrt(vp))).otherwise(0.0).alias("mcc"),
        F.when(pe >= 1, 0.0).otherwise(ratio(ratio(c, n) - pe, 1 - pe)).alias("kappa"),
    )


def auroc(df: DataFrame, score: str, label: Column, group: list[str] = ()) -> DataFrame:
    """Rank-sum AUROC with average ranks for ties, per group; null where a class is empty.

    Ranks come from counts per distinct score, summed up in pieces of the order, so neither a group's rows nor its
    distinct scores meet in one task.
    """
    g = list(group)
    each = df.groupBy(*g, F.col(score).alias("s")).agg(F.count("*").alias("n"), total(label).alias("pos"))
    ranked = running(each, g, ["s"], {"before": F.col("n")})
    mean_rank = F.col("before") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*g).agg(F.sum(mean_rank * F.col("pos")).alias("rank_sum"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
    return sums.select(*g, F.when((p > 0) & (q > 0), (F.col("rank_sum") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def brier(df: DataFrame, prob: str, label: str) -> DataFrame:
    d = F.col(prob) - F.col(label)
    return df.agg(F.avg(d * d).alias("brier"))


def brier_multiclass(df: DataFrame, probs: str, label: str) -> DataFrame:
    """Mean over rows of the squared distances between probabilities and the one-hot label (an index from 0)."""
    errors = F.transform(F.col(probs), lambda p, i: F.pow(p - (i == F.col(label)).cast("double"), 2))
    return df.agg(F.avg(F.aggregate(errors, F.lit(0.0), lambda a, x: a + x)).alias("brier"))


def edges(bins: int = 10) -> list[float]:
    """Equal bin edges as numpy's linspace gives them: i * (1 / bins), the last exactly 1."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Bins (lo, hi] of confidence with count, mean confidence and accuracy; confidence 0 falls in none."""
    e = edges(bins)
    c = F.col(confidence)
    which = None
    for i in range(bins):
        cond = (c > e[i]) & (c <= e[i + 1])
        which = F.when(cond, i) if which is None else which.when(cond, i)
    return df.withColumn("bin", which).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(c).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def ece(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    n = df.agg(F.count("*").alias("all_rows"))
    gaps = reliability(df, confidence, correct, bins).crossJoin(n)
    return gaps.agg(F.coalesce(F.sum(F.col("n") / F.col("all_rows") * F.abs(F.col("accuracy") - F.col("mean_confidence"))), F.lit(0.0)).alias("ece"))


def top_k_accuracy(df: DataFrame, probs: str, label: str, k: int) -> DataFrame:
    """Share of rows whose true class (index from 0) is among the k most likely; ties go to the lower index."""
    p = F.col(probs)
    mine = F.get(p, F.col(label))
    better = F.size(F.filter(F.transform(p, lambda x, i: (x > mine) | ((x == mine) & (i < F.col(label)))), lambda b: b))
    return df.agg(F.avg((better < k).cast("double")).alias("accuracy"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def top3(probs: Column) -> Column:
    """The three most likely classes as (cls index, prob), ties to the lower index."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("order"), i.alias("cls"), p.alias("prob")))
    return F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda x: F.struct(x["cls"].alias("cls"), x["prob"].alias("prob")))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """With continuity correction; 0 without discordant pairs."""
    d = F.abs(b - c).cast("double") - 1.0
    return F.when(b + c == 0, 0.0).otherwise(d * d / (b + c).cast("double"))


def chi2_p(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, erfc(sqrt(chi2 / 2)), in built-in functions.

    Below 2.5 the positive series of erf, beyond it the continued fraction of erfc; both end far below double precision.
    """
    z = F.sqrt(chi2 / 2.0)
    bell = F.exp(-z * z) / math.sqrt(math.pi)
    start = F.struct(z.alias("sum"), z.alias("term"))

    def add(acc, n):
        term = acc["term"] * (2.0 * z * z) / (2.0 * n + 1.0)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, add, lambda acc: acc["sum"])
    tail = F.aggregate(F.sequence(F.lit(-120), F.lit(-1)), F.lit(0.0), lambda t, k: (-k / 2.0) / (z + t))
    return F.when(z < 2.5, 1.0 - 2.0 * bell * series).otherwise(bell / (z + tail))


def mcnemar(df: DataFrame, right_a: Column, right_b: Column, group: list[str] = ()) -> DataFrame:
    """Paired comparison: the four cells, chi2, and the accuracy difference, per group."""
    cells = df.groupBy(*group).agg(total(right_a & ~right_b).alias("a_only"), total(~right_a & right_b).alias("b_only"), total(right_a & right_b).alias("both"), total(~right_a & ~right_b).alias("neither"))
    n = (F.col("a_only") + F.col("b_only") + F.col("both") + F.col("neither")).cast("double")
    return cells.withColumn("chi2", mcnemar_chi2(F.col("a_only"), F.col("b_only"))).withColumn("delta", ratio(F.col("a_only") - F.col("b_only"), n))


def mcnemar_bounds(right_a: Column, right_b: Column, n: Column) -> dict[str, Column]:
    """Least and largest chi2 that two accuracies on the same n rows allow.

    The difference of the discordant cells is fixed; chi2 falls as their sum grows, which is at most
    min(a + b, 2n - a - b) and at least the difference itself.
    """
    diff = F.abs(right_a - right_b)
    most = F.least(right_a + right_b, 2 * n - right_a - right_b)
    num = (diff.cast("double") - 1.0) * (diff.cast("double") - 1.0)
    at = lambda s: F.when(s == 0, 0.0).otherwise(num / s.cast("double"))
    return {"min_chi2": at(most), "max_chi2": at(diff)}


def pairwise(df: DataFrame, right: dict[str, Column]) -> DataFrame:
    """McNemar for every two configurations, in the given order."""
    names = list(right)
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one = mcnemar(df, right[a], right[b]).select(F.lit(a).alias("cfg_a"), F.lit(b).alias("cfg_b"), "a_only", "b_only", "chi2", "delta")
            out = one if out is None else out.unionByName(one)
    return out


def bootstrap_ci(df: DataFrame, right_a: Column, right_b: Column, replicates: int = 2000, seed: int = 42, blocks: int = 16) -> DataFrame:
    """Percentile interval of the accuracy difference over paired resamples.

    Only three outcomes of a pair matter (a alone right, b alone right, neither), so a resample of n rows is one
    multinomial draw over their counts: exact in distribution, independent of n in cost, and seeded per block.
    """
    cells = df.agg(total(right_a & ~right_b).alias("a"), total(~right_a & right_b).alias("b"), F.count("*").alias("n"))
    spread = cells.crossJoin(df.sparkSession.range(0, blocks, 1, blocks).withColumnRenamed("id", "block"))

    def draw(batches):
        import numpy as np

        for pdf in batches:
            for a, b, n, block in pdf[["a", "b", "n", "block"]].itertuples(index=False):
                if n:
                    g = np.random.default_rng([seed, block])
                    m = len(range(block, replicates, blocks))
                    x = g.multinomial(n, [a / n, b / n, (n - a - b) / n], size=m)
                    yield pd.DataFrame({"delta": (x[:, 0] - x[:, 1]) / n})

    deltas = spread.mapInPandas(draw, "delta double")
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return deltas.agg(F.count("*").alias("replicates"), F.avg("delta").alias("mean"), q[0].alias("low"), q[1].alias("high"))


#: How likely a Poisson(1) count is to be at most 0, 1, 2, ...; beyond these the chance is below 1e-11.
POISSON_STEPS = tuple(sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(13))


def poisson_bootstrap(df: DataFrame, key: Column, right_a: Column, right_b: Column, replicates: int = 2000, seed: str = "boot-1") -> DataFrame:
    """Percentile interval of the accuracy difference when every row counts Poisson(1) times in each replicate.

    A row's count comes from a hash of (seed, replicate, key), so any engine
    draws the same, rows may lie anywhere, and the replicates' sums are added
    up before they move. Keys should be unique. No rows give no replicates, and
    a replicate in which no row counts is left out.
    """
    gain = right_a.cast("long") - right_b.cast("long")
    rows = df.select(key.cast("string").alias("key"), F.coalesce(gain, F.lit(0)).alias("gain"))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), "key").cast("binary"))
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    count = sum((at >= x).cast("long") for x in POISSON_STEPS)
    sums = drawn.withColumn("n", count).groupBy("replicate").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gain")).alias("gain"))
    deltas = sums.where("n > 0").select((F.col("gain").cast("double") / F.col("n").cast("double")).alias("delta"))
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return deltas.agg(F.count("*").alias("replicates"), F.avg("delta").alias("mean"), q[0].alias("low"), q[1].alias("high"))


def threshold_sweep(df: DataFrame, confidence: str, predicted: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """P/R/F1 at each threshold in one pass: a prediction counts if its confidence reaches the threshold."""
    grid = F.broadcast(df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double"))
    p = predicted & (F.col(confidence) >= F.col("threshold"))
    cells = df.crossJoin(grid).groupBy("threshold").agg(total(p & truth).alias("tp"), total(p & ~truth).alias("fp"), total(~p & truth).alias("fn"))
    out = cells.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def grouped_accuracy(df: DataFrame, right: dict[str, Column], group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(f"acc_{k}") for k, c in right.items()])


def subset_accuracy(df: DataFrame, right: Column, keys: list[str]) -> DataFrame:
    """Accuracy overall and by each key alone, in one pass over grouping sets."""
    df = df.withColumn("_right", right.cast("double"))
    out = df.groupingSets([[], *[[k] for k in keys]], *keys).agg(F.count("*").alias("n"), F.avg("_right").alias("accuracy"), *[F.grouping(k).cast("int").alias(f"all_{k}") for k in keys])
    return out


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """N / (K * n_c), its square root, and 1 / sqrt(n_c) for sampling."""
    n = df.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n"))
    all_rows = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    w = F.col("total").cast("double") / (F.col("k") * F.col("n")).cast("double")
    return n.crossJoin(all_rows).select("cls", "n", w.alias("weight"), F.sqrt(w).alias("sqrt_weight"), (1.0 / F.sqrt(F.col("n").cast("double"))).alias("sample_weight"))


def most_common(df: DataFrame, key: str, n: int, order: Column | None = None) -> DataFrame:
    """The n most frequent values; ties by ``order`` (the value itself if none is given)."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *([F.min(order).alias("_o")] if order is not None else [])).orderBy(F.col("n").desc(), "_o" if order is not None else key).limit(n).select(key, "n")


def top_confused(cells: DataFrame, n: int = 30) -> DataFrame:
    return cells.where((F.col("y") != F.col("pred")) & (F.col("n") > 0)).orderBy(F.col("n").desc(), "y", "pred").limit(n)


def masked_mean(df: DataFrame, key: str, value: str, mask: str) -> DataFrame:
    return df.groupBy(key).agg((F.sum(F.col(value) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1.0))).alias("mean"))
