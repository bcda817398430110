"""A factorisation machine for text quality.

A text becomes a sparse vector: hashed words (counts, scaled to unit length),
structure statistics, and how the row's own n_chars agrees with its text. The
score is the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j,
whose pairwise part is half of sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2:
linear in the number of features (Rendle, 2010).

The model is fitted on the driver on a sample of labelled rows of documented
size; every row is scored by the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.runtime import utf8
from partloom.llm.words import U, hash_words, mix, word_table

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"
STOPS = b".,;:?'\"()-"
HIGH = bytes(range(128, 256))
ASCII = bytes(range(128))
BELOW_LEAD = bytes(range(192))
STATS = 20


@dataclass(frozen=True)
class QualityFM:
    """sample: most labelled rows that are fitted. bits: hashed words go to 2**bits features. factors: rank."""

    sample: int = 6000
    bits: int = 14
    factors: int = 8
    epochs: int = 12
    least_steps: int = 600
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7


def statistics(text: bytes, words: list[bytes], hashed: np.ndarray, counts: np.ndarray, n_chars) -> list[float]:
    size, n = max(1, len(text)), max(1, len(words))
    count = lambda kind: (len(text) - len(text.translate(None, kind))) / size
    lines = [x for x in text.split(b"\n") if x]
    letters = len(text) - len(text.translate(None, LOWER + UPPER + HIGH))
    upper = len(text) - len(text.translate(None, UPPER))
    chars = len(text) - len(text.translate(None, ASCII)) + len(text.translate(None, BELOW_LEAD)) if n_chars else 0
    top = counts.max(initial=0) / n
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        np.log1p(len(lines)),
        sum(map(len, words)) / n / 10,
        count(UPPER),
        upper / max(1, letters),
        count(DIGITS),
        count(MARKS),
        count(STOPS),
        text.count(b"|") / n,
        text.count(b"!") / n,
        len(counts) / n,
        top,
        float((hashed[1:] == hashed[:-1]).mean()) if len(hashed) > 1 else 0.0,
        len(set(lines)) / max(1, len(lines)),
        max(map(len, words), default=0) / 50,
        float((counts == 1).sum()) / n,
        len(words) / max(1, len(lines)) / 20,
        count(b"\n"),
        min(3.0, abs(np.log((n_chars or 1) / max(1, chars)))) if n_chars and n_chars > 0 else 0.0,
    ]


def features(text, n_chars, table, p: QualityFM) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word features, their values, and the statistics of one text (bytes or None)."""
    text = text or b""
    words = text.split()
    hashed = hash_words(words, table)
    distinct, counts = np.unique(hashed, return_counts=True)
    at = (mix(distinct) >> U(64 - p.bits)).astype(np.int32)
    value = np.log1p(counts).astype(np.float32)
    norm = float(np.sqrt((value * value).sum()))
    return at, value / norm if norm else value, statistics(text, words, hashed, counts, n_chars)


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32) / 2

    def scores(self, at: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        first = len(self.weight) - STATS
        dense = self.dense(stats)
        w, v = self.weight[first:], self.factor[first:]
        linear, total, squares = dense @ w, dense @ v, (dense**2) @ (v**2)
        for i, (a, x) in enumerate(zip(at, values, strict=True)):
            if len(a):
                vx = self.factor[a] * x[:, None]
                linear[i] += float(self.weight[a] @ x)
                total[i] += vx.sum(axis=0)
                squares[i] += (vx * vx).sum(axis=0)
        raw = self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def fit(at: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, p: QualityFM = QualityFM()) -> Model:
    """Logistic loss, AdaGrad, minibatches in a seeded order."""
    size = (1 << p.bits) + STATS
    draw = np.random.default_rng(p.seed)
    model = Model(0.0, np.zeros(size, np.float32), (draw.standard_normal((size, p.factors)) * 0.05).astype(np.float32), np.zeros(STATS), np.ones(STATS))
    n = len(labels)
    if not n:
        return model
    model.mean, model.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    share = (labels.sum() + 1) / (n + 2)
    model.bias = float(np.log(share / (1 - share)))
    dense, first = model.dense(stats), 1 << p.bits
    tail = np.arange(first, size, dtype=np.int64)
    rows = [(np.concatenate([a, tail]), np.concatenate([x, d])) for a, x, d in zip(at, values, dense, strict=True)]
    g0, gw, gv = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, p.factors), 1e-6, np.float32)
    epochs = max(p.epochs, -(-p.least_steps * p.batch // n))
    for _ in range(epochs):
        order = draw.permutation(n)
        for lo in range(0, n, p.batch):
            picked = order[lo : lo + p.batch]
            lengths = np.array([len(rows[i][0]) for i in picked])
            a = np.concatenate([rows[i][0] for i in picked])
            x = np.concatenate([rows[i][1] for i in picked])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = model.factor[a] * x[:, None]
            total = np.add.reduceat(vx, starts)
            raw = model.bias + np.add.reduceat(model.weight[a] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[picked]) / len(picked)
            e = np.repeat(error, lengths).astype(np.float32)
            step = (e * x)[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            used, inverse = np.unique(a, return_inverse=True)
            dw = np.bincount(inverse, weights=e * x, minlength=len(used)).astype(np.float32) + p.decay * model.weight[used]
            dv = np.stack([np.bincount(inverse, weights=step[:, f], minlength=len(used)) for f in range(p.factors)], axis=1).astype(np.float32) + p.decay * model.factor[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model.weight[used] -= p.rate * dw / np.sqrt(gw[used])
            model.factor[used] -= p.rate * 0.3 * dv / np.sqrt(gv[used])
            g0 += float(error.sum()) ** 2
            model.bias -= p.rate * float(error.sum()) / np.sqrt(g0)
    return model


def held_out() -> Column:
    """The rows no label is learned from: crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", utf8("text").alias("text"), chars.alias("n_chars"))


def _feature_rows(p: QualityFM):
    def run(batches):
        table = word_table()
        for batch in batches:
            found = [features(t, n, table, p) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary()), pa.array([np.array(f[2]).tobytes() for f in found], pa.binary()), batch.column("quality")],
                names=["at", "value", "stats", "quality"],
            )

    return run


def fit_on(docs: DataFrame, labels: DataFrame, params: QualityFM = QualityFM()) -> Model:
    """labels (doc_id, quality): the first ``sample`` of a seeded order of the rows that aren't held out.

    Several labels of one document count as their larger one, and of rows that
    share a doc_id the one with the least text is fitted; null labels and
    labels without a document are left out.
    """
    p = params
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    usable = usable.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    picked = usable.orderBy(F.xxhash64(F.lit(p.seed), F.col("doc_id").cast("string")), "doc_id").limit(p.sample)
    rows = _inputs(docs).join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "quality")).alias("row")).select("row.*")
    rows = rows.mapInArrow(_feature_rows(p), "at binary, value binary, stats binary, quality int")
    rows = sorted(rows.collect(), key=lambda r: (bytes(r["at"]), bytes(r["value"]), r["quality"]))  # at most ``sample`` rows
    stats = np.array([np.frombuffer(r["stats"]) for r in rows]).reshape(-1, STATS)
    return fit([np.frombuffer(r["at"], np.int32) for r in rows], [np.frombuffer(r["value"], np.float32) for r in rows], stats, np.array([r["quality"] for r in rows], float), p)


def _scorer(model: Model, p: QualityFM, out: str):
    def run(batches):
        table = word_table()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [features(t, n, table, p) for t, n in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist(), strict=True)]
                scores[lo : lo + 256] = model.scores([f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found]))
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("n_chars", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores)], names=[*(batch.schema.names[i] for i in keep), out])

    return run


def score_quality(docs: DataFrame, model: Model, params: QualityFM = QualityFM()) -> DataFrame:
    """docs (doc_id, text[, n_chars], ...) -> doc_id, held_out, score, predicted.

    One row per input row, whole texts of any length; null texts score as empty
    ones. Neither labels nor lang, source or doc_id reach the score; repeated
    rows have equal scores, and a row without a doc_id isn't held out. Other
    columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = _inputs(docs).mapInArrow(_scorer(model, params, "score"), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def _keeper(model: Model, p: QualityFM):
    def run(batches):
        table = word_table()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                chars = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * len(texts)
                found = [features(t, n, table, p) for t, n in zip(texts, chars, strict=True)]
                ok = model.scores([f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found]).reshape(-1, STATS)) >= p.threshold
                yield batch.filter(pa.array(ok))

    return run


def keep_good(docs: DataFrame, model: Model, params: QualityFM = QualityFM()) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    return docs.mapInArrow(_keeper(model, params), docs.schema)
