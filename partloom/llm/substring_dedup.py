"""Repeated token spans by compaction of the de Bruijn graph of token k-mers.

Edges are the k-word windows (k-mers) of all documents, nodes the (k-1)-word
windows between them. A k-mer repeats only where its minimizer (the smallest
hashed m-word window inside) does, so runs of consecutive k-mers of one
document that share their minimizer travel as one row, a stretch: its
minimizer, the hash of its words, and its source coordinates (document, first
window, number of windows; Chikhi, Limasset and Medvedev, 2016).

Spark joins then tell three cases apart. A minimizer seen once has no repeats.
A stretch that occurs twice or more as a whole is a path of repeated k-mers. A
minimizer with several different stretches is opened: one source per stretch
is read again at its coordinates, and its single k-mers are counted, each
weighing as often as its stretch occurs.

Repeated stretches that follow each other in a document meet in a node. The
degrees of such nodes, distinct stretches that come in and go out in all
documents, are counted by joins; where both are one, the two are one path, and
a document's rows of one path are compacted into one span (``compacted``).

Every span is then verified at its source coordinates: a 128-bit digest of its
words as they stand in the text. All spans of one path must have one digest,
and so must equal k-mers; if hashes ever collided, everything is done again
with word hashes of another seed. What a verified span covers is cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.runtime import keyed_join, materialise, utf8
from partloom.llm.words import STEP, U, WindowHasher, hash_words, word_table


@dataclass(frozen=True)
class SubstringDedup:
    """window: words of a repeated span at least. minimizer: words of a minimizer; window - minimizer < 62.

    seeds: of word hashes, tried in turn until every span is verified.
    """

    window: int = 35
    minimizer: int = 15
    seeds: tuple[int, ...] = (0, 1, 2, 3)


#: Bits of a minimizer value that hold its place within a batch.
PLACE = 24


def stretches(docs: list[tuple[int, np.ndarray]], p: SubstringDedup) -> dict[str, np.ndarray]:
    """Maximal runs of windows with one minimizer, over documents given as (row number, hashed words)."""
    docs = [(r, w) for r, w in docs if len(w) >= p.window]
    if not docs:
        return {}
    lengths = np.array([len(w) for _, w in docs])
    w = np.concatenate([w for _, w in docs])
    ends = np.cumsum(lengths)
    first, second = WindowHasher(w, 0), WindowHasher(w, 1)
    n = len(w) - p.minimizer + 1
    at = np.arange(n)
    grams = first(at, at + p.minimizer)
    value = (grams & ~U((1 << PLACE) - 1)) | at.astype(U)
    span = p.window - p.minimizer + 1
    low, width = value, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & U((1 << PLACE) - 1)).astype(np.int64)
    windows = np.ones(len(place), dtype=bool)
    for end in ends[:-1].tolist():
        windows[end - p.window + 1 : end] = False  # these would span two documents
    begin = windows.copy()
    begin[1:] &= (place[1:] != place[:-1]) | ~windows[:-1]
    start = np.flatnonzero(begin)
    stop = np.flatnonzero(windows & ~np.append(windows[1:] & ~begin[1:], False)) + 1
    doc = np.searchsorted(ends, start, side="right")
    return {
        "row": np.array([r for r, _ in docs])[doc],
        "start": start - (ends - lengths)[doc],
        "n": stop - start,
        "anchor": grams[place[start]].view(np.int64),
        "whole": second(start, stop + p.window - 1).view(np.int64),
    }


def seeded_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return hash_words(words, word_table(seed))


def _batched(batch, seed: int, p: SubstringDedup):
    """Documents of a batch in groups of about STEP words; a longer one comes in pieces that share window - 1 words."""
    group, total = [], 0
    for i, text in enumerate(batch.column(1)):
        text = text.as_py()
        words = text.split() if text else []
        if len(words) < p.window:
            continue
        w = seeded_hashes(words, seed)
        for at in range(0, len(w) - p.window + 1, STEP):
            piece = w[at : at + STEP + p.window - 1]
            group.append((i, at, piece))
            total += len(piece)
            if total >= STEP:
                yield group
                group, total = [], 0
    if group:
        yield group


def _stretch_rows(p: SubstringDedup, seed: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for group in _batched(batch, seed, p):
                found = stretches([(k, w) for k, (_, _, w) in enumerate(group)], p)
                if not found:
                    continue
                row, shift = np.array([g[0] for g in group])[found["row"]], np.array([g[1] for g in group])[found["row"]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array((found["start"] + shift).astype(np.int32)), pa.array(found["n"].astype(np.int32)), pa.array(found["anchor"]), pa.array(found["whole"])],
                    names=["key", "start", "n", "anchor", "whole"],
                )

    return run


def _window_rows(p: SubstringDedup, seed: int):
    """Single k-mers of the stretches asked for: rows (key, text, starts, ns, counts) -> k-mers with their weight."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = seeded_hashes(batch.column("text")[i].as_py().split(), seed)
                asked = batch.column("asked")[i].values
                start, n = asked.field("start").to_numpy().astype(np.int64), asked.field("n").to_numpy().astype(np.int64)
                at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashed = WindowHasher(words, 1)(at, at + p.window)
                other = WindowHasher(words, 0)(at, at + p.window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), batch.column("key")[i].as_py())),
                        pa.array(np.repeat(start, n).astype(np.int32)),
                        pa.array((at - np.repeat(start, n)).astype(np.int32)),
                        pa.array(np.repeat(asked.field("times").to_numpy(), n)),
                        pa.array(hashed.view(np.int64)),
                        pa.array(other.view(np.int64)),
                    ],
                    names=["key", "start", "place", "times", "h1", "h2"],
                )

    return run


def digest(words: list[bytes]) -> bytes:
    """128 bits of the words, which hold no space."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


#: Rows that are cut at a time.
ROWS = 256
CHECK = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("digest", pa.binary())])


def _inside(column: pa.ListArray, i: int) -> pa.StructArray:
    """The structs of row i."""
    return column.values.slice(column.offsets[i].as_py(), column.value_lengths()[i].as_py() or 0)


def _spans(solid: pa.ListArray, single: pa.ListArray, i: int, window: int):
    """First word, end, whether it goes, a and b of row i's spans, and how many of them, the first ones, are paths."""
    its, stretches = _inside(solid, i), _inside(single, i)
    start = [its.field("start").to_numpy()]
    stop = [start[0] + its.field("n").to_numpy() + window - 1]
    gone, a, b = [np.ones(len(its), dtype=bool)], [its.field("path").to_numpy()], [np.zeros(len(its), dtype=np.int64)]
    if len(stretches):
        lists = stretches.field("kmers")
        kmers = lists.flatten()
        at = np.repeat(stretches.field("start").to_numpy(), lists.value_lengths().to_numpy()) + kmers.field("place").to_numpy()
        start.append(at)
        stop.append(at + window)
        gone.append(kmers.field("gone").to_numpy(zero_copy_only=False))
        a.append(kmers.field("h1").to_numpy())
        b.append(kmers.field("h2").to_numpy())
    return (*map(np.concatenate, (start, stop, gone, a, b)), len(its))


def _cutter(p: SubstringDedup):
    """Rows (doc_id, text, solid, single) -> what is kept, and the digests of the spans by path or k-mer."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                solid, single = batch.column("solid"), batch.column("single")
                counts, kept, a, b, digests, ends = [], [], [], [], [], [0]
                for i, text in enumerate(batch.column("text")):
                    words = (text.as_py() or b"").split()
                    removed, left = 0, words
                    if solid[i].is_valid or single[i].is_valid:
                        start, stop, gone, its_a, its_b, paths = _spans(solid, single, i, p.window)
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, start[gone], 1)
                        np.add.at(edge, stop[gone], -1)
                        inside = np.cumsum(edge[:-1]) > 0
                        removed = int(inside.sum())
                        left = [w for w, g in zip(words, inside.tolist(), strict=True) if not g]
                        a.append(its_a)
                        b.append(np.ma.array(its_b, mask=np.arange(len(its_b)) < paths))
                        digests += [digest(words[x:y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                    counts.append((len(words), removed))
                    kept.append(b" ".join(left))
                    ends.append(len(digests))
                none = np.zeros(0, dtype=np.int64)
                flat = [pa.array(np.concatenate([none, *a])), pa.array(np.ma.concatenate([none, *b]).filled(0), mask=np.ma.getmaskarray(np.ma.concatenate([none, *b]))), pa.array(digests, type=pa.binary())]
                checks = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.StructArray.from_arrays(flat, fields=list(CHECK)))
                numbers = [pa.array([c[k] for c in counts], type=pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(kept, type=pa.binary()), checks], names=["doc_id", "n_words", "n_removed", "kept", "checks"])

    return run


def _digested(cut):
    def run(batches):
        for batch in cut(batches):
            sums = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, type=pa.string()), batch.column("checks")], names=["doc_id", "n_words", "n_removed", "kept_sha256", "checks"])

    return run


def compacted(solid: DataFrame) -> DataFrame:
    """solid (key, start, n, id): repeated stretches, ``id`` names equal ones -> key, start, n, path: spans along nonbranching paths.

    Between two stretches that follow each other is a node. It doesn't branch if every occurrence of the first is
    followed by the second and every occurrence of the second comes after the first; then the second is inside a
    path. A path is named by its first stretch, which fixes the others.
    """
    by_place = Window.partitionBy("key").orderBy("start")
    before = F.when(F.lag(F.col("start") + F.col("n")).over(by_place) == F.col("start"), F.lag("id").over(by_place))
    rows = materialise(solid.withColumn("before", before), "walks")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    into = rows.groupBy("id").agg(F.count("*").alias("times"), F.count("before").alias("entered"), one("before").alias("only_before"))
    out_of = rows.where("before is not null").groupBy("before").agg(F.count("*").alias("left"), one("id").alias("only_after"))
    into = materialise(into, "degrees")
    ends = into.select(F.col("id").alias("before"), F.col("times").alias("times_before")).join(out_of, "before")
    inner = ends.where("times_before = left and only_after is not null").select(F.col("only_after").alias("id"), F.col("before").alias("only_before"))
    inner = into.where("entered = times").join(inner, ["id", "only_before"]).select("id", F.lit(True).alias("inner"))
    marks = materialise(into.select("id", "times").join(inner, "id", "left").select("id", "times", F.coalesce("inner", F.lit(False)).alias("inner")), "marks")
    marked = keyed_join(rows.drop("before"), marks, ["id"], "times")
    marked = marked.withColumn("run", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("key", "run").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.max(F.when(~F.col("inner"), F.col("id"))).alias("path")).drop("run")


def repeated_spans(keyed: DataFrame, params: SubstringDedup = SubstringDedup(), seed: int = 0) -> DataFrame:
    """keyed (key long unique, text binary) -> key, solid, single: candidates for what repeats, by hashes.

    solid, array<struct<start, n, path>>: windows start .. start + n - 1 of the document, one path of the graph.
    single, array<struct<start, kmers>>: single windows at start + place; ``gone`` is false for one that is here
    only to be compared with its equals.
    """
    p = params
    found = materialise(keyed.mapInArrow(_stretch_rows(p, seed), "key long, start int, n int, anchor long, whole long"), "stretches")
    paths = found.groupBy("anchor", "whole", "n").agg(F.count("*").alias("times"), F.min(F.struct("key", "start")).alias("source"))
    paths = materialise(paths, "paths")
    anchors = materialise(paths.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors")

    repeated = paths.where("times > 1").select("anchor", "whole", "n", "times")
    solid = keyed_join(found, repeated, ["anchor", "whole", "n"], "times").select("key", "start", "n", F.xxhash64("anchor", "whole", "n").alias("id"))
    solid = compacted(solid).groupBy("key").agg(F.collect_list(F.struct("start", "n", "path")).alias("solid"))

    # An anchor in very many different stretches (a boilerplate of just under a window) would fill a task.
    branching = keyed_join(paths, anchors, ["anchor"], "kinds")
    asked = branching.select(F.col("source.key").alias("key"), F.struct(F.col("source.start").alias("start"), "n", "times").alias("one"))
    asked = asked.groupBy("key").agg(F.collect_list("one").alias("asked"))  # at most a document's own stretches
    kmers = keyed.join(asked, "key").mapInArrow(_window_rows(p, seed), "key long, start int, place int, times long, h1 long, h2 long")
    kmers = materialise(kmers, "kmers")
    more = materialise(kmers.groupBy("h1", "h2").agg(F.sum("times").alias("total"), F.count("*").alias("sources")).where("total > 1 and sources > 1").select("h1", "h2", "sources"), "more")
    single = keyed_join(kmers, more, ["h1", "h2"], "sources")
    single = single.groupBy("key", "start").agg(F.collect_list(F.struct("place", "h1", "h2", (F.col("times") == 1).alias("gone"))).alias("kmers"))
    single = single.groupBy("key").agg(F.collect_list(F.struct("start", "kmers")).alias("single"))
    return solid.join(single, "key", "full")


def verified(cut: DataFrame) -> bool:
    """Whether the spans of each path and the occurrences of each k-mer, two at least, have one digest."""
    each = cut.select(F.explode("checks").alias("c")).groupBy("c.a", "c.b").agg(F.min("c.digest").alias("low"), F.max("c.digest").alias("high"), F.count("*").alias("n"))
    return each.where("low <> high or n < 2").isEmpty()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))


def substring_dedup(docs: DataFrame, params: SubstringDedup = SubstringDedup(), texts: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256 (or kept, the text itself as bytes).

    A window is ``window`` consecutive words of one document, unchanged; every
    word that a window covers whose word sequence starts anywhere else, in the
    same document or another, is removed. Windows are judged on the input. Null
    texts have no words; doc_id may repeat or be null, every row is a document
    of its own and equal rows are each other's repeats. Texts of any length are
    taken whole. One row per input row; an empty table gives an empty result;
    other columns are ignored.
    """
    p = params
    slim = _keyed(docs)
    ids = slim.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not ids.isEmpty():
        slim = materialise(slim.withColumn("key", F.monotonically_increasing_id()), "keyed")  # written once, so the keys stay
    else:
        slim = slim.withColumn("key", F.col("doc_id"))
    kept = "kept" if texts else "kept_sha256"
    cutter, kind = (_cutter(p), "kept binary") if texts else (_digested(_cutter(p)), "kept_sha256 string")
    for seed in p.seeds:
        spans = repeated_spans(slim.select("key", "text"), p, seed)
        joined = slim.join(spans, "key", "left").select("doc_id", "text", "solid", "single")
        schema = f"doc_id long, n_words long, n_removed long, {kind}, checks array<struct<a:bigint,b:bigint,digest:binary>>"
        cut = materialise(joined.mapInArrow(cutter, schema), "cut")
        if verified(cut):
            return cut.select("doc_id", "n_words", "n_removed", kept)
    raise RuntimeError(f"hashes of words collided for all of the seeds {p.seeds}")
