"""MinHash near-duplicate groups by fast similarity sketching, banding and exact verification.

Method: a document's distinct k-word shingles go through rounds of hashed bin
placement (Dahlgaard, Knudsen and Thorup, 2017). In round i below t every
shingle lands in a random bin with a value above all of round i-1's; round t+j
sends every shingle to bin j, so each of the t coordinates fills, and two sets
agree on a coordinate with probability equal to their Jaccard similarity, with
concentration as for independent samples. Rows of ``rows`` coordinates make
bands; at similarity 0.8 the default 32 bands of 4 miss a pair with
probability (1 - 0.8**4)**32 = 5e-8.

Links are confirmed on full shingle sets only. Pairs are never spelled out
within a bucket: its members meet its smallest id (a linear number of pairs),
and what such stars leave undecided, members of buckets that still hold more
than one component, is compared block by block inside tasks, which emit links
rather than pairs.

Buckets, hubs and groups of copies of any size are split: a bucket's or a
class's row reaches its many rows by broadcast (``keyed_join``), and a hub's
text travels once for every ``hub`` documents that are compared with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.components import connected
from partloom.llm.runtime import keyed_join, materialise, utf8
from partloom.llm.words import U, hash_words, in_steps, mix, shingle_sets, word_table


@dataclass(frozen=True)
class NearDedup:
    """shingle: words per shingle. percent: least similarity, 100*|A&B| >= percent*|A|B|.

    bands * rows coordinates, a power of two. slack: a pair is verified if its
    sketches agree on at least percent/100 - slack of the coordinates; at 128
    coordinates 0.26 is seven standard deviations, and a pair at 0.8 fails with
    probability 8e-12, far below the banding's 5e-8. block: members that one
    task compares with as many others. hub: documents compared with one copy of
    a hub's text.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    slack: float = 0.26
    block: int = 256
    hub: int = 64

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_agree(self) -> int:
        return int(self.coordinates * (self.percent / 100 - self.slack))


EMPTY = U(0xFFFFFFFFFFFFFFFF)


def fast_sketch(x: np.ndarray, doc: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """(n_docs, t) coordinates of the sets x (hashed elements) grouped by doc; t is a power of two."""
    out = np.full(n_docs * t, EMPTY, dtype=U)
    shift = U(64 - t.bit_length() + 1)
    for i in range(2 * t):
        h = mix(x ^ U((i + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        bins = (h >> shift).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + bins, (U(i) << U(48)) | (h & U((1 << 48) - 1)))
        open_docs = (out.reshape(n_docs, t) == EMPTY).any(axis=1)
        keep = open_docs[doc]
        x, doc = x[keep], doc[keep]
        if not len(x):
            break
    return out.reshape(n_docs, t)


def _hashed(text, table):
    return hash_words(text.lower().split(), table) if text else np.zeros(0, dtype=U)


def _sketcher(p: NearDedup):
    def run(batches):
        table = word_table()
        salt = mix(np.arange(1, p.rows + 1, dtype=U))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, hashed in in_steps((x.as_py() for x in texts), lambda t: _hashed(t, table)):
                x, counts = shingle_sets(hashed, p.shingle)
                doc = np.repeat(np.arange(len(at)), counts)
                sketch = fast_sketch(x, doc, len(at), p.coordinates)
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
                digests = []
                for seed in (0x51ED270B, 0x2545F491):
                    total = np.concatenate([[0], np.cumsum(mix(x ^ U(seed)), dtype=U)]).astype(U)
                    digests.append((total[starts + counts] - total[starts]).view(np.int64))
                grouped = sketch.reshape(len(at), p.bands, p.rows)
                keys = mix((grouped * (salt | U(1))).sum(axis=2, dtype=U) + np.arange(p.bands, dtype=U)).view(np.int64)
                coarse = (mix(sketch) & U(255)).astype(np.uint8)
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)),
                        pa.array(counts),
                        pa.array(digests[0]),
                        pa.array(digests[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * p.bands), flat),
                        pa.array([row.tobytes() for row in coarse], type=pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "bands", "sketch"],
                )

    return run


def _agreeing(p: NearDedup):
    """Keeps the pairs whose sketches and set sizes allow the similarity."""

    def run(batches):
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("s1").to_pylist()), dtype=np.uint8).reshape(-1, p.coordinates)
            b = np.frombuffer(b"".join(batch.column("s2").to_pylist()), dtype=np.uint8).reshape(-1, p.coordinates)
            n1, n2 = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            ok = ((a == b).sum(axis=1) >= p.least_agree) & (100 * np.minimum(n1, n2) >= p.percent * np.maximum(n1, n2))
            yield batch.select(["id", "rep", "shared"]).filter(pa.array(ok))

    return run


def _set_of(text: bytes, p: NearDedup, table) -> np.ndarray:
    return shingle_sets([_hashed(text, table)], p.shingle)[0]


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _verifier(p: NearDedup):
    """Rows (rep, part, id, text) in order, a hub's own row (null id) before those compared with it."""

    def run(batches):
        table = word_table()
        head, held = None, None
        for batch in batches:
            found = []
            for rep, part, doc, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "part", "id")), batch.column("text"), strict=True):
                if doc is None:
                    head, held = (rep, part), _set_of(text.as_py(), p, table)
                elif head == (rep, part) and _linked(_set_of(text.as_py(), p, table), held, p.percent):
                    found.append((doc, rep))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, p: NearDedup, label: str) -> DataFrame:
    """The pairs (id, rep) that are links. Texts are shuffled once, then only those that take part."""
    pairs = materialise(pairs.select("id", "rep"), "pairs")
    hubs = materialise(pairs.groupBy("rep").agg(F.count("*").alias("n_rows")).withColumn("parts", F.ceil(F.col("n_rows") / p.hub).cast("int")), "hubs")
    heads = hubs.select(F.col("rep").alias("doc_id"), "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("id"))
    others = keyed_join(pairs, hubs, ["rep"], "n_rows").select(F.col("id").alias("doc_id"), "rep", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    rows = heads.union(others).join(texts, "doc_id").select("rep", "part", "id", "text")
    rows = rows.repartition("rep", "part").sortWithinPartitions("rep", "part", F.asc_nulls_first("id"))
    return materialise(rows.mapInArrow(_verifier(p), "a long, b long"), label)


def _with_component(df: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    named = labels.select(F.col("id").alias(key), F.col("comp").alias(name))
    return df.join(named, key, "left").withColumn(name, F.coalesce(name, key))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links."""
    if links.isEmpty():
        return labels
    known = labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    return materialise(connected(known.union(links)), "labels")


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """members (key, id, n_members, ...) -> one row for each pair of blocks a member takes part in.

    A bucket of up to ``block`` members is one task group; a larger one is dealt
    into blocks (``mine``), and every two blocks meet in a group of their own,
    in which only members of different blocks are compared.
    """
    dealt = members.withColumn("k", F.ceil(F.col("n_members") / F.lit(block)).cast("int"))
    dealt = dealt.withColumn("mine", F.when(F.col("k") > 1, F.pmod(F.xxhash64("id"), F.col("k"))).otherwise(0).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))


def _groups(batches, keys: list[str]):
    """Tables of equal keys from batches that arrive sorted by them."""
    held = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        marks = [rows.column(k).to_numpy() for k in keys]
        changes = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1 if len(rows) else np.zeros(0, dtype=int)
        cuts = [0, *changes.tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows.slice(a, b - a)
            if held and a == 0 and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            if b < len(rows):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def _owned(rows: pa.Table, p: NearDedup):
    """Pairs (i, [j...]) of a group that may link two components and have this bucket as their first common one."""
    key = rows.column("key")[0].as_py()
    comp, n, bands = rows.column("comp").to_numpy(), rows.column("n").to_numpy(), rows.column("bands")
    bands = bands.combine_chunks().values.to_numpy().reshape(-1, p.bands)
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, p.coordinates)
    mine, one_block = rows.column("mine").to_numpy(), rows.column("lo")[0] == rows.column("hi")[0]
    for i in range(len(comp) - 1):
        j = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (one_block | (mine[i + 1 :] != mine[i])))
        j = j[100 * np.minimum(n[j], n[i]) >= p.percent * np.maximum(n[j], n[i])]
        if len(j):
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= p.least_agree]
        if len(j):
            common = bands[j] == bands[i]
            j = j[bands[i][common.argmax(axis=1)] == key]
        if len(j):
            yield i, j


def _unresolved(p: NearDedup):
    """Members of a bucket that may link with a member of another component, by sketch and size."""

    def run(batches):
        for rows in _groups(batches, ["key", "lo", "hi"]):
            active = np.zeros(len(rows), dtype=bool)
            for i, j in _owned(rows, p):
                active[i] = True
                active[j] = True
            if active.any():
                yield from rows.select(["key", "id", "comp"]).filter(pa.array(active)).combine_chunks().to_batches()

    return run


def _block_links(p: NearDedup):
    """Exact links between components among the members of a group; a spanning set of them."""

    def run(batches):
        table = word_table()
        for rows in _groups(batches, ["key", "lo", "hi"]):
            ids, merged = rows.column("id").to_numpy(), {}
            comp, texts, sets, found = rows.column("comp").to_numpy(), rows.column("text"), {}, []

            def top(c):
                while c in merged:
                    c = merged[c]
                return c

            for i, others in _owned(rows, p):
                for j in others.tolist():
                    a, b = top(comp[i]), top(comp[j])
                    if a == b:
                        continue
                    for x in (i, j):
                        if x not in sets:
                            sets[x] = _set_of(texts[x].as_py(), p, table)
                    if _linked(sets[i], sets[j], p.percent):
                        found.append((ids[i], ids[j]))
                        merged[max(a, b)] = min(a, b)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([x for _, x in found])], names=["a", "b"])

    return run


def _in_groups(df: DataFrame) -> DataFrame:
    keys = ["key", "lo", "hi"]
    return df.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, params: NearDedup = NearDedup()) -> DataFrame:
    """docs (doc_id long, text string, ...) -> doc_id, n_shingles, component_id, kept.

    One row per input row. A null, empty or blank text has no shingles and is
    linked with nothing. Rows with one doc_id count as one document when
    components are named. A row with a null doc_id is kept, with a null
    component. Texts of any length are taken whole. Other columns are ignored;
    an empty table gives an empty result.
    """
    p = params
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    schema = "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary"
    sk = materialise(slim.mapInArrow(_sketcher(p), schema), "sketches")

    with_words = sk.where("n > 0 and doc_id is not null")
    classes = with_words.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = materialise(classes, "classes")
    reps = materialise(
        with_words.join(classes.select(F.col("class_id").alias("doc_id"), "d1", "d2", "n"), ["doc_id", "d1", "d2", "n"], "left_semi").select(F.col("doc_id").alias("id"), "n", "bands", "sketch"),
        "reps",
    )

    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = materialise(banded.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n_members")).where("n_members > 1"), "buckets")
    members = materialise(keyed_join(banded, buckets, ["key"], "n_members"), "members")
    stars = materialise(members.where("id <> first").groupBy("id", F.col("first").alias("rep")).agg(F.count("*").alias("shared")), "stars")
    sketches = reps.select("id", "n", "sketch")
    centres = stars.groupBy("rep").agg(F.count("*").alias("n_rows")).join(sketches.select(F.col("id").alias("rep"), F.col("n").alias("n2"), F.col("sketch").alias("s2")), "rep")
    near = keyed_join(stars, materialise(centres, "centres"), ["rep"], "n_rows")
    near = near.join(sketches.select("id", F.col("n").alias("n1"), F.col("sketch").alias("s1")), "id").mapInArrow(_agreeing(p), "id long, rep long, shared long")
    near = materialise(near, "candidates")

    texts = slim.where("doc_id is not null and text is not null")
    best = near.groupBy("id").agg(F.max_by("rep", F.struct("shared", -F.col("rep"))).alias("rep"))
    links = _verify(best, texts, p, "links1")
    labels = materialise(connected(links), "labels")
    rest = near.join(best, ["id", "rep"], "left_anti")
    rest = _with_component(_with_component(rest, labels, "id", "c1"), labels, "rep", "c2").where("c1 <> c2")
    labels = _merged(labels, _verify(rest, texts, p, "links2"))

    crowd = materialise(_with_component(members.where("n_members > 2"), labels, "id", "comp").select("key", "id", "comp", "n_members"), "crowd")
    mixed = materialise(crowd.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_rows")).where("low < high").select("key", "n_rows"), "mixed")
    crowd = keyed_join(crowd, mixed, ["key"], "n_rows").drop("n_rows").join(reps, "id")
    active = _in_groups(_block_pairs(crowd, p.block)).select("key", "lo", "hi", "mine", "id", "comp", "n", "bands", "sketch")
    active = materialise(active.mapInArrow(_unresolved(p), "key long, id long, comp long").distinct(), "unresolved")
    sizes = materialise(active.groupBy("key").agg(F.count("*").alias("n_members")), "sizes")
    late = keyed_join(active, sizes, ["key"], "n_members").join(reps, "id").join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    late = _in_groups(_block_pairs(late, p.block)).select("key", "lo", "hi", "mine", "id", "comp", "n", "bands", "sketch", "text")
    labels = _merged(labels, materialise(late.mapInArrow(_block_links(p), "a long, b long"), "links3"))

    named = _with_component(classes, labels, "class_id", "component_id").select("d1", "d2", "n", "component_id", "copies")
    named = materialise(named, "named")
    one = with_words.select("doc_id", "n", "d1", "d2")
    found = keyed_join(one, named, ["d1", "d2", "n"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sk.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
