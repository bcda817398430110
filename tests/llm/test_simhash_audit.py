"""Fingerprints and their components against all pairs; the audit against every order walked document by document."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from partloom.llm import filter_audit, simhash

DOCS = "doc_id long, text string, source string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows (doc_id, fingerprint) -> component_id of each row."""
    of = list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            of[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)] += [d] if d is not None else []
    return [min(least[top(i)], default=None) for i in range(len(rows))]


def test_fingerprints_and_components_equal_all_pairs(spark, docs, rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True))
    got = Counter(map(tuple, simhash.simhash_dedup(docs).collect()))
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_long_texts_repeated_rows_and_missing_ids(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(120_000))
    texts = [(1, long), (2, long), (None, long), (None, "only here with no id"), (5, None), (6, " \t"), (None, ""), (7, "A b"), (7, "a B"), (8, "ünï ÉÉ ß"), (3, "a b c"), (3, "x y z w")]
    got = simhash.simhash_dedup(spark.createDataFrame([(d, t, None) for d, t in texts], DOCS)).collect()
    prints = [(d, brute_print(t)) for d, t in texts]
    want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True))
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_a_crowded_bucket_gives_spanning_links(spark, block):
    """Fingerprints few bits apart, in buckets far larger than a block: the components of all pairs, fewer links than pairs."""
    rng = random.Random(block)
    near = {rng.getrandbits(12) | 0xABC << 52 for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "id long"), simhash.SimHash(block=block)).collect()
    assert all((((r.a ^ r.b) & (1 << 64) - 1).bit_count()) <= 3 for r in links)
    ids = sorted(near)
    want = brute_components([(x, x) for x in ids])
    of = {x: x for x in ids}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for r in links:
        a, b = top(r.a & (1 << 64) - 1), top(r.b & (1 << 64) - 1)
        of[max(a, b)] = min(a, b)
    assert [top(x) for x in ids] == want
    assert len(links) < 10 * 500 * (-(-500 // block) + 1)


def test_counters_equal_popcounts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 7, replace=False)) for k in range(300)], dtype=np.uint64)
    prints = np.concatenate([a, a ^ flips])
    everything = np.arange(len(prints))
    p = simhash.SimHash(pairs=100)
    of = list(range(len(prints)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for _, i, j in simhash.spanning_links([(prints, everything, everything)], p):
        assert (int(prints[i]) ^ int(prints[j])).bit_count() <= 3
        of[max(top(i), top(j))] = min(top(i), top(j))
    assert [top(i) for i in range(len(prints))] == brute_components([(i, int(x)) for i, x in enumerate(prints)])


def test_extra_columns_and_no_rows(spark, docs, clashing, empty):
    assert Counter(map(tuple, simhash.simhash_dedup(clashing).collect())) == Counter(map(tuple, simhash.simhash_dedup(docs).collect()))
    assert simhash.simhash_dedup(empty).collect() == []
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert Counter(map(tuple, filter_audit.filter_audit(clashing, labels).collect())) == Counter(map(tuple, filter_audit.filter_audit(docs, labels).collect()))
    assert filter_audit.filter_audit(empty, labels).collect() == []


def brute_audit(rows, labels):
    """rows (doc_id, text, source); every order walked document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    low = {}
    for d, t, _ in rows:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    out = Counter()
    totals = Counter()
    parts = {s or "" for _, _, s in rows}
    orders = ["".join(x) for x in itertools.permutations("ABCDE")]
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for d, t, s in rows:
        part, t = s or "", t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > low[t]}
        for o in orders:
            gone = False
            for k, x in enumerate(o, 1):
                here = fails[x] and not gone
                out[part, o, k, "redundant"] += fails[x] and gone
                gone = gone or fails[x]
                out[part, o, k, "kept"] += not gone
                out[part, o, k, "removed"] += here
                out[part, o, k, "unique_fails"] += fails[x] and sum(fails.values()) == 1
                out[part, o, k, "good_lost"] += here and d in good
                out[part, o, k, "toxic_lost"] += here and d in toxic
                totals[part, x] += here
    return {(part, o, k, *(out[part, o, k, f] for f in fields), totals[part, x]) for part in parts for o in orders for k, x in enumerate(o, 1)}


def test_audit_equals_every_order_walked(spark, rows):
    some = [(d, t, s) for d, t, _, s, _ in rows[:80] + rows[-40:]]
    some += [(None, rows[0][1], "src0"), (None, rows[0][1], "src1"), (0, rows[0][1], "src1"), (0, rows[0][1], "src0"), (900, rows[0][1], ""), (901, "A#" * 30, "only"), (902, "A#" * 30, "src0"), (-5, "ABC é" * 20, None), (903, "w | " * 60, "x")]
    labels = [(d, d % 2, d % 3 == 0) for d in range(0, 200, 2)] + [(0, 0, 0), (0, 1, 1), (901, None, 1), (902, 1, None), (None, 1, 1), (5000, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    got = filter_audit.filter_audit(spark.createDataFrame(some, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(some, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in some})
    assert {tuple(r) for r in got} == want


def test_one_text_in_a_third_of_the_rows_stays_few_rows(spark):
    rows = [(i, "same text here", f"s{i % 3}") for i in range(5000)] + [(10_000 + i, f"other {i}", "s0") for i in range(10)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.failure_counts(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(cells) == 3 + 10
    assert sum(c.n_ok for c in cells) == 11 and sum(c.n_copy for c in cells) == 4999
