"""Sharding, mixing, packing and URL filters against brute force and round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import mixing as mx
from partloom.llm import packing as pk
from partloom.llm import sharding as sh
from partloom.llm import url_filter as uf

try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None
needs_tokenizer = pytest.mark.skipif(public_tokenizers is None, reason="no tokenizer files")


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, at = 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("digits", "shards"), [(1, 8), (3, 8), (1, 3), (1, 500)])
def test_shards_are_minimax(clashing, rows, digits, shards):
    import hashlib

    out = sh.shard_documents(clashing, sh.Sharding(shards=shards, digits=digits, step=1)).collect()
    groups = defaultdict(int)
    for _, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    want = least_capacity([groups[k] for k in sorted(groups)], shards)
    assert {r.capacity for r in out} == {want}
    total, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    text = {i: t or "" for i, t, *_ in rows}
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and 0 <= r.shard < shards
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
        texts[text[r.doc_id]].add(r.shard)
    assert max(total.values()) == want
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in texts.values())


def test_shards_of_nothing(empty):
    assert sh.shard_documents(empty).count() == 0


def test_targets_reach_caps_and_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 100, None: 50}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mx.source_targets(df).collect()}
    weights, caps, total = {"a": 1, "b": 2, "c": 3, None: 1}, {k: 3 * v for k, v in sizes.items()}, sum(sizes.values())
    full = set()
    while True:
        rest = total - sum(caps[k] for k in full)
        w = sum(weights[k] for k in weights if k not in full)
        over = {k for k in weights if k not in full and weights[k] * rest / w >= caps[k]}
        if not over:
            break
        full |= over
    want = {k: caps[k] if k in full else weights[k] * rest / w for k in weights}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("stratum", [4, 1024])
def test_mix_takes_the_targets(clashing, rows, stratum):
    p = mx.Mixing(stratum=stratum)
    out = mx.mix_sources(clashing, p).collect()
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    taken, target = defaultdict(int), {}
    for r in out:
        assert r.size == len((dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").encode().split()) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(out) == len(rows) and sum(size.values())
    strata = len(rows) // stratum + 2
    assert all(abs(taken[s] - target[s]) <= strata for s in target)
    assert sorted(out) == sorted(mx.mix_sources(clashing, p).collect())


@pytest.mark.parametrize("stratum", [4, 1024])
def test_mixed_documents_are_whole_and_as_many_as_taken(docs, clashing, rows, stratum):
    p = mx.Mixing(stratum=stratum)
    taken = {r.doc_id: (r.taken, r.size) for r in mx.mix_sources(docs, p).collect()}
    out = mx.mixed_documents(clashing, p)
    assert out.columns == clashing.columns
    found = out.collect()
    texts, source = {i: t for i, t, *_ in rows}, {i: s for i, _, _, s, _ in rows}
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in found)
    copies, words, want = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        copies[r.doc_id] += 1
        words[source[r.doc_id]] += taken[r.doc_id][1]
    for i, (t, size) in taken.items():
        want[source[i]] += t
        assert copies[i] in ({0} if not t else {t // size, -(-t // size)})
    longest = max(size for _, size in taken.values())
    strata = len(rows) // stratum + 2
    assert all(abs(words[s] - want[s]) <= longest * strata for s in want)
    assert sorted(map(str, found)) == sorted(map(str, mx.mixed_documents(clashing, p).collect()))


def test_rows_alike_but_for_one_column_stay_apart(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "de"), (1, "a b c", "s", None), (1, "a b c", "s", ""), (None, "a b c", "s", "en"), (None, "a b c", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mx.mixed_documents(df, mx.Mixing(weights=(1,)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_rows_without_an_id_fill_many_strata(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 3000, "s").otherwise("t").alias("source"))
    sized = mx.materialise(df.select("doc_id", "source", F.lit(2).cast("long").alias("size"), mx._row_key().alias("key")), "sized")
    p = mx.Mixing(stratum=100)
    strata = F.pmod(F.conv(F.substring(mx._draw(p, F.col("key")), 1, 8), 16, 10).cast("long"), F.lit(30))
    assert sized.where("source = 's'").groupBy(strata.alias("k")).count().agg(F.max("count")).first()[0] < 200
    out = mx.mix_sources(df, p).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 31 for r in out)


def test_mix_of_nothing_and_of_blanks(spark, empty):
    assert mx.mix_sources(empty).count() == 0
    assert mx.mixed_documents(empty).count() == 0
    df = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mx.mix_sources(df).collect()] == [(0, 0.0, 0)] * 2
    assert mx.mixed_documents(df).count() == 0


@needs_tokenizer
def test_packing_round_trip(clashing, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    length = 128
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, *_ in rows}
    out = pk.pack_documents(clashing, pk.Packing(path, length=length)).collect()
    covered, place = defaultdict(list), defaultdict(list)
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        place[r.sequence_id].append((r.offset, r.length))
    for i, want in ids.items():
        at = 0
        for start, n in sorted(covered[i]):
            assert start == at
            at += n
        assert at == len(want)
    for pieces in place.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(place) == list(range(len(place)))
    tokens = sum(map(len, ids.values()))
    assert len(place) * length < 1.1 * tokens


@needs_tokenizer
def test_packing_of_nothing_and_empty_text(spark, empty):
    p = pk.Packing(public_tokenizers.path("byte_bpe_50k.json"))
    assert pk.pack_documents(empty, p).count() == 0
    r = pk.pack_documents(spark.createDataFrame([(5, None)], "doc_id long, text string"), p).first()
    assert (r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) == (5, 0, 1, 1, 0, 0)


ODD = ["a  b", "a \nb", " x", "x ", "a\tb c", "don't  we'll", "a\u00a0b c", "\n\na", "é è\nü", "1 2,3 .4", "word<|endoftext|> b", "x\r\ny z", "tail\n", "日本 語", "a\u2028b c", "'s 's x's"]


@needs_tokenizer
def test_encoder_equals_the_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert pk.agreed(path)
    assert pk.agreed_in_a_task(spark.sparkContext.applicationId, path)
    texts = [*ODD, "a" * 5000 + " b", "x" + " " * 900 + "y", "\x00 nul", "\U00020000\U0001d400 b", "end<|endoftext|>"]
    for fast in (True, False):
        e = pk.Encoder(path, fast)
        assert (e.twin is not None) == fast
        want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
        assert e.encode(texts) == want
        assert [e.encode([x])[0] for x in texts] == want


@needs_tokenizer
def test_encoder_equals_the_tokenizer_on_random_texts_of_all_scripts():
    e = pk.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    rng = np.random.default_rng(8)
    blocks = [(32, 127), (161, 591), (880, 1279), (1424, 1535), (1536, 1791), (2304, 2431), (3585, 3675), (4352, 4607), (12353, 12543), (19968, 20500), (44032, 44500), (127744, 128512)]
    texts = []
    for _ in range(400):
        low, high = blocks[rng.integers(len(blocks))]
        words = ["".join(chr(c) for c in rng.integers(low, high, rng.integers(1, 9))) for _ in range(rng.integers(1, 30))]
        texts.append("".join(w + [" ", "\n", "  ", " "][rng.integers(4)] for w in words))
    texts += [bytes(rng.integers(0, 256, 60, dtype=np.uint8).tolist()).decode("utf-8", "replace") for _ in range(200)]
    want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert e.encode(texts) == want


def test_patterns_use_the_histogram_exactly():
    rng = np.random.default_rng(3)
    for histogram in ({}, {1: 5}, {8: 3, 5: 4, 3: 4, 1: 9}, dict(enumerate(rng.integers(0, 40, 64).tolist(), 1))):
        patterns = pk.shortest_pack_first(histogram, 64)
        used = defaultdict(int)
        for count, lengths in patterns:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += count
        assert dict(used) == {k: v for k, v in histogram.items() if v}


URLS = [
    "http://a.example.com/en/x", "https://www.example.com/en/1?x", "http://EXAMPLE.com", "http://example.com/", "http://x.net/es/1", "http://net/fr/", "http://anet/fr/1", "http://example.com/EN/1",
    "no scheme example.com/en/", None, "", "ftp://user@example.com:80/en/", "http://example.com/en", "http://ww.www.example.com/en/a#b", "x://http://y.net/es/", "http://com?/", "http://a.example.com#/en/", "http://.com/en/", "://com/",
]


def brute_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, default
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.rule), len(r.host)), default=None)
    return host, path, best.rule if best else None, best.verdict if best else default


@pytest.mark.parametrize("bits", [2, 12])
def test_url_rules_match_brute_force(spark, bits):
    rules = [*uf.RULES, *[uf.Rule("block", f"h{i}.org/p{i % 7}") for i in range(60)]]
    urls = URLS + [f"http://s.h{i % 90}.org/p{i % 11}/x" for i in range(300)]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, key int, rule int")
    out = uf.judge_urls(df, tuple(rules), params=uf.Cascade(bits=bits, hashes=2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}


def test_url_rules_in_segments_and_from_a_table(spark):
    rules = [*uf.RULES, *[uf.Rule(["block", "allow", "review"][i % 3], f"h{i}.org/p{i % 7}") for i in range(90)]]
    urls = URLS + [f"http://s.h{i % 120}.org/p{i % 11}/x" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(r.rule, r.verdict, 1) for r in rules], "rule string, verdict string, key int")
    p = uf.Cascade(bits=4, hashes=2, most_bits=128)
    levels = uf.build_cascade(table.select(F.col("rule").alias("key")), table.select(F.col("rule").alias("key")), p)
    assert levels.segments == 3 and all(len(level) == 3 for level in levels.filters)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df, table, params=p).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in uf.judge_urls(df, ()).collect()} == {"allow"}


def test_url_rules_on_nothing(spark):
    assert uf.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
