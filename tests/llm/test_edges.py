"""Nulls in any column, empty, very long and repeated rows, and columns with clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partloom.llm import exact_dedup, filter_audit, license_scan, mixing, near_dedup, packing, quality_fm, sharding, simhash, substring_dedup, topk_search, url_filter
from partloom.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 5000}" for i in range(120_000))
ROWS = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (None, "a b c d e f g", None, None, 13), (None, "x", None, "s", None), (2, "", "en", None, 0), (3, LONG, "en", "t", len(LONG)), (3, "other text of one id", "en", "t", 20)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("id rep part key row n size digest keep_id kept shard slot start n_words score predicted held_out w rank comp component_id taken target draw stratum words bucket count license containment path solid single checks place "
         "before times inner run length offset sequence_id ids_crc32 rest cut copy first_sequence its_length quality at value stats bands sketch d1 d2 text_crc32 law capacity winner member fingerprint print first copies comp part mask digest good toxic known every label cells s bit gone step removed filter_order n_ok").split()  # fmt: skip


def fitted(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None), (9, 0)], "doc_id long, quality int")
    return quality_fm.fit_on(docs, labels)


OPERATORS = {
    "license": lambda d: license_scan.scan_licenses(d, {"own": "a b c d e f g"}),
    "shard": sharding.shard_documents,
    "near": near_dedup.near_duplicates,
    "substring": substring_dedup.substring_dedup,
    "quality": lambda d: quality_fm.score_quality(d, fitted(d)),
    "mix": mixing.mix_sources,
    "mixed": mixing.mixed_documents,
    "pack": lambda d: packing.pack_documents(d, packing.Packing(tokenizer_path())),
    "simhash": simhash.simhash_dedup,
    "audit": lambda d: filter_audit.filter_audit(d, d.sparkSession.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")),
    "exact": lambda d: exact_dedup.exact_dedup(d, exact_dedup.older_half(d)),
}
STAGES = {name: (lambda d, f=stage, name=name: f(d.sparkSession, d, "")) for name, stage in corpus_pipeline.STAGES if name != "quality"}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_odd_rows_and_clashing_names(odd, name):
    run = (OPERATORS | STAGES)[name]
    plain = run(odd)
    clash = run(odd.withColumns({c: F.lit(7) for c in NAMES}))
    shared = [c for c in plain.columns if name not in ("mixed", *STAGES) or c in odd.columns or name == "packing"]
    rows = lambda df: sorted(map(str, df.select(*shared).collect()))
    got = rows(plain)
    assert rows(clash) == got
    if name in ("shard", "near", "substring", "quality", "mix", "exact"):
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_empty_tables(empty, name):
    assert (OPERATORS | STAGES)[name](empty).count() == 0


def test_odd_rows_have_defined_results(odd):
    assert sorted((r.doc_id or 0, r.n_words) for r in OPERATORS["license"](odd).collect()) == [(0, 7), (1, 7), (1, 7)]
    assert sorted((r.doc_id or 0, r.size) for r in OPERATORS["shard"](odd).collect()) == sorted((a or 0, len(t or "") + 1) for a, t, *_ in ROWS)
    near = {(r.doc_id, r.n_shingles) for r in OPERATORS["near"](odd).collect()}
    assert {(1, 3), (None, 0), (None, 3), (2, 0), (3, 5000), (3, 1)} <= near
    cut = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in OPERATORS["substring"](odd).collect())
    assert (3, 120_000, 120_000) in cut and (1, 7, 0) in cut
    assert sorted((r.doc_id or 0, r.size) for r in OPERATORS["mix"](odd).collect()) == sorted((a or 0, len((t or "").split())) for a, t, *_ in ROWS)
    pieces = OPERATORS["pack"](odd).collect()
    assert sum(r.start == 0 for r in pieces) == len(ROWS) and sum(r.doc_id == 3 for r in pieces) > 50
    sizes = sorted((r.doc_id or 0, r.group_size) for r in OPERATORS["exact"](odd).collect())
    assert sizes == [(0, 1), (0, 2), (0, 3), (1, 3), (1, 3), (2, 2), (3, 1), (3, 1)]
    kept = {t: n for t, n in corpus_pipeline.exact(odd.sparkSession, odd, "").groupBy("text").count().collect()}
    assert kept == {"a b c d e f g": 1, "x": 1, "": 1, LONG: 1, "other text of one id": 1} or kept == {"a b c d e f g": 1, "x": 1, None: 1, LONG: 1, "other text of one id": 1}


def test_urls_of_any_kind(spark):
    long = "http://" + "a." * 5000 + "example.com/en/" + "p" * 100_000
    rows = [(1, long, "h"), (1, long, "h"), (None, None, None), (2, "", "h"), (None, "http://net/es/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("host", "path", "keys", "key", "rule", "verdict", "in", "labels", "n", "segment", "word", "bits", "at")})
    got = sorted((r.page_id or 0, r.rule or "", r.verdict) for r in url_filter.judge_urls(df).collect())
    assert got == [(0, "", "allow"), (0, "net/es/", "block"), (1, "example.com/en/", "block"), (1, "example.com/en/", "block"), (2, "", "allow")]


def test_vectors_of_any_kind(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0] * 3000), (None, [1.0]), (2, None), (3, [None]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in ("w", "score", "rank", "place", "q", "c", "query_id")})
    got = [tuple(r) for r in topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 50 == 0).orderBy("rank").select("query_id", "vec_id", "score").collect()]
    assert got == [(0, 1, 256 * 256 + 512 * 256), (0, 4, 0)]


def test_quality_stage_of_odd_rows(odd, tmp_path):
    labels = odd.sparkSession.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(odd.sparkSession, odd, str(tmp_path))
    assert kept.columns == odd.columns and kept.count() <= len(ROWS)
