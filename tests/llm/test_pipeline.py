"""The pipeline's stages and their guard, stage by stage against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from partloom.llm import mixing, quality_fm
from tests.llm.conftest import DOCS, corpus
from tests.llm.test_dedup import brute_components

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(9)
    rows += [(1000 + i, "BAD!! " * (20 + i), "en", "src0", 6 * (20 + i)) for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables, given = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, given, folder), f"test-{i}")
        tables.append(out)
        given = out
    good, exact, near, mixed, packed = tables
    assert all(t.columns == docs.columns for t in tables[:-1])

    model = quality_fm.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in quality_fm.score_quality(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == kept and not any(i is not None and i >= 1000 for i in kept)

    groups = defaultdict(list)
    for r in good.collect():
        groups[r.text or ""].append(r.doc_id)
    assert {r.doc_id for r in exact.collect()} == {max(g) for g in groups.values()}

    rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert {r.doc_id for r in near.collect()} == {top for _, top in brute_components(rows, 5).values()}

    want = {r.doc_id: (r.taken // r.size, -(-r.taken // r.size)) for r in mixing.mix_sources(near).collect() if r.taken}
    whole, got = {tuple(r) for r in near.collect()}, Counter()
    for r in mixed.collect():
        assert tuple(r) in whole  # whole rows: no text is cut, no column is lost
        got[r.doc_id] += 1
    assert set(got) <= set(want) and all(got[i] in n for i, n in want.items())

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter((r.doc_id, n) for r in mixed.collect() for n in [len(t.encode(r.text, add_special_tokens=False).ids) + 1])
    assert Counter((r.doc_id, r.doc_tokens) for r in packed.where("start = 0").collect()) == ids
    fill = defaultdict(int)
    for r in packed.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and out.count() > 0


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1], dtype="<u4").tobytes()) == zlib.crc32(b"\x01\x00\x00\x00")


def test_dedup_stages_keep_one_row_of_each_group_whatever_the_ids(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    close = [t + " end" for t in long]
    rows = [(1, long[0], "x"), (1, long[0], "y"), (1, long[1], "x"), (2, long[1], "x"), (3, long[1], "x")]  # equal rows but one column; one id of two texts
    rows += [(None, long[2], "x"), (None, long[2], "x"), (None, long[3], "x"), (9, long[3], "x"), (None, long[4], "x")]
    out = corpus_pipeline.exact(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == ["doc_id", "text", "source"]
    assert got == Counter([(1, long[0]), (3, long[1]), (None, long[2]), (9, long[3]), (None, long[4])])

    rows = [(1, long[0], "x"), (1, long[0], "y"), (1, close[1], "x"), (0, long[1], "x"), (None, long[2], "x"), (None, close[2], "x"), (None, long[3], "x"), (4, close[3], "x"), (None, None, "x")]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "")
    got = Counter((r.doc_id, r.text if r.doc_id is not None else r.text and r.text[:2]) for r in out.collect())
    assert got == Counter([(1, long[0]), (0, long[1]), (None, "c0"), (4, close[3]), (None, None)])
