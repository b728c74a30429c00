"""The pipeline's stages over a small table, each judged on its own input."""

from pathlib import Path

import pytest

import corpus_pipeline
from test_jaccard_groups import brute as linked
from test_wu_manber import brute as contaminated

TESTDATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TESTDATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], TESTDATA), name))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_lines_keep_all_documents(stages):
    assert sorted(i for i, _ in pairs(stages[1])) == sorted(i for i, _ in pairs(stages[2]))


def test_one_document_of_each_group(stages):
    roots = {root for _, _, root in linked(pairs(stages[2]), 5, 80)}
    assert {i for i, _ in pairs(stages[3])} == roots


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in contaminated(pairs(stages[3]), items, 13) if not r[-1]}
    assert {i for i, _ in pairs(stages[4])} == clean and len(clean) < stages[3].count()


def test_token_ids(stages):
    assert {r["doc_id"] for r in stages[5].collect()} == {i for i, _ in pairs(stages[4])}


def test_run(spark, stages):
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    run = corpus_pipeline.run(spark, TESTDATA).select(*columns)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, stages[5].select(*columns).collect()))


def test_empty_and_odd_documents(spark, docs_of, odd_rows):
    for docs in (docs_of(odd_rows), docs_of(odd_rows).where("false")):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, TESTDATA), "odd")
        assert docs.count() <= n


def test_short_pages_lose_their_boilerplate(spark, docs_of):
    license = "this license line stands on all of the sites and is much longer than the rest"
    docs = docs_of([(i, f"{license}\nown text {i}", f"s{i}") for i in range(10)])
    got = corpus_pipeline.lines(spark, docs, TESTDATA).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(tuple, got)) == [(i, f"own text {i}", 10) for i in range(10)]
