"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from tests.core.oracle import connect, differences
from tests.llm import fixtures as X
from tidegrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF) == []


def test_ten_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.collect()} == set(rows)
            continue
        assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out)
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "minhash_near_dedup":
            assert set(kept) == {root for _, root in X.components(list(rows.items())).values()}
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept) == {i for i, v in X.phrase_hits(list(rows.items()), items).items() if not v[1]}
        if name == "secret_scans":
            assert set(kept) == set(rows)
        rows = kept
    assert corpus_pipeline.run(spark, SF).count() == out.count()
