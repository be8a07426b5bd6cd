"""The pipeline's stages, each against a plainer version of itself, and the registered queries with SQL."""

import duckdb
import pytest

import corpus_pipeline
from fianchetto.llm import pii, quality, queries
from tests.conftest import SMALL
from tests.llm.test_classifiers import base_spans
from tests.llm.test_duplicates import brute_components, brute_tiles, words
from tests.llm.test_tokens import check_packed

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    res = con.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple("" if x is None else f"{x!r}" for x in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(res.fetchall(), key=key)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test-stage")
        kept.append((before, docs))
    for before, after in kept[:-1]:
        assert after.dtypes == before.dtypes
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    (before, after), model_scores = kept[0], None
    model_scores = quality.classify_quality(before, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert set(rows(after)) == {r.doc_id for r in model_scores if r.score >= 0.3}
    assert 0 < after.count() < before.count()

    before, after = map(rows, kept[1])
    assert set(after) == {i for i, (_, c) in brute_components(sorted(before.items()), 80, 5).items() if i == c}

    before, after = map(rows, kept[2])
    held = {i for i, t in before.items() for _, x in bench
            if set(words(x)) <= set(words(t)) | {""} and brute_tiles(words(t), words(x), 5)[0] >= 0.5 * len(words(x))}
    assert held.isdisjoint(after) and set(after) <= set(before)
    assert len(before) - len(after) <= len(held) + 2

    before, after = map(rows, kept[3])
    assert set(before) == set(after)
    for i, t in before.items():
        assert (after[i] != t) if base_spans(t) else True
        assert not [s for s in base_spans(after[i]) if s.startswith(("email", "phone"))]
    assert all(r.n_chars == len(r.text) for r in kept[3][1].collect())

    bins, least = check_packed(kept[4][1].collect(), [(i, t) for i, t in after.items()], 2048)
    assert bins <= 1.05 * least + 1


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0 and pii.KINDS == ["email", "ip", "card", "phone"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.collect() == []


def test_near_duplicates_go_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (3, c), (None, c), (None, "null " + b), (4, None), (4, None), (None, ""), (5, "z " + a)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, df, SMALL)
    assert got.columns == df.columns
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(1, a), (2, b), (3, c), (4, None), (4, None), (None, "")], key=key)
