"""Ranked search against scoring every document for every item in plain Python, by the definition."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fianchetto.llm import ranked_search
from fianchetto.llm.queries import op11_ranked_search
from tests.conftest import SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """docs: (doc_id, text) rows, items: (item_id, text) rows."""
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort()
        out += [(item, r, doc, -score) for r, (score, _, doc) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [8192, 7])
def test_ranks_equal_scoring_everything(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "DOCS_PER_BLOCK", block * 5)
    monkeypatch.setattr(ranked_search, "ITEMS_PER_BUNDLE", block)
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(op11_ranked_search(spark, SMALL)) == brute(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))


def test_odd_documents_and_items(spark, odd, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS_PER_BLOCK", 4)
    items = spark.createDataFrame([(1, "SAME words, lorem!"), (1, "fox"), (2, None), (3, ""), (None, "Grüße naïve 日本語"), (4, "nowhere-to-be-found"),
                                   (5, "the quick brown fox the quick"), (6, "GRÜSSE x")], "item_id long, text string").withColumn("score", F.lit("clash"))
    found = got(ranked_search.rank_documents(odd, items))
    assert found == brute(rows(odd, "doc_id", "text"), rows(items, "item_id", "text"))
    assert {r[0] for r in found} >= {1, None, 5, 6} and not {2, 3, 4} & {r[0] for r in found}


def test_many_equal_documents_are_ranked_by_id(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCS_PER_BLOCK", 50)
    docs = spark.range(900).select((F.lit(900) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "alpha beta common").otherwise(
        F.concat(F.lit("common gamma "), (F.col("id") % 40).cast("string"))).alias("text"))
    items = spark.createDataFrame([(1, "alpha common"), (2, "gamma 7"), (3, "common")], "item_id long, text string")
    assert got(ranked_search.rank_documents(docs, items)) == brute(rows(docs, "doc_id", "text"), rows(items, "item_id", "text"))


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    assert got(ranked_search.rank_documents(empty, items)) == []
    assert got(ranked_search.rank_documents(odd, items.limit(0))) == []


def test_common_words_do_not_keep_accumulators(spark):
    """An owner's stage drops what cannot win: few documents travel on when one has a rare word."""
    import pyarrow as pa

    n = 5000
    items = pa.table({"bundle": [0], "block": [0], "item_id": [1], "terms": [[1, 2]], "owners": [[0, 1]], "tops": [[10**9, 5]], "docs": [[]], "orders": [[]],
                      "scores": [[]]}, schema=pa.schema([("bundle", pa.int32()), ("block", pa.int32()), ("item_id", pa.int64()), ("terms", pa.list_(pa.int64())),
                                                         ("owners", pa.list_(pa.int32())), ("tops", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
                                                         ("orders", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))]))
    postings = pa.table({"row": range(n), "ord": range(n), "term_no": [1] * n, "gain": [10**6 if i < 20 else 3 for i in range(n)]})
    kept = ranked_search._stage(0, 10)(items, postings)
    assert kept.column("docs").to_pylist() == [list(range(20))]  # ties with the 10th best stay until the last stage
    final = ranked_search._stage(1, 10)(kept, pa.table({"row": range(n), "ord": range(n), "term_no": [2] * n, "gain": [5 if i % 2 else 4 for i in range(n)]}))
    assert final.column("docs").to_pylist() == [[1, 3, 5, 7, 9, 11, 13, 15, 17, 19]]
