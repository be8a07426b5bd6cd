"""Collocations against counting every phrase in plain Python, and the shards' index against slicing."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fianchetto.llm import collocations
from fianchetto.llm.queries import op13_collocations
from tests.conftest import SMALL
from tests.llm.conftest import LONG

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=2000, share=50):
    """docs: (lang, text) rows."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if any(100 * b >= share * a for p, b in f.items() if len(p) == 3 > len(phrase) and b >= least and phrase in (p[:2], p[1:])):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


def rows(df):
    return [tuple(r) for r in df.select("lang", "text").collect()]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_intervals_are_the_counts_of_slices():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = rng.integers(0, rng.integers(2, 9), rng.integers(1, 80))
        for depth in (2, 3, 4):
            found = {tuple(p): c for f, count in collocations.phrases(text, depth) for p, c in zip(f.tolist(), count.tolist(), strict=True)}
            slices = Counter(tuple(text[i : i + k].tolist()) for k in range(2, depth + 1) for i in range(len(text) - k + 1) if (text[i : i + k] > 0).all())
            assert found == slices


def test_texts_are_cut_between_pieces_only():
    text = b"one two\nthree four five six seven\n\neight"
    assert b"\n".join(collocations.cuts(text, 8)) == text
    assert all(len(part) <= 8 or b"\n" not in part for part in collocations.cuts(text, 8))


@pytest.mark.parametrize("shard_bytes", [8 << 20, 5000])
def test_phrases_equal_counting_all(spark, shard_bytes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    query = op13_collocations(spark, SMALL) if shard_bytes > 5000 else collocations.mine_collocations(docs, shard_bytes=shard_bytes)
    assert got(query) == brute(rows(docs))


def test_odd_rows_hot_language_and_an_empty_table(spark, odd, empty):
    assert got(collocations.mine_collocations(odd, shard_bytes=1000)) == brute(rows(odd))
    assert got(collocations.mine_collocations(empty)) == []
    more = [(None, "The sun rose. the SUN set! a\x1fb c\x00d a\x1fb c\x00d"), ("", "ÄPFEL und Birnen"), ("en", LONG), ("en", None), ("fr", ""),
            ("en", "a a a a a a a a a a a a a a"), ("en", "x\ty z x\ty z"), ("de", "new york city;new york city,new york")]
    docs = spark.createDataFrame(more * 12 + [("en", "copy of one line\n" * 40)] * 30, "lang string, text string").withColumns(
        {c: F.lit("clash") for c in ("n", "words", "ids", "shard", "id", "f")}).repartition(5)
    assert got(collocations.mine_collocations(docs, shard_bytes=3000)) == brute(rows(docs))
    assert got(collocations.mine_collocations(docs, least=2, top=3, share=90)) == brute(rows(docs), least=2, top=3, share=90)


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_007_199_254_740_997
    got = spark.sql(f"SELECT {a}L AS a, {left}L AS l, {right}L AS r").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffles of one step are gone before the next one writes its own."""
    import os
    import time

    from fianchetto.llm.common import SHUFFLE_CLEANUP, materialize

    local = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for top in local for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP, None)
    table = materialize(spark.range(50_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count(), "no-shuffles")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert table.count() == 100
