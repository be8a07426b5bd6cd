"""Toxicity, quality and personal data: held-out accuracy, brute force, awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fianchetto.llm import pii, quality, toxicity
from tests.conftest import SMALL
from tests.llm.conftest import ODD

SYLLABLES = "ba ko ti ra shen lo mu ver ga pol dri na".split()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(spark, bad, n=600):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        label = int(rng.random() < 0.3)
        docs.append((i, bad(rng, words) if label else " ".join(words)))
        labels.append((i, label, "x"))
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4), docs,
            spark.createDataFrame([*labels, (None, 1, "x"), (5, None, "x"), (10**9, 1, "x")], "doc_id long, y int, text string"), {i: y for i, y, _ in labels})


def insulting(rng, words):
    for _ in range(2):
        words.insert(rng.randrange(len(words)), rng.choice(["stupid", "moron", "idiot"]))
    return " ".join(words)


def shouting(rng, words):
    return " ".join(w.upper() + "!!" for w in words)


@pytest.mark.parametrize(("run", "bad"), [(toxicity.classify_toxicity, insulting), (quality.classify_quality, shouting)])
def test_held_out_accuracy(spark, run, bad):
    df, docs, labels, truth = corpus(spark, bad)
    got = run(df, labels, 0.5, "y").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 80 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)


@pytest.mark.parametrize("run", [toxicity.classify_toxicity, quality.classify_quality])
def test_odd_rows(spark, odd, empty, run):
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(1, 16)] + [(3, 0, "z"), (3, 1, "z")], "doc_id long, y int, score string")
    got = run(odd, labels, 0.5, "y").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in got)) == sorted((i is not None, i or 0) for i, *_ in ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 13)}) == 1  # null texts count as empty
    assert {r.score for r in run(odd, labels.limit(0), 0.5, "y").collect()} == {0.5}
    assert len({round(r.score) for r in run(odd, labels.where("y = 1"), 0.5, "y").collect()}) == 1
    assert run(empty, labels, 0.5, "y").collect() == []


def test_labels_beyond_the_bound_are_sampled(spark):
    from fianchetto.llm.labelled import labelled_sample

    df, _, labels, _ = corpus(spark, insulting)
    assert 0 < labelled_sample(df, labels, "y", 100).count() < 180
    assert all(r.fold for r in labelled_sample(df, labels, "y").collect())


def test_isotonic():
    got = quality.isotonic(np.array([0, 3, 1, 0, 4]), np.array([2, 4, 4, 0, 4]))
    assert np.allclose(got, [0, 0.5, 0.5, 0.5, 1]) or np.allclose(got, [0, 0.5, 0.5, 1, 1])
    assert (np.diff(got) >= 0).all()


def base_spans(text):
    """The contract's spans, from its own patterns."""
    out = []
    for kind, rx in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                     ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            if (kind == "email" or (kind == "ip" and max(map(int, m.group().split("."))) <= 255)
                    or (kind == "card" and 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0)
                    or (kind == "phone" and 9 <= len(digits) <= 15)):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_pii(docs, got):
    key = lambda i: (i is not None, i or 0)
    found = [(i, base_spans(t)) for i, t in docs]
    want = sorted((key(i), hashlib.sha256(",".join(b).encode()).hexdigest(), [sum(s.startswith(k) for s in b) for k in pii.KINDS]) for i, b in found)
    assert sorted((key(r.doc_id), r.base_sha256, [r.n_email, r.n_ip, r.n_card, r.n_phone]) for r in got) == want


def test_base_spans(spark):
    rng = random.Random(6)
    alphabet = ["a", "@", ".", "-", "_", "1", "22", "333", "4111111111111111", " ", " ", "+1", "(", ")", "x.org", "🙂", "é", "\n", "4242 4242 4242 4242", "10.0.0.1", "256", "%"]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    docs += [(2000, "a" * 3000 + "@" + "b." * 3000 + "c"), (2001, "1" * 9000), (2002, "1." * 3000), (2003, "+" + "1 " * 5000), (2004, "x_" * 2000)]
    check_pii(docs, pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())


def test_pii_odd(odd, empty):
    check_pii([(i, t) for i, t, *_ in ODD], got := pii.find_pii(odd).collect())
    assert all(set(filter(None, base_spans(dict((i, t) for i, t, *_ in ODD)[r.doc_id]))) <= set(r.spans.split(",")) for r in got)
    assert pii.find_pii(empty).collect() == []
    assert pii.redact(empty).collect() == []


def test_further_spans_and_redaction(spark):
    rng = random.Random(8)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    docs = [(i, f"please call +1 {number()} soon", 0) for i in range(200)] + [(500 + i, f"there are {rng.randint(1, 99)} birds, {rng.randint(100, 999)} trees", 0) for i in range(100)]
    docs += [(900, "please call (212) 555-0199 soon", 0), (901, "🙂 write me@example.org or 10.0.0.1, or +1 (212) 555-0199 10.0.0.2 now", 0), (902, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert spans[900] == "phone:12:26"  # no country code: the trees know the format and its surroundings
    assert spans[500] == ""
    done = {r.doc_id: r for r in pii.redact(df).collect()}
    assert done[900].text == "please call [phone] soon" and done[900].n_chars == len(done[900].text)
    assert done[901].text == "🙂 write [email] or [ip], or +1 [phone] [ip] now"
    assert done[902].text is None
    assert done[500].text == dict((i, t) for i, t, _ in docs)[500]


def test_further_spans_where_many_numbers_are_national(spark):
    rng = random.Random(10)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    docs = [(i, f"please call +1 {number()} soon") for i in range(200)] + [(1000 + i, f"please call {number()} soon") for i in range(160)]
    docs += [(2000 + i, f"please find licence {number()} here") for i in range(100)]  # of the same format
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[1000 + i] for i in range(160)} == {"phone:12:26"}
    assert {got[2000 + i] for i in range(100)} == {""}


def test_rare_false_candidates_stay_out(spark):
    rng = random.Random(11)
    part = lambda: rng.randint(0, 255)
    docs = [(i, f"from {part()}.{part()}.{part()}.{part()} on") for i in range(400)]
    docs += [(1000 + i, f"from {300 + i}.{part()}.{part()}.{part()} on") for i in range(8)]  # no addresses
    docs += [(2000 + i, f"from {part()}[.]{part()}[.]{part()}[.]{part()} on") for i in range(8)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[1000 + i] for i in range(8)} == {""}
    assert all(got[2000 + i] == f"ip:5:{len(docs[408 + i][1]) - 3}" for i in range(8))


def test_small_inputs_go_the_same_way(spark):
    rng = random.Random(12)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    few = [(1000 + i, f"please call {number()} soon") for i in range(3)] + [(2000, "from 300.1.2.3 on")]
    docs = [(i, f"please call +1 {number()} soon") for i in range(20)] + few  # fewer than 20 held-out candidates
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 2000)] == ["phone:12:26"] * 3 + [""]
    assert pii.find_pii(spark.createDataFrame(few, "doc_id long, text string")).where("spans <> ''").count() == 0  # nothing to learn from


def test_least_score():
    assert pii.least_score([(0.9, 95, 5), (0.5, 100, 0), (0.01, 0, 1)], 0.95) == 0.5  # each score's own share counts
    assert pii.least_score([(0.9, 0, 0), (0.8, 20, 0), (0.1, 1, 19)], 0.95) == 0.8
    assert pii.least_score([(0.9, 1, 1)], 0.95) is None
    assert pii.least_score([], 0.95) is None


def test_small_tables_quality(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
