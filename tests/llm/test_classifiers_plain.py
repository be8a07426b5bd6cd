"""The classifiers against plain versions: the whole fit and score again, without Spark, by their definitions."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from fianchetto.llm import quality, toxicity
from tests.llm.test_classifiers import corpus, insulting, shouting


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def noisy(rng, words):
    """Mostly in capitals, so that statistics and labels do not agree everywhere."""
    return shouting(rng, words) if rng.random() < 0.8 else " ".join(words)


def test_quality_equals_a_plain_fit(spark):
    df, docs, labels, truth = corpus(spark, noisy)
    got = {r.doc_id: r.score for r in quality.classify_quality(df, labels, 0.3, "y").collect()}
    known = [(quality.statistics(t), truth[i], fold(i)) for i, t in docs if fold(i) != 0]
    stats, y, folds = (np.array(x, np.float64) for x in zip(*known, strict=True))
    mean, scale = stats.mean(axis=0), stats.std(axis=0)
    scale[scale == 0] = 1
    rng = np.random.default_rng(42)
    directions = rng.normal(size=(stats.shape[1], 256)) / 4.0
    shift = rng.uniform(0, 2 * np.pi, 256)

    def features(x):
        z = np.clip((x - mean) / scale, -8, 8)
        return np.hstack([math.sqrt(2 / 256) * np.cos(z @ directions + shift), np.ones((len(z), 1))])

    fit = folds != 1
    x = features(stats[fit])
    penalty = np.diag([1e-3 * fit.sum()] * 256 + [0.0])
    w = np.linalg.solve(x.T @ x + penalty, x.T @ y[fit])
    # isotonic fit over bins by its min-max formula
    s = features(stats[~fit]) @ w
    at = np.clip(((s + 0.5) * 200).astype(int), 0, 399)
    total, weight = np.bincount(at, y[~fit], 400), np.bincount(at, minlength=400)
    used = np.flatnonzero(weight)
    t, n = np.concatenate(([0], np.cumsum(total[used]))), np.concatenate(([0], np.cumsum(weight[used])))
    level = [max(min((t[b] - t[a]) / (n[b] - n[a]) for b in range(i + 1, len(used) + 1)) for a in range(i + 1)) for i in range(len(used))]
    for i, text in docs[:150]:
        r = float((features(np.array([quality.statistics(text)])) @ w)[0])
        k = int(np.clip((r + 0.5) * 200, 0, 399))
        below, above = used[used <= k], used[used >= k]
        low = level[len(below) - 1] if len(below) else level[0]
        high = level[len(used) - len(above)] if len(above) else level[-1]
        assert low - 1e-6 <= got[i] <= high + 1e-6 or abs(got[i] - low) < 0.05, (i, r, got[i], low, high)


def gram_hash(gram):
    h = len(gram)
    for c in gram:
        h = ((h + ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return ((h * 0x85EBCA77) & 0xFFFFFFFF) >> 12


def test_toxicity_equals_a_plain_fit(spark):
    df, docs, labels, truth = corpus(spark, lambda rng, words: insulting(rng, words) if rng.random() < 0.9 else " ".join(words), n=300)
    model = toxicity.fit_toxicity(df, labels, "y")
    grams = {i: {gram_hash(t.lower()[k : k + n]) for n in (3, 4, 5) for k in range(len(t) - n + 1)} for i, t in docs}
    rows = [i for i, _ in docs if fold(i) != 0]
    pos, neg = Counter(), Counter()
    for i in rows:
        (pos if truth[i] else neg).update(grams[i])
    n, toxic = len(rows), sum(truth[i] for i in rows)

    def ratio(g):
        return math.log(((pos[g] + 1) / (toxic + 2)) / ((neg[g] + 1) / (n - toxic + 2)))

    telling = {g: abs(ratio(g) / math.sqrt(1 / (pos[g] + 1) + 1 / (neg[g] + 1))) for g in {*pos, *neg} if pos[g] + neg[g] >= 4}
    kept = sorted(telling, key=lambda g: (-round(telling[g], 9), g))[:4096]
    assert len(set(kept) & set(model.grams.tolist())) >= 0.999 * len(kept) and len(kept) == len(model.grams)
    # logistic regression by Newton's method on the same features
    place = {g: k for k, g in enumerate(model.grams.tolist())}
    x = np.zeros((n, len(place) + 1))
    x[:, -1] = 1
    for r, i in enumerate(rows):
        for g in grams[i]:
            if g in place:
                x[r, place[g]] = ratio(g)
    y = np.array([truth[i] for i in rows], float)
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(len(place), 2e-4), 0.0]

    def loss(v):
        z = x @ v
        return (np.logaddexp(0, z) - y * z).mean() + (penalty * v * v).sum() / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / n + penalty * w
        d = p * (1 - p) / n + 1e-12
        # (X'DX + P)^-1 g by the matrix inversion lemma; the constant has a tiny penalty here
        inv = 1 / np.where(penalty > 0, penalty, 1e-9)
        a = np.diag(1 / d) + (x * inv) @ x.T
        step = inv * g - inv * (x.T @ np.linalg.solve(a, x @ (inv * g)))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-12:  # damped
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    # Spark's own steps end close to the least loss
    ratios = np.array([ratio(g) for g in model.grams.tolist()])
    learnt = np.r_[np.divide(model.weights, ratios, out=np.zeros(len(ratios)), where=ratios != 0), model.constant]
    assert loss(w) - 1e-9 <= loss(learnt) <= loss(w) + 0.02 < loss(np.zeros(len(w))) - 0.5, (loss(w), loss(learnt))
    got = {r.doc_id: r.score for r in toxicity.classify_toxicity(df, labels, 0.5, "y").collect()}
    # the score is the model's sum over the n-grams that are present, once each
    weight = dict(zip(model.grams.tolist(), model.weights.tolist(), strict=True))
    for i, _ in random.Random(1).sample(docs, 40):
        z = model.constant + sum(weight.get(g, 0.0) for g in grams[i])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
