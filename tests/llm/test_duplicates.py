"""Near duplicates, components and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fianchetto.llm import decontam, near_dedup
from fianchetto.llm.components import components
from tests.llm.conftest import ODD


def brute_components(docs, percent, size):
    sets = {}
    for i, text in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_near_duplicates(spark, monkeypatch, percent, size):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # the cells of a large group, too
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    for words, n, edits in ((60, 80, 8), (300, 40, 25), (20, 30, 2), (1500, 10, 90)):
        base = [f"w{rng.randrange(200)}" for _ in range(words)]
        texts += variants(rng, base, n, edits)
    texts += [texts[160]] * 20 + ["A B c", "a b C", "a b", "a  b ", "a", None, "", " \n"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, percent, size).collect()}
    want = brute_components(docs, percent, size)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_odd(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.component_id, r.kept) for r in by[None]] == [(None, True)]
    assert {(r.component_id, r.kept) for r in by[5]} == {(5, True)} and len(by[5]) == 2
    assert by[15][0].component_id == 14 and not by[15][0].kept
    assert all(by[i][0].component_id == i and by[i][0].n_shingles == 0 for i in (1, 2, 7, 13))
    assert near_dedup.near_duplicates(empty).collect() == []


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(6)
    bases = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(4)]
    texts = [t for b in bases for t in variants(rng, b, 12, 4)]
    rows = [(7 if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(7, texts[5]), (7, texts[5]), (None, texts[5])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    plain = brute_components([(i, t) for i, (d, t) in enumerate(rows) if d is not None], 85, 3)
    least = {}
    for i, (_, root) in plain.items():
        least[root] = min(least.get(root, 10**9), rows[i][0])
    want = [(rows[i][0], n, least[root]) for i, (n, root) in plain.items()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(want)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_outsiders_of_a_pivot_find_their_links(spark, monkeypatch):
    """A chain: neighbours are linked, others are not, and a large group near its threshold."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(9)
    chain = [[f"c{i + k}" for k in range(100)] for i in range(0, 120, 6)]
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(c) for c in chain] + variants(rng, base, 90, 9)
    docs = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: root for i, (_, root) in brute_components(docs, 85, 3).items()}


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85, 0.95):
        union = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
        common = int(len(union) * share)
        rest = (len(union) - common) // 2
        a, b = np.sort(union[rng.permutation(len(union))[: common + rest]]), None
        take = rng.permutation(len(union))
        a, b = np.sort(union[take[: common + rest]]), np.sort(np.r_[union[take[:common]], union[take[common + rest :]]])
        s = near_dedup.sketches([a, b])
        j, used = near_dedup.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))
        assert used[0] == near_dedup.REGISTERS and abs(j[0] - share) < 0.12


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_one_of_few_bands(percent):
    """Sets of n shingles send n * (100 - percent) / percent + 1 bands a size class, and linked ones still share a key; texts
    that have but a common line in common hardly meet."""
    rng = np.random.default_rng(percent)

    def keys(sets):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                            pa.array([r.tobytes() for r in near_dedup.sketches(sets)], pa.binary())], names=["doc_id", "n", "registers"])
        out = [set() for _ in sets]
        for b in near_dedup._band_rows(percent)(iter([batch])):
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[i].add(k)
        return out

    def fresh(n):
        return rng.integers(0, 2**64, n, np.uint64)

    for n in (4, 5, 9, 20, 60, 100, 180, 204, 205, 230, 256, 300):
        left_out = [k for k in range(n) if 100 * (n - k) >= percent * n]
        for _ in range(20):
            base, k = fresh(n), left_out[-1]
            a = np.sort(base)
            shorter = np.sort(rng.permutation(base)[k:])  # as far from it as a link allows
            swaps = max(j for j in range(n) if 100 * (n - j) >= percent * (n + j))
            changed = np.sort(np.r_[rng.permutation(base)[swaps:], fresh(swaps)])
            x, y, z = keys([a, shorter, changed])
            assert x & y and x & z
            for s, found in ((a, x), (shorter, y), (changed, z)):
                if len(s) < near_dedup.SPARSE * percent // 100:
                    assert len(found) <= 2 * (len(s) * (100 - percent) // percent + 1)
    line = fresh(8)
    for_line = keys([np.sort(np.r_[line, fresh(60)]) for _ in range(200)])
    assert np.mean([sum(bool(x & y) for y in for_line) - 1 for x in for_line]) < 30  # with all bands over 60 of 199


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (13, 12), (20, 20), (None, 4), (30, 31), (31, 30), *[(100 + i, 101 + i) for i in range(60)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 30: 30, 31: 30, **{100 + i: 100 for i in range(61)}}
    assert got == want


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    used_d, used_i, words, tiles = [False] * len(doc), [False] * len(item), 0, 0
    while True:
        best = (0, 0, 0)
        for x in range(len(item)):
            for y in range(len(doc)):
                k = 0
                while x + k < len(item) and y + k < len(doc) and item[x + k] == doc[y + k] and not used_i[x + k] and not used_d[y + k]:
                    k += 1
                if k > best[0]:
                    best = (k, x, y)
        n, x, y = best
        if n < least:
            return words, tiles
        used_i[x : x + n] = [True] * n
        used_d[y : y + n] = [True] * n
        words, tiles = words + n, tiles + 1


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def test_tiling_equals_its_definition(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(3, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two three four")]
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(25)]
    parts = words(items[5][1])
    docs.append((100, " ".join([*parts[len(parts) // 2 :], "XX", *parts[: len(parts) // 2]])))  # reordered
    docs += [(101, None), (102, "one two three four")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, coverage int")
    got = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench, coverage=0.3).collect()
    want = []
    for d, t in docs:
        for i, x in items:
            w, n = brute_tiles(words(t), words(x), 5)
            if w and w >= 0.3 * len(words(x)):
                want.append((d, i, len(words(x)), w, n))
    assert sorted((r.doc_id, r.item_id, r.item_words, r.matched_words, r.tiles) for r in got) == sorted(want)


def test_contaminated_documents_go(spark, odd, empty, monkeypatch):
    item = "the lazy dog near the river bank today"
    bench = spark.createDataFrame([(1, "THE LAZY, dog: near the river bank today!"), (2, "nothing of this occurs anywhere at all here"), (3, None)], "item_id long, text string")
    for together in (decontam.ITEM_PARTS, 1):  # a document's items in many rows, in one
        monkeypatch.setattr(decontam, "ITEM_PARTS", together)
        assert [(r.doc_id, r.item_id, r.coverage) for r in decontam.find_contamination(odd, bench).collect()] == [(3, 1, 1.0)]
        left = decontam.drop_contaminated(odd, bench)
        assert left.columns == odd.columns and left.count() == len(ODD) - 1 and left.where("doc_id = 3").count() == 0
    swapped = spark.createDataFrame([(1, " ".join(item.split()[4:] + ["so"] + item.split()[:4]))], "doc_id long, text string")
    assert decontam.find_contamination(swapped, bench).count() == 0  # runs of four words are too short
    assert decontam.find_contamination(empty, bench).collect() == []
    assert decontam.find_contamination(odd, bench.limit(0)).collect() == []
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)


def test_repeats_are_tiled_by_the_definition(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        doc, item = (rng.integers(1, rng.integers(2, 4), rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        want = brute_tiles(doc.tolist(), item.tolist(), 3)
        seeds = [decontam._seeds(x, np.array([0, len(x)]), 3) for x in (doc, item)]
        for listed in (1 << 20, 0):
            monkeypatch.setattr(decontam, "LISTED_PLACES", listed)
            assert decontam.tile_pair(doc, seeds[0], item, seeds[1], 3) == want


def test_a_long_text_of_one_word_and_many_items(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(3000)] + [(9000, "echo " * 400), (9001, "echo " * 40 + "end of it")]
    docs = [(1, "echo " * 100_000), (2, "echo " * 30 + "so"), (3, " ".join(t for _, t in items[:200])), (4, items[7][1].upper()), (5, "w1x1 w1x2")]
    got = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    by = {d: sorted(r.item_id for r in got if r.doc_id == d) for d in range(1, 6)}
    assert by == {1: [9000, 9001], 2: [9001], 3: list(range(200)), 4: [7], 5: []}
    assert [(r.matched_words, r.tiles) for r in got if (r.doc_id, r.item_id) == (1, 9000)] == [(400, 1)]


def test_words_part_at_every_sign(spark):
    bench = spark.createDataFrame([(1, "the river's bank, a lazy dog and a fox"), (2, "größe über alle häuser hinaus")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see: “the\u00a0river’s bank”—a\u2009lazy dog…and a\u3000fox"), (2, "„GRÖSSE“ größe–über alle häuser\u00a0hinaus!")], "doc_id long, text string")
    got = decontam.find_contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words, r.matched_words) for r in got) == [(1, 1, 10, 10), (2, 2, 5, 5)]
