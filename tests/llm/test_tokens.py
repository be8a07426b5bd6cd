"""Token output, packing and counts against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from fianchetto.llm import packing, token_counts, token_planes
from fianchetto.llm.encoding import Encoder
from tests.llm.conftest import ODD

ALPHABET = " \n\t  \x1c\x85\xa0 ab'sZéß12.,<|>_-́Åİ日本ſ’٣²\0"


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))  # as it comes: strings of special tokens give their ids


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_equals_library(name, kind):
    rng = random.Random(0)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t or "" for _, t, *_ in ODD]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|endoftext|> ", " <|endoftext|>"]
    words = ["word", "Word.", "don't", "(well),", "a,b", "x!", "ÉTÉ;", "naïve?", "ſ.", "İ.", "日本.", "12.", "3,", "-", "…", ""]
    texts += [rng.choice([" ", "", "\n"]).join(rng.choices(special + words, k=rng.randint(1, 9))) for _ in range(2000)]
    texts += [rng.choice([" ", "\n", " \n"]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(3000)]
    t = tokenizer(name)
    for text, got in zip(texts, Encoder(public_tokenizers.path(name), kind).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_memo_changes_no_ids(monkeypatch):
    from fianchetto.llm import encoding

    texts = [f"word{i % 50} a{i} same, Same. b\nc{i % 7}; it's" for i in range(300)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Encoder(path, "byte").encode(texts)
    monkeypatch.setattr(encoding, "MEMO", 20)
    assert Encoder(path, "byte").encode(texts) == want


def held(enc):
    return sum(len(m) + len(m.older) for m in (enc.cut, enc.exact))


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_a_small_memo_equals_library(monkeypatch, name, kind):
    from fianchetto.llm import encoding

    rng = random.Random(1)
    words = ["word", "Word.", "don't", "(well),", "a,b", "x!", "x", "ÉTÉ;", "naïve?", "ſ.", "İ.", "日本.", "12.", "3,", "-", ".", "…", ""]
    texts = [rng.choice([" ", "\n", " \n", ""]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(2000)]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    monkeypatch.setattr(encoding, "SMALL_MEMO", 20)
    t, enc = tokenizer(name), Encoder(public_tokenizers.path(name), kind, small=True)
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_pipeline_packs_with_a_small_memo(monkeypatch):
    """What a worker holds stays small, however many different words there are; signs add nothing to it."""
    import pyarrow as pa

    import corpus_pipeline
    from fianchetto.llm import encoding

    asked = []
    monkeypatch.setattr(packing, "pack_documents", lambda docs, vocabulary, **more: asked.append((vocabulary, more)))
    corpus_pipeline.pack(None, None, None)
    (vocabulary, more), = asked
    monkeypatch.setattr(encoding, "_ENCODERS", {})
    monkeypatch.setattr(encoding, "SMALL_MEMO", 1000)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = [" ".join(f"{name(i)} {name(i)}. {name(i)}," for i in range(lo, lo + 100)) for lo in range(0, 20_000, 100)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    rows = [r for b in packing._pieces(vocabulary, "byte", 0, 2048, more.get("small_memo"))(iter(batches)) for r in b.to_pylist()]
    (enc,) = encoding._ENCODERS.values()
    assert held(enc) <= 2 * (1000 + 110)
    t = tokenizer("byte_bpe_50k.json")
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    sizes, payload = token_planes.pack_chunk(ids, planes, 3)
    assert len(sizes) == (32 if planes == "bit" else 4)
    assert (token_planes.unpack_chunk(payload, sizes, n) == ids).all()


def test_crc_of_joined_parts():
    a, b = b"some bytes", bytes(range(200))
    assert token_planes.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_planes.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_planes(spark, odd, planes):
    path = token_planes.write_token_planes(odd, public_tokenizers.path("word_bpe_49k.json"), planes=planes, chunk_ids=64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_planes.read_documents(spark, path).collect())
    t, start, all_ids = tokenizer("word_bpe_49k.json"), 0, []
    want = []
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        all_ids.append(ids)
    assert got == want
    assert (token_planes.read_ids(spark, path, 30, 200) == np.concatenate(all_ids)[30:230]).all()
    assert len(token_planes.read_ids(spark, path, start, 5)) == 0


def test_token_planes_empty(spark, empty):
    path = token_planes.write_token_planes(empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_planes.read_documents(spark, path).collect() == []


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert packing.best_fit([], 10) == []


def test_cut_lengths():
    assert packing.cut_lengths(5, 4) == [1, 4]
    assert packing.cut_lengths(8, 4) == [4, 4]
    assert packing.cut_lengths(4, 4) == [4]


def check_packed(rows, docs, capacity):
    t = tokenizer("byte_bpe_50k.json")
    want = []
    for doc_id, text, *_ in docs:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want.append((doc_id is not None, doc_id or 0, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[4] for w in want) // capacity)


def test_packing(odd):
    rows = packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    bins, least = check_packed(rows, ODD, 64)
    assert bins <= least + 2


def test_packing_merges_over_partitions(spark):
    docs = [(i, f"word{i % 7} " * (1 + i % 23), None, None, 0) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, a string, b string, n_chars long").repartition(40)
    bins, least = check_packed(packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=256).collect(), docs, 256)
    assert bins <= 1.05 * least + 1


def test_packing_empty(empty):
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def unigram(pieces, byte_fallback):
    least = min(s for _, s in pieces)
    extra = [(f"<0x{b:02X}>", least) for b in range(256)] if byte_fallback else []
    return Tokenizer(models.Unigram([("<unk>", least), *pieces, *extra], unk_id=0, byte_fallback=byte_fallback))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_follow_the_tie_rules(byte_fallback):
    rng = random.Random(3)
    pieces = {"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 5)) for _ in range(60)}
    counter, t = token_counts.Counter(list(pieces.items()), byte_fallback), unigram(list(pieces.items()), byte_fallback)
    for _ in range(2000):
        text = "".join(rng.choice("  abcdé🙂") for _ in range(rng.randint(1, 25)))
        assert counter.count(text)[0] == len(t.encode("▁" + text.replace(" ", "▁")).ids), repr(text)


def test_token_counts(odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    t = unigram(token_counts.load_pieces(path), True)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(odd, path).collect()))
    assert got == sorted((i is not None, i or 0, len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0) for i, x, *_ in ODD)


def test_token_counts_empty(empty):
    assert token_counts.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_merging_goes_on_while_little_merges(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    fills = [([60] * 99 + [45]) for _ in range(8)]  # only the eight of 45 go together, in pairs: far below 1% a round
    rows = [(n, False, (task << 32) | i, [(task * 100 + i, 0, 0, n, 0, 0)]) for task, own in enumerate(fills) for i, n in enumerate(own)]
    bins = packing.merge_bins(spark.createDataFrame(rows, packing.BIN_SCHEMA), 100).collect()
    assert sorted(m.doc_id for b in bins for m in b.members) == list(range(800))
    assert sum(b.fill == 90 for b in bins) == 4 and len(bins) == 796
