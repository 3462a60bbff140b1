import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from omenlog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(path=PATH):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


LIBRARY, ENCODER = library(), bpe.Encoder(PATH)
PARTS = ["a", "B", " ", "\n", "\t", "\r\n", "\u0301", "é", "İ", "'s", "'re", "7", "<|endoftext|>", "<|startof", "漢", "\u3000", "!!",
         "\x0b", "\x85", "ﬁ", "Σ", "😀", "\u1100", "\u1161", "the ", "over ", "tion"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.lists(st.sampled_from(PARTS), max_size=200).map("".join)), max_size=8))
def test_ids_and_decoding_are_the_librarys(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = ENCODER.encode([t.encode() for t in texts])
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in want]
    assert ENCODER.decode(ids) == [LIBRARY.decode(e.ids, skip_special_tokens=False) for e in want]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts(name):
    path = public_tokenizers.path(name)
    draw = np.random.default_rng(2)
    texts = ["".join(draw.choice(PARTS, n)) for n in (3000, 20_000, 60_000)] + ["x" * 5000, " " * 5000, "ab " * 9000]
    ids = bpe.Encoder(path).encode([t.encode() for t in texts])
    want = library(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in want]


def test_chunks_follow_content(monkeypatch):
    draw = np.random.default_rng(3)
    passage = bytes(draw.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = (bpe.chunks(bytes(draw.integers(97, 123, n, dtype=np.uint8)) + passage) for n in (1000, 1777))
    assert len(set(a) & set(b)) > 0.8 * len(bpe.chunks(passage))
    assert all(bpe.LEAST <= len(c) <= bpe.MOST for c in a[:-1]) and len(a[-1]) <= bpe.MOST
    whole = bpe.cuts(passage)
    monkeypatch.setattr(bpe, "STRIP", 999)
    assert bpe.cuts(passage) == whole
    assert bpe.cuts(b"") == [] and b"".join(bpe.chunks(b"a" * 5000)) == b"a" * 5000


def test_memory_of_words_and_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    encoder, draw = bpe.Encoder(PATH), np.random.default_rng(4)
    for _ in range(6):
        texts = [" ".join(map(str, draw.integers(0, 10**6, 400))) for _ in range(3)]
        ids = encoder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def documents():
    draw = np.random.default_rng(5)
    shared = " ".join(draw.choice(["stone", "river", "cloud", "meadow"], 400))
    rows = [(i, " ".join(draw.choice(["one", "Two", "three"], 50)) + " " + shared) for i in range(30)]
    return rows + [(None, "no id"), (31, None), (32, ""), (33, " \n"), (1, rows[1][1]), (34, "word " * 30_000), (35, "<|endoftext|> é e\u0301")]


def test_digests(spark):
    rows = documents()
    table = spark.createDataFrame([(*r, b"x", 1.5) for r in rows], "doc_id long, text string, ids binary, extra double")
    encoded = bpe.encode(table, PATH)
    assert encoded.columns == ["doc_id", "extra", "ids", "decoded"]
    got = sorted(map(tuple, bpe.digests(encoded).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode(table.limit(0), PATH).count() == 0


def test_dictionary_holds_what_documents_share(spark):
    rows = documents()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    shared = bpe.dictionary(table, PATH)
    assert shared
    for core, ids in shared.items():
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(core.decode(), add_special_tokens=False).ids
        assert sum(core in (t or "").encode() for _, t in rows) > 1
    assert len(bpe.dictionary(table, PATH, entries=2)) <= 2
