import random
import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomspan.llm import sentencepiece_scan as sp
from loomspan.llm import token_file as tf
from loomspan.llm.piece_model import PieceModel
from loomspan.session import scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a  b", " a\n b", "x\t y\n\nz ", "<|endoftext|> a <|endoftext|>b\n", "it's we'll\n's, don.", "\n", "a \n b", "12 3a!? ..\n.", "a\0 b", "é　x  y", "a\x1c b \x85 c", "漢字 word, wörd. W.,", ""]


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(bits, ids):
    x = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    assert (tf.unpack(tf.pack(x, bits), bits, len(x)) == x).all()
    assert len(tf.pack(x, bits)) == -(-len(x) * bits // 8)


def test_image_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 5, 9000, 1, 4096)]
    for bits in (16, 17):
        x = tf.Image(tf.image([3, None, 4, 5, 6], docs, bits, 7))
        assert x.doc_ids == [3, None, 4, 5, 6] and x.first == 7
        assert all((x.document(k) == d).all() for k, d in enumerate(docs))
        assert (x.slice(4000, 4200) == np.concatenate(docs)[4000:4200]).all()


def test_word_cache_equals_the_library(corpus):
    t, c = Tokenizer.from_file(BPE), tf.WordCache(BPE, limit=50)
    texts = TEXTS + [x or "" for _, x in corpus]
    for _ in range(2):  # the second time from the cache
        for got, text in zip(c.encode(texts), texts, strict=True):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_file_round_trip(spark, docs, corpus, empty):
    t = Tokenizer.from_file(BPE)
    path = scratch(spark, "t")
    tf.write_tokens(docs, path, BPE, parts=3, ids_a_file=500)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tf.read_tokens(spark, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for k, x in sorted(corpus, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((-1 if k is None else k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = scratch(spark, "t")
    tf.write_tokens(empty, path, BPE, parts=2)
    assert tf.read_tokens(spark, path).count() == 0


@pytest.fixture(scope="module")
def library():
    """The library with the same pieces and scores as a unigram model."""
    m = PieceModel(PIECES, True)

    def varint(x):
        out = b""
        while True:
            x, c = x >> 7, x & 127
            out += bytes([c | (128 if x else 0)])
            if not x:
                return out

    field = lambda n, raw: varint(n << 3 | 2) + varint(len(raw)) + raw
    flag = lambda n, v: varint(n << 3) + varint(v)
    raw = b"".join(field(1, field(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", m.scores.get(i, 0) / 64) + flag(3, k)) for i, (t, _, k) in enumerate(m.pieces))
    raw += field(2, flag(3, 1) + flag(35, 1)) + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))
    return m, SentencePieceProcessor(model_proto=raw)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pieces_equal_the_library(library, corpus):
    m, lib = library
    for text in TEXTS + [x or "" for _, x in corpus]:
        if text and "\0" not in text:
            got = ids_of(m.encode(text))
            assert got == lib.encode(text), text
            assert m.decode(got) == lib.decode(got) == text


def test_scan_equals_one_pass(library):
    m, _ = library
    rng = random.Random(2)
    for _ in range(120):
        text = "".join(rng.choice(["a", "th", "e", " ", "  ", "\n", "é", "漢", "ing", "😀", "\t"]) for _ in range(rng.randint(0, 160)))
        text = text.replace(" ", "") if rng.random() < 0.3 else text
        want = ids_of(m.encode(text))
        for chunk in (1, 7, 16, 45):
            assert ids_of(sp.scan_encode(m, text, chunk)) == want


def test_matrices_are_associative(library):
    m, _ = library
    a, b, c = (sp.transfer(m, s, 9) for s in ("▁the▁quick▁brown▁fox", "ingthingtheerstation", "▁a▁b▁cd▁ef▁gh▁ij▁kl"))
    assert (sp.product(sp.product(a, b), c) == sp.product(a, sp.product(b, c))).all()


def test_distributed_encode(spark, docs, corpus, library, empty):
    m, _ = library
    got = sorted((-1 if r.doc_id is None else r.doc_id, ids_of(r.ids)) for r in sp.encode(docs, PIECES, chunk=64, byte_pair_as_unigram=True).collect())
    assert got == sorted((-1 if k is None else k, ids_of(m.encode(t or ""))) for k, t in corpus)
    assert sp.encode(empty, PIECES, byte_pair_as_unigram=True).count() == 0
    back = {(r.doc_id, r.text) for r in sp.decode(sp.encode(docs.where("doc_id < 60"), PIECES, byte_pair_as_unigram=True), PIECES, byte_pair_as_unigram=True).collect()}
    assert back == {(k, t) for k, t in corpus if k is not None and k < 60}


def test_other_patterns_encode_whole_texts(spark, docs, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert not tf.cuts_hold(path) and tf.cuts_hold(public_tokenizers.path("byte_bpe_50k.json"))
    t, out = Tokenizer.from_file(path), scratch(spark, "tokens")
    tf.write_tokens(docs, out, path)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in tf.read_tokens(spark, out).collect())
    want = [(-1 if k is None else k, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for k, x in corpus]
    assert got == sorted(want)


def test_byte_pair_file_is_refused_unless_asked_for(docs):
    with pytest.raises(ValueError, match="byte-pair"):
        sp.encode(docs, PIECES)
    whole = {(r.doc_id, r.n_pieces, r.text_crc32) for r in sp.encode_summary(docs, PIECES, chunk=64, byte_pair_as_unigram=True).collect()}
    apart = sp.summary(sp.encode(docs, PIECES, byte_pair_as_unigram=True), PIECES, byte_pair_as_unigram=True)
    assert whole == {(r.doc_id, r.n_pieces, r.text_crc32) for r in apart.collect()}
