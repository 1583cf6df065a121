"""Long texts over several runs, nulls, repeated rows and clashing columns, in every operator."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from loomspan.llm import decontaminate, lm, pii, quality, simhash, substring, toxicity
from loomspan.llm import sentencepiece_scan as sp
from loomspan.llm import token_file as tf
from loomspan.llm.piece_model import PieceModel
from loomspan.llm.textops import CHUNK
from loomspan.session import scratch

LONG = " ".join(f"word{i % 9973} and no {i % 31}" for i in range(40_000)) + " Mr Quill Baxter"
LEAK = "one leaked sentence of the benchmark that stands at the very end of a giant text"
ROWS = [(1, LONG + " " + LEAK), (2, None), (3, ""), (4, "a short text of ten words or so, with Mr Quill Baxter"), (4, "a short text of ten words or so, with Mr Quill Baxter"), (None, LONG + " " + LEAK)]
EXTRA = ", _row int, _tries int, row string, batch int, fp int, key string, h int, name int, kept int"


@pytest.fixture(scope="module")
def odd(spark):
    assert len(LONG.encode()) > CHUNK
    return spark.createDataFrame([(*r, 1, 2, "r", 3, 4, "k", 5, 6, 7) for r in ROWS], "doc_id long, text string" + EXTRA)


def by_key(rows):
    return sorted(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id)


def test_scores_and_rules(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (4, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = by_key(toxicity.score(odd, toxicity.fit(odd, labels)).collect())
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score and got[4].score == got[5].score
    got = by_key(quality.quality_rules(odd, labels).collect())
    assert [r.n_words for r in got] == [len((t or "").split()) for _, t in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])]
    assert quality.fit(quality.stats(odd.where("1 = 0")), labels) == []
    got = by_key(lm.score(odd).collect())
    assert [r.n_tokens for r in got] == [len((t or "").split()) + 1 for _, t in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])] and got[0].base_score == got[1].base_score


def test_ids(spark, odd):
    out, path = scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    tf.write_tokens(odd, out, path)
    t = Tokenizer.from_file(path)
    want = {x: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for x in {t for _, t in ROWS}}
    assert [r.ids_crc32 for r in by_key(tf.read_tokens(spark, out).collect())] == [want[x] for _, x in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])]
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    m = PieceModel(pieces, True)
    got = by_key(sp.encode_summary(odd, pieces, byte_pair_as_unigram=True).collect())
    assert [r.text_crc32 for r in got] == [zlib.crc32((x or "").encode()) for _, x in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0])]
    assert np.array(got[1].ids, "<u4").tobytes() == m.encode(ROWS[0][1])


def test_copies(odd):
    got = by_key(simhash.near_duplicates(odd).collect())
    assert [r.component_id for r in got] == [1, 1, 2, 2, 4, 4] and got[2].fingerprint == "0" * 16
    words = ROWS[0][1].lower().split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], "<u8")
    ones = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    assert int(got[0].fingerprint, 16) == int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")
    got = by_key(substring.dedup_substrings(odd).collect())
    size = len(ROWS[0][1].encode())
    assert (got[0].n_removed, got[0].n_bytes) == (0, size) or got[0].n_removed > 0
    assert got[1].n_removed == size and got[2].n_bytes == got[3].n_bytes == 0
    with pytest.raises(ValueError, match="whole numbers"):
        substring.dedup_substrings(odd.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_private_and_leaked(spark, odd):
    got = by_key(pii.anonymize(odd, "k").collect())
    assert set(got[0].asDict()) == set(odd.columns) | {"n_entities"} and (got[0]._row, got[0]._tries, got[0].row) == (1, 2, "r")
    assert [r.n_entities for r in got] == [1, 1, 0, 0, 1, 1] and got[0].text == got[1].text and "Baxter" not in got[0].text and got[2].text is None
    bench = spark.createDataFrame([(9, LEAK), (9, LEAK), (None, "x y z w v u"), (8, None)], "item_id long, text string")
    got = by_key(decontaminate.decontaminate(odd, bench).collect())
    assert [r.leaked_items for r in got] == [[9], [9], [], [], [], []] and got[0]._row == 1 and got[0].kept == 7
