"""The agenda against the sentencepiece library, on texts, parts of long texts and arbitrary ids."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushpage.llm import queries
from hushpage.llm.sentence_pieces import SPACE, Coder, WordIds, decode_ids, encode_texts, parts_of
from hushpage.llm.token_counts import LengthTable

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER, SMALL = Coder(PATH), Coder(PATH, part=7)
TEXT = st.text(st.one_of(st.sampled_from("ab the ing  \n\t\r▁\x00é中�<s>"), st.characters(codec="utf-8")), max_size=80)


def ids_of(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=500, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_and_texts_equal_the_library(texts):
    assert CODER.vocabulary.merge_all(texts) == [b"".join(i.to_bytes(4, "little") for i in CODER.vocabulary.merge(t)) for t in texts]
    for coder, check in ((CODER, "texts"), (CODER, "words"), (SMALL, "texts"), (SMALL, "words")):
        packed, same = coder.encode([*texts, None], check)
        assert [ids_of(p) for p in packed] == [LIBRARY.encode(t) + [2] for t in texts] + [[2]] and all(same)
        decoded, same = coder.decode(packed, True)
        assert decoded == [LIBRARY.decode(LIBRARY.encode(t) + [2]) for t in texts] + [""] and all(same)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 262), st.sampled_from([0, 1, 2, 259, 29871])), max_size=40))
def test_any_ids_decode_as_in_the_library(ids):
    assert CODER.vocabulary.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(["a", SPACE, "b"]), max_size=60), st.integers(1, 9))
def test_parts_start_with_words(text, size):
    parts = list(parts_of(text, size))
    assert "".join(parts) == text
    assert all(p.startswith(SPACE) for p in parts[1:]) and not any(p.endswith(SPACE) for p in parts[:-1])


def test_long_words_and_a_small_cache():
    r = random.Random(5)
    texts = ["x" * 30_000, "ab" * 9_000 + " " + " " * 5_000, "".join(r.choices("etaoin shrdlu\n", k=50_000))]
    coder = Coder(PATH)
    coder.words = WordIds(coder.vocabulary, bits=5)  # forgets again and again
    packed, same = coder.encode(texts, "words")
    assert all(same) and [ids_of(p) for p in packed] == [LIBRARY.encode(t) + [2] for t in texts]


def test_documents(spark):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, None), (2, ""), (3, "naïve ▁ 🦜\n\n<s> x")]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, ids int, decoded string")
    got = encode_texts(docs, PATH, decode=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded, r.agrees) for r in got) == sorted((str(i), LIBRARY.encode(t or "") + [2], LIBRARY.decode(LIBRARY.encode(t or "")), True) for i, t in rows)
    back = decode_ids(encode_texts(docs, PATH, check=None), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.decoded) for r in got)
    assert encode_texts(docs.limit(0), PATH).collect() == [] and decode_ids(docs.limit(0).select("doc_id", F.array("ids").alias("ids")), PATH).collect() == []


def test_null_lists_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [3, None]), (3, []), (4, [2, 15043])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in decode_ids(rows, PATH).collect()) == [(1, None), (2, None), (3, ""), (4, LIBRARY.decode([2, 15043]))]
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode_ids(spark.createDataFrame([(1, [32_000])], "doc_id long, ids array<int>"), PATH).collect()


def test_the_query_over_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        ids = LIBRARY.encode(d.text or "") + [2]
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), True)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256, got[d.doc_id].agrees) == want


def test_a_wrong_word_is_noticed():
    coder = Coder(PATH)
    coder.vocabulary.pairs = LengthTable(2)  # nothing merges
    for check in ("words", "texts"):
        assert coder.encode(["a the b", "\n", "the", None], check)[1] == [False, True, False, True]
