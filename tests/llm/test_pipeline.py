"""The pipeline's stages against brute force on the smallest tables."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, written and read again as the next one's input."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][0].__fields__ == corpus_pipeline.COLUMNS


def test_toxicity_only_drops_rows(spark, stages):
    scores = {r.doc_id: r.predicted for r in __spark_entry__.queries()["op9_toxicity"](spark, SF).collect()}
    assert sorted(map(str, stages["toxicity"])) == sorted(str(r) for r in stages["documents"] if not scores[r.doc_id])


def test_one_document_of_each_group_stays(stages):
    before = stages["toxicity"]
    named = {d: c for d, _, c in classes([tuple(r) for r in before])}
    assert sorted(map(str, stages["ngram_jaccard_join"])) == sorted(str(r) for r in before if named[r.doc_id] == r.doc_id)


def test_repeated_passages_go(stages):
    before, after = stages["ngram_jaccard_join"], {r.doc_id: r for r in stages["substring_dedup"]}
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        w = (r.text or "").encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), r.doc_id)
    assert len(after) == len(before)
    for r in before:
        w = (r.text or "").encode().split()
        gone = {i for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for i in range(k, k + 13)}
        assert (after[r.doc_id].text or "").encode().split() == [x for i, x in enumerate(w) if i not in gone]
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_mix_and_packing(stages):
    before = {r.doc_id: r for r in stages["substring_dedup"]}
    copies = Counter(r.doc_id for r in stages["mixing"])
    assert max(copies.values()) <= 3 and all(r.text == before[r.doc_id].text for r in stages["mixing"])
    size = {i: len((r.text or "").encode().split()) for i, r in before.items()}
    total, taken = sum(size.values()), sum(size[i] * n for i, n in copies.items())
    assert abs(taken - 1.5 * total) <= sum(max(size[i] for i in before if before[i].source == s) for s in {r.source for r in before.values()})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages["mixing"]:
        ids = np.asarray([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[(r.doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in stages["best_fit_packing"]) == want
    filled = Counter()
    for r in stages["best_fit_packing"]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096
    assert len(filled) - -(-sum(filled.values()) // 4096) <= 1


def test_run_gives_the_last_stage(spark, stages):
    got = Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter(tuple(r)[:5] for r in stages["best_fit_packing"])
