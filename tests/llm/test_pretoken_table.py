import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hushpage.llm.token_counts import chunk_hashes, frequent_table, token_counts

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTE)


def lengths(table, chunks):
    points = [np.frombuffer(c.encode("utf-32-le"), "<u4") for c in chunks]
    keys = np.concatenate([chunk_hashes(p, np.zeros(1, int), np.full(1, len(p))) for p in points])
    n, found = table.get(keys)
    return [int(x) if f else None for x, f in zip(n, found)]


def test_table_has_the_most_frequent_of_the_sample(spark):
    """Words that only come after the first 2,000 rows, and in a text beyond 64 KiB, are in the table."""
    rows = [(i, "first words") for i in range(2_000)] + [(i, "later") for i in range(2_000, 5_000)] + [(5_000, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    table = frequent_table(docs, BYTE, "doc_id", "text", 2, 10_000)
    assert lengths(table, [" long", "later", "first", "unknown"]) == [len(LIBRARY.encode(" long").ids), len(LIBRARY.encode("later").ids), None, None]


def test_counts_do_not_depend_on_the_table(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(i % 40)) + "\n\n end ") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, len(LIBRARY.encode(t).ids)) for i, t in rows)
    for table_size, sample in ((1, 1), (8, 300), (1 << 15, 0)):
        got = token_counts(docs, BYTE, table_size=table_size, sample_docs=sample)
        assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want


def test_cached_chunk_of_256_tokens(spark):
    text = chr(0xf1234) * 64
    want = len(LIBRARY.encode(text).ids)
    assert want > 255
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts(docs, BYTE).collect()] == [want]
