"""Token counts and windows against another library that reads the same vocabulary."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorefield.operators import tokens as tk
from lorefield.operators import vector as ve
from lorefield.plans.ingest import IndexOptions, index

VOCABULARY = tk.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TEXTS = ["", None, "Hello wOrld!", "héé ﬁ \U0001f600\U0001f600 x", "漢字かな" * 50, "a" * 3000, "word " * 2500, "\n\n\t tab  two", "Zürich 12345 'll don't"]


@pytest.fixture(scope="module")
def other():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(2)
    return TEXTS + ["".join(rng.choices(["a", "é", "漢", "\U0001f600", " ", "\n", "Zz", "9"], k=rng.randint(1, 400))) for _ in range(40)]


def test_counts(spark, other):
    rows = [(i, t, 9) for i, t in enumerate(texts())]
    got = tk.with_token_count(spark.createDataFrame(rows, "doc_id long, text string, tokens int"), VOCABULARY)
    assert got.columns == ["doc_id", "text", "tokens"]
    assert {r.doc_id: r.tokens for r in got.collect()} == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}


def test_every_token_knows_its_characters(other):
    for text in texts():
        ids, places = tk.encoded(text, VOCABULARY)
        whole = other.encode(text or "", add_special_tokens=False)
        assert ids.tolist() == whole.ids and len(places) == len(ids) + 1 and places[-1] == len(text or "")
        # The other library gives the character that a token's first byte belongs to.
        assert [a for a, _ in whole.offsets] == places[:-1].tolist() or any(b - a == 0 for a, b in whole.offsets) or not text.isascii()
        assert all(a <= b for a, b in zip(places[:-1], places[1:], strict=False))


@pytest.mark.parametrize("size, overlap", [(16, 4), (7, 0), (5, 4), (1024, 100)])
def test_windows_rebuild_the_text(spark, other, size, overlap):
    rows = list(enumerate(texts()))
    got = {}
    for r in tk.chunk_by_vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, size=size, overlap=overlap).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        parts = sorted(got.get(doc, []), key=lambda r: r.chunk_index)
        count = len(other.encode(text or "", add_special_tokens=False).ids)
        assert [(r.token_start, r.token_count) for r in parts] == tk.windows(count, size, overlap)
        assert all(r.content == text[r.first : r.last] for r in parts)
        rebuilt = "".join(text[r.first : b.first] for r, b in zip(parts, parts[1:], strict=False)) + (parts[-1].content if parts else "")
        assert rebuilt == (text or "")
    with pytest.raises(ValueError):
        tk.chunk_by_vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, size=4, overlap=4)


def test_indexing_by_real_tokens(spark):
    docs = spark.createDataFrame([("d", "Ada Lindgren met Omar Castell in Bergen. " * 40)], "doc_id string, text string")
    options = IndexOptions(size=64, overlap=8, embedder=ve.hashing_embedder(8), vocabulary=VOCABULARY)
    chunks = index(docs, options)["chunks"].collect()
    assert len(chunks) > 3 and max(r.token_count for r in chunks) == 64
