"""Line dedup, near duplicates, exact duplicates and decontamination against their plain versions."""

import random

import pytest

from lorefield.llm import decontaminate, exactdup, flat, fmindex, linededup, neardup
from tests.llm import plain

SCHEMA = "doc_id long, text string"
EDGES = [(900, None), (901, ""), (902, "   \n\t"), (903, "one"), (904, "one"), (905, "Ünïcode wörter hier und dort überall gleich"), (906, "x" * 30000)]


def corpus(seed, n=60):
    """Texts from few words and lines, with copies, near copies and repeated lines."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Äpfel", "THE", "the"]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(40)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.4:
            parts = rng.choice(texts).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 5))):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
        else:
            texts.append("\n".join(rng.choice([rng.choice(lines), " ".join(rng.choices(words, k=rng.randint(1, 40)))]) for _ in range(rng.randint(1, 8))))
    return list(enumerate(texts)) + EDGES


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(frame, batches=5, fanout=2).collect()}
    assert got == plain.line_dedup(docs)


def test_line_dedup_repeated_rows_clashes_and_empty(spark):
    rows = [(1, "a line of text\na line of text", "x"), (1, "a line of text\na line of text", "y"), (2, "A LINE OF TEXT \nother", "z"), (None, "a line of text", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _doc string")
    got = sorted((r.doc_id or 99, r._doc, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(frame).collect())
    assert got == [(1, "x", 0, rows[0][1]), (1, "y", 0, rows[0][1]), (2, "z", 1, "other"), (99, "q", 1, "")]
    assert linededup.dedup_lines(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size,seed", [(4, 3), (5, 4)])
def test_near_duplicates(spark, size, seed, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    docs = corpus(seed, 120)
    base = docs[0][1] + " " + " ".join(f"v{i}" for i in range(60))
    rng = random.Random(seed)
    for i in range(40):
        parts = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            parts[rng.randrange(len(parts))] = f"e{rng.randrange(1000)}"
        docs.append((2000 + i, " ".join(parts)))
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    rows = neardup.near_duplicates(frame, shingle=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain.near_duplicates(docs, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_repeated_null_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_shingles, r.kept) for r in got) == [(0, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True), (7, 7, 0, True), (8, 8, 0, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_posterior_bound_keeps_similar_pairs():
    least = neardup.least_matches(0.8, 1e-6)
    assert 45 <= least[96] <= 65 and all(least[n] <= 0.8 * n for n in range(16, 97, 16))


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_groups(spark, monkeypatch, block):
    monkeypatch.setattr(exactdup, "BLOCK_BYTES", block)
    docs = corpus(5, 40)
    docs += [(3000 + i, t.replace(" ", "  ") if i % 2 else t) for i, (_, t) in enumerate(docs[:20])]
    rows = exactdup.exact_groups(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    body = lambda t: "".join(c for c in t or "" if c not in plain.WHITE)
    groups = {}
    for doc, text in docs:
        groups.setdefault(body(text), []).append((-len(text or ""), doc))
    want = {d: (min(groups[body(t)])[1], len(groups[body(t)]), min(groups[body(t)])[1] == d, plain.sha(body(t))) for d, t in docs}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want


def test_exact_groups_repeated_null_and_empty(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "a b "), (3, None), (4, " ")], SCHEMA)
    got = exactdup.exact_groups(rows).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, None, 3, True), (1, None, 3, False), (1, None, 3, False), (3, 4, 2, False), (4, 4, 2, True)]
    assert exactdup.exact_groups(rows.limit(0)).count() == 0


def test_fm_index_against_scan():
    rng = random.Random(7)
    import numpy as np

    for alphabet in (1, 2, 5):
        symbols = [rng.randint(0, alphabet) for _ in range(300)] + [0]
        index = fmindex.FMIndex(np.array(symbols), sample_every=4)
        phrases = [[rng.randint(1, alphabet + 1) for _ in range(n)] for n in (1, 1, 2, 3, 5)]
        table = np.zeros((len(phrases), 5), np.int64)
        for i, phrase in enumerate(phrases):
            table[i, : len(phrase)] = phrase
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for phrase, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(symbols)) if symbols[i : i + len(phrase)] == phrase]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, block_bytes):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(["aa", "b2", "çç", "dd"], k=rng.choice((3, 10, 12, 15))))) for i in range(8)] + [(50, None), (51, ""), (None, "aa aa aa")]
    docs = corpus(9, 30)
    for i in range(20):
        text = items[i % 8][1].upper() if i % 3 else items[i % 8][1].replace(" ", " - ")
        docs.append((4000 + i, " ".join(rng.choices(["aa", "b2", "x"], k=rng.randint(0, 30))) + ", " + text + " aa b2"))
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    found = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, shard_bytes=2000)
    got = {r.doc_id: (r.n_words, {w for s in r.spans for w in range(s.first, s.last)}, set(r["items"])) for r in found.collect()}
    assert got == plain.contamination(docs, [i for i in items if i[0] is not None])


def test_contamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in decontaminate.contamination(docs, none).collect()] == [(2, [], [])]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["ab ba ab", None, "", "ba\x0bab é", "e"])
    data, bounds = flat.text_bytes(texts)
    start, end, doc = flat.word_bounds(flat.NOT_SPACE[data], bounds)
    words = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
    assert words == [b"ab", b"ba", b"ab", b"ba", b"ab", "é".encode(), b"e"] and doc.tolist() == [0, 0, 0, 3, 3, 3, 4]
    hashes = flat.word_hashes(data, start, end)
    assert [[a == b for a in hashes] for b in hashes] == [[a == b for a in words] for b in words]
    assert flat.word_hashes(data[:0], np.empty(0, int), np.empty(0, int)).size == 0


def test_pivots_of_large_buckets_need_no_join_of_all_memberships(spark):
    """The member with the most company is a pivot; its weight reaches the buckets without a join."""
    sizes = {b: neardup.SMALL_BUCKET + 1 + b for b in range(4)} | {9: 2}
    rows = [(c, b, n) for b, n in sizes.items() for c in range(n)]
    pivots = neardup._first_pivots(spark.createDataFrame(rows, "cls long, bucket long, size long"))
    assert "Join" not in pivots._jdf.queryExecution().executedPlan().toString()
    got = [(r.bucket, r.pivot) for r in pivots.collect()]
    weight = {}
    for c, _, n in rows:
        weight[c] = weight.get(c, 0) + n
    assert {b for b, _ in got} == {0, 1, 2, 3} and len(set(got)) == len(got)
    for b in range(4):
        assert max((weight[c], c) for c, bucket, _ in rows if bucket == b)[1] in {p for bucket, p in got if bucket == b}
