import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorefield.functions import sentences as se
from lorefield.functions.arrays import offsets
from lorefield.operators import chunks as ch


def windows_by_hand(text, spans, limit=900):
    groups = []
    for s, e in spans:
        if groups and e - groups[-1][0] <= limit:
            groups[-1][1] = e
        else:
            groups.append([s, e])
    return [(s, text[s:e]) for s, e in groups]


prose = st.lists(st.text(alphabet="ab .!?\n é", max_size=300), min_size=5, max_size=10)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(prose)
def test_spans_and_windows(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spans = se.sentence_spans(F.col("t"))
    for r in df.select("t", spans.alias("p"), se.windows(F.col("t"), spans, 40).alias("w"), se.sentence_pieces(F.col("t")).alias("x")).collect():
        assert "".join(r.x) == r.t
        want = [(m.start(), m.end()) for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", r.t) if m.group().strip()]
        assert [(p.s, p.e) for p in r.p] == want
        assert [(w.start, w.text) for w in r.w] == windows_by_hand(r.t, want, 40)


def test_long_text_gives_bounded_windows(spark):
    text = " ".join(f"Sentence number {i} is short." for i in range(200))
    df = spark.createDataFrame([(text,)], "t string")
    wins = df.select(se.windows(F.col("t"), se.sentence_spans(F.col("t"))).alias("w")).first().w
    assert len(wins) > 1 and all(len(w.text) <= 900 for w in wins)
    assert "".join(w.text for w in wins) == text


def test_offsets_over_several_blocks(spark):
    items = ["x" * (i % 7) for i in range(1000)]
    df = spark.createDataFrame([(items,)], "a array<string>")
    got = df.select(offsets(F.col("a")).alias("o")).first().o
    assert got == [sum(map(len, items[:i])) for i in range(1000)]


def packed_by_hand(sentences, target, overlap):
    out, cur = [], []
    for s in sentences:
        if cur and sum(map(len, cur)) + len(s) > target:
            out.append(" ".join(cur))
            cur = cur[-overlap:]
        cur = cur + [s]
    return out + ([" ".join(cur)] if cur else [])


def test_packed_chunks(spark):
    text = " ".join("w" * (i % 30 + 1) + "." for i in range(120))
    sentences = [s.strip() for s in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text) if s.strip()]
    df = spark.createDataFrame([(text,), ("",)], "t string")
    for overlap in (1, 2):
        got = [r.c for r in df.select(se.packed_chunks(F.col("t"), 100, overlap).alias("c")).collect()]
        assert got == [packed_by_hand(sentences, 100, overlap), []]


def test_token_windows(spark):
    text = "  " + " ".join(f"t{i}" for i in range(25)) + "\n"
    df = spark.createDataFrame([(1, text), (2, " "), (3, "a\n\nb")], "doc_id long, text string")
    rows = ch.chunk_by_tokens(df, size=10, overlap=2).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r.doc_id == 1]
    assert [r.content.split()[0] for r in first] == ["t0", "t8", "t16", "t24"]
    assert [r.token_count for r in first] == [10, 10, 9, 1]
    assert [r.content for r in rows if r.doc_id == 3] == ["a\n\nb"]
    assert not [r for r in rows if r.doc_id == 2]


def test_cascade_small_text_is_one_chunk():
    assert ch.cascade_split("short text") == ["short text"]


def test_cascade_packs_with_overlap():
    cost = lambda s: len(s.split())
    text = "\n\n".join(f"a{i} b{i} c{i}" for i in range(6))
    got = ch.cascade_split(text, size=7, overlap=3, cost=cost)
    assert got[0] == "a0 b0 c0\n\na1 b1 c1"
    assert got[1] == "a1 b1 c1\n\na2 b2 c2"
    assert all(cost(c) <= 9 for c in got)


def test_cascade_goes_finer_only_where_needed(spark):
    cost = lambda s: len(s.split())
    text = "small\n\n" + ". ".join("one two three" for _ in range(6))
    got = ch.cascade_split(text, size=7, overlap=0, cost=cost)
    assert got[0] == "small"
    assert got[1:] == ["one two three. one two three"] * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = ch.chunk_by_cascade(df, size=7, overlap=0, cost=cost).orderBy("chunk_index").collect()
    assert [r.content for r in rows] == got


def test_cascade_without_separators_cuts_by_width():
    got = ch.cascade_split("x" * 100, size=5, overlap=1, separators=["\n"])
    assert [len(c) for c in got] == [23, 23, 23, 23, 23, 20]
    assert "".join(c[7 if i else 0 :] for i, c in enumerate(got)) == "x" * 100


def test_cascade_keeps_its_limit_on_long_texts():
    for text in ("abc " * 20000, "x" * 1_000_000, ("word " * 700 + "\n\n") * 50, "a. " * 3000 + "y" * 9000 + " tail"):
        began = time.perf_counter()
        spans = ch.cascade_spans(text)
        assert time.perf_counter() - began < 1.5
        assert all((b - a) // 4 <= ch.CASCADE_TOKENS for a, b in spans)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc.!?;, \n", max_size=400), st.integers(1, 12), st.integers(0, 3))
def test_cascade_spans_cover_the_text_in_order(text, size, overlap):
    spans = ch.cascade_spans(text, size, min(overlap, size - 1))
    assert all((b - a) // 4 <= size and a < b for a, b in spans)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(c in ".!?;, \n" for i, c in enumerate(text) if i not in covered)
    assert all((x[1] - y[0]) // 4 <= overlap for x, y in zip(spans, spans[1:]) if y[0] < x[1])


def test_cascade_leaves_out_empty_pieces():
    """A text that begins with a separator has nothing before it."""
    assert ch.cascade_spans("; ;;;;;;", 1, 0) == [(2, 8)]
