"""Importance resampling against plain sums and a plain sort."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorefield.llm import resample
from tests.llm import plain

COLUMNS = "doc_id long, text string"


def features(text):
    words = plain.ITEM_WORDS.findall(plain.low(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(docs, target):
    """{doc_id: (n_features, weight, score, rank)} of (doc_id, text) with distinct ids."""
    found = {i: features(t) for i, t in docs}
    s, t = Counter(b for _, f in found.values() for b in f), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + 10000) / ((s[b] + 1.0) * (tt + 10000)))) for b in range(10000)]
    rows = {}
    for i, (n, f) in found.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows[i] = (n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-score, i) for i, (n, _, _, score) in rows.items() if n >= 20)
    rank = {i: r for r, (_, i) in enumerate(able[: 5 * len(able) // 100], 1)}
    return {i: (f, w, score, rank.get(i)) for i, (_, f, w, score) in rows.items()}


def spark_draw(docs, target, **options):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, target, **options).collect()}


def test_draw_matches_plain_sort(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ÀB", "x_y", "1-2", "ﬁ", "漢字"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([3, 19, 20, 21, 60])))) for i in range(900)]
    docs += [(2000, None), (2001, ""), (2002, " \n.,"), (2003, "word " * 70_000), (2004, "a" * 300_000)]
    target = [" ".join(rng.choices(words[:9], k=30)) for _ in range(40)] + [None, ""]
    got = spark_draw(spark.createDataFrame(docs, COLUMNS).repartition(7), spark.createDataFrame([(t,) for t in target], "text string"))
    want = plain_draw(docs, target)
    assert got == want and sum(r[3] is not None for r in got.values()) > 20


def test_words_of_a_run_continue_in_the_next(monkeypatch):
    monkeypatch.setattr(resample, "RUN_WORDS", 3)
    for n in range(9):
        text = " ".join(f"w{i}" for i in range(n))
        runs = list(resample.feature_buckets(text.encode()))
        assert sum(k for k, _ in runs) == n and sorted(b for _, f in runs for b in f.tolist()) == sorted(features(text)[1])


@pytest.mark.parametrize("n, rank", [(1, 1), (2, 1), (2, 2), (500, 1), (500, 250), (500, 500), (500, 0), (500, 501)])
def test_cutoff_is_the_key_of_that_rank(spark, n, rank):
    rng = random.Random(n + rank)
    # Few scores, repeated and missing keys: rows alone tell some of them apart.
    keys = [(rng.randint(0, 3), rng.choice([None, 1, 2, 3, 4]), row) for row in range(n)]
    found = resample.cutoff(spark.createDataFrame(keys, "score long, key long, row long").repartition(6), rank)
    ordered = sorted(keys, key=lambda k: (-k[0], k[1] is None, k[1] or 0, k[2]))
    assert (found and (found.score, found.key, found.row)) == (ordered[rank - 1] if 1 <= rank <= n else None)


def test_each_round_throws_a_share_away(spark, monkeypatch):
    rounds = []
    real = resample.up_to
    monkeypatch.setattr(resample, "up_to", lambda pivot: rounds.append(pivot) or real(pivot))
    keys = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("score"), F.col("id").alias("key"), F.col("id").alias("row"))
    found = resample.cutoff(keys.repartition(5), 1000)
    scores = sorted((i * 7919 % 20_011 for i in range(20_000)), reverse=True)
    assert found.score == scores[999]
    assert len({id(p) for p in rounds}) <= math.log(20_000) / math.log(8 / 7)


def test_string_keys_repeated_rows_and_clashing_columns(spark):
    rows = [(f"k{i % 50:02}", "alpha beta " * 12, 1, 2.0) for i in range(100)] + [(None, "alpha beta " * 12, 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, rank int, score double")
    target = spark.createDataFrame([("alpha",)], "text string")
    got = resample.resample(docs, target, percent=50).collect()
    drawn = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 101 and drawn == list(range(1, 51))
    best = max(r.score for r in got)
    assert all(r.score == best for r in got if r["rank"] == 1)


def test_no_documents_and_no_target(spark):
    docs = spark.createDataFrame([(i, "one two three " * 9) for i in range(40)], COLUMNS)
    target = spark.createDataFrame([("one",)], "text string")
    assert spark_draw(docs.limit(0), target) == {}
    assert spark_draw(docs, target.limit(0)) == plain_draw([(r.doc_id, r.text) for r in docs.collect()], [])
    few = spark_draw(docs.where("doc_id < 19"), target)
    assert len(few) == 19 and all(r[3] is None for r in few.values())
