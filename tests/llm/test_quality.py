"""Quality scores: the statistics by hand, the sums against one matrix, the isotonic step by hand, and held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorefield.llm import quality
from lorefield.llm.queries import op11_quality

BASE = "/root/testdata/sf0.01"


def stats(*texts):
    return [dict(zip(quality.STATISTICS, (row / quality.UNIT).tolist(), strict=True)) for row in quality.statistics(pa.array(texts, pa.string()))]


def test_statistics_by_hand():
    plain, shout, empty, none, table = stats("The cat, the cat.\nThe dog é", "BUY NOW!! BUY NOW!!", "", None, "a | b | c# 12")
    near = lambda x: pytest.approx(x, abs=2 / quality.UNIT)
    assert plain["words"] == near(np.log1p(7)) and plain["distinct words"] == near(5 / 7) and plain["most frequent word"] == near(3 / 7)
    assert plain["word length"] == near(3) and plain["not ascii"] == near(1 / 27) and plain["capitals"] == near(2 / 19)
    assert plain["distinct lines"] == 1 and plain["word again"] == 0 and plain["words ending in a mark"] == near(2 / 7)
    assert shout["words in capitals"] == 1 and shout["exclamations"] == near(1) and shout["distinct pairs"] == near(2 / 3)
    assert set(empty.values()) == set(none.values()) == {0.0}
    assert table["words ending in a symbol"] == near(3 / 6) and table["words without letters"] == near(3 / 6) and table["digits"] == near(2 / 13)


def test_statistics_do_not_depend_on_neighbours_and_take_long_texts():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "Bb", "ç!", "12", "\n"], k=rng.randint(0, 40))) for _ in range(30)] + ["x" * 400_000, "word " * 90_000, None, ""]
    together = quality.statistics(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert (together == alone).all() and together.max() <= quality.LARGEST * quality.UNIT


def test_isotonic_against_all_cuts():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 7)
        at, count = sorted(rng.sample(range(50), n)), [rng.randint(1, 5) for _ in range(n)]
        good = [rng.randint(0, c) for c in count]
        place, share = quality.isotonic(at, count, good)
        loss = lambda values: sum(c * v * v - 2 * g * v for c, g, v in zip(count, good, values, strict=True))
        best = min(
            loss(values)
            for cuts in itertools.product((0, 1), repeat=n - 1)
            for values in [_pooled(cuts, count, good)]
            if all(a <= b + 1e-12 for a, b in itertools.pairwise(values))
        )
        sizes = np.searchsorted(at, place, "right")
        assert (np.diff(share) > 0).all()
        means = _isotonic_values(at, count, place, share)
        assert len(sizes) == len(share) and loss(means) == pytest.approx(best)


def _pooled(cuts, count, good):
    groups = np.cumsum([0, *cuts])
    return [sum(g for g, k in zip(good, groups, strict=True) if k == own) / sum(c for c, k in zip(count, groups, strict=True) if k == own) for own in groups]


def _isotonic_values(at, count, place, share):
    """Give every place the share of its pool, the pools being runs whose weighted mean is their place."""
    values, i = [], 0
    for p, s in zip(place, share, strict=True):
        weight = total = 0
        while weight == 0 or abs(total / weight - p) > 1e-9:
            weight, total = weight + count[i], total + count[i] * at[i]
            values.append(s)
            i += 1
    return values


def corpus(spark, n=600):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(["tree", "House", "river,", "stone", "light."]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_equations_are_sums_of_the_parts(spark):
    docs = corpus(spark)
    described = quality.describe(docs.select("doc_id", "text"))
    labels = docs.select("doc_id", "quality")
    model, again = quality.train(described, labels), quality.train(described.repartition(7), labels.repartition(3))
    assert (model.weights == again.weights).all() and (model.steps[1] == again.steps[1]).all()
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(quality.CALIBRATION_SHARE)) == 0
    rows = described.join(labels, "doc_id").where(~apart).collect()
    x, y = np.array([r.stats for r in rows]), np.array([r.quality for r in rows])
    z = quality.fourier(x, model.mean, model.spread) / quality.FEATURE_UNIT
    held = quality.RIDGE * len(x) * np.diag([1.0] * quality.FEATURES + [0.0])
    assert np.allclose(x.mean(0), model.mean) and np.allclose(np.where(x.std(0) > 0, x.std(0), quality.UNIT), model.spread)
    assert np.allclose(z @ np.linalg.solve(z.T @ z + held, z.T @ y), z @ model.weights * quality.FEATURE_UNIT, atol=1e-6)


def test_kernel_is_approximated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, len(quality.STATISTICS)))
    z = quality.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), features=20_000)[:, :-1] / quality.FEATURE_UNIT
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(2 * z @ z.T / 20_000 - np.exp(-far / (2 * x.shape[1]))).max() < 0.05


def test_clean_and_noisy_texts_nulls_and_clashing_columns(spark):
    docs = corpus(spark)
    rows = docs.union(spark.createDataFrame([(None, "tree", 1), (9000, None, None), (9001, "", 1)], docs.schema)).withColumn("score", F.lit("x")).withColumn("stats", F.lit(1))
    described = quality.describe(rows)
    model = quality.train(described, docs.where("doc_id < 400").select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, 7), (6, None)], "doc_id long, quality int")))
    got = quality.score(described, model).collect()
    assert len(got) == 603 and set(got[0].asDict()) == {"doc_id", "quality", "score", "predicted"}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    tested = [r for r in got if r.doc_id and 400 <= r.doc_id < 9000]
    assert sum(r.predicted == r.quality for r in tested) >= 0.97 * len(tested)


def test_no_labels_one_class_and_no_rows(spark):
    docs = corpus(spark, 30)
    described = quality.describe(docs.select("doc_id", "text"))
    labels = docs.select("doc_id", "quality")
    assert {r.score for r in quality.score(described, quality.train(described, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(described, quality.train(described, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.score(described.limit(0), quality.train(described, labels)).count() == 0


def test_held_out_accuracy(spark):
    got = op11_quality(spark, BASE)
    labels = spark.read.parquet(f"{BASE}/labels.parquet").where("quality is not null")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
