"""Vector codes against plain Lloyd rounds on Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lorefield.llm import vectorcodes

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error, label_error, digest)} of rows with distinct ids and vectors of one length."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort()
    d = len(kept[0][1])
    cut = [(i * d // parts, (i + 1) * d // parts) for i in range(parts)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cut]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, row, strict=True)), e) for e, row in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[best(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else row for m, row in zip(members, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for row in book for x in row).encode()).hexdigest()
    coded = {i: [best(v[a:b], books[p]) for p, (a, b) in enumerate(cut)] for i, v, _ in kept}
    errors = {i: sum(d for d, _ in c) for i, c in coded.items()}
    groups = {g: sum(errors[i] for i, _, h in kept if h == g) for _, _, g in kept}
    return {i: ("".join(f"{e:02x}" for _, e in coded[i]), errors[i], groups[g], digest) for i, _, g in kept}


def spark_codes(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.compressed(df).collect()}


def test_codes_match_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(3, 260)]
    rows += [(i, [0.25] * 16, 7) for i in range(300, 420)]
    rows += [(500, None, 1), (501, [0.1] * 15 + [None], 1), (502, [float("nan")] * 16, 1), (503, [0.1] * 15 + [float("inf")], 2), (0, [float("-inf")] * 16, 1)]
    rng.shuffle(rows)
    assert spark_codes(spark.createDataFrame(rows, COLUMNS).repartition(5)) == plain_codes(rows)


@pytest.mark.parametrize("length, n", [(16, 1), (16, 5), (8, 40), (13, 40), (3, 30), (0, 4)])
def test_few_rows_and_odd_lengths(spark, length, n):
    rng = random.Random(n)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(length)], 1) for i in range(n)]
    assert spark_codes(spark.createDataFrame(rows, COLUMNS)) == plain_codes(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-30000, 30000) for _ in range(16)], i % 3) for i in range(60)]
    assert spark_codes(spark.createDataFrame(rows, COLUMNS)) == plain_codes(rows)


def test_repeated_and_missing_ids_other_lengths_and_clashing_columns(spark):
    rng = random.Random(4)
    base = [(i, [rng.uniform(-1, 1) for _ in range(8)], 1) for i in range(20)]
    rows = base + [base[3], (None, base[5][1], None), (21, [0.5] * 9, 1)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], COLUMNS + ", code string, error double")
    got = vectorcodes.compressed(df).collect()
    # Sixteen smallest ids, the repeated one counted twice, and neither the null id nor the odd length.
    assert len(got) == 22 and sum(r.vec_id == 3 for r in got) == 2
    assert next(r.code for r in got if r.vec_id is None) == next(r.code for r in got if r.vec_id == 5)
    assert {r.label_error for r in got if r.vec_id is not None} == {sum(r.error for r in got if r.vec_id is not None)}
    books = vectorcodes.train(df)
    assert vectorcodes.encode(df, books).columns == ["vec_id", "label", "code", "error"]
    assert len(books.books[0]) == 16


def test_no_usable_rows(spark):
    nothing = spark.createDataFrame([(1, None, 1)], COLUMNS)
    assert vectorcodes.compressed(nothing).collect() == [] and vectorcodes.train(nothing) is None
    assert vectorcodes.compressed(nothing.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_only_changes_of_entry_are_dealt_out_again(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 4, 0.2) for _ in range(8)], 1) for i in range(400)]
    tables = []
    real = vectorcodes.checkpointed
    monkeypatch.setattr(vectorcodes, "checkpointed", lambda df, *by: tables.append(real(df, *by)) or tables[-1])
    vectorcodes.train(spark.createDataFrame(rows, COLUMNS), entries=4)
    members = [t.where("count is null").count() for t in tables]
    assert len(tables) == 6 and members[0] == 8 * 400 and sum(members[1:]) < members[0]
    for table in tables[1:]:
        held = table.where("count is not null").groupBy("position").sum("count").collect()
        moved = {r["position"]: r["count"] for r in table.where("count is null").groupBy("position").count().collect()}
        assert all(r[1] + moved.get(r[0], 0) == 400 for r in held)
