import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from lorefield.operators import extract as ex

NAMES = {"Ada Byrne": "person", "Northwind Labs": "organization", "Lisbon": "location"}


def gazetteer(names):
    def predict(windows):
        return [
            sorted(
                (
                    {"start": m.start(), "end": m.end(), "text": m.group(), "label": label, "score": 0.9}
                    for name, label in names.items()
                    for m in re.finditer(re.escape(name), w)
                ),
                key=lambda d: d["start"],
            )
            for w in windows
        ]

    return predict


def run(spark, texts, predict, threshold=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    rows = ex.extract_records(df, predictor=ex.window_list_predictor(predict), threshold=threshold).orderBy("id").collect()
    return [([tuple(e) for e in r.entities], [tuple(e) for e in r.relationships]) for r in rows]


def test_entities_and_same_sentence_pairs(spark):
    text = "Ada Byrne is the chief executive of Northwind Labs. The office is in Lisbon."
    [(entities, relations)] = run(spark, [text], gazetteer(NAMES))
    assert [e[:2] for e in entities] == [("Ada Byrne", "person"), ("Northwind Labs", "organization"), ("Lisbon", "location")]
    assert entities[2][2] == "The office is in Lisbon."
    assert relations == [
        ("Ada Byrne", "Northwind Labs", "is the chief executive of", "Ada Byrne is the chief executive of Northwind Labs.")
    ]


def test_threshold_and_closed_labels(spark):
    def predict(windows):
        return [[{"start": 0, "end": 3, "text": "Ada", "label": "person", "score": 0.39}, {"start": 4, "end": 7, "text": "Bob", "label": "animal", "score": 0.9}] for _ in windows]

    assert run(spark, ["Ada Bob."], predict, 0.4) == [([], [])]
    assert len(run(spark, ["Ada Bob."], predict)[0][0]) == 2


def by_hand(text, predict):
    """Plain reading of the rules, written apart from the Spark expressions."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text) if m.group().strip()]
    wins = []
    for s, e in spans:
        if wins and e - wins[-1][0] <= 900:
            wins[-1][1] = e
        else:
            wins.append([s, e])
    starts = [s for s, _ in spans]
    seen, per_sentence = {}, {}
    for (s, e), found in zip(wins, predict([text[s:e] for s, e in wins])):
        for m in found:
            name = re.sub(r"\s+", " ", m["text"]).strip(" \t\n\r.,;:!?'\"()[]{}<>|/\\")
            if not name:
                continue
            at, to = s + m["start"], s + m["end"]
            si = bisect.bisect_right(starts, at) - 1
            rec = seen.setdefault(name.casefold(), {"name": name, "label": m["label"], "score": m["score"], "si": si, "n": len(seen)})
            per_sentence.setdefault(si, {}).setdefault(rec["name"], (at, to))
    kept = sorted(seen.values(), key=lambda r: (-r["score"], r["n"]))[:40]
    names = {r["name"] for r in kept}
    body = lambda si: text[slice(*spans[si])].strip()
    entities = [(r["name"], r["label"], body(r["si"])[:400] or r["name"]) for r in kept]
    relations = []
    for si in sorted(per_sentence):
        ms = [(n, p) for n, p in per_sentence[si].items() if n in names][:5]
        for i, (a, pa) in enumerate(ms):
            for b, pb in ms[i + 1 :]:
                between = " ".join(text[pa[1] : pb[0]].split()[:6]) or "related to"
                relations.append((a, b, between, body(si)[:400]))
    return entities, relations[:60]


def test_random_texts_against_plain_reading(spark):
    rng = random.Random(7)
    vocab = [f"E{i}x" for i in range(70)] + [f"e{i}X" for i in range(20)]

    def predict(windows):
        return [
            [
                {"start": m.start(), "end": m.end(), "text": m.group(), "label": "concept", "score": (len(m.group()) % 3) / 4 + 0.3}
                for m in re.finditer(r"\b[Ee]\d+[xX]\b|\(\.\)", w)
            ]
            for w in windows
        ]

    texts = []
    for n in (0, 3, 30, 400, 1200):
        words = [rng.choice(vocab) if rng.random() < 0.4 else rng.choice(["the", "is", "(.)", "x.", "y!\n", "\n", "z?"]) for _ in range(n)]
        texts.append(" ".join(words))
    texts.append(" ".join(vocab) + ".")
    got = run(spark, texts, predict)
    for text, result in zip(texts, got):
        assert result == by_hand(text, predict)


def test_shape_predictor(spark):
    text = "On 2024-01-05 Ada Byrne met (NATO) about interoperability. Done"
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(ex.shape_mentions(F.col("t")).alias("m")).first().m
    assert [(m.text, m.label) for m in found] == [
        ("On", "other"), ("2024-01-05", "date"), ("Ada Byrne", "person"), ("NATO", "technology"), ("interoperability", "concept"), ("Done", "other"),
    ]
    assert all(text[m.start : m.end] == m.text for m in found)


def test_records_json(spark):
    df = spark.createDataFrame([(1, "Ada Byrne met Kenji Mori.")], "id long, content string")
    js = ex.extract_records(df).select(ex.records_json(F.col("entities"), F.col("relationships")).alias("j")).first().j
    assert js.startswith('{"entities":[{"name":"Ada Byrne","type":"person"') and '"keywords":"met"' in js


@pytest.mark.parametrize("text", ["", "   \n", "..."])
def test_nothing_to_find(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, content string")
    row = ex.extract_records(df).first()
    assert row.entities == [] and row.relationships == []


def test_whole_chunk_equals_packed_windows(spark):
    """The default predictor reads a chunk at once; run over packed windows it must find the same records."""
    rng = random.Random(5)
    vocab = ["Ada Byrne", "Kenji", "NATO", "interoperability", "2024-01-05", "and", "the", "x.", "y!Z", "Osaka?\n", "\n \n", "..."]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (5, 200, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    windowed = ex.extract_records(df, predictor=lambda wins: F.transform(wins, ex.shape_mentions))
    assert sorted(ex.extract_records(df).collect()) == sorted(windowed.collect())


def test_a_query_for_one_list_does_not_compute_the_other(spark):
    """Entities alone must not cost the pairs of every sentence."""
    records = ex.extract_records(spark.createDataFrame([(1, "Ada Byrne met Kenji Mori.")], "id long, content string"))
    plan = lambda *names: records.select(*names)._jdf.queryExecution().optimizedPlan().toString()
    assert "related to" in plan("relationships") and "related to" not in plan("entities")


def test_numbers_of_sentences_do_not_hide_later_ones(spark):
    """Caps hold over the whole chunk: the first five of a sentence, 40 entities and 60 pairs."""
    names = [f"Ada{chr(97 + i // 26)}{chr(97 + i % 26)} Byrne" for i in range(60)]
    text = " ".join("; ".join(names[i : i + 6]) + "." for i in range(0, 60, 6))
    row = ex.extract_records(spark.createDataFrame([(1, text)], "id long, content string")).first()
    assert [e.name for e in row.entities] == names[:40]
    want = [(a, b) for i in range(0, 40, 6) for s in [names[i : min(i + 5, 40)]] for j, a in enumerate(s) for b in s[j + 1 :]]
    assert [(r.source, r.target) for r in row.relationships] == want[:60] and row.relationships[0].keywords == ";"
