"""Toxicity of texts: a learned lexicon, matched with spelling errors, and scores of the window around each match.

The lexicon holds words and stems that set labelled toxic texts apart. A Levenshtein automaton over its trie reads every
word; each match counts by its spelling (exact or not), by whether it stands inside a quotation and by whether other
matches stand near it, and a logistic model weighs these counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm import flat, levenshtein
from lorefield.llm.arrow import extended, with_columns

SAMPLE_PER_CLASS = 20_000
MAX_TERMS = 200
STEMS = (4, 5, 6)
LEAST_LENGTH = 3
LEAST_EVIDENCE = 25.0
LEAST_LOG_ODDS = 2.0
SPECIFIC_SHARE = 0.9
NEAR_WORDS = 12
QUOTES = {0x22: 0, 0x201C: 1, 0xAB: 1, 0x201E: 1, 0x201D: -1, 0xBB: -1}
# What the model assumes where labels say nothing: bias, exact, quoted exact, inexact, quoted inexact, near others.
ASSUMED = np.array([-3.0, 6.0, 1.5, 2.5, 0.5, 1.0])
RIDGE = 1.0


@dataclass(frozen=True)
class ToxicityModel:
    terms: list[levenshtein.Term]
    automaton: levenshtein.Automaton
    weights: np.ndarray


def _letters(texts: pa.Array):
    """Lower-case code points, and the words, runs of letters and digits, as ranges of them."""
    chars, bounds = flat.text_chars(texts)
    low = flat.lower_table()[np.minimum(chars, 0x10FFFF)]
    digit = (low >= 0x30) & (low <= 0x39)
    start, end, doc = flat.word_bounds((flat.script_table()[np.minimum(low, 0x10FFFF)] > 0) | digit, bounds)
    return low, bounds, start, end, doc


def _quoted(low: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether these places lie inside a quotation that opened on their line."""
    if not len(at):
        return np.zeros(0, bool)
    line = np.zeros(len(low) + 1, bool)
    line[bounds] = True
    line[np.flatnonzero(low == 0x0A) + 1] = True
    begins = np.flatnonzero(line)
    first = begins[np.searchsorted(begins, at, "right") - 1]
    plain = np.concatenate(([0], np.cumsum(low == 0x22)))
    paired = np.zeros(len(low), np.int64)
    for char, step in QUOTES.items():
        if step:
            paired[low == char] = step
    paired = np.concatenate(([0], np.cumsum(paired)))
    return ((plain[at] - plain[first]) % 2 == 1) | (paired[at] > paired[first])


def _matches(texts: pa.Array, automaton: levenshtein.Automaton):
    low, bounds, start, end, doc = _letters(texts)
    classes = np.zeros(0x110000, np.int16)
    classes[list(automaton.letters)] = list(automaton.letters.values())
    state = levenshtein.read(automaton, classes[low], start, end)
    hit = np.flatnonzero(automaton.kind[state])
    return hit, doc[hit], automaton.kind[state[hit]], automaton.term[state[hit]], _quoted(low, bounds, start[hit]), start[hit] - bounds[doc[hit]], end[hit] - bounds[doc[hit]]


def _features(texts: pa.Array, automaton: levenshtein.Automaton) -> np.ndarray:
    hit, doc, kind, _, quoted, _, _ = _matches(texts, automaton)
    near = np.zeros(len(hit), bool)
    if len(hit) > 1:
        close = (np.diff(hit) <= NEAR_WORDS) & (np.diff(doc) == 0)
        near[1:] |= close
        near[:-1] |= close
    exact = kind == levenshtein.EXACT
    groups = (exact & ~quoted, exact & quoted, ~exact & ~quoted, ~exact & quoted, near & ~quoted)
    counts = [np.bincount(doc[g], minlength=len(texts)) for g in groups]
    return np.column_stack([np.ones(len(texts)), *(np.log1p(c) for c in counts)])


def _terms_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a word or a stem (marked by a closing *)."""
    sums: tuple[Counter, Counter] = Counter(), Counter()
    for part in flat.slices(batches, "text"):
        toxic = part.column(1).to_pylist()
        for text, label in zip(part.column(0).to_pylist(), toxic, strict=True):
            low, _, start, end, _ = _letters(pa.array([text], pa.string()))
            line = low.tobytes().decode("utf-32-le")
            words = {line[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True) if b - a >= LEAST_LENGTH}
            sums[label].update(words)
            sums[label].update({w[:n] + "*" for w in words for n in STEMS if len(w) >= n})
    names = list(set(sums[0]) | set(sums[1]))
    clean, bad = ([s[n] for n in names] for s in sums)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(clean, pa.int64()), pa.array(bad, pa.int64())], ["term", "clean", "bad"])


def _contexts(candidates: frozenset[str]):
    """(term, context) for each candidate in a text, the context being the words before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, "text"):
            found: set[tuple[str, str]] = set()
            for text in part.column(0).to_pylist():
                low, _, start, end, _ = _letters(pa.array([text], pa.string()))
                line = low.tobytes().decode("utf-32-le")
                words = [line[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    for term in (word, *(word[:n] + "*" for n in STEMS if len(word) >= n)):
                        if term in candidates:
                            found.add((term, f"{before} {after}"))
            terms, around = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(around, pa.string())], ["term", "around"])

    return run


def _lexicon(found: list[tuple[str, int]]) -> list[levenshtein.Term]:
    """Terms among the candidates (word, or stem with a closing *; toxic documents that hold it).

    A stem gives way to a longer candidate that holds nearly all of its documents; what begins with a stem that stays is
    covered by it.
    """
    weight = dict(found)

    def gives_way(stem: str) -> bool:
        return any(t != stem and t.startswith(stem[:-1]) and n >= SPECIFIC_SHARE * weight[stem] for t, n in found)

    stems: list[str] = []
    for stem in sorted((t for t in weight if t.endswith("*")), key=len):
        if not stem.startswith(tuple(stems)) and not gives_way(stem):
            stems.append(stem[:-1])
    words = [t for t in weight if not t.endswith("*") and not t.startswith(tuple(stems))]
    ranked = sorted([(-weight[w], w, False) for w in words] + [(-weight[t + "*"], t, True) for t in stems])[:MAX_TERMS]
    return [levenshtein.Term(t, stem, 0 if stem or len(t) < 5 else 1 if len(t) < 9 else 2) for _, t, stem in ranked]


def _telling(cells: DataFrame, bad: int, clean: int) -> DataFrame:
    """Terms (b toxic and c clean documents of `bad` and `clean`) that toxic texts hold far more often, with their evidence g,
    the likelihood ratio against independence."""
    a, c, share = F.col("b"), F.col("c"), bad / (bad + clean)
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((c + 0.5) / (clean + 1))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    inside = part(a, (a + c) * share) + part(c, (a + c) * (1 - share))
    outside = part(bad - a, (bad + clean - a - c) * share) + part(clean - c, (bad + clean - a - c) * (1 - share))
    return cells.where(odds >= LEAST_LOG_ODDS).withColumn("g", 2 * (inside + outside)).where(F.col("g") >= LEAST_EVIDENCE)


def _fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a ridge towards the assumed ones."""
    weights = ASSUMED.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + RIDGE * (weights - ASSUMED)
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(len(weights))
        move = np.linalg.solve(curve, slope)
        weights = weights - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from `labels` (key, label 0 or 1) and the texts of those documents.

    `per_class` bounds the sample: of each label about so many rows are used, chosen by the hash of the key, and all
    where there are fewer. Null texts and labels teach nothing; a key labelled twice counts as toxic if either is.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    counts = known.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    pace = F.pmod(F.xxhash64(F.lit("toxicity sample"), "_key"), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(counts), "_label").where(pace * F.col("_n") < per_class).select("_key", "_label")
    texts = docs.where(F.col(text).isNotNull()).join(F.broadcast(sample), F.col(key) == F.col("_key")).select(F.col(text).alias("text"), "_label")
    totals = {r["_label"]: r["n"] for r in texts.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, bad = totals.get(0, 0), totals.get(1, 0)
    if not bad or not clean:
        return ToxicityModel([], levenshtein.build([]), ASSUMED.copy())
    cells = texts.mapInArrow(_terms_in, "term string, clean long, bad long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("bad").alias("b"))
    candidates = _telling(cells, bad, clean).orderBy(F.desc("g"), "term").limit(20 * MAX_TERMS).select("term", "b", "c").collect()
    # Copies of one toxic text repeat all its words, but each with the same neighbours: such words count once.
    around = texts.where("_label = 1").mapInArrow(_contexts(frozenset(r["term"] for r in candidates)), "term string, around string")
    places = {r["term"]: r["n"] for r in around.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = docs.sparkSession.createDataFrame([(r["term"], min(r["b"], places.get(r["term"], 0)), r["c"]) for r in candidates], "term string, b long, c long")
    terms = _lexicon([(r["term"], r["b"]) for r in _telling(seen, bad, clean).select("term", "b").collect()])
    automaton = levenshtein.build(terms)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, "text"):
            rows = np.column_stack((_features(part.column(0), automaton), part.column(1).to_numpy()))
            cells, n = np.unique(rows, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.tolist(), pa.list_(pa.float64())), pa.array(n)], ["row", "n"])

    rows = texts.mapInArrow(describe, "row array<double>, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    table = np.repeat(np.array([r["row"] for r in rows]), [r["n"] for r in rows], axis=0)
    return ToxicityModel(terms, automaton, _fit(table[:, :-1], table[:, -1]))


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """`docs` with score, the probability of toxicity, and predicted, 1 from 0.5 on. Null and empty texts have no matches.
    Columns of these two names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, text):
            rows = _features(part.column(part.schema.get_field_index(text)), model.automaton)
            score = 1 / (1 + np.exp(-np.clip(rows @ model.weights, -30, 30)))
            yield with_columns(part, {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, extended(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def matches(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: the key, its code points (end exclusive), the term, whether its spelling is exact, and whether it is quoted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, "text"):
            _, doc, kind, term, quoted, first, last = _matches(part.column(1), model.automaton)
            names = pa.array([model.terms[t].text for t in term.tolist()], pa.string())
            columns = [part.column(0).take(pa.array(doc)), pa.array(first), pa.array(last), names, pa.array(kind == levenshtein.EXACT), pa.array(quoted)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "first", "last", "term", "exact", "quoted"])

    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]
    fields += [T.StructField("term", T.StringType()), T.StructField("exact", T.BooleanType()), T.StructField("quoted", T.BooleanType())]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)
