"""Language of texts and of spans inside mixed texts.

Scripts of the letters narrow the candidate languages of each word; letter-trigram scores rate the word under each
candidate; and a Viterbi pass with a switching penalty labels the spans. A text's language is the one whose spans hold
most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm import flat
from lorefield.llm.arrow import extended, with_columns

UNDETERMINED = "und"
FEATURES = 1 << 15
SAMPLE_PER_LANGUAGE = 4000
SWITCH_PENALTY = 8.0
SCRIPT_SHARE = 0.01
BARRED = -1e4
RUN_BYTES = 8 << 20


@dataclass(frozen=True)
class LanguageModel:
    """Languages in text order, log scores [language, trigram], word scores by script and the log share of each language."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray
    prior: np.ndarray


def _words(texts: pa.Array):
    """Letters of the texts: trigram feature, script and text of each, and the words as ranges of letters."""
    chars, bounds = flat.text_chars(texts)
    script = flat.script_table()[np.minimum(chars, 0x10FFFF)]
    start, end, doc = flat.word_bounds(script > 0, bounds)
    at = np.flatnonzero(script)
    low = flat.lower_table()[chars[at]]
    sizes = end - start
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
    before = np.concatenate((np.zeros(1, np.uint32), low[:-1])) if len(low) else low
    after = np.concatenate((low[1:], np.zeros(1, np.uint32))) if len(low) else low
    before, after = before.copy(), after.copy()
    before[first] = 0
    after[first + sizes - 1] = 0
    mix = before * np.uint32(0x85EBCA6B) + low * np.uint32(0xC2B2AE35) + after * np.uint32(0x27D4EB2F)
    feature = (mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
    return feature.astype(np.uint16), script[start], first, sizes, doc, start, bounds


def train(docs: DataFrame, text: str = "text", lang: str = "lang", spread_by: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the labelled rows of `docs`; rows without a language or text teach nothing.

    `per_language` bounds the sample: of each language about so many rows are used, chosen by the hash of `spread_by`,
    and all of them where a language has fewer. Only counts by trigram and script leave the tasks.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_rows"))
    pace = F.pmod(F.xxhash64(F.lit("language sample"), spread_by), F.lit(1_000_000)) / 1e6
    sample = (
        labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), pace.alias("_pace"))
        .join(F.broadcast(counts), "_lang")
        .where(F.col("_pace") * F.col("_rows") < per_language)
        .select("_lang", "_text")
    )
    width = FEATURES + len(flat.SCRIPTS) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in (p for b in batches for p in flat.slices(iter([b]), "_text")):
            feature, script, first, sizes, doc, _, _ = _words(part.column(1))
            names = part.column(0).to_pylist()
            for name in set(names):
                mine = np.array([n == name for n in names])
                got = sums.setdefault(name, np.zeros(width, np.int64))
                got[:FEATURES] += np.bincount(feature[np.repeat(mine[doc], sizes)], minlength=FEATURES)
                got[FEATURES:] += np.bincount(script[mine[doc]], minlength=width - FEATURES)
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(got[at])], ["lang", "place", "n"])

    cells = sample.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = cells.groupBy("lang").agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n")).collect()
    rows.sort(key=lambda r: r["lang"])
    total = np.zeros((max(1, len(rows)), width))
    for i, row in enumerate(rows):
        total[i, row["place"]] = row["n"]
    letters, words = total[:, :FEATURES], total[:, FEATURES:]
    logs = np.log(letters + 0.5) - np.log(letters.sum(1, keepdims=True) + 0.5 * FEATURES)
    share = words / np.maximum(words.sum(1, keepdims=True), 1)
    allowed = share.T >= SCRIPT_SHARE
    barred = np.where(allowed | ~allowed.any(1, keepdims=True), 0.0, BARRED)
    prior = np.log((words.sum(1) + 1) / (words.sum() + len(total)))
    return LanguageModel([r["lang"] for r in rows], (logs - logs.mean(0)).astype(np.float32), barred.astype(np.float32), prior.astype(np.float32))


def _labels(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word by Viterbi, for all texts of a run at once; a step of the loop is one word of each text."""
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate(([0], np.cumsum(counts)))[:-1][order]
    sizes = counts[order]
    label = np.zeros(len(scores), np.int16)
    back = np.zeros(scores.shape, np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest + 1), "left")
    same = np.arange(scores.shape[1], dtype=np.int16)
    value = np.empty((len(order), scores.shape[1]), np.float32)
    for step in range(longest):
        n = active[step]
        at = first[:n] + step
        if not step:
            value[:n] = prior + scores[at]
            continue
        best = value[:n].argmax(1)
        moved = value[np.arange(n), best] - penalty
        stay = value[:n] >= moved[:, None]
        back[at] = np.where(stay, same, best[:, None].astype(np.int16))
        value[:n] = np.where(stay, value[:n], moved[:, None]) + scores[at]
    state = value[: active[0]].argmax(1) if longest else np.empty(0, np.int64)
    for step in range(longest - 1, -1, -1):
        n = active[step]
        at = first[:n] + step
        label[at] = state[:n]
        state[:n] = back[at, state[:n]] if step else state[:n]
    return label


def _analyse(texts: pa.Array, model: LanguageModel, penalty: float):
    feature, script, first, sizes, doc, start, bounds = _words(texts)
    if not len(first):
        return sizes, doc, np.empty(0, np.int16), start, bounds
    # One language at a time: the letters of a run by all languages would be the largest array of the task.
    scores = np.stack([np.add.reduceat(weights[feature], first) for weights in model.weights], axis=1) + model.scripts[script]
    counts = np.bincount(doc, minlength=len(bounds) - 1)
    return sizes, doc, _labels(scores, counts, model.prior, penalty), start, bounds


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """`docs` with lang_pred and score, the share of the letters that lie in spans of that language.

    A null text, or one without letters, gives `und` and 0, as does every text when no language was learned. Equal
    shares fall to the language first in text order. Columns of these two names are replaced; all others stay.
    """
    share = model.languages

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, text, limit=RUN_BYTES):
            column = part.column(part.schema.get_field_index(text))
            sizes, doc, best, _, bounds = _analyse(column, model, penalty)
            held = np.bincount(doc * max(1, len(share)) + best, weights=sizes, minlength=part.num_rows * max(1, len(share)))
            held = held.reshape(part.num_rows, -1)
            total = held.sum(1)
            known = (total > 0) & bool(share)
            names = [share[i] if k else UNDETERMINED for i, k in zip(held.argmax(1), known, strict=True)]
            score = np.where(known, held.max(1) / np.maximum(total, 1), 0.0)
            yield with_columns(part, {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})

    return docs.mapInArrow(label, extended(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def spans(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per labelled span: the key, first and last code point (end exclusive) of its words, and its language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, "text", limit=RUN_BYTES):
            sizes, doc, best, start, bounds = _analyse(part.column(1), model, penalty)
            if not len(doc) or not model.languages:
                continue
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1]))))
            last = np.concatenate((new[1:], [len(doc)])) - 1
            arrays = [
                part.column(0).take(pa.array(doc[new])),
                pa.array(start[new] - bounds[doc[new]]),
                pa.array(start[last] + sizes[last] - bounds[doc[last]]),
                pa.array([model.languages[i] for i in best[new]], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "first", "last", "lang"])

    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("lang", T.StringType())])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, out).withColumnRenamed("key", key)
