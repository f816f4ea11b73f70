"""Entity and relationship records of one chunk, and the mention predictor that feeds them.

A chunk has a bounded number of tokens, so all steps work on arrays inside the chunk's own row:
extraction adds no shuffle to the plan. Only the merge across chunks (see `graph`) moves rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.arrays import explode_rows, let, let_all, scan
from lorefield.functions.sentences import sentence_pieces, sentence_spans, windows
from lorefield.functions.text import (
    MAX_DESCRIPTION_CHARS,
    casefold,
    clean_name,
    keywords_between,
    mention_description,
    py_strip,
)
from lorefield.schemas import MENTION

# --- fixed values ---
ENTITY_LABELS = ("person", "organization", "location", "product", "technology", "event", "concept", "date")
SCORE_THRESHOLD = 0.4
MAX_ENTITIES_PER_CHUNK = 40
MAX_RELATIONS_PER_CHUNK = 60
MAX_ENTITIES_PER_SENTENCE = 5
# --------------------

# Offline predictor: shapes of words, tried in this order. Every shape runs to the end of a word.
WORD_TAIL = r"[\p{L}\p{N}]*"
SHAPES = (
    ("date", r"\d{4}-\d{2}-\d{2}" + WORD_TAIL, 0.95),
    ("person", r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)+", 0.9),
    ("technology", r"\p{Lu}{3,}" + WORD_TAIL, 0.6),
    ("concept", r"\p{L}{12,}" + WORD_TAIL, 0.5),
    ("other", r"\p{Lu}[\p{L}\p{N}]+", 0.3),
)
SHAPE_PATTERN = "|".join(shape for _, shape, _ in SHAPES)
_AT_WORD_START = r"(?<![\p{L}\p{N}])(?:" + SHAPE_PATTERN + ")"

Predictor = Callable[[Column], Column]


def shape_label(mention: Column) -> Column:
    branch = None
    for name, shape, _ in SHAPES:
        test = mention.rlike(f"^(?:{shape})\\z")
        branch = F.when(test, name) if branch is None else branch.when(test, name)
    return branch


def shape_score(label: Column) -> Column:
    branch = None
    for name, _, value in SHAPES:
        branch = F.when(label == name, value) if branch is None else branch.when(label == name, value)
    return branch


def shape_mentions(text: Column) -> Column:
    """Default predictor as a column: array<struct<start, end, text, label, score>> for one window."""

    def place(window: Column, found: Column) -> Column:
        # A mention starts after all the gaps and mentions before it, and after its own gap.
        gaps = F.slice(F.split(window, _AT_WORD_START), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        return scan(
            steps,
            F.lit(0),
            "struct<start:int,end:int,text:string>",
            lambda at, p: (
                F.struct(
                    (at + F.length(p["gap"])).alias("start"),
                    (at + F.length(p["gap"]) + F.length(p["m"])).alias("end"),
                    p["m"].alias("text"),
                ),
                at + F.length(p["gap"]) + F.length(p["m"]),
            ),
        )

    def scored(m: Column) -> Column:
        return let(
            shape_label(m["text"]),
            lambda label: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                m["text"].alias("text"),
                label.alias("label"),
                shape_score(label).alias("score"),
            ),
        )

    return let(
        text,
        lambda window: let(
            F.regexp_extract_all(window, F.lit(_AT_WORD_START), F.lit(0)),
            lambda found: F.transform(place(window, found), scored),
        ),
    )


def accepted(mentions: Column, threshold: float = SCORE_THRESHOLD, labels=ENTITY_LABELS) -> Column:
    """Closed label set and minimum confidence."""
    return F.filter(mentions, lambda m: (m["score"] >= threshold) & m["label"].isin(*labels))


def chunk_mentions(spans: Column, wins: Column, predicted: Column, threshold: float | None) -> Column:
    """Mentions of all windows with chunk offsets, clean name, caseless key and 1-based sentence number `si`.

    `predicted` holds one mention array per window; `si` is 0 when a mention starts before every sentence.
    """

    def in_chunk(starts: Column, window: Column, found: Column) -> Column:
        chosen = accepted(found, threshold) if threshold is not None else found

        def one(m: Column) -> Column:
            return let_all(
                [m["start"] + window["start"], clean_name(m["text"])],
                lambda at, name: F.struct(
                    at.alias("s"),
                    (m["end"] + window["start"]).alias("e"),
                    name.alias("name"),
                    casefold(name).alias("key"),
                    m["label"].alias("label"),
                    m["score"].alias("score"),
                    # As-of lookup: the last sentence that starts at or before the mention.
                    F.size(F.filter(starts, lambda s: s <= at)).alias("si"),
                ),
            )

        return F.transform(chosen, one)

    return let(
        F.transform(spans, lambda p: p["s"]),
        lambda starts: F.filter(
            F.flatten(F.zip_with(wins, predicted, lambda w, found: in_chunk(starts, w, found))),
            lambda m: m["name"] != "",
        ),
    )


def kept_entities(mentions: Column) -> Column:
    """Mentions that stand for the kept entities: the first of each key, best scores first, ties by position."""

    def rank(keys: Column) -> Column:
        firsts = F.transform(
            F.array_distinct(keys), lambda k: F.element_at(mentions, F.array_position(keys, k).cast("int"))
        )
        # The native order of structs: `array_sort` would call a lambda for every comparison.
        ordered = F.sort_array(
            F.transform(firsts, lambda m, i: F.struct((-m["score"]).alias("o"), i.alias("i"), m.alias("m")))
        )
        return F.transform(F.slice(ordered, 1, MAX_ENTITIES_PER_CHUNK), lambda r: r["m"])

    return let(F.transform(mentions, lambda m: m["key"]), rank)


def sentence_pairs(mentions: Column, kept: Column) -> Column:
    """Pairs of kept entities inside one sentence, in order, up to the chunk's cap: array<struct<a, b, si>>.

    At most five mentions of a sentence take part, so a sentence gives at most ten pairs.
    """

    def distinct_slice(ms: Column) -> Column:
        keys = F.transform(ms, lambda m: m["key"])
        firsts = let(keys, lambda ks: F.filter(ms, lambda m, i: F.array_position(ks, m["key"]) == i + 1))
        return F.slice(firsts, 1, MAX_ENTITIES_PER_SENTENCE)

    def pairs(ms: Column) -> Column:
        return F.flatten(
            F.transform(
                ms,
                lambda a, i: F.transform(
                    F.slice(ms, i + 2, F.lit(MAX_ENTITIES_PER_SENTENCE)),
                    lambda b: F.struct(a.alias("a"), b.alias("b"), a["si"].alias("si")),
                ),
            )
        )

    def build(keys: Column) -> Column:
        eligible = F.filter(mentions, lambda m: (m["si"] > 0) & F.array_contains(keys, m["key"]))
        return let(
            eligible,
            lambda ms: F.flatten(
                F.transform(
                    F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["si"]))),
                    lambda si: let(distinct_slice(F.filter(ms, lambda m: m["si"] == si)), pairs),
                )
            ),
        )

    every = let(F.transform(kept, lambda m: m["key"]), build)
    return F.slice(every, 1, MAX_RELATIONS_PER_CHUNK)


def records(text: Column, spans: Column, mentions: Column) -> Column:
    """struct<entities, relationships> of one chunk."""

    def sentence(si: Column) -> Column:
        return let(
            F.element_at(spans, si), lambda span: py_strip(F.substring(text, span["s"] + 1, span["e"] - span["s"]))
        )

    def build(ms: Column, kept: Column) -> Column:
        names = F.map_from_arrays(F.transform(kept, lambda m: m["key"]), F.transform(kept, lambda m: m["name"]))
        entities = F.transform(
            kept,
            lambda m: F.struct(
                m["name"].alias("name"),
                m["label"].alias("type"),
                mention_description(F.when(m["si"] > 0, sentence(m["si"])).otherwise(""), m["name"]).alias("description"),
            ),
        )
        relationships = let(
            names,
            lambda by_key: F.transform(
                sentence_pairs(ms, kept),
                lambda p: F.struct(
                    F.element_at(by_key, p["a"]["key"]).alias("source"),
                    F.element_at(by_key, p["b"]["key"]).alias("target"),
                    keywords_between(text, p["a"]["e"], p["b"]["s"]).alias("keywords"),
                    F.substring(sentence(p["si"]), 1, MAX_DESCRIPTION_CHARS).alias("description"),
                ),
            ),
        )
        return F.struct(entities.alias("entities"), relationships.alias("relationships"))

    return let(mentions, lambda ms: let(kept_entities(ms), lambda kept: build(ms, kept)))


def extract_records(
    chunks: DataFrame,
    content: str = "content",
    predictor: Predictor | None = None,
    threshold: float | None = SCORE_THRESHOLD,
) -> DataFrame:
    """Add `entities` and `relationships` to chunk rows.

    Relationships are pairs of entities named in one sentence. Without a predictor the word shapes above are used
    and everything stays in the JVM; `threshold=None` trusts the predictor's own cut.
    """
    if predictor is None:
        found, entities, relationships = _shape_records(chunks.sparkSession.sparkContext.applicationId, content, threshold)
        return chunks.withColumn("_found", found).select(*chunks.columns, entities.alias("entities"), relationships.alias("relationships"))
    text = F.col(content)
    staged = chunks.withColumn("_spans", sentence_spans(text))
    staged = staged.withColumn("_windows", windows(text, F.col("_spans")))
    staged = staged.withColumn("_found", predictor(F.transform("_windows", lambda w: w["text"])))
    parts = [F.col("_spans"), F.col("_windows"), F.col("_found")]
    done = staged.withColumn("_rec", let_all(parts, lambda *p: _records_from(text, threshold, *p)))
    return done.select(
        *chunks.columns, F.col("_rec.entities").alias("entities"), F.col("_rec.relationships").alias("relationships")
    )


def _records_from(text: Column, threshold: float | None, spans: Column, wins: Column, predicted: Column) -> Column:
    return let(chunk_mentions(spans, wins, predicted, threshold), lambda ms: records(text, spans, ms))


@lru_cache(maxsize=8)
def _shape_records(application: str, content: str, threshold: float | None) -> tuple[Column, Column, Column]:
    """The all-JVM expressions: what is found in the chunk, and its entities and relationships as read from that `_found`.

    They are long, so they are put together once per application and column. A query that asks for one of the two lists
    does not compute the other.
    """
    found = let(
        shape_sentences(F.col(content), threshold),
        lambda sents: F.struct(sents.alias("sents"), kept_entities(_placed_mentions(sents)).alias("kept")),
    )
    entities = let(F.col("_found"), lambda f: _sentence_entities(f["sents"], f["kept"]))
    relationships = let(F.col("_found"), lambda f: _sentence_relationships(f["sents"], f["kept"]))
    return found, entities, relationships


def shape_sentences(text: Column, threshold: float | None) -> Column:
    """Sentences that hold mentions: array<struct<body, piece, found, ms>>.

    No shape crosses a sentence end and no sentence begins inside a word, so reading sentence by sentence finds what the
    packed windows would. `found` are all matches in the piece; `ms` the chosen ones with their number among them.
    """

    def one(piece: Column) -> Column:
        return let(F.regexp_extract_all(piece, F.lit(_AT_WORD_START), F.lit(0)), lambda found: F.struct(piece.alias("piece"), found.alias("found"), chosen(found).alias("ms")))

    def chosen(found: Column) -> Column:
        labelled = F.transform(
            found,
            lambda m, i: let(shape_label(m), lambda label: F.struct(i.alias("i"), m.alias("text"), label.alias("label"), shape_score(label).alias("score"))),
        )
        return accepted(labelled, threshold) if threshold is not None else labelled

    def named(m: Column) -> Column:
        return let(
            clean_name(m["text"]),
            lambda name: F.struct(m["i"].alias("i"), name.alias("name"), casefold(name).alias("key"), m["label"].alias("label"), m["score"].alias("score")),
        )

    holding = F.filter(F.transform(sentence_pieces(text), one), lambda s: F.size(s["ms"]) > 0)
    return F.transform(
        holding, lambda s: F.struct(py_strip(s["piece"]).alias("body"), s["piece"].alias("piece"), s["found"].alias("found"), F.transform(s["ms"], named).alias("ms"))
    )


def _placed_mentions(sents: Column) -> Column:
    """Mentions of all sentences in order, each with the number of its sentence."""
    return F.flatten(
        F.transform(
            sents,
            lambda s, n: F.transform(
                s["ms"], lambda m: F.struct(n.alias("n"), m["name"].alias("name"), m["key"].alias("key"), m["label"].alias("label"), m["score"].alias("score"))
            ),
        )
    )


def _sentence_entities(sents: Column, kept: Column) -> Column:
    return F.transform(
        kept,
        lambda m: F.struct(
            m["name"].alias("name"), m["label"].alias("type"), mention_description(F.element_at(sents, m["n"] + 1)["body"], m["name"]).alias("description")
        ),
    )


def _sentence_relationships(sents: Column, kept: Column) -> Column:
    """Pairs of kept entities inside one sentence, as `sentence_pairs` chooses them."""

    def eligible(ms: Column, keys: Column) -> Column:
        mine = F.when(F.size(keys) < MAX_ENTITIES_PER_CHUNK, ms).otherwise(F.filter(ms, lambda m: F.array_contains(keys, m["key"])))
        return let(mine, _first_of_each)

    def places(s: Column) -> Column:
        """Start and end of every match in the piece."""
        gaps = F.slice(F.split(s["piece"], _AT_WORD_START), 1, F.size(s["found"]))
        steps = F.zip_with(gaps, s["found"], lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n")))
        return scan(
            steps, F.lit(0), "struct<s:int,e:int>", lambda at, p: (F.struct((at + p["gap"]).alias("s"), (at + p["gap"] + p["n"]).alias("e")), at + p["gap"] + p["n"])
        )

    def related(s: Column, ms: Column, by_key: Column) -> Column:
        pairs = lambda at: F.transform(
            _all_pairs(ms),
            lambda p: F.struct(
                F.element_at(by_key, p["a"]["key"]).alias("source"),
                F.element_at(by_key, p["b"]["key"]).alias("target"),
                keywords_between(s["piece"], F.element_at(at, p["a"]["i"] + 1)["e"], F.element_at(at, p["b"]["i"] + 1)["s"]).alias("keywords"),
                F.substring(s["body"], 1, MAX_DESCRIPTION_CHARS).alias("description"),
            ),
        )
        return let(places(s), pairs)

    def build(keys: Column, by_key: Column) -> Column:
        several = F.filter(sents, lambda s: F.size(s["ms"]) > 1)
        chosen = F.transform(several, lambda s: F.struct(s.alias("s"), eligible(s["ms"], keys).alias("ms")))
        return F.flatten(F.transform(F.filter(chosen, lambda c: F.size(c["ms"]) > 1), lambda c: related(c["s"], c["ms"], by_key)))

    every = let(
        F.transform(kept, lambda m: m["key"]),
        lambda keys: let(F.map_from_arrays(keys, F.transform(kept, lambda m: m["name"])), lambda by_key: build(keys, by_key)),
    )
    return F.slice(every, 1, MAX_RELATIONS_PER_CHUNK)


def _first_of_each(ms: Column) -> Column:
    """The first mention of each key, up to the sentence's cap."""
    keys = F.transform(ms, lambda m: m["key"])
    firsts = let(keys, lambda ks: F.filter(ms, lambda m, i: F.array_position(ks, m["key"]) == i + 1))
    return F.slice(firsts, 1, MAX_ENTITIES_PER_SENTENCE)


def _all_pairs(ms: Column) -> Column:
    return F.flatten(
        F.transform(ms, lambda a, i: F.transform(F.slice(ms, i + 2, F.lit(MAX_ENTITIES_PER_SENTENCE)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )


def window_list_predictor(predict: Callable[[list[str]], list[list[dict]]]) -> Predictor:
    """Predictor for `extract_records`: one call per Arrow batch over the windows of all its chunks."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(MENTION)))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sizes = [len(ws) for ws in batch]
            flat = iter(predict([w for ws in batch for w in ws]))
            yield pd.Series(
                [
                    [
                        [
                            {**{f: m[f] for f in ("start", "end", "text", "label")}, "score": float(m.get("score", 1.0))}
                            for m in next(flat)
                        ]
                        for _ in range(n)
                    ]
                    for n in sizes
                ]
            )

    return run


def entity_rows(records: DataFrame, *keys: str) -> DataFrame:
    """One row per extracted entity with its position in the chunk."""
    return explode_rows(records, F.col("entities"), *keys, item="r").select(*keys, "pos", "r.*")


def relationship_rows(records: DataFrame, *keys: str) -> DataFrame:
    return explode_rows(records, F.col("relationships"), *keys, item="r").select(*keys, "pos", "r.*")


def records_json(entities: Column, relationships: Column) -> Column:
    return F.to_json(F.struct(entities.alias("entities"), relationships.alias("relationships")))
