"""Quality of texts from statistics of the document alone.

Every text becomes a row of small whole numbers. Random Fourier features of these approximate a Gaussian kernel; each task
sums its part of the normal equations, a ridge solution of the sum gives raw scores, and an isotonic step, fitted on
labelled documents that the ridge has not seen, turns them into probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm import flat
from lorefield.llm.arrow import extended, ragged, with_columns
from lorefield.session import checkpointed

FEATURES = 256
SEED = 20240611
RIDGE = 1e-4
CALIBRATION_SHARE = 4
PREDICT_FROM = 0.7
#: Statistics are kept in 1024ths, features in 2**-14, raw scores for calibration in 1024ths.
UNIT = 1 << 10
FEATURE_UNIT = 1 << 14
LARGEST = 32.0
#: Standard deviations beyond which a statistic counts no further.
FAR = 4.0
LONG_WORD, SHORT_WORD = 15, 3

SYMBOL, SPACE, DIGIT, LETTER, CAPITAL, PUNCTUATION = range(6)
#: Marks of ordinary prose (fixed values).
PROSE_MARKS = ".,;:!?'\"()-‐–—‘’‚“”„…«»¡¿、。"
STATISTICS = (
    "characters", "words", "word length", "word length deviation", "letters", "digits", "capitals", "spaces", "prose marks", "symbols", "not ascii",
    "words ending in a symbol", "words ending in a mark", "words without letters", "capitalised words", "words in capitals", "short words", "long words",
    "distinct words", "most frequent word", "distinct pairs", "word again", "distinct lines", "line length", "exclamations",
)


@dataclass(frozen=True)
class QualityModel:
    """Without weights every text gets `share`."""

    share: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] in "LM":
            kinds[c] = CAPITAL if category in ("Lu", "Lt") else LETTER
        elif category[0] == "N":
            kinds[c] = DIGIT
        elif category[0] == "Z":
            kinds[c] = SPACE
    kinds[[0x20, *range(0x09, 0x0E)]] = SPACE
    kinds[[ord(c) for c in PROSE_MARKS]] = PUNCTUATION
    return kinds


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of each text, and how often the most frequent one stands there."""
    _, first, times = np.unique(flat.mixed(hashes ^ (doc.astype(np.uint64) * np.uint64(flat.STEP))), return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[first], times)
    return np.bincount(doc[first], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text, in whole 1024ths; null and empty texts give zeros."""
    chars, bounds = flat.text_chars(texts)
    chars, n = np.minimum(chars, 0x10FFFF), len(texts)
    kind, low = _kinds()[chars], flat.lower_table()[chars]
    folded = ((low ^ (low >> 8)) & 0xFF).astype(np.uint8)

    def within(mask: np.ndarray, at: np.ndarray = bounds[:-1], to: np.ndarray = bounds[1:]) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask)))
        return run[to] - run[at]

    size = np.diff(bounds)
    letters, capitals = within((kind == LETTER) | (kind == CAPITAL)), within(kind == CAPITAL)
    start, end, doc = flat.word_bounds(kind != SPACE, bounds)
    length = (end - start).astype(np.float64)
    words = np.bincount(doc, minlength=n)
    per_word = lambda mask: _share(np.bincount(doc[mask], minlength=n), words)
    mean = _share(np.bincount(doc, length, n), words)
    deviation = np.sqrt(np.maximum(_share(np.bincount(doc, length * length, n), words) - mean * mean, 0))
    in_letters, in_capitals = within((kind == LETTER) | (kind == CAPITAL), start, end), within(kind == CAPITAL, start, end)
    hashes = flat.word_hashes(folded, start, end)
    distinct, top = _distinct(hashes, doc, n)
    beside = doc[1:] == doc[:-1]
    pairs = np.bincount(doc[1:][beside], minlength=n)
    distinct_pairs, _ = _distinct((hashes[:-1] * np.uint64(flat.STEP) + hashes[1:])[beside], doc[1:][beside], n)
    again = np.bincount(doc[1:][beside & (hashes[1:] == hashes[:-1])], minlength=n)
    line_start, line_end, line_doc = flat.word_bounds(chars != 0x0A, bounds)
    lines = np.bincount(line_doc, minlength=n)
    distinct_lines, _ = _distinct(flat.word_hashes(folded, line_start, line_end), line_doc, n)
    last = kind[end - 1]
    table = np.column_stack(
        [
            np.log1p(size), np.log1p(words), mean, deviation, _share(letters, size), _share(within(kind == DIGIT), size), _share(capitals, letters), _share(within(kind == SPACE), size),
            _share(within(kind == PUNCTUATION), size), _share(within(kind == SYMBOL), size), _share(within(chars > 0x7F), size),
            per_word(last == SYMBOL), per_word(last == PUNCTUATION), per_word(in_letters == 0), per_word(kind[start] == CAPITAL), per_word((in_letters > 1) & (in_letters == in_capitals)),
            per_word(length <= SHORT_WORD), per_word(length > LONG_WORD), _share(distinct, words), _share(top, words), _share(distinct_pairs, pairs), _share(again, pairs),
            _share(distinct_lines, lines), np.log1p(_share(within(chars != 0x0A), lines)), _share(within(chars == 0x21), words),
        ]
    )
    return np.rint(np.minimum(table, LARGEST) * UNIT).astype(np.int32)


def describe(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Rows without their text, with its statistics in `out`, which replaces a column of that name."""
    rows = docs.drop(out) if out != text else docs
    schema = extended(rows.drop(text), [T.StructField(out, T.ArrayType(T.IntegerType()))])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, text):
            found = statistics(part.column(part.schema.get_field_index(text)))
            yield with_columns(part.select(kept), {out: ragged(pa.array(found.ravel()), np.full(len(found), found.shape[1]))})

    return rows.mapInArrow(run, schema)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def fourier(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Whole numbers: cosines of random projections, whose products approximate a Gaussian kernel, and a constant."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(stats.shape[1], features)) / np.sqrt(stats.shape[1])
    shift = rng.uniform(0, 2 * np.pi, features)
    standard = np.clip((stats - mean) / spread, -FAR, FAR)
    return np.column_stack([np.rint(np.cos(standard @ directions + shift) * FEATURE_UNIT), np.full(len(stats), FEATURE_UNIT)])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, len(STATISTICS)), np.int64)
    for batch in batches:
        x = _rows(batch.column(0)).astype(np.int64)
        total += np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], ["i", "x", "xx", "n"])


def _equations(mean: np.ndarray, spread: np.ndarray) -> Callable:
    """A task's part of the normal equations, a row of whole numbers for each unknown: its products with all unknowns, and with the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2), np.int64)
        for batch in batches:
            z, y = fourier(_rows(batch.column(0)), mean, spread), np.asarray(batch.column(1)).astype(np.float64)
            # Whole numbers below 2**53: the sums are exact in whatever order they are made.
            total += (z.T @ np.column_stack([z, y])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "row"])

    return run


def _raw(stats: np.ndarray, model: QualityModel) -> np.ndarray:
    return fourier(stats, model.mean, model.spread) @ model.weights


def _grid(raw: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(raw, -2, 3) * UNIT).astype(np.int64)


def _placed(model: QualityModel) -> Callable:
    """Labelled rows by raw score in 1024ths: (at, n, good)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, inverse = np.unique(_grid(_raw(_rows(batch.column(0)), model)), return_inverse=True)
            good = np.bincount(inverse, np.asarray(batch.column(1)), len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(inverse, minlength=len(at)).astype(np.int64)), pa.array(good)], ["at", "n", "good"])

    return run


def isotonic(at: list[int], n: list[int], good: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing shares of good rows: neighbours that fall are pooled. (mean place, share) of each pool, by place."""
    pools: list[list[float]] = []
    for x, count, hits in sorted(zip(at, n, good, strict=True)):
        pools.append([x * count, count, hits])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def train(described: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", stats: str = "stats") -> QualityModel:
    """Learn from the statistics of all documents that `labels` (key, label 0 or 1) names; every such row counts.

    Of these, about one key in `CALIBRATION_SHARE`, by its hash, is left to the isotonic step. Other labels and null keys teach
    nothing; a key with several labels is good only if all say so. Without labelled rows every text scores one half, and with
    one class only that class.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "_key"), F.lit(CALIBRATION_SHARE)) == 0
    rows = checkpointed(described.select(F.col(key).alias("_key"), F.col(stats).alias("stats")).join(known, "_key").select("stats", "_label", apart.alias("_apart")))
    sums = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sums.get(1, 0) / sum(sums.values()) if sums else 0.5
    fitting = rows.where(~F.col("_apart"))
    moments = sorted(fitting.select("stats").mapInArrow(_moments, "i int, x long, xx long, n long").groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("x", "xx", "n"))).collect())
    if len(sums) < 2 or not moments or not moments[0].n:
        return QualityModel(share)
    n = int(moments[0].n)
    mean = np.array([int(r.x) / n for r in moments])
    spread = np.sqrt(np.array([max(int(r.xx) * n - int(r.x) ** 2, 0) / n**2 for r in moments]))
    spread = np.where(spread > 0, spread, UNIT)

    parts = fitting.select("stats", "_label").mapInArrow(_equations(mean, spread), "i int, row array<long>").select("i", F.posexplode("row").alias("j", "x"))
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    # As many numbers as the model has unknowns, squared.
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        system[r.i, r.j] = float(r.x)
    products, towards = system[:, :-1] / FEATURE_UNIT**2, system[:, -1] / FEATURE_UNIT
    # The constant is not held back.
    held = RIDGE * n * np.diag([1.0] * FEATURES + [0.0])
    model = QualityModel(share, mean, spread, np.linalg.solve(products + held, towards) / FEATURE_UNIT)

    cells = rows.where("_apart").select("stats", "_label").mapInArrow(_placed(model), "at long, n long, good long")
    placed = cells.groupBy("at").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    if not placed:
        return QualityModel(share, mean, spread, model.weights)
    return QualityModel(share, mean, spread, model.weights, isotonic(*zip(*((r["at"], r["n"], r["good"]) for r in placed), strict=True)))


def probabilities(stats: np.ndarray, model: QualityModel) -> np.ndarray:
    """Between the pools of the isotonic step scores follow straight lines; without one the raw score is cut to 0 and 1."""
    if model.weights is None:
        return np.full(len(stats), model.share)
    raw = _raw(stats, model)
    return np.clip(raw, 0, 1) if model.steps is None else np.interp(np.clip(raw, -2, 3) * UNIT, *model.steps)


def score(described: DataFrame, model: QualityModel, stats: str = "stats") -> DataFrame:
    """Described rows without their statistics, with score, the probability of good quality, and predicted, 1 from 0.7 on.
    Columns of these two names are replaced. Null and empty texts are scored by their statistics, which are zeros."""
    schema = extended(described.drop(stats), [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = probabilities(_rows(batch.column(batch.schema.get_field_index(stats))), model)
            yield with_columns(batch.select(kept), {"score": pa.array(found), "predicted": pa.array((found >= PREDICT_FROM).astype(np.int32))})

    return described.mapInArrow(run, schema)
