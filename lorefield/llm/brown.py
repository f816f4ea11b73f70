"""Language-model scores from a class-based bigram model (Brown classes found by exchange clustering).

Word counts cover the whole corpus and are never gathered in one place: each run of documents numbers its own words, the
words' hashes meet in buckets of the hash range where their counts are summed, and the counts go back to the runs.

Classes start from units: frequent words are units of their own, all others share the unit of their ending, and exchange
clustering puts the units, which are few, into classes by their neighbours. Then every word of the training documents is
exchanged by itself, half of them in a pass: the runs count the classes before and after each word, the counts are summed in
the words' buckets, each word moves to the class that raises the likelihood most, and the classes go back to the runs. A
pass is kept if the likelihood of the whole corpus has risen.

log P(text) sums log P(class | class before) + log P(word | class). Unknown words, which are in the class of their ending's
unit, share the mass that absolute discounting takes from the known words of the class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefield.llm import flat
from lorefield.session import checkpointed, shared_folder

RUN_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
ENDINGS = 256
FREQUENT_SHARE = 1 / 1024
CLASSES = 48
EXCHANGES = 8
# Passes over all words, each of which moves half of them.
PASSES = 4
# Words of a bucket whose gains are computed together.
GAIN_WORDS = 2048
PRIOR_WEIGHT = 10.0
END = np.uint64(0)
END_UNIT = ENDINGS

RUNS = "run long, n_docs int, doc_ids binary, ids_null binary, training binary, sizes binary, tokens binary, hashes binary, counts binary, endings binary"
RUN_NAMES = [field.split(" ")[0] for field in RUNS.split(", ")]


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: most high bytes are equal."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def _loose(raw: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of documents: their tokens as numbers of the run's distinct words, and those words."""
    run = TaskContext.get().partitionId() << 32
    for part in flat.slices(batches, "text", limit=RUN_BYTES):
        data, bounds = flat.text_bytes(part.column(1))
        data = flat.lower_ascii(data)
        start, end, doc = flat.word_bounds(flat.NOT_SPACE[data], bounds)
        n = part.num_rows
        sizes = np.bincount(doc, minlength=n) + 1
        stops = np.cumsum(sizes) - 1
        hashes = np.full(len(start) + n, END)
        at = np.arange(len(start)) + doc
        hashes[at] = np.maximum(flat.word_hashes(data, start, end), END + np.uint64(1))
        words, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        tail = np.maximum(start, end - 3)
        ending = np.full(len(hashes), END_UNIT, np.int32)
        source = np.full(len(hashes), -1)
        source[at] = np.arange(len(start))
        mine = source[first]
        real = mine >= 0
        units = ending[first]
        units[real] = (flat.word_hashes(data, tail[mine[real]], end[mine[real]]) % np.uint64(ENDINGS)).astype(np.int32)
        training = ~part.column(2).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(number[np.repeat(training, sizes)], minlength=len(words))
        ids = part.column(0)
        columns = (
            ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), training,
            sizes.astype(np.int64), _squeezed(number.astype(np.uint32)), words, _squeezed(counts.astype(np.uint32)), _squeezed(units.astype(np.uint16)),
        )
        assert stops[-1] + 1 == len(hashes)
        packed = [c if isinstance(c, bytes) else c.tobytes() for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([n], pa.int32()), *(pa.array([c], pa.binary()) for c in packed)], RUN_NAMES)
        run += 1


def _array(batch: pa.RecordBatch, name: str, kind, row: int = 0) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)


def _numbers(batch: pa.RecordBatch, name: str, kind, row: int = 0) -> np.ndarray:
    return _loose(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)


def _edges(words: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the buckets of the hash range in sorted words."""
    inner = np.searchsorted(words, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
    return np.concatenate(([0], inner, [len(words)])).astype(np.int64)


def _to_buckets(bits: int):
    """Each run's words, which are sorted, as one row per bucket of the hash range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts, endings = _array(batch, "hashes", np.uint64, i), _numbers(batch, "counts", np.uint32, i), _numbers(batch, "endings", np.uint16, i)
                edges = _edges(words, bits)
                used = np.flatnonzero(np.diff(edges))
                cuts = [slice(a, b) for a, b in zip(edges[used].tolist(), edges[used + 1].tolist(), strict=True)]
                parts = [pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (words,)]
                parts += [pa.array([_squeezed(x[c]) for c in cuts], pa.binary()) for x in (counts, endings)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array(np.full(len(used), batch.column(0)[i].as_py(), np.int64)), *parts],
                    ["bucket", "run", "hashes", "counts", "endings"],
                )

    return cut


SUMMED = "kind int, run long, bucket int, values binary, ranks binary, hashes binary, endings binary"
SUMMED_NAMES = [field.split(" ")[0] for field in SUMMED.split(", ")]


def _sum_bucket(frequent_from: float):
    """Corpus counts of a bucket's words: to each run, with the words' numbers in the bucket (kind 0), and statistics of the
    bucket (kind 1: by ending; 2: frequent words; 3: all words)."""

    def merge(table: pa.Table) -> pa.Table:
        raw = {n: table.column(n).to_pylist() for n in ("hashes", "counts", "endings")}
        hashes = np.frombuffer(b"".join(raw["hashes"]), np.uint64)
        counts, endings = (np.concatenate([_loose(x, k) for x in raw[n]]) for n, k in (("counts", np.uint32), ("endings", np.uint16)))
        words, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, number, counts.astype(np.int64))
        bounds = np.concatenate(([0], np.cumsum([len(h) // 8 for h in raw["hashes"]])))
        back = total[number]
        runs, bucket = table.column("run").to_pylist(), table.column("bucket")[0].as_py()
        slices = zip(runs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        rows = [(0, r, bucket, _squeezed(back[a:b]), _squeezed(np.diff(number[a:b], prepend=0).astype(np.uint32)), None, None) for r, a, b in slices]
        often = (total >= frequent_from) & (words != END)
        rare = (total > 0) & ~often
        unit, mine = endings[first], total[rare]
        shape = [np.bincount(unit[rare], w, minlength=ENDINGS + 1) for w in (mine, np.ones(len(mine)), mine == 1, mine == 2)]
        rows.append((1, None, bucket, np.stack(shape).astype(np.int64).tobytes(), None, None, None))
        rows.append((2, None, bucket, total[often].tobytes(), None, words[often].tobytes(), unit[often].tobytes()))
        rows.append((3, None, bucket, _squeezed(total), None, None, _squeezed(unit)))
        columns = zip(*rows, strict=True)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SUMMED_NAMES)

    return merge


def _units(hashes: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Unit of each word: its ending, the end mark, or its own number if it is frequent."""
    if not len(frequent):
        return endings.astype(np.int64)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, END_UNIT + 1 + at, endings)


def _neighbours(frequent: np.ndarray):
    """Counts of neighbouring units in the training documents, one row per unit and task."""
    size = END_UNIT + 1 + len(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                unit = _units(_array(batch, "hashes", np.uint64, i), _numbers(batch, "endings", np.uint16, i), frequent)
                sizes, training = _array(batch, "sizes", np.int64, i), _array(batch, "training", bool, i)
                now = unit[_numbers(batch, "tokens", np.uint32, i)]
                before = np.concatenate(([END_UNIT], now[:-1]))
                kept = np.repeat(training, sizes)
                sums += np.bincount(before[kept] * size + now[kept], minlength=size * size)
        matrix = sums.reshape(size, size)
        used = np.flatnonzero(matrix.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([matrix[u].tobytes() for u in used], pa.binary())], ["unit", "after"])

    return count


def _sum_rows(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.int64) for x in table.column("after").to_pylist()], axis=0)
    return pa.table([pa.array([table.column("unit")[0].as_py()], pa.int32()), pa.array([total.astype(np.int64).tobytes()], pa.binary())], ["unit", "after"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_clusters(pairs: np.ndarray, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """Class of each unit: units move, one after the other, to the class that raises the bigram likelihood most, until
    a round moves none or `rounds` have passed."""
    units = len(pairs)
    order = np.argsort(-pairs.sum(1), kind="stable")
    label = np.empty(units, np.int64)
    label[order] = np.arange(units) % classes
    member = np.eye(classes)[label]
    table = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            own = pairs[u, u]
            after, before = pairs[u] @ member - own * member[u], pairs[:, u] @ member - own * member[u]
            was = label[u]
            table[was] -= after
            table[:, was] -= before
            table[was, was] -= own
            left, right = table.sum(1), table.sum(0)
            diagonal = np.diag(table)
            gain = (_xlogx(table + after) - _xlogx(table)).sum(1) - _xlogx(diagonal + after) + _xlogx(diagonal)
            gain += (_xlogx(table.T + before) - _xlogx(table.T)).sum(1) - _xlogx(diagonal + before) + _xlogx(diagonal)
            gain += _xlogx(diagonal + after + before + own) - _xlogx(diagonal)
            gain -= _xlogx(left + after.sum() + own) - _xlogx(left) + _xlogx(right + before.sum() + own) - _xlogx(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[was] + 1e-9:
                best = was
            moved += best != was
            label[u] = best
            member[u] = np.eye(classes)[best]
            table[best] += after
            table[:, best] += before
            table[best, best] += own
        if not moved:
            break
    return label


@dataclass(frozen=True)
class ClassModel:
    """Everything that scoring needs besides a word's own count; its size does not depend on the corpus."""

    tokens: int
    types: int
    frequent: np.ndarray
    label: np.ndarray
    transition: np.ndarray
    unit_given_class: np.ndarray
    unit_tokens: np.ndarray
    unit_discount: np.ndarray
    unit_types: np.ndarray


def _model(pairs: np.ndarray, frequent: np.ndarray, shape: np.ndarray, tokens: int, types: int, classes: int) -> ClassModel:
    label = exchange_clusters(pairs, classes)
    member = np.eye(classes)[label]
    counts = pairs.sum(0)
    table, size = member.T @ pairs @ member, counts @ member
    prior = (size + 0.5) / (size.sum() + 0.5 * classes)
    transition = (table + PRIOR_WEIGHT * prior) / (table.sum(1, keepdims=True) + PRIOR_WEIGHT)
    units = (counts + 0.5) / ((size + 0.5 * member.sum(0))[label])
    n_tokens, n_types, once, twice = (np.concatenate((s, np.zeros(len(frequent)))) for s in shape)
    taken = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9)
    return ClassModel(tokens, types, frequent, label, np.log10(transition), np.log10(units), n_tokens, taken, n_types)


@dataclass(frozen=True)
class Start:
    """Where the words' classes come from before they are exchanged: the classes of the units."""

    frequent: np.ndarray
    label: np.ndarray
    frequent_from: float
    bits: int
    classes: int

    def labels(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        return self.label[_units(hashes, endings, self.frequent)]


def _labels(batch: pa.RecordBatch, row: int, start: Start) -> np.ndarray:
    """Class of each word of a run: what the buckets have sent, or that of its unit."""
    sent = batch.column(batch.schema.get_field_index("labels"))[row].as_py() if "labels" in batch.schema.names else None
    if sent is None:
        return start.labels(_array(batch, "hashes", np.uint64, row), _numbers(batch, "endings", np.uint16, row))
    return np.concatenate([_loose(x["labels"], np.uint16) for x in sent]).astype(np.int64)


def _class_pairs(start: Start):
    """Counts of neighbouring classes in the training documents, summed by task."""
    size = start.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                label, sizes, training = _labels(batch, i, start), _array(batch, "sizes", np.int64, i), _array(batch, "training", bool, i)
                now = label[_numbers(batch, "tokens", np.uint32, i)]
                # The end mark, whose hash is the least, is a run's first word.
                before = np.concatenate((label[:1], now[:-1]))
                kept = np.repeat(training, sizes)
                sums += np.bincount(before[kept] * size + now[kept], minlength=size * size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(sums)], ["place", "n"])

    return count


MOVING = "bucket int, kind int, run long, a binary, b binary, c binary"
MOVING_NAMES = [field.split(" ")[0] for field in MOVING.split(", ")]


def _contexts(start: Start, turn: int):
    """How often each word of this turn comes before (codes from 0) and after (from the number of classes) words of each
    class, and after itself (the last code), in the training documents of a run: a row per bucket of words."""
    size, codes = start.classes, 2 * start.classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, sizes, training = _labels(batch, i, start), _array(batch, "sizes", np.int64, i), _array(batch, "training", bool, i)
                hashes, token = _array(batch, "hashes", np.uint64, i), _numbers(batch, "tokens", np.uint32, i).astype(np.int64)
                kept = np.repeat(training, sizes)
                now, before = token[kept], np.concatenate(([0], token[:-1]))[kept]
                own = now == before
                moves = (hashes & np.uint64(1)) == np.uint64(turn % 2)
                parts = [(before[~own], label[now[~own]]), (now[~own], size + label[before[~own]]), (now[own], np.full(own.sum(), 2 * size))]
                key, n = np.unique(np.concatenate([w[moves[w]] * codes + c[moves[w]] for w, c in parts]), return_counts=True)
                word, code = key // codes, key % codes
                edges = _edges(hashes, start.bits)
                cuts = np.searchsorted(word, edges)
                used = np.flatnonzero(np.diff(cuts))
                rows = [(word[x:y] - edges[k], code[x:y], n[x:y]) for k, x, y in zip(used.tolist(), cuts[used].tolist(), cuts[used + 1].tolist(), strict=True)]
                packed = [[_squeezed(np.diff(w, prepend=0).astype(np.uint32)), _squeezed(c.astype(np.uint16)), _squeezed(m.astype(np.uint32))] for w, c, m in rows]
                run = batch.column(batch.schema.get_field_index("run"))[i].as_py()
                columns = [pa.array(used, pa.int32()), pa.array(np.full(len(used), 4), pa.int32()), pa.array(np.full(len(used), run), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([p[j] for p in packed], pa.binary()) for j in range(3)], MOVING_NAMES)

    return count


def word_gains(table: np.ndarray, was: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gain in likelihood of each word in each class over being in none, by the classes around it, while all others stay.

    `word`, sorted, numbers the words of `was`, their classes in `table`; `code` and `n` are those of `_contexts`.
    """
    size, words = len(table), len(was)
    after, before, own = np.zeros((words, size)), np.zeros((words, size)), np.zeros(words)
    kinds = code // size
    after[word[kinds == 0], code[kinds == 0]] = n[kinds == 0]
    before[word[kinds == 1], code[kinds == 1] - size] = n[kinds == 1]
    own[word[kinds == 2]] = n[kinds == 2]
    at = np.arange(words)
    gain = np.zeros((words, size))
    for kind, cells, other in ((0, table.T, before), (1, table, after)):
        mine = np.flatnonzero(kinds == kind)
        if not len(mine):
            continue
        w, j, m = word[mine], code[mine] - kind * size, n[mine].astype(float)
        row = np.arange(len(mine))
        base = cells[j]
        base[row, was[w]] -= m
        same = j == was[w]
        base[same] -= other[w[same]]
        base[row[same], j[same]] -= own[w[same]]
        more = _xlogx(base + m[:, None]) - _xlogx(base)
        more[row, j] = 0
        begins = np.flatnonzero(np.concatenate(([True], np.diff(w) != 0)))
        gain[w[begins]] += np.add.reduceat(more, begins)
    diagonal = np.tile(np.diag(table), (words, 1))
    diagonal[at, was] -= after[at, was] + before[at, was] + own
    gain += _xlogx(diagonal + after + before + own[:, None]) - _xlogx(diagonal)
    for sums, mine in ((table.sum(1), after), (table.sum(0), before)):
        taken = mine.sum(1) + own
        left = np.tile(sums, (words, 1))
        left[at, was] -= taken
        gain -= _xlogx(left + taken[:, None]) - _xlogx(left)
    return gain


def _moved(table: np.ndarray, codes: int):
    """Classes of a bucket's words after a pass: to each run (kind 0), and all of them (kind 3)."""

    def move(rows: pa.Table) -> pa.Table:
        kinds, runs = rows.column("kind").to_pylist(), rows.column("run").to_pylist()
        a, b, c = (rows.column(x).to_pylist() for x in "abc")
        label = _loose(a[kinds.index(3)], np.uint16).astype(np.int64)
        ranks = {r: np.cumsum(_loose(x, np.uint32).astype(np.int64)) for k, r, x in zip(kinds, runs, a, strict=True) if k == 0}
        found = [(ranks[r][np.cumsum(_loose(x, np.uint32).astype(np.int64))], _loose(y, np.uint16), _loose(z, np.uint32)) for k, r, x, y, z in zip(kinds, runs, a, b, c, strict=True) if k == 4]
        if found:
            word, code, n = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            key, place = np.unique(word * codes + code, return_inverse=True)
            n = np.bincount(place, n).astype(np.int64)
            word, code = key // codes, key % codes
            some = np.unique(word)
            for x in range(0, len(some), GAIN_WORDS):
                mine = some[x : x + GAIN_WORDS]
                part = slice(*np.searchsorted(word, (mine[0], mine[-1] + 1)))
                was = label[mine]
                gain = word_gains(table, was, np.searchsorted(mine, word[part]), code[part], n[part])
                best, at = gain.argmax(1), np.arange(len(mine))
                label[mine] = np.where(gain[at, best] > gain[at, was] + 1e-9, best, was)
        label, bucket = label.astype(np.uint16), rows.column("bucket")[0].as_py()
        out = [(bucket, 0, r, _squeezed(label[x]), None, None) for r, x in ranks.items()] + [(bucket, 3, None, _squeezed(label), None, None)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], MOVING_NAMES)

    return move


def _first_labels(start: Start):
    """Each bucket's words in the classes of their units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                total, unit, bucket = _numbers(batch, "values", np.int64, i), _numbers(batch, "endings", np.uint16, i).astype(np.int64), batch.column(0)[i].as_py()
                # Buckets are ranges of the hashes, by which frequent words are numbered.
                often = (total >= start.frequent_from) & (unit != END_UNIT)
                low = np.searchsorted(start.frequent, np.uint64(bucket << (64 - start.bits))) if start.bits else 0
                unit[often] = END_UNIT + 1 + low + np.arange(often.sum())
                row = (bucket, 3, None, _squeezed(start.label[unit].astype(np.uint16)), None, None)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], MOVING_NAMES)

    return run


def _class_shapes(classes: int):
    """Types, and types that come once and twice, of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(3 * classes, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total, label = _numbers(batch, "values", np.int64, i), _numbers(batch, "a", np.uint16, i).astype(np.int64)
                got += np.concatenate([np.bincount(label[x], minlength=classes) for x in (total > 0, total == 1, total == 2)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(got)], ["place", "n"])

    return run


def _summed(cells: DataFrame, size: int) -> np.ndarray:
    sums = np.zeros(size)
    for cell in cells.groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[cell["place"]] = cell["n"]
    return sums


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to what does not depend on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


@dataclass(frozen=True)
class WordModel:
    """Everything that scoring needs besides each word's own count and class; its size does not depend on the corpus."""

    tokens: int
    types: int
    start: Start
    transition: np.ndarray
    size: np.ndarray
    discount: np.ndarray
    unknown: np.ndarray
    """log10 P(unknown word of the ending | class of the ending)"""


def _transition(table: np.ndarray) -> np.ndarray:
    size, classes = table.sum(0), len(table)
    prior = (size + 0.5) / (size.sum() + 0.5 * classes)
    return np.log10((table + PRIOR_WEIGHT * prior) / (table.sum(1, keepdims=True) + PRIOR_WEIGHT))


def _word_model(units: ClassModel, start: Start, table: np.ndarray, shape: np.ndarray) -> WordModel:
    """`shape`: of each class the types, and those that come once and twice."""
    size = table.sum(0)
    types, once, twice = shape
    # Where something was learnt the end mark is known.
    endings = np.arange(ENDINGS if units.tokens else ENDINGS + 1)
    kind, share = units.label[endings], 10 ** units.unit_given_class[endings]
    shares = np.bincount(kind, share, minlength=start.classes)
    taken = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9) * (shares > 0)
    mass = np.where(size > 0, taken * types / np.maximum(size, 1), 1.0)
    unknown = np.full(ENDINGS + 1, -np.inf)
    unknown[endings] = np.log10(np.maximum(mass[kind] * share / shares[kind], 1e-300))
    return WordModel(units.tokens, units.types, start, _transition(table), size, taken, unknown)


def _score(model: WordModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                endings, sizes = _numbers(batch, "endings", np.uint16, i), _array(batch, "sizes", np.int64, i)
                count = np.concatenate([_loose(x["values"], np.int64) for x in batch.column(batch.schema.get_field_index("parts"))[i].as_py()])
                label = _labels(batch, i, model.start)
                base = np.log10((count + 1) / (model.tokens + 1 * (model.types + 1)))
                known = np.log10(np.maximum(count - model.discount[label], 1e-300) / np.maximum(model.size[label], 1))
                emitted = np.where(count > 0, known, model.unknown[endings])
                token = _numbers(batch, "tokens", np.uint32, i)
                kind = label[token]
                before = np.concatenate((label[:1], kind[:-1]))
                first = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, first)
                doc_ids = pa.array(_array(batch, "doc_ids", np.int64, i), mask=_array(batch, "ids_null", bool, i))
                columns = [~_array(batch, "training", bool, i), sizes, add((count > 0)[token].astype(np.int64)), add(base[token]), add(emitted[token] + model.transition[before, kind])]
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _by_run(df: DataFrame, size: int) -> DataFrame:
    """A stored table whose rows need not be moved to be joined by run."""
    name, path = f"lm_runs_{uuid.uuid4().hex}", shared_folder(df.sparkSession, "table")
    buckets = max(df.sparkSession.sparkContext.defaultParallelism, 1 + size // (8 * RUN_BYTES))
    df.write.bucketBy(buckets, "run").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = "held_out", classes: int = CLASSES) -> DataFrame:
    """One row per row of `docs`: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from the rows whose `held_out` is false. Tokens are the words between ASCII white space, A-Z lower-cased, and
    one end mark per text; a null or empty text is the end mark alone. base_score is the add-one unigram score. With
    nothing to learn from, all words are unknown and scores are those of the smoothing alone. No rows give no rows.
    """
    given = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(held_out).alias("held_out"))
    size = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, int(size // BUCKET_BYTES).bit_length())
    runs = _by_run(given.mapInArrow(_read_runs, RUNS), size)
    buckets = runs.select("run", "hashes", "counts", "endings").mapInArrow(_to_buckets(bits), "bucket int, run long, hashes binary, counts binary, endings binary")

    def tokens_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(_numbers(batch, "counts", np.uint32, i).sum()) for i in range(batch.num_rows)], pa.int64())], ["n"])

    tokens = runs.select("counts").mapInArrow(tokens_in, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    frequent_from = max(1.0, tokens * FREQUENT_SHARE)
    summed = checkpointed(buckets.groupBy("bucket").applyInArrow(_sum_bucket(frequent_from), SUMMED), "kind")
    often = summed.where("kind = 2 AND length(values) > 0").select("values", "hashes", "endings").collect()
    frequent = np.sort(np.frombuffer(b"".join(bytes(r["hashes"]) for r in often), np.uint64))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(4 * (ENDINGS + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                got += _array(batch, "values", np.int64, i)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(got)], ["place", "n"])

    shape = _summed(summed.where("kind = 1").select("values").mapInArrow(shapes, "place long, n long"), 4 * (ENDINGS + 1)).reshape(4, -1)
    types = int(shape[1].sum()) + len(frequent)
    width = END_UNIT + 1 + len(frequent)
    rows = runs.select("hashes", "endings", "sizes", "training", "tokens").mapInArrow(_neighbours(frequent), "unit int, after binary")
    pairs = np.zeros((width, width))
    for row in rows.groupBy("unit").applyInArrow(_sum_rows, "unit int, after binary").collect():
        pairs[row["unit"]] = np.frombuffer(row["after"], np.int64)
    units = _model(pairs, frequent, shape, tokens, types, classes)
    start = Start(frequent, units.label, frequent_from, bits, classes)
    member = np.eye(classes)[units.label]
    table = member.T @ pairs @ member

    def with_labels(sent: DataFrame | None, *columns: str) -> DataFrame:
        if sent is None:
            return runs.select("run", *columns)
        back = sent.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("bucket", "labels"))).alias("labels"))
        return runs.select("run", *columns).join(back, "run")

    ranks = summed.where("kind = 0").select("bucket", "kind", "run", F.col("ranks").alias("a"), *(F.lit(None).cast("binary").alias(x) for x in "bc"))
    state, sent = summed.where("kind = 3").select("bucket", "values", "endings").mapInArrow(_first_labels(start), MOVING), None
    for turn in range(PASSES):
        around = with_labels(sent, "hashes", "endings", "sizes", "training", "tokens").mapInArrow(_contexts(start, turn), MOVING)
        rows = ranks.unionByName(state).unionByName(around)
        moved = checkpointed(rows.groupBy("bucket").applyInArrow(_moved(table, 2 * classes + 1), MOVING), "kind")
        now = moved.where("kind = 0").select("run", "bucket", F.col("a").alias("labels"))
        cells = with_labels(now, "sizes", "training", "tokens").mapInArrow(_class_pairs(start), "place long, n long")
        pairs_now = _summed(cells, classes * classes).reshape(classes, classes)
        if likelihood(pairs_now) > likelihood(table):
            table, sent, state = pairs_now, now, moved.where("kind = 3").select(*MOVING_NAMES)

    labelled = summed.where("kind = 3").select("bucket", "values").join(state.select("bucket", "a"), "bucket").select("values", "a")
    model = _word_model(units, start, table, _summed(labelled.mapInArrow(_class_shapes(classes), "place long, n long"), 3 * classes).reshape(3, -1))
    back = summed.where("kind = 0").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("bucket", "values"))).alias("parts"))
    core = ["doc_ids", "ids_null", "training", "sizes", "tokens", "endings"] + (["hashes"] if sent is None else [])
    scored = with_labels(sent, *core).join(back, "run").mapInArrow(
        _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
