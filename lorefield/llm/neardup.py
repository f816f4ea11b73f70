"""Near duplicates by MinHash bands with sequential Bayesian verification.

1. Each text becomes its set of word shingles and a MinHash signature; texts with the same set are one class.
2. Classes that share a band meet in a bucket. Small buckets give all their pairs. In a large one a few pivots meet all
   members; then the members outside the bucket's largest linked part meet all others, block against block inside a
   task, which hands on only the links it finds. No pair of a bucket goes unseen unless its sides are already linked.
3. Signatures of a pair are compared batch by batch, and the pair is given up as soon as the posterior probability of
   the wanted similarity falls below the chosen miss probability. Survivors are compared on their full shingle sets.
4. Linked classes form components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefield.llm import flat
from lorefield.operators.graph import connected_components
from lorefield.session import checkpointed

SHINGLE = 5
LINK_PARTS = (80, 100)
BANDS = 24
ROWS_PER_BAND = 4
HASHES = BANDS * ROWS_PER_BAND
COMPARE_BATCH = 16
MISS_PROBABILITY = 1e-6
SMALL_BUCKET = 6
RANDOM_PIVOTS = 2
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
LAST_ID = (1 << 63) - 1

_SEEDS = np.random.default_rng(19991)
MULTIPLY = _SEEDS.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _SEEDS.integers(0, 1 << 63, HASHES, np.uint64)
PLACES = _SEEDS.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end, sorted inside each text, and their offsets.

    A text of fewer words than `size`, but not none, has its whole word sequence as its one shingle.
    """
    data, bounds = flat.text_bytes(texts)
    data = flat.lower_ascii(data)
    start, end, doc = flat.word_bounds(flat.NOT_SPACE[data], bounds)
    words = flat.word_hashes(data, start, end)
    counts = np.bincount(doc, minlength=len(bounds) - 1)
    first = np.cumsum(counts) - counts
    spans = max(0, len(words) - size + 1)
    summed = reduce(np.add, (words[j : j + spans] * PLACES[j] for j in range(size))) if spans else np.empty(0, np.uint64)
    summed = flat.mixed(summed)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (at, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        if n >= size:
            own = np.sort(summed[at : at + n - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            short = (words[at : at + n] * PLACES[size : size + n]).sum(dtype=np.uint64) + np.uint64(n)
            own = flat.mixed(np.array([short], np.uint64))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def _fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each text's whole set as two signed numbers."""
    raw = hashes.tobytes()
    out = b"".join(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values [text, hash] of the texts that have shingles."""
    first = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(first), HASHES), np.uint64)
    if len(first):
        for i in range(HASHES):
            out[:, i] = np.minimum.reduceat(hashes * MULTIPLY[i] + ADD[i], first)
    return out


SIGNED = "row long, doc long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for part in flat.slices(batches, "text", limit=2 << 20):
            hashes, bounds = shingle_sets(part.column(1), size)
            sizes = np.diff(bounds)
            marks = _fingerprints(hashes, bounds)
            values = _signatures(hashes, bounds)
            n, m = part.num_rows, len(values)
            folded = (values.reshape(m, BANDS, ROWS_PER_BAND) * PLACES[:ROWS_PER_BAND]).sum(2, dtype=np.uint64)
            bands = flat.mixed(folded + np.arange(BANDS, dtype=np.uint64) * PLACES[-1]).view(np.int64)
            low = (flat.mixed(values) & np.uint64(255)).astype(np.uint8)
            full = sizes > 0
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))), pa.int32())
            places = iter(low)
            signature = pa.array([next(places).tobytes() if f else None for f in full.tolist()], pa.binary())
            arrays = [pa.array(row + np.arange(n)), part.column(0), pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())), signature], SIGNED_NAMES)
            row += n

    return run


SIGNED_NAMES = [field.split(" ")[0] for field in SIGNED.split(", ")]


@lru_cache(maxsize=4)
def least_matches(similarity: float, miss: float) -> np.ndarray:
    """For n compared hashes, the fewest equal ones at which a pair stays: below it, the posterior probability of
    `similarity` or more, under a uniform prior on the similarity, is less than `miss`. Values of 8 bits also agree by chance."""
    grid = (np.arange(20000) + 0.5) / 20000
    agree = grid + (1 - grid) / 256
    least = np.zeros(HASHES + 1, np.int64)
    for n in range(COMPARE_BATCH, HASHES + 1, COMPARE_BATCH):
        for m in range(n + 1):
            logs = m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(logs - logs.max())
            if weight[grid >= similarity].sum() >= miss * weight.sum():
                least[n] = m
                break
    return least


def _survivors(parts: tuple[int, int], miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(parts[0] / parts[1], miss)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            live, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for at in range(0, HASHES, COMPARE_BATCH):
                matches[live] += (a[live, at : at + COMPARE_BATCH] == b[live, at : at + COMPARE_BATCH]).sum(1)
                live = live[matches[live] >= least[at + COMPARE_BATCH]]
            kept = batch.select([0, 1]).take(pa.array(live))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches[live])], ["a", "b", "matches"])

    return run


def _exact(size: int, parts: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(iter([batch]), "text_a", limit=1 << 20):
                (ha, ba), (hb, bb) = (shingle_sets(part.column(i), size) for i in (2, 3))
                linked = []
                for i in range(part.num_rows):
                    x, y = ha[ba[i] : ba[i + 1]], hb[bb[i] : bb[i + 1]]
                    shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    linked.append(parts[1] * shared >= parts[0] * (len(x) + len(y) - shared))
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _texts_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(cls, text) of the classes' own documents; of rows with one id the one with the class's set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in flat.slices(batches, "text"):
            marks = _fingerprints(*shingle_sets(part.column(3), size))
            same = (marks[:, 0] == part.column(1).to_numpy()) & (marks[:, 1] == part.column(2).to_numpy())
            yield part.select([0, 3]).filter(pa.array(same))

    found = docs.join(classes.select("doc", "cls", "s1", "s2"), "doc").select("cls", "s1", "s2", "text")
    return found.mapInArrow(mark, "cls long, text string").dropDuplicates(["cls"])


def _pairs_of_small(members: DataFrame) -> DataFrame:
    """All pairs of the buckets that have at most SMALL_BUCKET members."""
    lists = members.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_set("cls")).alias("all"))
    tails = lists.select(F.posexplode("all").alias("i", "a"), "all").where(F.col("i") + 1 < F.size("all"))
    return tails.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))


def _first_pivots(members: DataFrame) -> DataFrame:
    """Per large bucket the member that meets most others in all its buckets, and a few chosen by hash."""
    # A class has at most BANDS buckets, so its weight goes to them as a list and not by a join of all memberships.
    large = F.collect_list(F.when(F.col("size") > SMALL_BUCKET, F.col("bucket")))
    weighed = members.groupBy("cls").agg(F.sum("size").alias("weight"), large.alias("buckets")).select("cls", "weight", F.explode("buckets").alias("bucket"))
    marks = [F.max(F.struct("weight", "cls")).alias("p0")]
    marks += [F.min(F.struct(F.xxhash64("cls", F.lit(i)).alias("mark"), "cls")).alias(f"p{i}") for i in range(1, RANDOM_PIVOTS + 1)]
    wide = weighed.groupBy("bucket").agg(*marks)
    names = F.array_distinct(F.array(*(F.col(f"p{i}.cls") for i in range(RANDOM_PIVOTS + 1))))
    return wide.select("bucket", F.explode(names).alias("pivot"))


def _likely(pairs: DataFrame, reps: DataFrame, parts: tuple[int, int], miss: float) -> DataFrame:
    """Candidate pairs that the comparison of their signatures leaves, with their number of equal hashes."""
    signed = reps.select("cls", "n_shingles", "signature")
    sides = pairs.join(signed.toDF("a", "na", "sig_a"), "a").join(signed.toDF("b", "nb", "sig_b"), "b")
    sized = sides.where(parts[1] * F.least("na", "nb") >= parts[0] * F.greatest("na", "nb")).select("a", "b", "sig_a", "sig_b")
    return sized.mapInArrow(_survivors(parts, miss), "a long, b long, matches long")


def _tree(survivors: DataFrame) -> DataFrame:
    """Each class's most similar partner, as pairs: a forest that mostly suffices to link what is linked."""
    ends = survivors.select(F.col("a").alias("id"), "*").unionByName(survivors.select(F.col("b").alias("id"), "*"))
    best = ends.groupBy("id").agg(F.max(F.struct("matches", -F.col("a"), -F.col("b"))).alias("p"))
    return best.select((-F.col("p.col2")).alias("a"), (-F.col("p.col3")).alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, parts: tuple[int, int]) -> DataFrame:
    """The pairs that are links on their full sets."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(size, parts), "a long, b long")


def _blocks(large: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (bucket, left, right, side, cls, label) that bring the members outside a bucket's main part (side 0) together with
    all its members (side 1), a bounded block of each at a time."""
    classes = large.groupBy("cls").agg(F.collect_list("bucket").alias("buckets")).join(labels.toDF("cls", "component"), "cls", "left").join(reps.select("cls", "n_shingles"), "cls")
    labelled = classes.select(F.explode("buckets").alias("bucket"), "cls", "n_shingles", F.coalesce("component", "cls").alias("label"))
    parts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    totals = parts.groupBy("bucket").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    count = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    lefts = count(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("lefts")
    open_ = totals.where(F.col("n") > F.col("main.n")).select("bucket", F.col("main.label").alias("main"), lefts, count(F.col("n"), F.col("size")).alias("rights"))
    rows = checkpointed(labelled.join(open_, "bucket"))
    place = lambda n: F.pmod(F.xxhash64("cls", F.lit("block")), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where("label <> main").select("bucket", place(F.col("lefts")).alias("left"), every(F.col("rights")).alias("right"), F.lit(0).alias("side"), "cls", "label")
    right = rows.select("bucket", every(F.col("lefts")).alias("left"), place(F.col("rights")).alias("right"), F.lit(1).alias("side"), "cls", "label")
    return left.unionByName(right)


def _compare_blocks(size: int, parts: tuple[int, int], miss: float):
    """Links between the two sides of a group. A pair is compared only in the first bucket that it shares, and not when its
    sides are linked already."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table.to_batches()[0] if table.num_rows else None
        least = least_matches(parts[0] / parts[1], miss)
        side, cls, label = (table.column(n).to_numpy() for n in ("side", "cls", "label"))
        bucket = table.column("bucket")[0].as_py()
        hashes, bounds = shingle_sets(rows.column(rows.schema.get_field_index("text")), size)
        sizes = np.diff(bounds)
        sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        parent = {int(x): int(x) for x in label}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found: list[tuple[int, int]] = []
        others = np.flatnonzero(side == 1)
        main = ~np.isin(cls, cls[side == 0])
        for i in np.flatnonzero(side == 0).tolist():
            same = bands[others] == bands[i]
            first = bands[i][same.argmax(1)] == bucket
            fits = parts[1] * np.minimum(sizes[others], sizes[i]) >= parts[0] * np.maximum(sizes[others], sizes[i])
            live = others[first & fits & (label[others] != label[i]) & (main[others] | (cls[others] > cls[i]))]
            matches = np.zeros(len(live), np.int64)
            for at in range(0, HASHES, COMPARE_BATCH):
                matches += (sign[live, at : at + COMPARE_BATCH] == sign[i, at : at + COMPARE_BATCH]).sum(1)
                kept = matches >= least[at + COMPARE_BATCH]
                live, matches = live[kept], matches[kept]
            mine = hashes[bounds[i] : bounds[i + 1]]
            for j in live[np.argsort(-matches, kind="stable")].tolist():
                a, b = root(int(label[i])), root(int(label[j]))
                if a == b:
                    continue
                theirs = hashes[bounds[j] : bounds[j + 1]]
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                shared = int((mine[at] == theirs).sum())
                if parts[1] * shared >= parts[0] * (len(mine) + len(theirs) - shared):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(cls[i]), int(cls[j])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    parts: tuple[int, int] = LINK_PARTS,
    miss: float = MISS_PROBABILITY,
) -> DataFrame:
    """One row per row of `docs`: the key, n_shingles, component_id and kept.

    Two documents are linked when parts[1] times their shared shingles is at least parts[0] times all their shingles;
    component_id is the smallest id that links reach. A null text, or one without words, has no shingles and is linked
    with nothing. One row of each component is kept, that with the smallest id; rows without an id come last, and of
    rows with the same id and set only one is kept. Words are separated by ASCII white space, A-Z lower-cased.
    """
    given = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text).alias("text"))
    signed = checkpointed(given.mapInArrow(_sign(shingle), SIGNED))
    full = signed.where("n_shingles > 0")
    sets = full.groupBy("s1", "s2").agg(F.min(F.struct("doc", "row")).alias("first"))
    sets = checkpointed(sets.select("s1", "s2", F.col("first.row").alias("cls"), F.col("first.doc").alias("doc")))
    reps = checkpointed(full.drop("doc", "s1", "s2").join(sets, full["row"] == sets["cls"]).drop("row"))

    placed = reps.select("cls", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = checkpointed(placed.join(shared, "bucket"))

    large = members.where(F.col("size") > SMALL_BUCKET).select("bucket", "cls")
    met = large.join(_first_pivots(members), "bucket").where(F.col("cls") != F.col("pivot"))
    pairs = _pairs_of_small(members).unionByName(met.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))).distinct()
    survivors = checkpointed(_likely(pairs, reps, parts, miss))
    wanted = survivors.select(F.col("a").alias("cls")).unionByName(survivors.select(F.col("b").alias("cls"))).unionByName(large.select("cls")).distinct()
    texts = checkpointed(_texts_of(given, reps.join(wanted, "cls", "left_semi"), shingle))

    tree = checkpointed(_tree(survivors))
    links = checkpointed(_confirmed(tree, texts, shingle, parts))
    labels = connected_components(links.toDF("src", "dst"))
    rest = survivors.select("a", "b").join(tree, ["a", "b"], "left_anti").join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    more = checkpointed(_confirmed(rest.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), texts, shingle, parts))
    payload = reps.select("cls", "bands", "signature").join(texts, "cls")
    groups = _blocks(large, labels, reps).join(payload, "cls").groupBy("bucket", "left", "right")
    last = checkpointed(groups.applyInArrow(_compare_blocks(shingle, parts, miss), "a long, b long"))
    labels = connected_components(links.unionByName(more).unionByName(last).toDF("src", "dst"))

    grouped = sets.select("s1", "s2", "cls", "doc")
    grouped = grouped.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    tops = grouped.groupBy("component").agg(F.min(F.struct("doc", "cls")).alias("top"))
    named = grouped.join(tops, "component").select("s1", "s2", F.col("top.doc").alias("top_doc"), F.col("top.cls").alias("top_row"))
    rows = signed.select("row", "doc", "n_shingles", "s1", "s2")
    out = rows.where("n_shingles > 0").join(named, ["s1", "s2"]).drop("s1", "s2")
    empty = rows.where("n_shingles = 0").drop("s1", "s2").withColumns({"top_doc": F.col("doc"), "top_row": F.col("row")})
    real = lambda c: F.when(c != LAST_ID, c)
    return out.unionByName(empty).select(
        real(F.col("doc")).alias(key), "n_shingles", real(F.col("top_doc")).alias("component_id"), (F.col("row") == F.col("top_row")).alias("kept")
    )
