"""Hops and paths over the stored layout against plain walks, and what their plans read."""

import random

import pytest
from pyspark.sql import functions as F

from lorefield.operators import adjacency as ad
from lorefield.operators import graph as gr
from lorefield.session import shared_folder
from tests.test_graph import hops_by_hand

COLUMNS = "src string, dst string, relation string, weight double"


def random_edges(seed, nodes=30, count=70):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}", rng.choice("ab"), 1.0) for _ in range(count)})


def start_at(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("hops", [0, 1, 3])
def test_neighborhood(spark, monkeypatch, few, hops):
    monkeypatch.setattr(ad, "FEW_NODES", few)
    edges = random_edges(1)
    store = ad.write_adjacency(spark.createDataFrame(edges + [(None, "n01", "a", 1.0)], COLUMNS), buckets=4)
    start = edges[0][0]
    nodes, touching = ad.neighborhood(store, start_at(spark, start, start), hops)
    want = hops_by_hand([(a, b) for a, b, _, _ in edges], start, hops)
    assert {r.id: r.hop for r in nodes.collect()} == {n: h for n, h in want.items() if h}
    expanded = {n for n, h in want.items() if h < hops}
    assert sorted((r.src, r.dst, r.relation, r.weight) for r in touching.collect()) == [e for e in edges if e[0] in expanded or e[1] in expanded]


def test_rows_of_nodes_come_along(spark):
    store = ad.write_adjacency(spark.createDataFrame([("a", "b", "r", 1.0), ("c", "a", "r", 1.0)], COLUMNS), buckets=2)
    nodes, _ = ad.neighborhood(store, start_at(spark, "a"), 1, spark.createDataFrame([("b", "place")], "id string, entity_type string"))
    assert [(r.id, r.hop, r.entity_type) for r in nodes.collect()] == [("b", 1, "place")]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_hop_neither_shuffles_edges_nor_opens_other_buckets(spark, monkeypatch):
    path = shared_folder(spark, "adjacency")
    ad.write_adjacency(spark.createDataFrame(random_edges(2), COLUMNS), path=path, buckets=8)
    store = ad.open_adjacency(spark, path, buckets=8)
    one = store.at(start_at(spark, "n03"))
    plan = plan_of(one)
    assert "PushedFilters: [IsNotNull(node), EqualTo(node,n03)]" in plan and "Exchange" not in plan
    # A scan that is planned by bucket tells how many of them it opens.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in plan_of(store.at(start_at(spark, "n03")))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert {r.node for r in one.collect()} == {"n03"}
    monkeypatch.setattr(ad, "FEW_NODES", 1)
    many = store.at(start_at(spark, *(f"n{i:02}" for i in range(9))))
    plan = plan_of(many)
    # The only exchange is that of the frontier, and the edges are neither dealt out nor sorted again.
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert {r.node for r in many.collect()} == {x for e in random_edges(2) for x in e[:2] if x < "n09"}


def paths_by_hand(edges, source, target, length):
    out, stack = [], [([source], [])]
    while stack:
        path, used = stack.pop()
        for e in edges:
            if e[0] == path[-1] and e[1] not in path and len(used) < length:
                found = (path + [e[1]], used + [(e[0], e[2], e[1])])
                (out if e[1] == target else stack).append(found)
    return sorted(out)


@pytest.mark.parametrize("seed, length", [(3, 1), (3, 2), (4, 3), (5, 4)])
def test_paths_keep_parallel_relationships_apart(spark, seed, length):
    edges = random_edges(seed, nodes=9, count=45)
    store = ad.write_adjacency(spark.createDataFrame(edges, COLUMNS), buckets=4)
    source, target = edges[0][0], edges[-1][1]
    if source == target:
        target = next(e[1] for e in edges if e[1] != source)
    got = ad.relationship_paths(store, source, target, length).collect()
    assert sorted((r.path, [(e.src, e.relation, e.dst) for e in r.edges]) for r in got) == paths_by_hand(edges, source, target, length)
    assert all(r.length == len(r.edges) for r in got)


def test_paths_without_an_answer(spark):
    store = ad.write_adjacency(spark.createDataFrame([("a", "b", "r", 1.0), ("c", "d", "r", 1.0), ("a", "a", "r", 1.0)], COLUMNS), buckets=2)
    assert ad.relationship_paths(store, "a", "d").count() == 0
    assert ad.relationship_paths(store, "a", "a").count() == 0
    assert ad.relationship_paths(store, "nobody", "b").count() == 0


def test_same_nodes_as_the_unstored_walk(spark):
    edges = spark.createDataFrame(random_edges(6), COLUMNS)
    nodes, _ = ad.neighborhood(ad.write_adjacency(edges, buckets=4), start_at(spark, "n05"), 2)
    plain, _ = gr.neighbors(edges, "n05", 2)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, plain.collect()))


def test_keys_of_a_path(spark):
    store = ad.write_adjacency(spark.createDataFrame([("A", "B", "Owns", 1.0)], COLUMNS), buckets=2)
    paths = ad.relationship_paths(store, "A", "B", 1)
    assert paths.select(ad.path_keys(F.col("edges")).alias("k")).first().k == ["a|owns|b"]


def test_edges_are_computed_once_for_both_ends(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame(random_edges(8), COLUMNS).withColumn("relation", F.udf(mark)("relation"))
    store = ad.write_adjacency(edges, buckets=4)
    assert seen.value == len(random_edges(8))
    assert store.rows.where("forward").count() == len(random_edges(8)) and store.rows.where("node <> IF(forward, edge.src, edge.dst)").count() == 0


def test_the_last_level_is_not_walked(spark, monkeypatch):
    walked = []
    plain = ad.levels
    monkeypatch.setattr(ad, "levels", lambda adjacency, start, hops, forward=None: walked.append(hops) or plain(adjacency, start, hops, forward))
    store = ad.write_adjacency(spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "d", "r", 1.0)], COLUMNS), buckets=2)
    assert [r.path for r in ad.relationship_paths(store, "a", "d", 3).collect()] == [["a", "b", "c", "d"]] and walked == [2, 2]
