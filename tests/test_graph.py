import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorefield.operators import graph as gr
from lorefield.plans.graph_view import graph_view


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def random_pairs(seed, nodes=40, count=60):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(count)})


def test_degree_counts_loops_twice(spark):
    got = {r.id: r.degree for r in gr.degrees(edges_of(spark, [("a", "b"), ("a", "a")])).collect()}
    assert got == {"a": 3, "b": 1}


def test_isolates_vanish_and_edges_keep_their_ends(spark):
    entities = spark.createDataFrame([(n, "t", "d") for n in ("a", "b", "lonely")], "key string, entity_type string, description string")
    edges = spark.createDataFrame([("a", "b", 1.0, "k", "d")], "src string, dst string, weight double, keywords string, description string")
    nodes, lines, flag = graph_view(entities, edges)
    assert {r.id for r in nodes.collect()} == {"a", "b"}
    assert {(r.source, r.target) for r in lines.collect()} == {("a", "b")}
    assert flag.first().is_truncated is False


@pytest.mark.parametrize("seed", [1, 2])
def test_top_subgraph(spark, seed):
    pairs = random_pairs(seed)
    full = Counter(x for p in pairs for x in p)
    kept = {n for n, _ in sorted(full.items(), key=lambda x: (-x[1], x[0]))[:10]}
    inside = [p for p in pairs if p[0] in kept and p[1] in kept]
    want = Counter(x for p in inside for x in p)
    nodes, lines, flag = gr.top_subgraph(edges_of(spark, pairs), max_nodes=10)
    assert {r.id: (r.full_degree, r.degree) for r in nodes.collect()} == {n: (full[n], d) for n, d in want.items()}
    assert sorted((r.src, r.dst) for r in lines.collect()) == inside
    assert flag.first().is_truncated is True
    with pytest.raises(ValueError):
        gr.top_subgraph(edges_of(spark, pairs), max_nodes=1001)


def hops_by_hand(pairs, start, hops):
    seen, frontier = {start: 0}, {start}
    for h in range(1, hops + 1):
        near = {b for a, b in pairs if a in frontier} | {a for a, b in pairs if b in frontier}
        frontier = near - set(seen)
        seen.update(dict.fromkeys(frontier, h))
    return seen


@pytest.mark.parametrize("hops", [1, 3])
def test_neighbors(spark, hops):
    pairs = random_pairs(3)
    start = pairs[0][0]
    nodes, touching = gr.neighbors(edges_of(spark, pairs), start.upper(), hops)
    want = hops_by_hand(pairs, start, hops)
    assert {r.id: r.hop for r in nodes.collect()} == {n: h for n, h in want.items() if h}
    expanded = {n for n, h in want.items() if h < hops}
    assert {(r.src, r.dst) for r in touching.collect()} == {p for p in pairs if p[0] in expanded or p[1] in expanded}


def paths_by_hand(pairs, source, target, length):
    out, stack = [], [[source]]
    while stack:
        path = stack.pop()
        for a, b in pairs:
            if a == path[-1] and b not in path and len(path) <= length:
                if b == target:
                    out.append(path + [b])
                else:
                    stack.append(path + [b])
    return sorted(out)


@pytest.mark.parametrize("length", [1, 2, 4])
def test_simple_paths(spark, length):
    pairs = random_pairs(4, nodes=15, count=50)
    got = gr.simple_paths(edges_of(spark, pairs), "n00", "n07", length).collect()
    assert sorted(r.path for r in got) == paths_by_hand(pairs, "n00", "n07", length)


@pytest.mark.parametrize("seed", [5, 6])
def test_components(spark, seed):
    pairs = random_pairs(seed, nodes=60, count=45) + [("chain%02d" % i, "chain%02d" % (i + 1)) for i in range(30)] + [("self", "self")]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r.id: r.component for r in gr.connected_components(edges_of(spark, pairs)).collect()}
    assert got == {x: root(x) for x in parent}


def test_upserts(spark):
    cols = "name string, entity_type string, description string, first_seen int, last_seen int, seq long"
    old = spark.createDataFrame([("Ada", "Person", "first", 1, 9, -1)], cols)
    new = spark.createDataFrame([("ADA", "person", "second", 5, 5, 1), ("Bob", "person", "b", 6, 6, 2), ("ada", "PERSON", "x", 7, 3, 3)], cols)
    got = {r.key: r for r in gr.upsert_entities(old, new).collect()}
    assert got["person:ada"].name == "Ada" and got["person:ada"].description == "first"
    assert got["person:ada"].last_seen == 3 and got["person:ada"].is_new is False and got["person:bob"].is_new is True
    cols = "source string, relation_type string, target string, weight double, description string, seq long"
    rel = gr.upsert_relationships(
        spark.createDataFrame([("A", "knows", "B", 1.0, "", -1)], cols),
        spark.createDataFrame([("a", "Knows", "b", 2.5, "met", 1), ("a", "knows", "b", 1.0, "later", 2), ("b", "knows", "a", 1.0, None, 3)], cols),
    )
    got = {r.key: r for r in rel.collect()}
    assert got["a|knows|b"].weight == 4.5 and got["a|knows|b"].description == "met" and got["a|knows|b"].source == "A"
    assert got["b|knows|a"].is_new and got["b|knows|a"].description is None
    attrs = gr.upsert_attributes(
        spark.createDataFrame([("k", {"a": "1", "b": "1"}, 0)], "key string, attributes map<string,string>, seq long"),
        spark.createDataFrame([("k", {"b": "2", "c": "2"}, 1)], "key string, attributes map<string,string>, seq long"),
    )
    assert attrs.first().attributes == {"a": "1", "b": "2", "c": "2"}


def test_merge_of_hot_entity_keeps_order_and_cut(spark):
    rows = spark.range(5000).select(
        F.lit("k").alias("key"), F.concat(F.lit("K"), F.col("id") % 2).alias("name"),
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("type"),
        F.concat(F.lit("d"), F.col("id") % 700).alias("description"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit(0).alias("pos"),
    )
    got = gr.merge_mentions(rows).first()
    whole = " ".join(f"d{i}" for i in range(700))
    assert (got.name, got.entity_type, got.mentions) == ("K0", "a", 5000)
    assert got.description == whole[:1200].rsplit(" ", 1)[0]


def test_legend_ties_and_unresolved(spark):
    types = ["x"] * 3 + [f"t{i}" for i in range(9)] + ["Unknown", " ", None, "NULL", " x "]
    nodes = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(types)], "id string, entity_type string, seq long")
    got = {r.legend_type: (r.slot, r.nodes) for r in gr.type_legend(nodes).collect()}
    assert got["x"] == (1, 4) and got["t0"] == (2, 1) and got["t6"] == (8, 1) and got["Other"] == (9, 2)


def test_search_and_selection(spark):
    nodes = spark.createDataFrame([(n,) for n in ("Alpha", "beta", "gamma", "delta")], "id string")
    edges = edges_of(spark, [("beta", "Alpha"), ("gamma", "delta")])
    got = {r.id: (r.matched, r.dimmed) for r in gr.search_dim(nodes, edges, " ALPH ").collect()}
    assert got == {"Alpha": (True, False), "beta": (False, False), "gamma": (False, True), "delta": (False, True)}
    assert not any(r.dimmed for r in gr.search_dim(nodes, edges, "  ").collect())
    assert [(r.other) for r in gr.incident_edges(edges, "Alpha").collect()] == ["beta"]


def test_sizes(one):
    assert one(lambda: gr.node_size(F.lit(3))) == 3.5
    assert [one(lambda w=w: gr.link_width(F.lit(w).cast("double"))) for w in (None, 0.0, 2.0, 9.0)] == [1.0, 1.0, 2.0, 4.0]
