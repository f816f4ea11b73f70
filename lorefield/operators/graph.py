"""Knowledge graph: merge across chunks, degrees, sub-graphs, neighbours, paths and components.

Edges are (src, dst, ...) and nodes (id, ...). Hubs may hold a third of all edges: every aggregation below
combines on the map side, and unions of sources are kept as link rows instead of ever-growing arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorefield.functions.text import MAX_SUMMARY_CHARS, entity_key, falsy, relationship_key, truncate_summary
from lorefield.session import checkpointed

# --- fixed values ---
MAX_GRAPH_NODES = 1000
DEFAULT_GRAPH_NODES = 300
MAX_GRAPH_DEPTH = 10
DEFAULT_GRAPH_DEPTH = 3
UNRESOLVED_TYPES = ("", "unknown", "other", "none", "null")
TYPE_SLOTS = 8
OTHER_TYPE = "Other"
# --------------------

# Every description has at least one character and is followed by a blank, so more than this many cannot fit.
MAX_MERGED_DESCRIPTIONS = MAX_SUMMARY_CHARS // 2 + 1


# --- merging extracted records ----------------------------------------------------------------


def entity_links(mentions: DataFrame) -> DataFrame:
    """Distinct (entity, chunk) pairs. `mentions`: (key, doc_id, chunk_id, ...)."""
    return mentions.select("key", "chunk_id", "doc_id").distinct()


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One row per entity from (key, name, type, description, doc_id, chunk_index, pos).

    name: first surface form; type: the most frequent, ties to the smallest; description: distinct sentences in
    order, joined and cut. Only as many sentences per entity are collected as the cut can show.
    """
    place = F.struct("doc_id", "chunk_index", "pos")
    types = (
        mentions.groupBy("key", "type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("name", place).alias("name"),
            F.min(place).alias("at"),
        )
        .groupBy("key")
        .agg(
            F.min_by("type", F.struct((-F.col("n")).alias("o"), F.col("type"))).alias("entity_type"),
            F.min_by("name", "at").alias("name"),
            F.sum("n").alias("mentions"),
        )
    )
    return types.join(merge_descriptions(mentions, "key", place), "key", "left")


def merge_descriptions(rows: DataFrame, key: str, place: Column) -> DataFrame:
    distinct = rows.where(F.col("description") != "").groupBy(key, "description").agg(F.min(place).alias("at"))
    order = Window.partitionBy(key).orderBy("at")
    fitting = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_MERGED_DESCRIPTIONS)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "description")))
    return fitting.groupBy(key).agg(
        truncate_summary(F.array_join(F.transform(in_order, lambda x: x["description"]), " ")).alias("description")
    )


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """One undirected edge per pair of keys, from (source_key, target_key, keywords, description, place columns).

    weight = number of co-occurrences; keywords and description are those of the first one.
    """
    place = F.struct("doc_id", "chunk_index", "pos")
    return (
        pairs.where(F.col("source_key") != F.col("target_key"))
        .withColumns({"src": F.least("source_key", "target_key"), "dst": F.greatest("source_key", "target_key")})
        .groupBy("src", "dst")
        .agg(
            F.count(F.lit(1)).cast("double").alias("weight"),
            F.min_by("keywords", place).alias("keywords"),
            F.min_by("description", place).alias("description"),
        )
    )


def edge_keywords(pairs: DataFrame) -> DataFrame:
    """All distinct keywords of every edge with their first place, as rows."""
    place = F.struct("doc_id", "chunk_index", "pos")
    return (
        pairs.where(F.col("source_key") != F.col("target_key"))
        .withColumns({"src": F.least("source_key", "target_key"), "dst": F.greatest("source_key", "target_key")})
        .groupBy("src", "dst", "keywords")
        .agg(F.min(place).alias("first_place"), F.count(F.lit(1)).alias("uses"))
    )


# --- incremental upsert -----------------------------------------------------------------------


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge incoming entity rows into the stored ones, keyed by lower(type):lower(name).

    Both sides: (name, entity_type, description, first_seen, last_seen, seq); stored rows have a seq below all
    incoming ones. Name, type, description and first_seen stay those of the first row; last_seen is that of the
    latest arrival, which need not be the largest. `is_new` marks entities that were not stored before.
    """
    both = existing.withColumn("_old", F.lit(True)).unionByName(incoming.withColumn("_old", F.lit(False)))
    fields = ["name", "entity_type", "description", "first_seen"]
    return (
        both.withColumn("key", entity_key(F.col("name"), F.col("entity_type")))
        .groupBy("key")
        .agg(
            F.min_by(F.struct(*fields), "seq").alias("f"),
            F.max_by("last_seen", "seq").alias("last_seen"),
            (~F.bool_or("_old")).alias("is_new"),
        )
        .select("key", *[f"f.{c}" for c in fields], "last_seen", "is_new")
    )


def upsert_attributes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Map union per entity where later rows win: input (key, attributes, seq), output (key, attributes)."""
    entries = existing.unionByName(incoming).select("key", "seq", F.explode("attributes").alias("k", "v"))
    latest = entries.groupBy("key", "k").agg(F.max_by("v", "seq").alias("v"))
    # Attribute names come from the extraction schema, so a map is small however often its entity occurs.
    return latest.groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes")
    )


def union_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set union of (key, source) link rows."""
    return existing.select("key", "source").unionByName(incoming.select("key", "source")).distinct()


def upsert_relationships(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge relationships keyed by source|type|target: weights add up, the first non-empty description stays."""
    both = existing.withColumn("_old", F.lit(True)).unionByName(incoming.withColumn("_old", F.lit(False)))
    fields = ["source", "relation_type", "target"]
    described = F.when(F.col("description") != "", F.col("description"))
    first_described = F.min_by(described, F.when(described.isNotNull(), F.col("seq")))
    return (
        both.withColumn("key", relationship_key(F.col("source"), F.col("relation_type"), F.col("target")))
        .groupBy("key")
        .agg(
            F.min_by(F.struct(*fields), "seq").alias("f"),
            F.sum("weight").alias("weight"),
            first_described.alias("description"),
            (~F.bool_or("_old")).alias("is_new"),
        )
        .select("key", *[f"f.{c}" for c in fields], "weight", "description", "is_new")
    )


def upsert_chunks(existing: DataFrame, incoming: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write chunks by id: new properties win. Links are made only to documents that exist.

    Returns (chunks, links); columns (chunk_id, text, source_url) and links (url, chunk_id).
    """
    new = incoming.select("chunk_id", F.col("text").alias("_t"), F.col("source_url").alias("_u"))
    merged = existing.join(new, "chunk_id", "full").select(
        "chunk_id", F.coalesce("_t", "text").alias("text"), F.coalesce("_u", "source_url").alias("source_url")
    )
    links = incoming.join(documents.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_semi")
    return merged, links.select(F.col("source_url").alias("url"), "chunk_id").distinct()


def one_row(spark: SparkSession, **values: Column) -> DataFrame:
    """A single row made in the plan itself, so that its size is known to the join planner."""
    return spark.range(1).select(*[value.alias(name) for name, value in values.items()])


# --- degrees and sub-graphs -------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """Edge end points per node; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of all nodes within `hops` steps in either direction, the start nodes at 0.

    Every frontier is made durable, so each hop reads the edges once and the plan does not grow with the hops.
    `edges` should be a stored table.
    """
    pairs = edges.select("src", "dst")
    levels = [start.select("id").distinct()]
    for _ in range(hops):
        frontier = levels[-1]
        forward = pairs.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        backward = pairs.join(frontier.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        fresh = forward.unionByName(backward).distinct()
        # In an undirected walk only the last two levels can be met again.
        for seen in levels[-2:]:
            fresh = fresh.join(seen, "id", "left_anti")
        levels.append(checkpointed(fresh))
    reached = levels[0].withColumn("hop", F.lit(0))
    for hop, level in enumerate(levels[1:], start=1):
        reached = reached.unionByName(level.withColumn("hop", F.lit(hop)))
    return reached


def top_subgraph(
    edges: DataFrame,
    label: str = "*",
    max_depth: int = DEFAULT_GRAPH_DEPTH,
    max_nodes: int = DEFAULT_GRAPH_NODES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, flag): the `max_nodes` best connected nodes, the edges among them, and whether nodes were cut.

    Nodes are ranked by their degree in the whole graph; the degree shown is the one inside the sub-graph, and
    nodes without an edge there are left out. `max_nodes` is at most 1000, so the node set is safe to broadcast.
    The nodes carry the flag too.
    """
    if not 1 <= max_nodes <= MAX_GRAPH_NODES or not 1 <= max_depth <= MAX_GRAPH_DEPTH:
        raise ValueError("max_nodes must be in 1..1000 and max_depth in 1..10")
    ranked = degrees(edges)
    if label != "*":
        start = one_row(edges.sparkSession, id=F.lit(label))
        ranked = ranked.join(within_hops(edges, start, max_depth).select("id"), "id", "left_semi")
    # One more than wanted tells whether the graph was cut, without counting it.
    top = ranked.orderBy(F.desc("degree"), "id").limit(max_nodes + 1)
    # Both windows see at most max_nodes + 1 rows.
    numbered = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id"))).withColumn(
        "is_truncated", F.max("rank").over(Window.partitionBy()) > max_nodes
    )
    kept = numbered.where(F.col("rank") <= max_nodes).select("id", F.col("degree").alias("full_degree"), "is_truncated")
    flag = numbered.agg(F.coalesce(F.max("rank") > max_nodes, F.lit(False)).alias("is_truncated"))
    inside = induced_edges(edges, kept)
    nodes = kept.join(degrees(inside), "id")
    return nodes, inside, flag


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in `kept` (id), which must be small."""
    ids = F.broadcast(kept.select("id"))
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their degree; those without an edge vanish."""
    return nodes.join(degrees(edges), "id")


def neighbors(edges: DataFrame, name: str, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within `hops` of `name` (itself left out) and the distinct edges that touch an expanded node."""
    start = one_row(edges.sparkSession, id=F.lit(name.lower()))
    reached = within_hops(edges, start, hops)
    expanded = reached.where(F.col("hop") < hops).select("id")
    touching = edges.join(expanded.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(
        edges.join(expanded.withColumnRenamed("id", "dst"), "dst", "left_semi")
    )
    return reached.where(F.col("hop") > 0), touching.distinct()


def simple_paths(edges: DataFrame, source: str, target: str, max_length: int = 3) -> DataFrame:
    """All directed simple paths of 1..max_length edges from source to target, as node arrays.

    A partial path is only extended to nodes that can still reach the target in the steps that remain, so the
    work follows the number of answers and not the number of walks.
    """
    spark = edges.sparkSession
    steps = checkpointed(edges.select("src", "dst").distinct())
    reach = [one_row(spark, dst=F.lit(target))]
    for _ in range(max_length - 1):
        nearer = reach[-1]
        back = steps.join(nearer, "dst", "left_semi").select(F.col("src").alias("dst"))
        reach.append(checkpointed(back.unionByName(nearer).distinct()))
    paths = one_row(spark, path=F.array(F.lit(source)), src=F.lit(source))
    found = None
    for length in range(1, max_length + 1):
        allowed = steps.join(reach[max_length - length], "dst", "left_semi")
        grown = (
            paths.join(allowed, "src")
            .where(~F.array_contains("path", F.col("dst")))
            .select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
        )
        if length < max_length:
            grown = checkpointed(grown)
        hits = grown.where(F.col("src") == target).select("path", F.lit(length).alias("length"))
        found = hits if found is None else found.unionByName(hits)
        paths = grown.where(F.col("src") != target)
    return found


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node id of each connected component, for all nodes that have an edge.

    Trees of parent links grow over the components: each round every edge offers its far end's grandparent, the offer
    goes to the node and to its tree's root, and links are shortened. Whole trees join at once, so the number of rounds
    follows the logarithm of the longest path; the loop ends when a round changes no grandparent. Minima combine before
    the shuffle, which keeps hubs cheap.
    """
    pairs = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    both = checkpointed(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    first = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
    parents = _with_grandparents(first.select("id", F.least("id", "m").alias("parent")))
    while True:
        far = parents.select(F.col("id").alias("dst"), F.col("top").alias("offer"))
        best = both.join(far, "dst").groupBy(F.col("src").alias("id")).agg(F.min("offer").alias("offer"))
        offers = parents.join(best, "id").select("id", "parent", "top", "offer")
        to_self = offers.select("id", F.least("parent", "top", "offer").alias("parent"))
        to_root = offers.select(F.col("parent").alias("id"), F.col("offer").alias("parent"))
        hooked = to_self.unionByName(to_root).groupBy("id").agg(F.min("parent").alias("parent"))
        following = _with_grandparents(hooked)
        before = parents.select("id", F.col("top").alias("old"))
        changed = following.join(before, "id").where(F.col("old") != F.col("top")).limit(1).count()
        parents = following
        if not changed:
            return parents.select("id", F.col("top").alias("component"))


def _with_grandparents(parents: DataFrame) -> DataFrame:
    """Add `top`, the parent's parent, and store the result."""
    above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("top"))
    return checkpointed(parents.join(above, "parent").select("id", "parent", "top"))


def store_stats(**tables: DataFrame) -> DataFrame:
    """Row counts of named tables as (store, rows)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("store"), "rows") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- views of a loaded graph ------------------------------------------------------------------


def type_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per trimmed type, unresolved types left out. `nodes`: (id, entity_type, seq)."""
    trimmed = F.trim(F.coalesce("entity_type", F.lit("")))
    return (
        nodes.where(~F.lower(trimmed).isin(*UNRESOLVED_TYPES))
        .groupBy(trimmed.alias("entity_type"))
        .agg(F.count(F.lit(1)).alias("nodes"), F.min("seq").alias("first_seq"))
    )


def type_legend(nodes: DataFrame, slots: int = TYPE_SLOTS) -> DataFrame:
    """The most frequent types keep their own slot, ties by first appearance; all others share `Other`."""
    ranked = type_counts(nodes).withColumn(
        # Types are one row each by now; the single ordering task sees the type list, never the nodes.
        "slot", F.row_number().over(Window.orderBy(F.desc("nodes"), "first_seq"))
    )
    shown = F.when(F.col("slot") <= slots, F.col("entity_type")).otherwise(F.lit(OTHER_TYPE))
    return (
        ranked.groupBy(shown.alias("legend_type"))
        .agg(F.least(F.min("slot"), F.lit(slots + 1)).alias("slot"), F.sum("nodes").alias("nodes"))
    )


def search_dim(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(id, matched, dimmed): nodes whose id contains the query, and those neither matching nor next to a match."""
    needle = query.strip().lower()
    if not needle:
        return nodes.select("id", F.lit(False).alias("matched"), F.lit(False).alias("dimmed"))
    hit = F.contains(F.lower("id"), F.lit(needle))
    beside = (
        edges.where(F.contains(F.lower("src"), F.lit(needle))).select(F.col("dst").alias("id"))
        .unionByName(edges.where(F.contains(F.lower("dst"), F.lit(needle))).select(F.col("src").alias("id")))
        .distinct()
        .withColumn("_near", F.lit(True))
    )
    return nodes.select("id", hit.alias("matched")).join(beside, "id", "left").select(
        "id", "matched", (~F.col("matched") & F.col("_near").isNull()).alias("dimmed")
    )


def incident_edges(edges: DataFrame, node: str) -> DataFrame:
    touching = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return touching.withColumn("other", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))


def node_size(degree: Column) -> Column:
    return F.lit(1.5) + F.sqrt(degree + 1)


def link_width(weight: Column) -> Column:
    """Width capped at 4; a missing or zero weight counts as 1."""
    return F.least(F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0)), F.lit(4.0))


def bag_projection(edges: DataFrame) -> DataFrame:
    """Typed columns out of a property map; missing keys give null."""
    def prop(name: str) -> Column:
        return F.try_element_at("properties", F.lit(name))

    return edges.select(
        "id",
        "source",
        "target",
        prop("keywords").alias("keywords"),
        prop("description").alias("description"),
        prop("weight").try_cast("double").alias("weight"),
        prop("file_path").alias("file_path"),
    )


def display_name(value: Column, fallback: Column) -> Column:
    return falsy(value, fallback)
