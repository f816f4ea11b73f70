"""Graph queries over the relational tables: degrees, sub-graphs, neighbours, paths, merges and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.catalog import inputs as src
from lorefield.catalog.sqlparts import TRADE
from lorefield.functions import text as tx
from lorefield.operators import adjacency as ad
from lorefield.operators import communities as co
from lorefield.operators import graph as gr
from lorefield.session import ROWS_A_TASK, checkpointed, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY id)"
_NODES = """nodes AS (
  SELECT 'customer:' || c_custkey AS id, 'customer' AS entity_type, CAST(c_custkey AS BIGINT) AS seq FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_partkey FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_nationkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_regionkey FROM region)"""


@query(f"WITH {TRADE},{_DEG} SELECT id, degree, round(1.5 + sqrt(degree + 1), 6) AS size FROM deg")
def trade_degrees(spark, base):
    return gr.degrees(src.trade_edges(spark, base)).withColumn("size", F.round(gr.node_size(F.col("degree")), 6))


@query(
    f"""WITH {TRADE},{_DEG},
kept AS (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 300),
inside AS (SELECT * FROM trade WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)),
ideg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM inside UNION ALL SELECT dst FROM inside) GROUP BY id)
SELECT k.id, k.degree AS full_degree, i.degree, (SELECT count(*) FROM deg) > 300 AS is_truncated FROM kept k JOIN ideg i USING (id)"""
)
def trade_top_subgraph(spark, base):
    nodes, _, _ = gr.top_subgraph(checkpointed(src.trade_edges(spark, base)))
    return nodes


@query(
    f"""WITH {TRADE},{_DEG},
kept AS (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 300)
SELECT src, dst, relation, weight, least(coalesce(nullif(weight, 0), 1), 4) AS width FROM trade
WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)"""
)
def trade_top_subgraph_edges(spark, base):
    _, edges, _ = gr.top_subgraph(checkpointed(src.trade_edges(spark, base)))
    return edges.withColumn("width", gr.link_width(F.col("weight")))


_BOTH = "both_ways AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade)"


@query(
    f"""WITH {TRADE},{_DEG},{_BOTH},
h1 AS (SELECT 'region:1' AS id UNION SELECT dst FROM both_ways WHERE src = 'region:1'),
h2 AS (SELECT id FROM h1 UNION SELECT dst FROM both_ways WHERE src IN (SELECT id FROM h1)),
cand AS (SELECT * FROM deg WHERE id IN (SELECT id FROM h2)),
kept AS (SELECT * FROM cand ORDER BY degree DESC, id LIMIT 100),
inside AS (SELECT * FROM trade WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)),
ideg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM inside UNION ALL SELECT dst FROM inside) GROUP BY id)
SELECT k.id, k.degree AS full_degree, i.degree, (SELECT count(*) FROM cand) > 100 AS is_truncated FROM kept k JOIN ideg i USING (id)"""
)
def trade_centered_subgraph(spark, base):
    nodes, _, _ = gr.top_subgraph(checkpointed(src.trade_edges(spark, base)), "region:1", max_depth=2, max_nodes=100)
    return nodes


@query(
    f"""WITH {TRADE},{_BOTH},
h1 AS (SELECT DISTINCT dst AS id FROM both_ways WHERE src = 'nation:7' AND dst <> 'nation:7'),
h2 AS (SELECT DISTINCT dst AS id FROM both_ways WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h1) AND dst <> 'nation:7')
SELECT id, CAST(1 AS INTEGER) AS hop FROM h1 UNION ALL SELECT id, CAST(2 AS INTEGER) FROM h2"""
)
def trade_neighbors_2hop(spark, base):
    nodes, _ = gr.neighbors(checkpointed(src.trade_edges(spark, base)), "nation:7", hops=2)
    return nodes


@query(
    f"""WITH {TRADE},{_BOTH},
ex AS (SELECT 'nation:7' AS id UNION SELECT dst FROM both_ways WHERE src = 'nation:7')
SELECT DISTINCT src, dst, relation, weight FROM trade WHERE src IN (SELECT id FROM ex) OR dst IN (SELECT id FROM ex)"""
)
def trade_neighbor_edges(spark, base):
    _, edges = gr.neighbors(checkpointed(src.trade_edges(spark, base)), "nation:7", hops=2)
    return edges


def _paths_sql(source: str, target: str, length: int) -> str:
    return f"""WITH RECURSIVE {TRADE},
step AS (SELECT DISTINCT src, dst FROM trade),
walk AS (
  SELECT [src, dst] AS path, dst, 1 AS len FROM step WHERE src = '{source}' AND dst <> '{source}'
  UNION ALL
  SELECT list_append(w.path, s.dst), s.dst, w.len + 1 FROM walk w JOIN step s ON s.src = w.dst
  WHERE w.len < {length} AND w.dst <> '{target}' AND NOT list_contains(w.path, s.dst))
SELECT array_to_string(path, '>') AS path, CAST(len AS INTEGER) AS length FROM walk WHERE dst = '{target}'"""


@query(_paths_sql("customer:1", "nation:3", 3))
def trade_paths_3(spark, base):
    paths = gr.simple_paths(src.trade_edges(spark, base), "customer:1", "nation:3", 3)
    return paths.select(F.array_join("path", ">").alias("path"), "length")


@query(_paths_sql("customer:1", "region:2", 4))
def trade_paths_4(spark, base):
    paths = gr.simple_paths(src.trade_edges(spark, base), "customer:1", "region:2", 4)
    return paths.select(F.array_join("path", ">").alias("path"), "length")


def _adjacency(spark, base):
    # An edge has two rows, and a bucket's rows are sorted by one task.
    size = 2 * table(spark, base, "lineitem", "l_orderkey").count()
    return ad.write_adjacency(src.trade_edges(spark, base), buckets=max(ad.BUCKETS, -(-size // (2 * ROWS_A_TASK))))


def _at(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@query(
    f"""WITH {TRADE},{_BOTH},{_NODES},
h1 AS (SELECT DISTINCT dst AS id FROM both_ways WHERE src = 'nation:7' AND dst <> 'nation:7'),
h2 AS (SELECT DISTINCT dst AS id FROM both_ways WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h1) AND dst <> 'nation:7'),
found AS (SELECT id, CAST(1 AS INTEGER) AS hop FROM h1 UNION ALL SELECT id, CAST(2 AS INTEGER) FROM h2)
SELECT id, hop, entity_type, seq FROM found JOIN nodes USING (id)"""
)
def trade_adjacent_nodes(spark, base):
    """Rows of the nodes within two hops, over the stored layout."""
    nodes, _ = ad.neighborhood(_adjacency(spark, base), _at(spark, "nation:7"), 2, src.trade_nodes(spark, base))
    return nodes


@query(
    f"""WITH {TRADE},{_BOTH},
ex AS (SELECT 'nation:7' AS id UNION SELECT dst FROM both_ways WHERE src = 'nation:7')
SELECT DISTINCT src, dst, relation, weight FROM trade WHERE src IN (SELECT id FROM ex) OR dst IN (SELECT id FROM ex)"""
)
def trade_adjacent_edges(spark, base):
    _, edges = ad.neighborhood(_adjacency(spark, base), _at(spark, "nation:7"), 2)
    return edges


_KEY = "lower({0}.src) || '|' || lower({0}.relation) || '|' || lower({0}.dst)"


@query(
    f"""WITH RECURSIVE {TRADE},
walk AS (
  SELECT [src, dst] AS path, [{_KEY.format('s')}] AS keys, dst, 1 AS len FROM trade s WHERE src = 'customer:1' AND dst <> 'customer:1'
  UNION ALL
  SELECT list_append(w.path, s.dst), list_append(w.keys, {_KEY.format('s')}), s.dst, w.len + 1 FROM walk w JOIN trade s ON s.src = w.dst
  WHERE w.len < 4 AND w.dst <> 'region:2' AND NOT list_contains(w.path, s.dst))
SELECT array_to_string(path, '>') AS path, array_to_string(keys, '>') AS relationships, CAST(len AS INTEGER) AS length FROM walk WHERE dst = 'region:2'"""
)
def trade_relationship_paths(spark, base):
    """Paths with the relationships they follow."""
    paths = ad.relationship_paths(_adjacency(spark, base), "customer:1", "region:2", 4)
    return paths.select(F.array_join("path", ">").alias("path"), F.array_join(ad.path_keys(F.col("edges")), ">").alias("relationships"), "length")


@query(
    f"""WITH {TRADE}, ends AS (SELECT src AS id, dst AS star FROM trade WHERE relation = 'located_in' UNION ALL SELECT DISTINCT dst, dst FROM trade WHERE relation = 'located_in')
SELECT id, min(id) OVER (PARTITION BY star) AS community FROM ends"""
)
def trade_star_communities(spark, base):
    """Customers and suppliers of a nation: stars, of which each is one community."""
    return co.louvain(src.trade_edges(spark, base).where("relation = 'located_in'"))


@query(
    f"""WITH {TRADE}, places AS (SELECT * FROM trade WHERE relation = 'part_of' OR relation = 'located_in' AND src LIKE 'supplier:%'),
ends AS (SELECT src, dst, weight AS w FROM places UNION ALL SELECT dst, src, weight FROM places),
kinds AS (SELECT split_part(src, ':', 1) AS a, split_part(dst, ':', 1) AS b, w FROM ends),
whole AS (SELECT sum(w) AS m FROM ends), tot AS (SELECT a, sum(w) AS t FROM kinds GROUP BY a)
SELECT (SELECT count(DISTINCT src) FROM ends) AS nodes,
  round((SELECT coalesce(sum(w), 0) FROM kinds WHERE a = b) / m - (SELECT sum(t * t) FROM tot) / (m * m), 9) AS kind_modularity, true AS higher, true AS connected FROM whole"""
)
def trade_communities(spark, base):
    """Communities of suppliers, nations and regions: all nodes have one, modularity is higher than by kind of node, and every
    node of a community of several has an edge inside it."""
    placed = (F.col("relation") == "part_of") | ((F.col("relation") == "located_in") & F.startswith("src", F.lit("supplier:")))
    edges = checkpointed(src.trade_edges(spark, base).where(placed))
    communities = checkpointed(co.louvain(edges))
    by_kind = communities.select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("community"))
    found, plain = co.modularity(edges, communities), co.modularity(edges, by_kind)
    inside = edges.join(communities.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(communities.withColumnsRenamed({"id": "dst", "community": "b"}), "dst").where("a = b")
    linked = inside.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    sizes = communities.join(linked, "id", "left").groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("linked").isNull()).alias("alone"))
    counted = sizes.agg(F.sum("n").alias("nodes"), F.bool_and((F.col("n") == 1) | (F.col("alone") == 0)).alias("connected"))
    # Each side has one row.
    both = counted.join(F.broadcast(plain.withColumnRenamed("modularity", "plain"))).join(F.broadcast(found))
    return both.select("nodes", F.round("plain", 9).alias("kind_modularity"), (F.col("modularity") > F.col("plain")).alias("higher"), "connected")


@query(
    f"""WITH {_NODES.replace("'supplier', s_suppkey", "' Unknown ', s_suppkey")}
SELECT trim(entity_type) AS legend_type, CAST(row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS INTEGER) AS slot, count(*) AS nodes
FROM nodes WHERE lower(trim(entity_type)) NOT IN ('', 'unknown', 'other', 'none', 'null') GROUP BY trim(entity_type)"""
)
def trade_type_legend(spark, base):
    nodes = src.trade_nodes(spark, base).withColumn(
        "entity_type", F.when(F.col("entity_type") == "supplier", F.lit(" Unknown ")).otherwise(F.col("entity_type"))
    )
    return gr.type_legend(nodes)


@query(
    """WITH c AS (SELECT p_type AS t, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_type),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS k FROM c)
SELECT CASE WHEN k <= 8 THEN t ELSE 'Other' END AS legend_type, CAST(min(least(k, 9)) AS INTEGER) AS slot, CAST(sum(n) AS BIGINT) AS nodes
FROM r GROUP BY 1"""
)
def part_type_top8(spark, base):
    nodes = table(spark, base, "part", "p_partkey", "p_type").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("entity_type"), F.col("p_partkey").alias("seq")
    )
    return gr.type_legend(nodes)


@query(
    f"""WITH {TRADE},{_NODES},
m AS (SELECT id FROM nodes WHERE contains(lower(id), 'supplier:1')),
keep AS (SELECT id FROM m UNION SELECT dst FROM trade WHERE src IN (SELECT id FROM m) UNION SELECT src FROM trade WHERE dst IN (SELECT id FROM m))
SELECT id, id IN (SELECT id FROM m) AS matched, id NOT IN (SELECT id FROM keep) AS dimmed FROM nodes"""
)
def trade_search_dim(spark, base):
    return gr.search_dim(src.trade_nodes(spark, base), src.trade_edges(spark, base), "  Supplier:1 ")


@query(
    f"""WITH {TRADE}
SELECT src, dst, relation, weight, CASE WHEN src = 'nation:3' THEN dst ELSE src END AS other FROM trade WHERE src = 'nation:3' OR dst = 'nation:3'"""
)
def trade_incident_edges(spark, base):
    return gr.incident_edges(src.trade_edges(spark, base), "nation:3")


_MENTIONED = """
rows0 AS (
  SELECT 'Customer ' || c_custkey AS name, 'Account' AS entity_type, c_mktsegment AS description, TIMESTAMP '1990-01-01' AS first_seen, TIMESTAMP '1990-01-01' AS last_seen, CAST(-1 AS BIGINT) AS seq, true AS old FROM customer
  UNION ALL
  SELECT 'CUSTOMER ' || o_custkey, 'account', o_orderpriority, CAST(o_orderdate AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP), o_orderkey, false FROM orders
  UNION ALL
  SELECT 'Supplier ' || s_suppkey, 'account', 'supplies', TIMESTAMP '1991-01-01', TIMESTAMP '1991-01-01', CAST(s_suppkey AS BIGINT), false FROM supplier)"""


@query(
    f"""WITH {_MENTIONED}
SELECT lower(entity_type) || ':' || lower(name) AS key, arg_min(name, seq) AS name, arg_min(entity_type, seq) AS entity_type, arg_min(description, seq) AS description,
       arg_min(first_seen, seq) AS first_seen, arg_max(last_seen, seq) AS last_seen, NOT bool_or(old) AS is_new FROM rows0 GROUP BY 1"""
)
def trade_upsert_entities(spark, base):
    early = F.lit("1990-01-01 00:00:00").cast("timestamp")
    stored = table(spark, base, "customer", "c_custkey", "c_mktsegment").select(
        F.concat(F.lit("Customer "), "c_custkey").alias("name"),
        F.lit("Account").alias("entity_type"),
        F.col("c_mktsegment").alias("description"),
        early.alias("first_seen"),
        early.alias("last_seen"),
        F.lit(-1).cast("long").alias("seq"),
    )
    seen = F.col("o_orderdate").cast("timestamp")
    incoming = table(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").select(
        F.concat(F.lit("CUSTOMER "), "o_custkey").alias("name"),
        F.lit("account").alias("entity_type"),
        F.col("o_orderpriority").alias("description"),
        seen.alias("first_seen"),
        seen.alias("last_seen"),
        F.col("o_orderkey").alias("seq"),
    )
    opened = F.lit("1991-01-01 00:00:00").cast("timestamp")
    suppliers = table(spark, base, "supplier", "s_suppkey").select(
        F.concat(F.lit("Supplier "), "s_suppkey").alias("name"),
        F.lit("account").alias("entity_type"),
        F.lit("supplies").alias("description"),
        opened.alias("first_seen"),
        opened.alias("last_seen"),
        F.col("s_suppkey").cast("long").alias("seq"),
    )
    return gr.upsert_entities(stored, incoming.unionByName(suppliers))


@query(
    """WITH rows0 AS (
  SELECT 'customer:' || c_custkey AS source, 'located_in' AS relation_type, 'nation:' || c_nationkey AS target, CAST(1 AS DOUBLE) AS weight, '' AS description, CAST(-1 AS BIGINT) AS seq, true AS old FROM customer
  UNION ALL
  SELECT 'Customer:' || o_custkey, 'Ordered', o_orderpriority, CAST(1 AS DOUBLE), CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus || ' ' || o_orderkey END, o_orderkey, false FROM orders)
SELECT lower(source) || '|' || lower(relation_type) || '|' || lower(target) AS key, arg_min(source, seq) AS source, arg_min(relation_type, seq) AS relation_type,
       arg_min(target, seq) AS target, sum(weight) AS weight, arg_min(description, seq) FILTER (WHERE description <> '') AS description, NOT bool_or(old) AS is_new
FROM rows0 GROUP BY 1"""
)
def trade_upsert_relationships(spark, base):
    stored = table(spark, base, "customer", "c_custkey", "c_nationkey").select(
        F.concat(F.lit("customer:"), "c_custkey").alias("source"),
        F.lit("located_in").alias("relation_type"),
        F.concat(F.lit("nation:"), "c_nationkey").alias("target"),
        F.lit(1.0).alias("weight"),
        F.lit("").alias("description"),
        F.lit(-1).cast("long").alias("seq"),
    )
    incoming = table(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").select(
        F.concat(F.lit("Customer:"), "o_custkey").alias("source"),
        F.lit("Ordered").alias("relation_type"),
        F.col("o_orderpriority").alias("target"),
        F.lit(1.0).alias("weight"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.concat_ws(" ", "o_orderstatus", "o_orderkey")).alias("description"),
        F.col("o_orderkey").alias("seq"),
    )
    return gr.upsert_relationships(stored, incoming)


@query(
    """WITH e AS (
  SELECT 'customer:' || c_custkey AS key, CAST(-1 AS BIGINT) AS seq, unnest([{'k': 'segment', 'v': c_mktsegment}, {'k': 'status', 'v': 'none'}], recursive := true) FROM customer
  UNION ALL
  SELECT 'customer:' || o_custkey, o_orderkey, unnest([{'k': 'status', 'v': o_orderstatus}, {'k': 'priority', 'v': o_orderpriority}], recursive := true) FROM orders),
l AS (SELECT key, k, arg_max(v, seq) AS v FROM e GROUP BY ALL)
SELECT key, string_agg(k || '=' || v, ';' ORDER BY k) AS attributes FROM l GROUP BY key"""
)
def trade_upsert_attributes(spark, base):
    def pairs(*items):
        return F.create_map(*[x for name, col in items for x in (F.lit(name), col)])

    stored = table(spark, base, "customer", "c_custkey", "c_mktsegment").select(
        F.concat(F.lit("customer:"), "c_custkey").alias("key"),
        pairs(("segment", F.col("c_mktsegment")), ("status", F.lit("none"))).alias("attributes"),
        F.lit(-1).cast("long").alias("seq"),
    )
    incoming = table(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select(
        F.concat(F.lit("customer:"), "o_custkey").alias("key"),
        pairs(("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority"))).alias("attributes"),
        F.col("o_orderkey").alias("seq"),
    )
    merged = gr.upsert_attributes(stored, incoming)
    entries = F.array_sort(F.map_entries("attributes"))
    return merged.select("key", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"))


@query(
    """SELECT DISTINCT 'part:' || l_partkey AS key, 'supplier:' || l_suppkey AS source FROM lineitem"""
)
def trade_union_sources(spark, base):
    lines = table(spark, base, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    links = lines.select(F.concat(F.lit("part:"), "l_partkey").alias("key"), F.concat(F.lit("supplier:"), "l_suppkey").alias("source"), "l_returnflag")
    returned = F.col("l_returnflag") == "R"
    return gr.union_sources(links.where(returned), links.where(~returned))


@query(
    """WITH old AS (SELECT doc_id AS chunk_id, 'old ' || source AS text, source AS source_url FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
inc AS (SELECT doc_id AS chunk_id, lang || ' ' || source AS text, source AS source_url FROM documents),
urls AS (SELECT DISTINCT source AS url FROM documents)
SELECT 'chunk' AS part, coalesce(o.chunk_id, i.chunk_id) AS chunk_id, coalesce(i.text, o.text) AS text, coalesce(i.source_url, o.source_url) AS url FROM old o FULL JOIN inc i ON o.chunk_id = i.chunk_id
UNION ALL SELECT 'link', chunk_id, NULL, source_url FROM inc WHERE source_url IN (SELECT url FROM urls)"""
)
def chunk_upsert_links(spark, base):
    docs = src.documents(spark, base, "doc_id", "lang", "source")
    labelled = docs.join(table(spark, base, "labels", "doc_id"), "doc_id", "left_semi")
    stored = labelled.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("old "), "source").alias("text"), F.col("source").alias("source_url"))
    incoming = docs.select(
        F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("text"), F.col("source").alias("source_url")
    )
    urls = docs.select(F.col("source").alias("url")).distinct()
    chunks, links = gr.upsert_chunks(stored, incoming, urls)
    return chunks.select(F.lit("chunk").alias("part"), "chunk_id", "text", F.col("source_url").alias("url")).unionByName(
        links.select(F.lit("link").alias("part"), "chunk_id", F.lit(None).cast("string").alias("text"), "url")
    )


@query(
    f"""WITH {TRADE}
SELECT lower('unknown') || ':' || lower(src) AS entity_key, lower(src) || '|' || lower(relation) || '|' || lower(dst) AS relationship_key, count(*) AS n FROM trade GROUP BY ALL"""
)
def trade_graph_keys(spark, base):
    edges = src.trade_edges(spark, base)
    return edges.groupBy(
        tx.entity_key(F.col("src"), F.lit("unknown")).alias("entity_key"),
        tx.relationship_key(F.col("src"), F.col("relation"), F.col("dst")).alias("relationship_key"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {TRADE}
SELECT src || '-' || dst AS id, src AS source, dst AS target, relation AS keywords, CAST(NULL AS VARCHAR) AS description, weight, CAST(NULL AS VARCHAR) AS file_path FROM trade"""
)
def trade_edge_projection(spark, base):
    edges = src.trade_edges(spark, base).select(
        F.concat_ws("-", "src", "dst").alias("id"),
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.create_map(F.lit("keywords"), F.col("relation"), F.lit("weight"), F.col("weight").cast("string")).alias("properties"),
    )
    return gr.bag_projection(edges)
