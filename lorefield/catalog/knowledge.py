"""Queries over the graph extracted from the documents, and hybrid retrieval on top of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.catalog import inputs as src
from lorefield.catalog.sqlparts import chunk_id, extraction, norm, sentences, strip, text_graph, token_chunks, unique_docs, words
from lorefield.functions import sentences as st
from lorefield.functions import text as tx
from lorefield.operators import extract as ex
from lorefield.operators import graph as gr
from lorefield.operators import retrieve as rt
from lorefield.operators import vector as ve
from lorefield.plans import ask
from lorefield.plans.store import Store, add_batch, remove_documents
from lorefield.streaming.ingest import index_to_end
from lorefield.session import checkpointed, shared_folder, table, table_stream

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(f"{text_graph()} SELECT doc_id, chunk_index, pos, name, type, description FROM ents")
def kg_chunk_entities(spark, base):
    return ex.entity_rows(src.chunk_records(spark, base), "doc_id", "chunk_index")


@query(f"{text_graph()} SELECT doc_id, chunk_index, pos, source, target, keywords, description FROM rels")
def kg_chunk_relationships(spark, base):
    return ex.relationship_rows(src.chunk_records(spark, base), "doc_id", "chunk_index")


_ENTITIES = f"""
tcount AS (SELECT key, type, count(*) AS n FROM ents GROUP BY ALL),
ttype AS (SELECT key, type FROM tcount QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, type) = 1),
named AS (SELECT key, arg_min(name, (doc_id, chunk_index, pos)) AS name, count(*) AS mentions FROM ents GROUP BY key),
ddesc AS (SELECT key, description, min((doc_id, chunk_index, pos)) AS place0 FROM ents WHERE description <> '' GROUP BY ALL),
djoin AS (SELECT key, string_agg(description, ' ' ORDER BY place0) AS d FROM ddesc GROUP BY key),
merged AS (
  SELECT n.key, n.name, t.type AS entity_type, n.mentions,
         CASE WHEN length(d) > 1200 THEN regexp_replace(substr(d, 1, 1200), ' [^ ]*$', '') ELSE d END AS description
  FROM named n JOIN ttype t USING (key) LEFT JOIN djoin USING (key))"""

_EDGES = """
edges AS (
  SELECT least(source_key, target_key) AS src, greatest(source_key, target_key) AS dst, CAST(count(*) AS DOUBLE) AS weight,
         arg_min(keywords, (doc_id, chunk_index, pos)) AS keywords, arg_min(description, (doc_id, chunk_index, pos)) AS description
  FROM rels WHERE source_key <> target_key GROUP BY ALL)"""


@query(f"{text_graph()},{_ENTITIES} SELECT key, name, entity_type, mentions, description FROM merged")
def kg_entities(spark, base):
    # Read twice by the merge, so the extraction is made durable once.
    return gr.merge_mentions(checkpointed(src.mention_rows(spark, base)))


@query(f"{text_graph()},{_EDGES} SELECT src, dst, weight, keywords, description FROM edges")
def kg_edges(spark, base):
    return gr.merge_pairs(src.pair_rows(spark, base))


@query(
    f"""{text_graph()} SELECT least(source_key, target_key) AS src, greatest(source_key, target_key) AS dst, keywords, count(*) AS uses
        FROM rels WHERE source_key <> target_key GROUP BY ALL"""
)
def kg_edge_keywords(spark, base):
    return gr.edge_keywords(src.pair_rows(spark, base)).drop("first_place")


@query(f"{text_graph()} SELECT DISTINCT key, {chunk_id()} AS chunk_id, doc_id FROM ents")
def kg_entity_links(spark, base):
    return gr.entity_links(src.mention_rows(spark, base))


@query(
    f"""{text_graph().replace('WITH', 'WITH RECURSIVE', 1)},{_EDGES},
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
cc(id, component) USING KEY (id) AS (
  SELECT src, src FROM both_ways GROUP BY src
  UNION
  SELECT b.dst, min(c.component) FROM cc c JOIN both_ways b ON b.src = c.id JOIN recurring.cc r ON r.id = b.dst
  WHERE c.component < r.component GROUP BY b.dst)
SELECT id, component FROM cc"""
)
def kg_components(spark, base):
    edges = gr.merge_pairs(src.pair_rows(spark, base)).select("src", "dst")
    return gr.connected_components(edges)


@query(
    f"""{text_graph()},{_EDGES},{_ENTITIES}
SELECT 'chunks' AS store, count(*) AS rows FROM chunks UNION ALL SELECT 'nodes', count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'entities', count(*) FROM merged UNION ALL SELECT 'relationships', count(*) FROM rels"""
)
def kg_stats(spark, base):
    records = checkpointed(src.chunk_records(spark, base).select("doc_id", "chunk_index", "entities", "relationships"))
    mentions = ex.entity_rows(records, "doc_id", "chunk_index").withColumn("key", tx.casefold(F.col("name")))
    pairs = ex.relationship_rows(records, "doc_id", "chunk_index").withColumns(
        {"source_key": tx.casefold(F.col("source")), "target_key": tx.casefold(F.col("target"))}
    )
    edges = gr.merge_pairs(pairs)
    return gr.store_stats(
        chunks=records, nodes=gr.degrees(edges), edges=edges, entities=mentions.select("key").distinct(), relationships=pairs
    )


@query(
    f"""{text_graph()},{_EDGES},{_ENTITIES},
deg AS (SELECT id, count(*) AS full_degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
kept AS (SELECT * FROM deg ORDER BY full_degree DESC, id LIMIT 300),
inside AS (SELECT * FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)),
ideg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM inside UNION ALL SELECT dst FROM inside) GROUP BY id)
SELECT k.id, m.entity_type, m.description, k.full_degree, i.degree, round(1.5 + sqrt(i.degree + 1), 6) AS size, (SELECT count(*) FROM deg) > 300 AS is_truncated
FROM kept k JOIN ideg i USING (id) JOIN merged m ON m.key = k.id"""
)
def kg_graph_view(spark, base):
    records = checkpointed(src.chunk_records(spark, base).select("doc_id", "chunk_index", "chunk_id", "entities", "relationships"))
    mentions, edges = _graph_of(records)
    nodes, _, _ = gr.top_subgraph(checkpointed(edges.select("src", "dst")))
    # At most 1000 nodes come out of the cut, so they are the broadcast side of the property lookup.
    shown = checkpointed(nodes)
    entities = gr.merge_mentions(mentions.join(F.broadcast(shown.select(F.col("id").alias("key"))), "key", "left_semi"))
    joined = shown.join(entities.select(F.col("key").alias("id"), "entity_type", "description"), "id")
    return joined.select(
        "id", "entity_type", "description", "full_degree", "degree", F.round(gr.node_size(F.col("degree")), 6).alias("size"), "is_truncated"
    )


@query(
    f"""{text_graph()},
links AS (SELECT DISTINCT key, {chunk_id()} AS chunk_id FROM ents),
texts AS (SELECT {chunk_id()} AS chunk_id, content FROM chunks),
related AS (
  SELECT DISTINCT a.chunk_id, t.content FROM links a JOIN links b ON a.key = b.key AND a.chunk_id <> b.chunk_id JOIN texts t ON t.chunk_id = b.chunk_id),
three AS (SELECT * FROM related QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY content) <= 3)
SELECT c.chunk_id, coalesce(string_agg(r.content, '|' ORDER BY r.content), '') AS related_context, CAST(count(r.content) AS INTEGER) AS related
FROM texts c LEFT JOIN three r USING (chunk_id) GROUP BY c.chunk_id"""
)
def kg_related_context(spark, base):
    records = checkpointed(src.chunk_records(spark, base).select("chunk_id", "content", "entities"))
    mentions = ex.entity_rows(records, "chunk_id").select("chunk_id", tx.casefold(F.col("name")).alias("key"))
    out = rt.related_by_entity(records.select("chunk_id"), mentions, records)
    return out.select(
        "chunk_id", F.array_join("related_context", "|").alias("related_context"), F.size("related_context").alias("related")
    )


@query(
    f"""WITH {sentences('documents', 'doc_id', 'text')},
firsts AS (SELECT doc_id, body, min(si) AS place0 FROM sents GROUP BY ALL),
joined AS (SELECT doc_id, string_agg(body, ' ' ORDER BY place0) AS m FROM firsts GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(m) > 1200 THEN regexp_replace(substr(m, 1, 1200), ' [^ ]*$', '') ELSE coalesce(m, '') END AS summary
FROM documents d LEFT JOIN joined USING (doc_id)"""
)
def description_summaries(spark, base):
    """Description lists in the prompt's own form, one JSON object per sentence, answered by the summary role."""
    docs = src.documents(spark, base)
    sents = F.filter(F.transform(st.sentence_pieces(F.col("text")), tx.py_strip), lambda s: s != "")
    jsonl = F.array_join(F.transform(sents, lambda s: F.to_json(F.struct(s.alias("Description")))), "\n")
    prompt = F.concat(F.lit("Description List:\n\n```\n"), jsonl, F.lit("\n```\n\n---Output---"))
    return docs.select("doc_id", tx.summarize_descriptions(tx.prompt_description_list(prompt)).alias("summary"))


@query(
    r"""SELECT doc_id, CASE lang WHEN 'en' THEN 'extract' WHEN 'fr' THEN 'summarize' ELSE 'empty' END AS route,
       CASE WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN NULL ELSE NULL END AS input_text,
       CASE WHEN lang = 'fr' THEN text END AS description_list FROM documents"""
)
def prompt_routing(spark, base):
    docs = src.documents(spark, base, "doc_id", "text", "lang")
    prompt = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Head\n---Input Text---\n```\n"), F.col("text"), F.lit("\n```\n\n---Output---\n")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Description List:\n\n```\n"), F.col("text"), F.lit("\n```\n\n---Output---\n")))
        .otherwise(F.col("text"))
    )
    staged = docs.select("doc_id", prompt.alias("prompt"))
    return staged.select(
        "doc_id",
        tx.prompt_route(F.col("prompt")).alias("route"),
        tx.prompt_input_text(F.col("prompt")).alias("input_text"),
        tx.prompt_description_list(F.col("prompt")).alias("description_list"),
    )


DIM = ve.EMBEDDING_DIM


def _buckets(source: str, key: str, text: str, name: str) -> str:
    bucket = f"CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {DIM}"
    return f"""
{name}_tok AS (SELECT {key}, unnest({words(f'lower({text})')}) AS tok FROM {source}),
{name}_b AS (SELECT {key}, {bucket} AS b, CAST(count(*) AS DOUBLE) AS n FROM {name}_tok GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_b GROUP BY ALL)"""


_QUERY_CHUNKS = "qchunks AS (SELECT item_id AS doc_id, CAST(0 AS INTEGER) AS chunk_index, text AS content FROM benchmark)"


def _hybrid_base() -> str:
    """Document graph, chunk vectors and question entities, each in its own scope of names."""
    return f"""WITH
g_ents AS ({text_graph()} SELECT * FROM ents),
g_rels AS ({text_graph()} SELECT * FROM rels),
g_chunks AS (WITH {unique_docs()},{token_chunks('uniq')} SELECT *, {chunk_id()} AS chunk_id FROM chunks),
q_ents AS (WITH {_QUERY_CHUNKS},{extraction('qchunks')} SELECT doc_id AS query_id, key FROM ents),
links AS (SELECT DISTINCT key, {chunk_id()} AS chunk_id FROM g_ents),
g_edges AS (
  SELECT least(source_key, target_key) AS src, greatest(source_key, target_key) AS dst, CAST(count(*) AS DOUBLE) AS weight,
         arg_min(description, (doc_id, chunk_index, pos)) AS description
  FROM g_rels WHERE source_key <> target_key GROUP BY ALL),
touching AS (
  SELECT DISTINCT q.query_id, e.* FROM q_ents q JOIN g_edges e ON e.src = q.key OR e.dst = q.key),
wanted AS (SELECT query_id, key FROM q_ents UNION SELECT query_id, src FROM touching UNION SELECT query_id, dst FROM touching)"""


@query(
    f"""{_hybrid_base()},{_buckets('g_chunks', 'chunk_id', 'content', 'c')},{_buckets('benchmark', 'item_id', 'text', 'q')},
sims AS (
  SELECT item_id AS query_id, chunk_id, round(sum(cb.n * qb.n) / (any_value(cn.norm) * any_value(qn.norm)), 9) AS score
  FROM c_b cb JOIN q_b qb USING (b) JOIN c_n cn USING (chunk_id) JOIN q_n qn USING (item_id) GROUP BY item_id, chunk_id),
byv AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims QUALIFY rank <= 40),
gh AS (SELECT w.query_id, l.chunk_id, count(*) AS matched FROM wanted w JOIN links l USING (key) GROUP BY ALL),
byg AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, chunk_id) AS rank FROM gh QUALIFY rank <= 40),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score FROM (SELECT * FROM byv UNION ALL SELECT * FROM byg) GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS idx FROM fused QUALIFY idx <= 40),
pairs AS (
  SELECT p.*, c.content, c.doc_id, list_distinct({words('lower(b.text)')}) AS qt, list_distinct({words('lower(c.content)')}) AS dt
  FROM pool p JOIN g_chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = p.query_id),
scored AS (SELECT *, coalesce(len(list_intersect(qt, dt)) / nullif(CAST(len(qt) AS DOUBLE), 0), 0) AS relevance FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, idx) AS rerank FROM scored QUALIFY rerank <= 10),
used AS (SELECT *, sum(length(content) // 4) OVER (PARTITION BY query_id ORDER BY rerank) AS tokens_used FROM best QUALIFY tokens_used <= 8000),
refs AS (
  SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rerank), doc_id) AS VARCHAR) AS reference_id
  FROM used GROUP BY query_id, doc_id)
SELECT u.query_id, CAST(u.rerank AS INTEGER) AS rerank, u.chunk_id, u.doc_id, round(u.relevance, 6) AS relevance_score, round(u.rrf_score, 9) AS rrf_score,
       CAST(u.tokens_used AS BIGINT) AS tokens_used, r.reference_id
FROM used u JOIN refs r ON r.query_id = u.query_id AND r.doc_id = u.doc_id"""
)
def hybrid_retrieval(spark, base):
    """Every benchmark text as a question: vector and graph hits fused, reranked, cut to the budget, with references."""
    records = checkpointed(src.chunk_records(spark, base))
    questions = _questions(spark, base)
    mentions, edges = _graph_of(records)
    vectors = ve.embed(records.select("chunk_id", "content")).select("chunk_id", "embedding")
    context = ask.retrieve(questions, records.select("chunk_id", "doc_id", "content"), vectors, mentions, edges)
    # At most ten rows per question: made durable once, because the references read them a second time.
    rows = checkpointed(context.select("query_id", "rerank", "chunk_id", "doc_id", "relevance_score", "rrf_score", "tokens_used"))
    refs = rt.references(rows, file_path="doc_id").withColumnRenamed("file_path", "doc_id")
    return rows.join(refs, ["query_id", "doc_id"]).select(
        "query_id",
        "rerank",
        "chunk_id",
        "doc_id",
        F.round("relevance_score", 6).alias("relevance_score"),
        F.round("rrf_score", 9).alias("rrf_score"),
        "tokens_used",
        "reference_id",
    )


def _questions(spark, base):
    return table(spark, base, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def _graph_of(records):
    mentions = ex.entity_rows(records, "doc_id", "chunk_index", "chunk_id").withColumn("key", tx.casefold(F.col("name")))
    pairs = ex.relationship_rows(records, "doc_id", "chunk_index").withColumns(
        {"source_key": tx.casefold(F.col("source")), "target_key": tx.casefold(F.col("target"))}
    )
    return mentions, gr.merge_pairs(pairs)


@query(
    f"""{_hybrid_base()},
ments AS (SELECT key, count(*) AS mentions FROM g_ents GROUP BY key),
ddesc AS (SELECT key, description, min((doc_id, chunk_index, pos)) AS place0 FROM g_ents WHERE description <> '' GROUP BY ALL),
djoin AS (SELECT key, string_agg(description, ' ' ORDER BY place0) AS d FROM ddesc GROUP BY key),
ent AS (SELECT key, mentions, CASE WHEN length(d) > 1200 THEN regexp_replace(substr(d, 1, 1200), ' [^ ]*$', '') ELSE d END AS description FROM ments LEFT JOIN djoin USING (key)),
e1 AS (SELECT w.query_id, e.*, row_number() OVER (PARTITION BY w.query_id ORDER BY mentions DESC, key) AS place FROM wanted w JOIN ent e USING (key)),
e2 AS (SELECT *, sum(length(description) // 4 + 1) OVER (PARTITION BY query_id ORDER BY place) AS used FROM e1),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, src, dst) AS place FROM touching),
r2 AS (SELECT *, sum(length(description) // 4 + 1) OVER (PARTITION BY query_id ORDER BY place) AS used FROM r1)
SELECT 'entity' AS part, query_id, key AS name, '' AS target, CAST(used AS BIGINT) AS tokens_used FROM e2 WHERE used <= 2000
UNION ALL SELECT 'relation', query_id, src, dst, CAST(used AS BIGINT) FROM r2 WHERE used <= 2666"""
)
def hybrid_knowledge_budget(spark, base):
    records = checkpointed(src.chunk_records(spark, base).select("doc_id", "chunk_index", "chunk_id", "entities", "relationships"))
    mentions, edges = _graph_of(records)
    shown, rels = ask.knowledge(_questions(spark, base), gr.merge_mentions(mentions), edges)
    return shown.select(F.lit("entity").alias("part"), "query_id", F.col("key").alias("name"), F.lit("").alias("target"), "tokens_used").unionByName(
        rels.select(F.lit("relation").alias("part"), "query_id", F.col("src").alias("name"), F.col("dst").alias("target"), "tokens_used")
    )


def _english_first(spark, base, docs):
    """The documents whose id an English one has, and the others. Read several times, so their texts are dealt once and stored."""
    english = table(spark, base, "documents", "doc_id", "lang").where("lang = 'en'").select(F.col("doc_id").alias("seq")).distinct()
    marked = checkpointed(docs.join(english.withColumn("_english", F.lit(True)), "seq", "left"))
    return marked.where("_english").drop("_english"), marked.where("_english IS NULL").drop("_english")


@query(
    f"""{text_graph()},
bad AS (SELECT DISTINCT sha256({norm(strip('text'))}) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
gone AS (SELECT doc_id FROM uniq WHERE sha256({norm(strip('text'))}) IN (SELECT h FROM bad)),
e AS (SELECT * FROM ents WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
r AS (SELECT * FROM rels WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
tcount AS (SELECT key, type, count(*) AS n FROM e GROUP BY ALL)
SELECT 'entity' AS part, key AS a, arg_min(type, (-n, type)) AS b, CAST(sum(n) AS DOUBLE) AS n FROM tcount GROUP BY key
UNION ALL
SELECT 'edge', least(source_key, target_key), greatest(source_key, target_key), CAST(count(*) AS DOUBLE) FROM r WHERE source_key <> target_key GROUP BY ALL
UNION ALL
SELECT 'document', sha256({norm(strip('text'))}), NULL, 1.0 FROM uniq WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND {strip('text')} <> ''"""
)
def kb_life_cycle(spark, base):
    """All documents in two batches, the second one twice, then the toxic ones deleted: what the stored base holds."""
    docs = src.incoming(spark, base).withColumn("file_name", F.concat_ws("-", "seq", "file_name"))
    batches = _english_first(spark, base, docs)
    base_tables = Store(spark, shared_folder(spark, "base"))
    when = F.lit(src.BASE_TIME).cast("timestamp")
    for batch in (batches[0], batches[1], batches[1]):
        add_batch(base_tables, batch, when)
    toxic = table(spark, base, "labels", "doc_id", "toxic").where("toxic = 1").select(F.col("doc_id").alias("seq"))
    hashes = docs.select("seq", tx.doc_id_from_hash(tx.content_hash(tx.py_strip(F.col("text")))).alias("doc_id"))
    remove_documents(base_tables, hashes.join(toxic, "seq", "left_semi").select("doc_id"))
    entities, edges, manifest = (base_tables.load(n) for n in ("entities", "edges", "manifest"))
    return (
        entities.select(F.lit("entity").alias("part"), F.col("key").alias("a"), F.col("entity_type").alias("b"), F.col("mentions").cast("double").alias("n"))
        .unionByName(edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("n")))
        .unionByName(manifest.select(F.lit("document").alias("part"), F.col("content_hash").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(1.0).alias("n")))
    )


@query(
    f"""{text_graph()},
en AS (SELECT DISTINCT sha256({norm(strip('text'))}) AS h FROM documents WHERE lang = 'en'),
early AS (SELECT doc_id FROM uniq WHERE sha256({norm(strip('text'))}) IN (SELECT h FROM en)),
c1 AS (SELECT key, type, count(*) AS n FROM ents WHERE doc_id IN (SELECT doc_id FROM early) GROUP BY ALL),
c2 AS (SELECT key, type, count(*) AS n FROM ents GROUP BY ALL),
s1 AS (SELECT key, arg_min(type, (-n, type)) AS entity_type, CAST(sum(n) AS BIGINT) AS mentions FROM c1 GROUP BY key),
s2 AS (SELECT key, arg_min(type, (-n, type)) AS entity_type, CAST(sum(n) AS BIGINT) AS mentions FROM c2 GROUP BY key)
SELECT 'added' AS change, * FROM (SELECT * FROM s2 EXCEPT SELECT * FROM s1) UNION ALL SELECT 'removed', * FROM (SELECT * FROM s1 EXCEPT SELECT * FROM s2)"""
)
def kb_change_feed(spark, base):
    """What the second of two batches changes in the stored entities, from the runs that the two snapshots do not share."""
    docs = src.incoming(spark, base).withColumn("file_name", F.concat_ws("-", "seq", "file_name"))
    batches = _english_first(spark, base, docs)
    base_tables = Store(spark, shared_folder(spark, "base"))
    when = F.lit(src.BASE_TIME).cast("timestamp")
    add_batch(base_tables, batches[0], when)
    first = base_tables.latest()
    add_batch(base_tables, batches[1], when)
    return base_tables.changes("entities", first).select("change", "key", "entity_type", "mentions")


@query(
    f"""{text_graph()}, c AS (SELECT key, type, count(*) AS n FROM ents GROUP BY ALL)
SELECT key, arg_min(type, (-n, type)) AS entity_type, CAST(sum(n) AS BIGINT) AS mentions FROM c GROUP BY key"""
)
def stream_kb_entities(spark, base):
    """Entities of a base that a stream of documents has filled."""
    stream = table_stream(spark, base, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    uploads = stream.select(F.col("doc_id").alias("seq"), name.alias("file_name"), F.lit("text").alias("source_type"), "text")
    folder = shared_folder(spark, "base")
    store = Store(spark, f"{folder}/tables")
    index_to_end(uploads, store, f"{folder}/progress", F.lit(src.BASE_TIME).cast("timestamp"))
    return store.load("entities").select("key", "entity_type", "mentions")
