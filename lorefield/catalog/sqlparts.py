"""SQL fragments shared by the oracle statements. They are written relationally, not as the Spark side does it."""

from __future__ import annotations

from lorefield.functions.text import NAME_EDGE_CHARS, WS_CHARS
from lorefield.operators.extract import SHAPES

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SENTENCE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def clean_name(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), {lit(NAME_EDGE_CHARS)})"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def chunk_id(doc: str = "doc_id", idx: str = "chunk_index") -> str:
    return f"sha256(CAST({doc} AS VARCHAR) || '|' || CAST({idx} AS VARCHAR))"


def token_chunks(source: str = "documents") -> str:
    """CTE `chunks(doc_id, chunk_index, token_count, content)`."""
    return f"""
toks AS (SELECT doc_id, regexp_extract_all({strip('text')}, '{NON_WS}+{WS}*') AS toks FROM {source}),
starts AS (SELECT doc_id, toks, unnest(range(0, len(toks), 924)) AS st FROM toks),
chunks AS (
  SELECT doc_id, CAST(st // 924 AS INTEGER) AS chunk_index,
         CAST(least(1024, len(toks) - st) AS INTEGER) AS token_count,
         {strip("array_to_string(toks[st + 1 : st + 1024], '')")} AS content
  FROM starts)"""


def unique_docs() -> str:
    """CTE `uniq`: the first document of every content hash."""
    return f"""
uniq AS (
  SELECT doc_id, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY sha256({norm(strip('text'))}) ORDER BY doc_id) = 1)"""


def sentences(source: str, key: str, text: str) -> str:
    """CTE `sents(key..., si, s, e, body)`: non-blank sentences with offsets; si from 1."""
    return f"""
pieces AS (
  SELECT {key}, unnest(regexp_extract_all({text}, '{SENTENCE}')) AS piece,
         generate_subscripts(regexp_extract_all({text}, '{SENTENCE}'), 1) AS pos
  FROM {source}),
placed AS (
  SELECT {key}, pos, piece,
         CAST(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY pos) AS INTEGER) AS e
  FROM pieces),
sents AS (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY pos) AS INTEGER) AS si,
         e - CAST(length(piece) AS INTEGER) AS s, e, {strip('piece')} AS body
  FROM placed WHERE {strip('piece')} <> '')"""


def _label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({x}, '{shape}') THEN '{name}'" for name, shape, _ in SHAPES) + " END"


def _score(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{name}' THEN CAST({score} AS DOUBLE)" for name, _, score in SHAPES) + " END"


def extraction(chunk_source: str = "chunks") -> str:
    """CTEs `ents` and `rels` from `chunks`, with the caps of one chunk."""
    # Dates and names can span several words; every other shape is a whole word, so words are cut first and tested after.
    spanning = "|".join(shape for name, shape, _ in SHAPES if name in ("date", "person"))
    tile = spanning + r"|[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
    key = "doc_id, chunk_index"
    return f"""
{sentences(chunk_source, key, 'content').lstrip()},
tiles AS (
  SELECT {key}, unnest(regexp_extract_all(content, '{tile}')) AS tile,
         generate_subscripts(regexp_extract_all(content, '{tile}'), 1) AS tpos
  FROM {chunk_source}),
laid AS (
  SELECT {key}, tpos, tile, {_label('tile')} AS label,
         CAST(sum(length(tile)) OVER (PARTITION BY {key} ORDER BY tpos) AS INTEGER) AS e
  FROM tiles),
found AS MATERIALIZED (
  SELECT {key}, tpos, e - CAST(length(tile) AS INTEGER) AS s, e, {clean_name('tile')} AS name, label, {_score('label')} AS score
  FROM laid WHERE label IS NOT NULL AND label <> 'other'),
ment AS MATERIALIZED (
  SELECT f.*, {fold('f.name')} AS key, t.si, t.body
  FROM found f ASOF JOIN sents t ON f.doc_id = t.doc_id AND f.chunk_index = t.chunk_index AND f.s >= t.s
  WHERE f.name <> '' AND f.score >= 0.4),
ent0 AS (
  SELECT {key}, key, min(tpos) AS fpos, arg_min(name, tpos) AS name, arg_min(label, tpos) AS type,
         arg_min(score, tpos) AS score, arg_min(body, tpos) AS body
  FROM ment GROUP BY ALL),
ent1 AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, fpos) AS rnk FROM ent0),
ents AS (
  SELECT {key}, CAST(rnk - 1 AS INTEGER) AS pos, key, name, type, substr(body, 1, 400) AS description FROM ent1 WHERE rnk <= 40),
elig AS (
  SELECT m.doc_id, m.chunk_index, m.si, m.body, m.s, m.e, n.key, n.name,
         row_number() OVER (PARTITION BY m.doc_id, m.chunk_index, m.si, m.key ORDER BY m.tpos) AS dup, m.tpos
  FROM ment m JOIN ents n USING (doc_id, chunk_index, key)),
five AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index, si ORDER BY tpos) AS slot
  FROM elig WHERE dup = 1),
pairs AS (
  SELECT a.doc_id, a.chunk_index, a.key AS source_key, b.key AS target_key, a.name AS source, b.name AS target, substr(a.body, 1, 400) AS description,
         coalesce(nullif(array_to_string(({words('CASE WHEN b.s > a.e THEN substr(c.content, a.e + 1, b.s - a.e) ELSE $$$$ END')})[1:6], ' '), ''), 'related to') AS keywords,
         row_number() OVER (PARTITION BY a.doc_id, a.chunk_index ORDER BY a.si, a.slot, b.slot) AS rnk
  FROM five a JOIN five b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND a.si = b.si AND a.slot < b.slot AND b.slot <= 5
  JOIN {chunk_source} c ON c.doc_id = a.doc_id AND c.chunk_index = a.chunk_index),
rels AS (
  SELECT {key}, CAST(rnk - 1 AS INTEGER) AS pos, source_key, target_key, source, target, keywords, description FROM pairs WHERE rnk <= 60)"""


def text_graph() -> str:
    """All CTEs from documents to `ents` and `rels`, duplicates removed first."""
    return f"WITH {unique_docs()},{token_chunks('uniq')},{extraction()}"


TRADE = """
trade AS (
  SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'located_in' AS relation, CAST(1 AS DOUBLE) AS weight FROM customer
  UNION ALL
  SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', CAST(1 AS DOUBLE) FROM supplier
  UNION ALL
  SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', CAST(1 AS DOUBLE) FROM nation
  UNION ALL
  SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 'bought', CAST(count(*) AS DOUBLE)
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL
  SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', CAST(count(*) AS DOUBLE)
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
