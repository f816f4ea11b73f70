"""Queries over `documents`: text functions, duplicate resolution, inventory, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.catalog import inputs as src
from lorefield.catalog.sqlparts import WS, chunk_id, norm, sentences, strip, token_chunks, unique_docs, words
from lorefield.functions.arrays import explode_rows
from lorefield.functions import sentences as st
from lorefield.functions import text as tx
from lorefield.operators import chunks as ch
from lorefield.operators import manifest as mf
from lorefield.operators import vector as ve
from lorefield.session import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add





@query(
    f"""SELECT doc_id, sha256({norm('text')}) AS content_hash, sha256(text) AS raw_sha256, md5(text) AS raw_md5,
        CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents"""
)
def doc_content_hash(spark, base):
    return src.documents(spark, base).select(
        "doc_id",
        tx.content_hash(F.col("text")).alias("content_hash"),
        F.sha2(F.col("text"), 256).alias("raw_sha256"),
        F.md5(F.col("text")).alias("raw_md5"),
        tx.utf8_size(F.col("text")).alias("size_bytes"),
    )


@query(
    f"""SELECT doc_id, {strip("translate(regexp_replace(regexp_replace(text, '" + WS + "+', ' ', 'g'), '[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}]', '', 'g'), ' ​', ' ')")} AS clean_text
        FROM documents"""
)
def doc_clean_text(spark, base):
    return src.documents(spark, base).select("doc_id", tx.clean_text(F.col("text")).alias("clean_text"))


@query(
    f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS word_count,
        CASE WHEN len(w) <= 12 THEN text ELSE array_to_string(w[1:12], ' ') || '...' END AS snippet
        FROM (SELECT doc_id, text, {words('text')} AS w FROM documents)"""
)
def doc_snippet(spark, base):
    return src.documents(spark, base).select(
        "doc_id", tx.word_count(F.col("text")).alias("word_count"), tx.snippet(F.col("text")).alias("snippet")
    )


@query(
    """SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens,
       CAST((length(text) + length(source)) // 4 + 1000 AS INTEGER) AS request_tokens,
       (length(text) // 4 + 2000) > 6000 AS over_rate,
       printf('%.1f KB', floor(CAST(strlen(text) AS DOUBLE) / 1024 * 10 + 0.5) / 10) AS size_label FROM documents"""
)
def doc_token_estimates(spark, base):
    docs = src.documents(spark, base, "doc_id", "text", "source")
    return docs.select(
        "doc_id",
        tx.count_tokens(F.col("text")).alias("tokens"),
        tx.estimate_tokens(F.col("text"), F.col("source")).alias("request_tokens"),
        tx.budget_exceeds_rate(tx.count_tokens(F.col("text")), F.lit(6000)).alias("over_rate"),
        tx.kilobytes(tx.utf8_size(F.col("text"))).alias("size_label"),
    )


@query(
    f"""SELECT doc_id, coalesce(nullif({strip("CASE WHEN lang = 'en' THEN '  ' ELSE source END")}, ''), nullif(substr({strip('text')}, 1, 60), ''), 'Pasted text') AS pasted_name,
        coalesce(nullif({strip("CASE WHEN lang = 'en' THEN '  ' ELSE source END")}, ''), substr(text, 1, 40)) AS upload_label,
        'doc-' || substr(sha256({norm('text')}), 1, 32) AS stable_id FROM documents"""
)
def doc_display_names(spark, base):
    docs = src.documents(spark, base, "doc_id", "text", "source", "lang")
    title = F.when(F.col("lang") == "en", "  ").otherwise(F.col("source"))
    return docs.select(
        "doc_id",
        tx.pasted_name(title, F.col("text")).alias("pasted_name"),
        tx.upload_label(title, F.col("text")).alias("upload_label"),
        tx.doc_id_from_hash(tx.content_hash(F.col("text"))).alias("stable_id"),
    )


@query(
    f"""SELECT doc_id, file_name, extension, source_type, coalesce(source_type, 'unknown') AS reconcile_type,
        CASE WHEN source_type IS NULL THEN 'Unsupported file type: ' || extension END AS error
        FROM (SELECT doc_id, {src.FILE_NAME_SQL} AS file_name, lower(regexp_extract({src.FILE_NAME_SQL}, '(\\.[^.]*)$', 1)) AS extension,
              {src.TYPE_SQL.format(src.FILE_NAME_SQL)} AS source_type FROM documents)"""
)
def upload_types(spark, base):
    docs = src.documents(spark, base, "doc_id", "source", "lang").withColumn("file_name", src.file_name())
    kind = mf.source_type_of(F.col("file_name"))
    ext = mf.extension(F.col("file_name"))
    return docs.select(
        "doc_id",
        "file_name",
        ext.alias("extension"),
        kind.alias("source_type"),
        F.coalesce(kind, F.lit("unknown")).alias("reconcile_type"),
        F.when(kind.isNull(), F.concat(F.lit("Unsupported file type: "), ext)).alias("error"),
    )


_STORED = f"""
stored AS (
  SELECT 'kb-' || doc_id AS doc_id, {src.FILE_NAME_SQL} AS file_name,
         coalesce({src.TYPE_SQL.format(src.FILE_NAME_SQL)}, 'unknown') AS source_type,
         sha256({norm('text')}) AS content_hash, CAST(1 AS INTEGER) AS chunk_count, CAST(strlen({strip('text')}) AS BIGINT) AS size_bytes,
         {src.DATE_SQL} AS date_added
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""

_INCOMING = f"""
inc AS (
  SELECT doc_id AS seq, {src.FILE_NAME_SQL} AS file_name, {src.TYPE_SQL.format(src.FILE_NAME_SQL)} AS source_type,
         sha256({norm('text')}) AS content_hash, CAST(strlen({strip('text')}) AS BIGINT) AS size_bytes
  FROM documents WHERE {strip('text')} <> '')"""


@query(
    f"""WITH {_STORED},{_INCOMING},
known AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY date_added, doc_id) = 1),
firsts AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1)
SELECT i.seq, coalesce(k.doc_id, 'doc-' || substr(i.content_hash, 1, 32)) AS doc_id,
       coalesce(k.file_name, f.file_name) AS file_name,
       CASE WHEN k.doc_id IS NOT NULL THEN k.source_type ELSE f.source_type END AS source_type,
       i.content_hash, coalesce(k.size_bytes, f.size_bytes) AS size_bytes,
       (k.doc_id IS NOT NULL OR i.seq <> f.seq) AS deduped,
       CASE WHEN (k.doc_id IS NOT NULL OR i.seq <> f.seq) THEN 'Already in the knowledge base (' || coalesce(k.file_name, f.file_name) || ').'
            ELSE 'Added "' || f.file_name || '" — 1 chunk.' END AS message
FROM inc i JOIN firsts f USING (content_hash) LEFT JOIN known k USING (content_hash)"""
)
def ingest_outcomes(spark, base):
    outcome = mf.resolve_batch(mf.prepare(src.incoming(spark, base)), src.stored_manifest(spark, base))
    return outcome.withColumn("message", tx.ingest_message(F.col("deduped"), F.col("file_name"), F.lit(1)))


@query(
    f"""WITH {_STORED},{_INCOMING}
SELECT seq, 'doc-' || substr(content_hash, 1, 32) AS doc_id, file_name, content_hash, size_bytes FROM inc
WHERE content_hash NOT IN (SELECT content_hash FROM stored)
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1"""
)
def ingest_new_documents(spark, base):
    fresh = mf.new_documents(mf.prepare(src.incoming(spark, base)), src.stored_manifest(spark, base))
    return fresh.select("seq", "doc_id", "file_name", "content_hash", "size_bytes")


@query(
    f"""WITH {unique_docs()},{token_chunks('uniq')},
n AS (SELECT doc_id, count(*) AS c FROM chunks GROUP BY doc_id)
SELECT 'doc-' || substr(sha256({norm('d.text')}), 1, 32) AS doc_id, {src.FILE_NAME_SQL} AS file_name,
       coalesce({src.TYPE_SQL.format(src.FILE_NAME_SQL)}, 'unknown') AS source_type,
       CAST(coalesce(n.c, 0) AS INTEGER) AS chunk_count, CAST(strlen({strip('d.text')}) AS BIGINT) AS size_bytes,
       TIMESTAMP '{src.BASE_TIME}' + to_minutes(CAST(d.doc_id AS INTEGER)) AS date_added
FROM documents d SEMI JOIN uniq u ON d.doc_id = u.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def manifest_listing(spark, base):
    """The flagship inventory: deduplicated documents with chunk counts, newest first."""
    docs = src.documents(spark, base, "doc_id", "text", "source", "lang")
    hashed = docs.withColumn("content_hash", tx.content_hash(tx.py_strip(F.col("text"))))
    # The chunk count needs only the text in its own row, so the text itself is never shuffled.
    counted = hashed.select(
        F.col("doc_id").alias("seq"),
        "content_hash",
        tx.doc_id_from_hash(F.col("content_hash")).alias("doc_id"),
        src.file_name().alias("file_name"),
        F.coalesce(mf.source_type_of(src.file_name()), F.lit("unknown")).alias("source_type"),
        F.size(ch.token_windows(ch.token_pieces(tx.py_strip(F.col("text"))))).alias("chunk_count"),
        tx.utf8_size(tx.py_strip(F.col("text"))).alias("size_bytes"),
        src.date_added(F.col("doc_id")).alias("date_added"),
    )
    row = F.struct("seq", *[c for c in counted.columns if c not in ("seq", "content_hash")])
    firsts = counted.groupBy("content_hash").agg(F.min_by(row, "seq").alias("r")).select("content_hash", "r.*")
    return mf.listing(firsts)


_STATUS = f"""
base AS (SELECT d.*, l.quality, {src.FILE_NAME_SQL} AS name FROM documents d LEFT JOIN labels l USING (doc_id)),
status AS (
  SELECT 'kb-' || doc_id AS id, CASE quality WHEN 1 THEN 'processed' WHEN 0 THEN 'failed' ELSE 'pending' END AS status,
         CASE WHEN lang = 'es' THEN '' ELSE name END AS file_path, CAST(NULL AS INTEGER) AS chunks_count,
         CASE WHEN lang = 'en' THEN md5(name) END AS content_hash, n_chars AS content_length, CAST(NULL AS VARCHAR) AS error_msg, doc_id AS num
  FROM base
  UNION ALL
  SELECT 'dup-' || doc_id, 'failed', name, NULL, NULL, NULL, 'File name already exists.', doc_id FROM base WHERE quality = 0)"""


@query(
    f"""WITH {_STORED},{_STATUS},
en AS (SELECT * FROM stored WHERE source_type = 'text')
SELECT id AS doc_id, coalesce(nullif(file_path, ''), id) AS file_name,
       coalesce({src.TYPE_SQL.format("coalesce(nullif(file_path, ''), id)")}, 'unknown') AS source_type,
       '{mf.RECONCILED_HASH_PREFIX}' || coalesce(nullif(content_hash, ''), id) AS content_hash,
       CAST(coalesce(chunks_count, 0) AS INTEGER) AS chunk_count, coalesce(content_length, 0) AS size_bytes,
       TIMESTAMP '{src.BASE_TIME}' AS date_added
FROM status WHERE status = 'processed' AND id NOT IN (SELECT doc_id FROM en)"""
)
def manifest_reconcile(spark, base):
    stored = src.stored_manifest(spark, base).where("source_type = 'text'")
    return mf.reconcile(src.doc_status(spark, base), stored, F.lit(src.BASE_TIME).cast("timestamp"))


@query(
    f"""WITH {_STORED},{_INCOMING},
named AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY date_added, doc_id) = 1)
SELECT i.seq, i.file_name, n.doc_id, n.doc_id IS NOT NULL AS deduped,
       CASE WHEN n.doc_id IS NULL THEN '''' || i.file_name || ''' was rejected as a duplicate, but no indexed document with that name exists. Delete it from the knowledge base and upload again.' END AS error
FROM (SELECT seq, file_name FROM inc UNION ALL SELECT -1 - seq, 'new-' || file_name FROM inc) i LEFT JOIN named n USING (file_name)"""
)
def ingest_name_conflicts(spark, base):
    """Every file name, and as many that no stored document has."""
    names = src.incoming(spark, base).select("seq", "file_name")
    unknown = names.select((-1 - F.col("seq")).alias("seq"), F.concat(F.lit("new-"), "file_name").alias("file_name"))
    return mf.resolve_rejected(names.unionByName(unknown), src.stored_manifest(spark, base))


@query(
    f"""WITH {_STORED},{_STATUS},
wanted AS (SELECT 'kb-' || doc_id AS doc_id FROM labels WHERE toxic = 1),
hit AS (SELECT * FROM stored WHERE doc_id IN (SELECT doc_id FROM wanted)),
gone AS (SELECT id FROM status WHERE status = 'failed' AND id LIKE 'dup-%' AND file_path IN (SELECT file_name FROM hit)
         UNION ALL SELECT doc_id FROM hit)
SELECT 'deleted' AS part, doc_id AS id, doc_id IN (SELECT doc_id FROM hit) AS flag FROM wanted
UNION ALL SELECT 'manifest', doc_id, NULL FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM wanted)
UNION ALL SELECT 'status', id, NULL FROM status WHERE id NOT IN (SELECT id FROM gone)"""
)
def kb_delete_cascade(spark, base):
    ids = table(spark, base, "labels", "doc_id", "toxic").where("toxic = 1").select(F.concat(F.lit("kb-"), "doc_id").alias("doc_id"))
    out = mf.delete_documents(ids, src.stored_manifest(spark, base), src.doc_status(spark, base))
    none = F.lit(None).cast("boolean").alias("flag")
    return (
        out["outcome"].select(F.lit("deleted").alias("part"), F.col("doc_id").alias("id"), F.col("deleted").alias("flag"))
        .unionByName(out["manifest"].select(F.lit("manifest").alias("part"), F.col("doc_id").alias("id"), none))
        .unionByName(out["status"].select(F.lit("status").alias("part"), "id", none))
    )


@query(
    f"""WITH {_STATUS}
SELECT id, status, status IN ('pending', 'processing', 'failed') AS resumable,
       CASE WHEN status = 'failed' THEN coalesce(nullif(error_msg, ''), 'Processing failed.') END AS error FROM status"""
)
def doc_status_resume(spark, base):
    status = src.doc_status(spark, base)
    errors = mf.failed_inserts(status).select(F.col("doc_id").alias("id"), "error")
    return status.select("id", "status", F.col("status").isin(*mf.RESUMABLE).alias("resumable")).join(errors, "id", "left")


@query("SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY ALL")
def doc_source_inventory(spark, base):
    docs = src.documents(spark, base, "source", "lang", "n_chars")
    return docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest")
    )


@query(f"WITH {sentences('documents', 'doc_id', 'text')} SELECT doc_id, si, s, e FROM sents")
def sentence_spans(spark, base):
    docs = src.documents(spark, base)
    spans = explode_rows(docs, st.sentence_spans(F.col("text")), "doc_id", pos="si", item="p")
    return spans.select("doc_id", (F.col("si") + 1).alias("si"), F.col("p.s").alias("s"), F.col("p.e").alias("e"))


@query(
    f"""WITH RECURSIVE {sentences('documents', 'doc_id', 'text')},
walk AS (
  SELECT doc_id, si, s AS start, e FROM sents WHERE si = 1
  UNION ALL
  SELECT t.doc_id, t.si, CASE WHEN t.e - w.start > 900 THEN t.s ELSE w.start END, t.e
  FROM walk w JOIN sents t ON t.doc_id = w.doc_id AND t.si = w.si + 1)
SELECT w.doc_id, w.start, substr(d.text, w.start + 1, max(w.e) - w.start) AS window_text
FROM walk w JOIN documents d USING (doc_id) GROUP BY w.doc_id, w.start, d.text"""
)
def sentence_windows(spark, base):
    docs = src.documents(spark, base)
    wins = explode_rows(docs, st.windows(F.col("text"), st.sentence_spans(F.col("text"))), "doc_id", item="w")
    return wins.select("doc_id", F.col("w.start").alias("start"), F.col("w.text").alias("window_text"))


@query(
    f"""WITH RECURSIVE {sentences('documents', 'doc_id', 'text')},
walk AS (
  SELECT doc_id, si, 1 AS first, length(body) AS held, CAST(NULL AS INTEGER) AS closed_from, CAST(NULL AS INTEGER) AS closed_to FROM sents WHERE si = 1
  UNION ALL
  SELECT t.doc_id, t.si,
         CASE WHEN w.held + length(t.body) > 800 THEN w.si ELSE w.first END,
         CASE WHEN w.held + length(t.body) > 800 THEN length(p.body) + length(t.body) ELSE w.held + length(t.body) END,
         CASE WHEN w.held + length(t.body) > 800 THEN w.first END,
         CASE WHEN w.held + length(t.body) > 800 THEN w.si END
  FROM walk w JOIN sents t ON t.doc_id = w.doc_id AND t.si = w.si + 1 JOIN sents p ON p.doc_id = w.doc_id AND p.si = w.si),
spans AS (
  SELECT doc_id, closed_from AS a, closed_to AS b FROM walk WHERE closed_from IS NOT NULL
  UNION ALL
  SELECT doc_id, first, si FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY si DESC) = 1)
SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.b, p.a) - 1 AS INTEGER) AS chunk_index, string_agg(t.body, ' ' ORDER BY t.si) AS content
FROM spans p JOIN sents t ON t.doc_id = p.doc_id AND t.si BETWEEN p.a AND p.b GROUP BY p.doc_id, p.a, p.b"""
)
def sentence_packed_chunks(spark, base):
    docs = src.documents(spark, base)
    return explode_rows(docs, st.packed_chunks(F.col("text")), "doc_id", pos="chunk_index", item="content")


@query(
    f"""WITH {token_chunks()}
SELECT doc_id, chunk_index, {chunk_id()} AS chunk_id, content, token_count FROM chunks"""
)
def token_window_chunks(spark, base):
    return ch.chunk_by_tokens(src.documents(spark, base))


@query()
def cascade_chunks(spark, base):
    return ch.chunk_by_cascade(src.documents(spark, base))


@query(
    f"""WITH {token_chunks()},
facts AS (SELECT *, sha256(content) AS content_hash, CAST(length(content) AS INTEGER) AS char_count FROM chunks)
SELECT doc_id, chunk_index, char_count, content_hash FROM facts
WHERE content_hash NOT IN (SELECT content_hash FROM facts WHERE doc_id IN (SELECT doc_id FROM labels))"""
)
def chunk_hash_skip(spark, base):
    chunks = ch.with_chunk_facts(ch.chunk_by_tokens(src.documents(spark, base)))
    stored = chunks.join(table(spark, base, "labels", "doc_id"), "doc_id", "left_semi")
    light = chunks.select("doc_id", "chunk_index", "char_count", "content_hash")
    return ve.missing_chunks(light, stored)


@query(
    f"""WITH {token_chunks()}
SELECT d.doc_id, CAST(count(c.doc_id) AS INTEGER) AS chunk_count FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id"""
)
def doc_chunk_counts(spark, base):
    docs = src.documents(spark, base)
    chunks = ch.chunk_by_tokens(docs).select("doc_id")
    return ch.chunk_counts(docs.select("doc_id"), chunks)
