"""Queries over `conversations`: history, answer streams and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.catalog.sqlparts import NON_WS, WS
from lorefield.functions import markdown as md
from lorefield.functions import text as tx
from lorefield.operators import uploads as up
from lorefield.session import apply_semantics, shared_folder, table, table_stream
from lorefield.streaming import chat as sc
from lorefield.streaming import conversations as cv

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _turns(spark, base):
    apply_semantics(spark)
    return table(spark, base, "conversations", "conv_id", "turn", "role", "text")


@query("SELECT conv_id, role, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id, role")
def chat_last_by_role(spark, base):
    return up.last_by_role(_turns(spark, base))


@query("SELECT conv_id, turn // 256 AS page, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, CAST(count(*) AS INTEGER) AS messages FROM conversations GROUP BY ALL")
def chat_history_state(spark, base):
    state = up.conversation_state(_turns(spark, base))
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return state.select("conv_id", "page", F.array_join(lines, "\n").alias("history"), F.size("history").alias("messages"))


@query(ORACLES["chat_history_state"])
def chat_history_stream(spark, base):
    """The same histories, kept as state of a stream."""
    apply_semantics(spark)
    stream = table_stream(spark, base, "conversations")
    folder = shared_folder(spark, "chat")
    state = cv.run_to_end(stream.select("conv_id", "turn", "role", "text"), f"{folder}/pages", f"{folder}/progress")
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return state.select(F.col("conv_id").cast(stream.schema["conv_id"].dataType).alias("conv_id"), "page", F.array_join(lines, "\n").alias("history"), F.size("history").alias("messages"))


@query(
    """WITH h AS (SELECT *, row_number() OVER w - 1 AS history_len, lag(turn) OVER w AS history_last_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, history_len, history_last_turn FROM h WHERE role = 'user'"""
)
def chat_history_before(spark, base):
    return up.history_before(_turns(spark, base))


@query("SELECT conv_id, turn, text AS resolved FROM conversations WHERE role = 'user'")
def chat_resolved_queries(spark, base):
    turns = _turns(spark, base).where("role = 'user'")
    return turns.select("conv_id", "turn", tx.resolve_coreferences(F.col("text")).alias("resolved"))


def _answers(spark, base):
    """Assistant turns as streamed answers: pieces with their blanks, and a failure where a system turn says so."""
    turns = _turns(spark, base).where("role <> 'user'")
    text = F.col("text")
    pieces = F.concat(F.regexp_extract_all(text, F.lit(f"{tx.WS}*{tx.NON_WS}+"), F.lit(0)), F.array(F.lit("")))
    refs = F.array(
        F.struct(F.lit("1").alias("reference_id"), F.concat(F.lit("conv-"), "conv_id", F.lit(".txt")).alias("file_path"), F.lit("x").alias("extra"))
    )
    return turns.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("turn") > 1, refs).alias("references"),
        pieces.alias("chunks"),
        F.when(F.col("role") == "system", "Query failed.").alias("failure"),
        F.when(F.col("turn") > 3, 2).cast("int").alias("failed_at"),
        "text",
    )


_EVENTS = f"""
a AS (
  SELECT conv_id, turn, role, regexp_extract_all(text, '{WS}*{NON_WS}+') AS chunks,
         CASE WHEN role = 'system' THEN 'Query failed.' END AS failure, CASE WHEN turn > 3 THEN 2 END AS failed_at FROM conversations WHERE role <> 'user'),
src AS (
  SELECT conv_id, turn, 0 AS seq, 'sources' AS type,
         '{{"type":"sources","sources":[' || CASE WHEN turn > 1 THEN '{{"reference_id":"1","file_path":"conv-' || conv_id || '.txt"}}' ELSE '' END || ']}}' AS payload
  FROM a WHERE failure IS NULL OR failed_at IS NOT NULL),
shown AS (SELECT *, CASE WHEN failed_at IS NOT NULL THEN chunks[1:failed_at] ELSE chunks END AS sent FROM a WHERE failure IS NULL OR failed_at IS NOT NULL),
tok AS (
  SELECT conv_id, turn, generate_subscripts(sent, 1) AS seq, 'token' AS type, unnest(sent) AS t FROM shown),
fin AS (
  SELECT conv_id, turn, CASE WHEN failure IS NOT NULL AND failed_at IS NULL THEN 0 ELSE 1 + len(CASE WHEN failed_at IS NOT NULL THEN chunks[1:failed_at] ELSE chunks END) END AS seq,
         CASE WHEN failure IS NOT NULL THEN 'error' ELSE 'done' END AS type,
         CASE WHEN failure IS NOT NULL THEN '{{"type":"error","message":"' || failure || '"}}' ELSE '{{"type":"done"}}' END AS payload FROM a)"""


@query(
    f"""WITH {_EVENTS}, e AS (
  SELECT * FROM src UNION ALL SELECT conv_id, turn, seq, type, CAST(json_object('type', 'token', 'text', t) AS VARCHAR) FROM tok UNION ALL SELECT * FROM fin)
SELECT conv_id, turn, CAST(seq AS INTEGER) AS seq, type, 'data: ' || payload || chr(10) || chr(10) AS frame FROM e"""
)
def chat_stream_frames(spark, base):
    events = sc.answer_events(_answers(spark, base), "conv_id", "turn")
    return sc.frames(events).drop("payload")


@query(
    f"""WITH {_EVENTS}
SELECT a.conv_id, a.turn, coalesce(string_agg(t.t, '' ORDER BY t.seq), '') AS message, 'data: {{"ty' AS tail FROM a LEFT JOIN tok t ON t.conv_id = a.conv_id AND t.turn = a.turn GROUP BY a.conv_id, a.turn"""
)
def chat_stream_fold(spark, base):
    """Frames of an answer received as one buffer with a cut-off tail, folded back to the message."""
    events = sc.frames(sc.answer_events(_answers(spark, base), "conv_id", "turn"))
    # One answer's frames, which a client receives as one response.
    buffers = events.groupBy("conv_id", "turn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda f: f["frame"]), "").alias("whole")
    )
    cut = buffers.withColumn("buffer", F.concat("whole", F.lit('data: {"ty')))
    return cut.select(
        "conv_id", "turn", sc.fold_tokens(sc.parse_frames(F.col("buffer"))).alias("message"), sc.unread_tail(F.col("buffer")).alias("tail")
    )


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
r AS (SELECT conv_id, turn, pos, regexp_replace(line, '[ \\t]+$', '') AS line FROM l)
SELECT conv_id, turn, string_agg('<p>' || {_esc('line')} || '</p>', '' ORDER BY pos) AS html FROM r WHERE trim(line) <> '' GROUP BY conv_id, turn"""
)
def chat_markdown_html(spark, base):
    """Messages as HTML. The table holds plain paragraphs; headings, lists and marks are covered by unit tests."""
    return _turns(spark, base).select("conv_id", "turn", md.render(F.col("text")).alias("html"))


@query(
    """WITH u AS (SELECT turn * 1000000 + conv_id AS idx, conv_id, turn, CASE role WHEN 'user' THEN 'done' WHEN 'system' THEN 'error' ELSE 'processing' END AS status, 'conv-' || conv_id AS file_name FROM conversations),
f AS (SELECT file_name, min(idx) AS idx FROM u GROUP BY file_name)
SELECT u.conv_id, u.turn, u.status, f.idx AS first_idx FROM u JOIN f USING (file_name) WHERE u.status NOT IN ('done', 'error')"""
)
def upload_list(spark, base):
    """Upload reducers: status patches, first row of the same name, unfinished rows."""
    status = F.when(F.col("role") == "user", "done").when(F.col("role") == "system", "error").otherwise("processing")
    turns = _turns(spark, base)
    idx = F.col("turn") * 1000000 + F.col("conv_id")
    ids = F.concat_ws("-", "conv_id", "turn")
    uploads = turns.select("conv_id", "turn", idx.alias("idx"), ids.alias("id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("conv-"), "conv_id").alias("file_name"))
    patched = up.patch(uploads, turns.select(ids.alias("id"), status.alias("status"), F.lit(None).cast("string").alias("error")))
    named = up.results_to_uploads(patched.select("conv_id", "turn", "id", "status", "file_name"), uploads)
    return up.unfinished(named).select("conv_id", "turn", "status", F.col("idx").alias("first_idx"))
