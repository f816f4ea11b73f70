"""Queries over `events`: pacing, retries, cooldowns, fallbacks and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.catalog.sqlparts import norm, strip
from lorefield.functions import text as tx
from lorefield.session import apply_semantics, shared_folder, table, table_stream
from lorefield.streaming import ingest as si
from lorefield.streaming import pacing as pa

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _events(spark, base):
    apply_semantics(spark)
    return table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing,
       coalesce(json_extract_string(props, '$.missing'), event_type) AS fallback FROM events"""
)
def event_props(spark, base):
    missing = F.get_json_object("props", "$.missing")
    return _events(spark, base).select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), missing.alias("missing"), F.coalesce(missing, "event_type").alias("fallback")
    )


def _requests(spark, base, key):
    return _events(spark, base).select(
        "ts",
        key.alias("key"),
        F.col("event_id").alias("request_id"),
        F.unix_micros("ts").alias("at_us"),
        F.round(F.col("value") * 600).cast("long").alias("tokens"),
    )


def _bucket_sql(key: str) -> str:
    return f"""WITH r AS (
  SELECT {key} AS key, event_id AS request_id, epoch_us(ts) AS at_us, CAST(least(CAST(round(value * 600) AS BIGINT), 6000) * 10000 AS BIGINT) AS cost FROM events),
s AS (SELECT *, sum(cost) OVER w AS total FROM r WINDOW w AS (PARTITION BY key ORDER BY at_us, request_id)),
m AS (SELECT *, max(at_us - (total - cost)) OVER (PARTITION BY key ORDER BY at_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_us FROM s),
g AS (SELECT *, max(greatest(at_us, coalesce(total - cost + lead_us + cost - 60000000, at_us))) OVER (PARTITION BY key ORDER BY at_us, request_id) AS granted FROM m)
SELECT key, request_id, CAST(granted AS BIGINT) AS granted_us, CAST(granted - at_us AS BIGINT) AS wait_us FROM g"""


@query(_bucket_sql("'extract'"))
def token_bucket_global(spark, base):
    """One bucket for all requests, the hottest key there is."""
    requests = _requests(spark, base, F.lit("extract")).withColumn("day", F.date_trunc("day", "ts"))
    return pa.bucket_schedule(requests, 6000, ["key"], "day").select("key", "request_id", "granted_us", "wait_us")


@query(_bucket_sql("event_type"))
def token_bucket_by_model(spark, base):
    requests = _requests(spark, base, F.col("event_type")).withColumn("day", F.date_trunc("day", "ts"))
    return pa.bucket_schedule(requests, 6000, ["key"], "day").select("key", "request_id", "granted_us", "wait_us")


_MESSAGE = """CASE WHEN event_type <> 'error' THEN NULL
  WHEN value < 1 THEN 'Rate limit reached (TPD): tokens per day'
  WHEN value < 5 THEN 'Limits (TPM): Limit 6000, Used 3286. Please try again in ' || CAST(CAST(floor(value * 100) AS INTEGER) AS VARCHAR) || 'ms.'
  WHEN value < 10 THEN 'Limits (TPM): Limit 12000, Used 9. Please try again in ' || CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) || '.5s.'
  ELSE 'Service busy' END"""


def _message():
    value = F.col("value")
    return (
        F.when(F.col("event_type") != "error", F.lit(None).cast("string"))
        .when(value < 1, "Rate limit reached (TPD): tokens per day")
        .when(value < 5, F.concat(F.lit("Limits (TPM): Limit 6000, Used 3286. Please try again in "), F.floor(value * 100).cast("int").cast("string"), F.lit("ms.")))
        .when(value < 10, F.concat(F.lit("Limits (TPM): Limit 12000, Used 9. Please try again in "), F.floor(value).cast("int").cast("string"), F.lit(".5s.")))
        .otherwise("Service busy")
    )


_PARSED = f"""
p AS (SELECT event_id, user_id, ts, {_MESSAGE} AS message FROM events),
q AS (SELECT *, CAST(nullif(regexp_extract(message, '\\(TPM\\): Limit (\\d+)', 1), '') AS INTEGER) AS tpm_limit,
  coalesce(CASE WHEN regexp_extract(message, 'try again in ([\\d.]+)(ms|s)', 2) = 'ms' THEN CAST(regexp_extract(message, 'try again in ([\\d.]+)(ms|s)', 1) AS DOUBLE) / 1000
       WHEN regexp_extract(message, 'try again in ([\\d.]+)(ms|s)', 2) = 's' THEN CAST(regexp_extract(message, 'try again in ([\\d.]+)(ms|s)', 1) AS DOUBLE) END, 20.0) AS wait,
  coalesce(contains(lower(message), 'tokens per day') OR contains(lower(message), '(tpd)'), false) AS daily FROM p)"""


@query(f"WITH {_PARSED} SELECT event_id, tpm_limit, round(wait, 6) AS wait_seconds, daily FROM q WHERE message IS NOT NULL")
def rate_limit_messages(spark, base):
    errors = _events(spark, base).where("event_type = 'error'").withColumn("message", _message())
    message = F.col("message")
    return errors.select(
        "event_id",
        tx.tpm_limit(message).alias("tpm_limit"),
        F.round(tx.retry_after_seconds(message), 6).alias("wait_seconds"),
        tx.is_daily_quota(message).alias("daily"),
    )


@query(
    f"""WITH {_PARSED},
n AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS day, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM q),
h AS (SELECT *, CASE WHEN message IS NULL THEN 'ok' WHEN daily THEN 'daily_quota' WHEN n = 4 THEN 'exhausted' END AS how FROM n WHERE n <= 4),
e AS (SELECT user_id, day, coalesce(min(n) FILTER (WHERE how IS NOT NULL), max(n)) AS last_n FROM h GROUP BY user_id, day)
SELECT h.user_id, h.day, coalesce(arg_max(h.how, h.n) FILTER (WHERE h.n = e.last_n), 'pending') AS outcome, CAST(e.last_n AS INTEGER) AS attempts,
       round(coalesce(sum(h.wait) FILTER (WHERE h.how IS NULL), 0), 6) AS waited_seconds, arg_max(h.tpm_limit, h.n) FILTER (WHERE h.how IS NULL AND h.tpm_limit IS NOT NULL) AS learned_limit
FROM h JOIN e ON e.user_id = h.user_id AND e.day = h.day AND h.n <= e.last_n GROUP BY h.user_id, h.day, e.last_n"""
)
def retry_ladder(spark, base):
    attempts = _events(spark, base).select("event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("day"), _message().alias("message"))
    out = pa.retry_outcomes(attempts, ["user_id", "day"], ["ts", "event_id"])
    return out.withColumn("waited_seconds", F.round("waited_seconds", 6))


@query(
    f"""WITH {_PARSED},
l AS (SELECT *, max(CASE WHEN daily THEN ts END) OVER (PARTITION BY 1 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_quota FROM q)
SELECT event_id, last_quota, coalesce(ts < last_quota + INTERVAL 300 SECONDS, false) AS on_cooldown FROM l"""
)
def model_cooldown(spark, base):
    events = _events(spark, base).select("event_id", "ts", F.lit("m").alias("model"), _message().alias("message"))
    return pa.on_cooldown(events, ["model"], ["ts", "event_id"]).select("event_id", "last_quota", "on_cooldown")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'primary' WHEN event_type = 'purchase' THEN 'secondary' ELSE 'local' END AS provider,
       CASE WHEN event_type IN ('click', 'view') THEN 'p' || event_id WHEN event_type = 'purchase' THEN 's' || event_id ELSE 'l' || event_id END AS answer FROM events"""
)
def provider_fallback(spark, base):
    ident = F.col("event_id").cast("string")
    kind = F.col("event_type")
    results = (
        F.when(kind.isin("click", "view"), F.concat(F.lit("p"), ident)),
        F.when(kind.isin("click", "purchase"), F.concat(F.lit("s"), ident)),
        F.concat(F.lit("l"), ident),
    )
    return _events(spark, base).select(
        "event_id", pa.provider_used(["primary", "secondary", "local"], *results).alias("provider"), pa.first_success(*results).alias("answer")
    )


@query(
    """WITH m AS (SELECT user_id, list_sort(list_distinct(list(event_type || ':latest'))) AS models FROM events GROUP BY user_id)
SELECT user_id, list_contains(models, 'error:latest') AS has_error, list_contains(models, 'signup:latest') AS has_signup FROM m"""
)
def model_lookup(spark, base):
    models = _events(spark, base).groupBy("user_id").agg(F.collect_set(F.concat("event_type", F.lit(":latest"))).alias("models"))
    return models.select(
        "user_id",
        tx.has_model(F.col("models"), F.lit("error")).alias("has_error"),
        tx.has_model(F.col("models"), F.lit("signup:latest")).alias("has_signup"),
    )


@query(f"SELECT DISTINCT sha256({norm('text')}) AS content_hash FROM documents WHERE {strip('text')} <> ''")
def stream_ingest_dedup(spark, base):
    """The documents as a stream, drained into a table that holds every content hash once."""
    apply_semantics(spark)
    stream = table_stream(spark, base, "documents")
    minutes = F.pmod(F.col("doc_id") * 7919, F.lit(100_003)) * 60
    arrived = stream.select("doc_id", "text", F.timestamp_seconds(F.lit(1_704_067_200) + minutes).alias("arrived_at"))
    folder = shared_folder(spark, "ingest")
    rows = si.run_to_end(si.hashed_stream(arrived).select("doc_id", "arrived_at", "content_hash", si.PART), f"{folder}/table", f"{folder}/progress")
    return rows.select("content_hash")


@query(_bucket_sql("event_type"))
def stream_token_bucket(spark, base):
    """The same pacing as token_bucket_by_model, kept as state of a stream."""
    apply_semantics(spark)
    stream = table_stream(spark, base, "events")
    ts = F.col("ts").cast("timestamp")
    requests = stream.select(
        ts.alias("ts"),
        F.col("event_type").alias("key"),
        F.col("event_id").alias("request_id"),
        F.unix_micros(ts).alias("at_us"),
        F.round(F.col("value") * 600).cast("long").alias("tokens"),
        F.lit(0).alias("new_limit"),
    )
    folder = shared_folder(spark, "bucket")
    return si.drain(pa.stream_bucket(requests, 6000), f"{folder}/table", f"{folder}/progress")
