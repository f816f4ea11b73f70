import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lorefield.session import shared_folder
from lorefield.streaming import chat as sc
from lorefield.streaming import ingest as si
from lorefield.streaming import pacing as pa

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def bucket_by_hand(rows, tpm):
    """(at_us, id, tokens) in order; waits one by one."""
    held, updated, out = float(tpm), None, {}
    for at, rid, tokens in sorted(rows):
        now = at / 1e6 if updated is None else max(at / 1e6, updated)
        if updated is not None:
            held = min(tpm, held + (now - updated) * tpm / 60)
        need = min(tokens, tpm)
        if held < need:
            now += (need - held) / (tpm / 60)
            held = need
        held, updated = held - need, now
        out[rid] = now
    return out


def test_first_request_is_free_and_the_next_waits(spark):
    df = spark.createDataFrame([("k", 0, 0, 60), ("k", 1, 0, 1), ("k", 2, 0, 10_000)], "key string, request_id long, at_us long, tokens long")
    got = {r.request_id: r.wait_us / 1e6 for r in pa.bucket_schedule(df.withColumn("seg", F.lit(0)), 60, ["key"], "seg").collect()}
    assert got[0] == 0 and got[1] == 1.0 and got[2] == 61.0


def test_closed_form_equals_one_by_one(spark):
    rng = random.Random(11)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 1, 1, 5, 40]) * 700_001
        rows.append((at, i, rng.choice([1, 50, 500, 900, 5000])))
    want = bucket_by_hand(rows, 1200)
    df = spark.createDataFrame([("k", i, a, t, a // 30_000_000) for a, i, t in rows], "key string, request_id long, at_us long, tokens long, seg long")
    got = pa.bucket_schedule(df, 1200, ["key"], "seg").collect()
    assert len(got) == 600
    assert max(abs(r.granted_us / 1e6 - want[r.request_id]) for r in got) < 0.001


def test_stream_bucket_resizes_and_keeps_state(spark):
    folder = shared_folder(spark, "test")
    cols = "ts timestamp, key string, request_id long, at_us long, tokens long, new_limit int"
    first = [(START, "k", 1, 0, 60, 0), (START, "k", 2, 0, 0, 30), (START, "k", 3, 0, 30, 0)]
    second = [(START, "k", 4, 1_000_000, 15, 0)]
    for i, part in enumerate((first, second)):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(cols).parquet(f"{folder}/in")
        out = si.drain(pa.stream_bucket(stream, 60), f"{folder}/out", f"{folder}/progress")
    got = {r.request_id: r.wait_us / 1e6 for r in out.collect()}
    # 60 spent; the limit drops to 30 (0.5 per second), so 30 tokens take 60 s, and 15 more take another 30 s.
    assert got == {1: 0.0, 3: 60.0, 4: 89.0}


def test_arrivals_come_in_time_order_in_bounded_pieces():
    rng = np.random.default_rng(1)
    n = 5000
    rows = pd.DataFrame({"at_us": rng.integers(0, 300, n), "request_id": rng.integers(0, 40, n), "tokens": np.arange(n), "new_limit": 0, "key": "k"})
    rows.loc[rng.random(n) < 0.3, "at_us"] = 7
    batches = [rows[i : i + 90] for i in range(0, n, 90)]
    for given in (rows, rows.assign(at_us=rows["at_us"].where(rows["at_us"] != 9))):
        want = given.sort_values(["at_us", "request_id"], kind="stable")[pa.ARRIVAL].astype(float).fillna(-1).to_numpy()
        pieces = list(pa.in_time_order(iter([given.loc[b.index] for b in batches]), 500))
        assert np.array_equal(np.nan_to_num(np.concatenate([np.stack(p, 1).astype(float) for p in pieces]), nan=-1), want)
        assert len(pieces) > 5 and max(len(p[0]) for p in pieces) < 1000
    assert list(pa.in_time_order(iter([]))) == []


def test_stream_bucket_holds_few_arrivals_of_a_key(spark):
    folder = shared_folder(spark, "test")
    cols = "ts timestamp, key string, request_id long, at_us long, tokens long, new_limit int"
    found, rng = [], random.Random(4)
    rows = [(START, "k", i, rng.randrange(10**10), rng.randrange(90), rng.choice((0, 0, 0, 0, 30, 80))) for i in range(30_000)]
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(cols).parquet(f"{folder}/in")
    found = []
    for limit in (pa.SORTED_ROWS, 4000):
        out = si.drain(pa.stream_bucket(stream, 60, sorted_rows=limit), f"{folder}/out{limit}", f"{folder}/progress{limit}")
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] and len(found[0]) > 15_000


def test_retry_ladder(spark):
    tpm, daily = "(TPM): Limit 6000, Used 1. Please try again in 430ms.", "tokens per day (TPD)"
    calls = {"ok": [tpm, "busy", None], "daily": [tpm, daily, None], "out": ["busy"] * 5, "open": ["busy"]}
    rows = [(c, i, m) for c, ms in calls.items() for i, m in enumerate(ms)]
    got = {r.call: (r.outcome, r.attempts, round(r.waited_seconds, 2), r.learned_limit) for r in pa.retry_outcomes(spark.createDataFrame(rows, "call string, n0 int, message string"), ["call"], ["n0"]).collect()}
    assert got == {"ok": ("ok", 3, 20.43, 6000), "daily": ("daily_quota", 2, 0.43, 6000), "out": ("exhausted", 4, 60.0, None), "open": ("pending", 1, 20.0, None)}


def test_cooldown_crosses_segments(spark):
    at = dt.datetime(2024, 1, 1, 23, 58)
    rows = [(1, at, "Tokens per day"), (2, at + dt.timedelta(seconds=299), None), (3, at + dt.timedelta(seconds=300), None)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, id int, ts timestamp, message string")
    got = {r.id: r.on_cooldown for r in pa.on_cooldown(df, ["model"], ["ts", "id"]).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_ingest_stream_over_restarts(spark):
    folder = shared_folder(spark, "ingest")
    cols = "doc_id long, text string, arrived_at timestamp"
    for part in ([(1, "a  b", START), (2, "a b ", START), (3, " ", START)], [(4, "a b", START), (5, "c", START)]):
        spark.createDataFrame(part, cols).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(cols).parquet(f"{folder}/in")
        out = si.run_to_end(si.hashed_stream(stream).select("doc_id", "content_hash", si.PART), f"{folder}/out", f"{folder}/progress")
    rows = out.collect()
    assert len(rows) == 2 and 5 in {r.doc_id for r in rows}
    # A lost progress folder replays everything and still adds nothing.
    again = si.run_to_end(si.hashed_stream(spark.readStream.schema(cols).parquet(f"{folder}/in")).select("doc_id", "content_hash", si.PART), f"{folder}/out", f"{folder}/progress2")
    assert again.count() == 2


def test_ingest_stream_keeps_late_documents(spark):
    folder = shared_folder(spark, "ingest")
    cols = "doc_id long, text string, arrived_at timestamp"
    for part in ([(1, "new", START)], [(2, "newer", START + dt.timedelta(days=9))], [(3, "late and never seen", START - dt.timedelta(days=400)), (4, "new", START)]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = si.hashed_stream(spark.readStream.schema(cols).parquet(f"{folder}/in")).select("doc_id", "content_hash", si.PART)
        out = si.run_to_end(stream, f"{folder}/out", f"{folder}/progress")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3]


def test_answer_grammar_and_frames(spark):
    cols = "id int, references array<struct<reference_id:string,file_path:string>>, chunks array<string>, failure string, failed_at int"
    rows = [(1, [("1", "f")], ["He", "", "y é"], None, None), (2, None, ["x"], "boom", None), (3, None, ["x", "y"], "late", 1), (4, None, None, None, None)]
    events = sc.answer_events(spark.createDataFrame(rows, cols), "id")
    by_id = {}
    for r in events.orderBy("id", "seq").collect():
        by_id.setdefault(r.id, []).append(r.type)
    assert by_id == {1: ["sources", "token", "token", "done"], 2: ["error"], 3: ["sources", "token", "error"], 4: ["sources", "done"]}
    whole = "".join(r.frame for r in sc.frames(events).where("id = 1").orderBy("seq").collect())
    assert whole.startswith('data: {"type":"sources","sources":[{"reference_id":"1","file_path":"f"}]}\n\n')
    df = spark.createDataFrame([(whole + ": ping\n\ndata: {", )], "b string")
    got = df.select(sc.fold_tokens(sc.parse_frames(F.col("b"))).alias("m"), sc.unread_tail(F.col("b")).alias("t")).first()
    assert got.m == "Hey é" and got.t == "data: {"


def test_provider_fallback(one):
    got = one(lambda: F.concat_ws("|", pa.first_success(F.lit(None).cast("string"), F.lit("o"), F.lit("l")), pa.provider_used(["p", "s", "l"], F.lit(None).cast("string"), F.lit("o"), F.lit("l"))))
    assert got == "o|s"
