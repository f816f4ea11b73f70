"""Conversation state from a stream: micro-batches, replays, late turns, time-out."""

import random

import pytest

from lorefield.operators.uploads import conversation_state
from lorefield.session import shared_folder
from lorefield.streaming import conversations as cv

COLUMNS = "conv_id string, turn long, role string, text string"


def feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def drained(spark, folder, **options):
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = cv.run_to_end(stream, f"{folder}/out", f"{folder}/progress", **options).collect()
    return {(r.conv_id, r.page): [tuple(m) for m in r.history] for r in rows}


def whole(spark, messages, page_turns):
    rows = conversation_state(spark.createDataFrame(messages, COLUMNS), page_turns).collect()
    return {(r.conv_id, r.page): [tuple(m) for m in r.history] for r in rows}


@pytest.fixture()
def messages():
    rng = random.Random(3)
    return [(f"c{c}", t, rng.choice(["user", "assistant"]), rng.choice(["", "hi", None, f"t{t}"])) for c in range(6) for t in range(rng.randint(1, 12))]


def test_three_batches_one_sent_twice(spark, messages):
    folder, rng = shared_folder(spark, "chat"), random.Random(5)
    rng.shuffle(messages)
    third = len(messages) // 3
    parts = [messages[:third], messages[third : 2 * third], messages[2 * third :]]
    feed(spark, folder, [parts[0], parts[1], parts[1] + [("c0", None, "user", "lost"), (None, 1, "user", "lost")], parts[2]])
    assert drained(spark, folder, page_turns=4) == whole(spark, messages, 4)


def test_state_goes_on_after_a_restart_and_a_batch_written_again_changes_nothing(spark):
    folder = shared_folder(spark, "chat")
    feed(spark, folder, [[("a", 0, "user", "one"), ("a", 2, "user", "three")]])
    drained(spark, folder)
    feed(spark, folder, [[("a", 1, "assistant", "late"), ("a", 2, "user", "three, corrected")]])
    want = {("a", 0): [("user", "one"), ("assistant", "late"), ("user", "three, corrected")]}
    assert drained(spark, folder) == want
    last = spark.read.parquet(f"{folder}/out/batch=1")
    cv._keep(f"{folder}/out")(spark.createDataFrame(last.collect(), last.schema), 1)
    assert len(cv.histories(spark, f"{folder}/out").first().history) == 3


def test_an_idle_page_is_forgotten_and_begins_again(spark):
    folder = shared_folder(spark, "chat")
    feed(spark, folder, [[("a", 0, "user", "one")]])
    drained(spark, folder, idle=0.0)
    feed(spark, folder, [[("b", 0, "user", "other")]])
    drained(spark, folder, idle=0.0)
    feed(spark, folder, [[("a", 1, "assistant", "two")]])
    assert drained(spark, folder, idle=0.0) == {("a", 0): [("user", "one"), ("assistant", "two")], ("b", 0): [("user", "other")]}
    states = spark.read.parquet(f"{folder}/out").where("conv_id = 'a'").collect()
    assert {(s.closed, len(s.messages)) for s in states} >= {(False, 1), (True, 1)}
