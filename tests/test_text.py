import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorefield.functions import text as tx


def test_white_space_class_is_pythons(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c), chr(c).isspace()) for c in points], "c int, a string, b boolean")
    wrong = df.where(
        (F.col("a").rlike(f"^{tx.WS}\\z") != F.col("b"))
        | (F.col("a").rlike(f"^{tx.NON_WS}\\z") == F.col("b"))
        | ((tx.py_strip(F.col("a")) == "") != F.col("b"))
    )
    assert wrong.count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=60), min_size=20, max_size=40))
def test_normalize_and_hash_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", tx.normalize_text(F.col("t")).alias("n"), tx.content_hash(F.col("t")).alias("h"), tx.word_count(F.col("t")).alias("w")).collect()
    for r in rows:
        want = re.sub(r"\s+", " ", r.t).strip()
        assert r.n == want
        assert r.h == hashlib.sha256(want.encode()).hexdigest()
        assert r.w == len(r.t.split())


def test_hash_is_case_sensitive_and_blank_insensitive(one):
    a = one(tx.content_hash, t=" A\tb  c ")
    assert a == one(tx.content_hash, t="A b c") != one(tx.content_hash, t="a b c")


def test_clean_text_collapses_before_dropping(one):
    assert one(tx.clean_text, t=" a\n\nb\x07c ​d ") == "a bc d"


def test_snippet(one):
    assert one(tx.snippet, t="a  b") == "a  b"
    assert one(tx.snippet, t=" ".join(map(str, range(13)))) == " ".join(map(str, range(12))) + "..."


def test_token_estimates(one):
    assert one(lambda p, s: tx.estimate_tokens(p, s, 0), p="x" * 400, s="y" * 400) == 200
    assert one(lambda p: tx.estimate_tokens(p), p="x" * 7) == 1001
    assert one(tx.count_tokens, t="x" * 7) == 1


@pytest.mark.parametrize("name, want", [('  "Acme\n Labs".', "Acme Labs"), ("(x)", "x"), ("...", ""), ("a.b", "a.b")])
def test_clean_name(one, name, want):
    assert one(tx.clean_name, t=name) == want


def test_casefold(one):
    assert one(tx.casefold, t="STRASSE") == one(tx.casefold, t="Straße") == "strasse"
    assert one(tx.casefold, t="Σίσυφος") == "Σίσυφος".casefold()


def test_keywords_between(one):
    text = "Ada Byrne is the chief executive of Northwind Labs"
    assert one(lambda t: tx.keywords_between(t, F.lit(9), F.lit(36)), t=text) == "is the chief executive of"
    assert one(lambda t: tx.keywords_between(t, F.lit(36), F.lit(9)), t=text) == "related to"
    assert one(lambda t: tx.keywords_between(t, F.lit(0), F.lit(16)), t="a b c d e f g h i j") == "a b c d e f"


def test_prompt_routes(one):
    inner = "one\n```\ncode\n```\ntwo"
    prompt = f"x\n---Input Text---\n```\n{inner}\n```\n\n---Output---\n"
    assert one(tx.prompt_route, p=prompt) == "extract"
    assert one(tx.prompt_input_text, p=prompt) == inner
    listed = 'Description List:\n\n```\n{"Description": "A b."}\n{"Description": "A b."}\nraw\n```\n\n---Output---'
    assert one(tx.prompt_route, p=listed) == "summarize"
    assert one(lambda p: tx.answer_prompt_route(p, F.lit("{}")), p=listed) == "A b. raw"
    assert one(lambda p: tx.answer_prompt_route(p, F.lit("{}")), p="continue") == tx.EMPTY_RESULT
    assert one(lambda p: tx.answer_prompt_route(p, F.lit("{}")), p=prompt) == "{}"


def test_summary_of_json_lines(one):
    lines = ['{"Description": "First."}', '{"Description": "First."}', "{}", "[1]", "not json", '{"Description": " Last. "}']
    assert one(tx.summarize_descriptions, t="\n".join(lines)) == "First. [1] not json Last."
    long = "\n".join('{"Description": "%s"}' % ("w%d " % i * 20).strip() for i in range(40))
    out = one(tx.summarize_descriptions, t=long)
    assert len(out) <= 1200 and re.fullmatch(r"w\d+", out.split(" ")[-1])


@pytest.mark.parametrize(
    "message, limit, wait, daily",
    [
        ("(TPM): Limit 6000, Used 3286, Requested 2757. Please try again in 430ms.", 6000, 0.43, False),
        ("Please try again in 18.8s.", None, 18.8, False),
        ("something else", None, 20.0, False),
        ("Limit reached: Tokens Per Day (TPD)", None, 20.0, True),
    ],
)
def test_rate_limit_messages(one, message, limit, wait, daily):
    assert one(tx.tpm_limit, m=message) == limit
    assert one(tx.retry_after_seconds, m=message) == pytest.approx(wait)
    assert one(tx.is_daily_quota, m=message) is daily


def test_names_and_lists(one):
    assert one(tx.pasted_name, a="  ", b="\n hello world") == "hello world"
    assert one(tx.pasted_name, a=None, b="   ") == "Pasted text"
    assert one(tx.pasted_name, a="T ", b="x") == "T"
    assert one(lambda b: F.length(tx.pasted_name(F.lit(""), b)), b="x" * 90) == 60
    assert one(lambda b: F.length(tx.upload_label(F.lit(""), b)), b="x" * 90) == 40
    assert one(tx.split_list, s=" a, b ,,c") == ["a", "b", "c"]
    assert one(tx.provider_base, u="http://h:1/v1") == "http://h:1"
    assert one(lambda m: tx.has_model(F.array(F.lit("base:latest")), m), m="base") is True
    assert one(lambda m: tx.has_model(F.array(F.lit("base:7b")), m), m="base:8b") is False
    row = one(lambda n: F.concat_ws("|", tx.ingest_message(F.lit(False), n, F.lit(1)), tx.ingest_message(F.lit(False), n, F.lit(2)), tx.ingest_message(F.lit(True), n, F.lit(2))), n="f")
    assert row == 'Added "f" — 1 chunk.|Added "f" — 2 chunks.|Already in the knowledge base (f).'


def test_budget_warning(one):
    assert one(lambda: tx.budget_exceeds_rate(F.lit(8000), F.lit(12000))) is False
    assert one(lambda: tx.budget_exceeds_rate(F.lit(30000), F.lit(12000))) is True
