"""String, hash and token expressions over Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorefield.functions.arrays import let

# --- fixed values -----------------------------------------------------------------------------
# Every code point that Python's str.strip() and \s treat as white space.
_WS_RANGES = r"\t-\x{20}\x{85}-\x{a0}\x{1680}-\x{3000}"
_WS_MEMBERS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The coarse ranges are tested first, so that letters leave the class after three comparisons.
WS = f"[{_WS_RANGES}&&[{_WS_MEMBERS}]]"
NON_WS = f"[^{_WS_RANGES}&&[{_WS_MEMBERS}]]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
NAME_EDGE_CHARS = " \t\n\r.,;:!?'\"()[]{}<>|/\\"
DEFAULT_KEYWORD = "related to"
MAX_KEYWORD_WORDS = 6
MAX_DESCRIPTION_CHARS = 400
MAX_SUMMARY_CHARS = 1200
SNIPPET_WORDS = 12
PASTED_NAME_CHARS = 60
UPLOAD_LABEL_CHARS = 40
OUTPUT_ALLOWANCE_TOKENS = 1000
ANSWER_HEADROOM_TOKENS = 2000
EMPTY_RESULT = '{"entities": [], "relationships": []}'
INPUT_TEXT_PATTERN = r"(?s)---Input Text---\n```\n(.*)\n```\n\n---Output---"
DESCRIPTION_LIST_PATTERN = r"(?s)Description List:\n\n```\n(.*)\n```\n\n---Output---"
TPM_LIMIT_PATTERN = r"\(TPM\): Limit (\d+)"
RETRY_AFTER_PATTERN = r"try again in ([\d.]+)(ms|s)"
DAILY_QUOTA_MARKS = ("tokens per day", "(tpd)")
# ----------------------------------------------------------------------------------------------


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """White-space separated words as an array, without empty items."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def content_hash(text: Column) -> Column:
    """Identity of a document: SHA-256 of the white-space normalised text."""
    return F.sha2(normalize_text(text), 256)


def clean_text(text: Column) -> Column:
    collapsed = F.regexp_replace(text, f"{WS}+", " ")
    printable = F.regexp_replace(collapsed, CONTROL_CHARS, "")
    return py_strip(F.translate(printable, "\u00a0\u200b", " "))


def snippet(text: Column, max_words: int = SNIPPET_WORDS) -> Column:
    def shorten(parts: Column) -> Column:
        short = F.concat(F.array_join(F.slice(parts, 1, max_words), " "), F.lit("..."))
        return F.when(F.size(parts) <= max_words, text).otherwise(short)

    return let(words(text), shorten)


def count_tokens(text: Column) -> Column:
    """Offline token count: one token per four characters."""
    return (F.length(text) / 4).cast("int")


def estimate_tokens(prompt: Column, system: Column | None = None, allowance: int = OUTPUT_ALLOWANCE_TOKENS) -> Column:
    system_length = F.length(F.coalesce(system, F.lit(""))) if system is not None else F.lit(0)
    return ((F.length(prompt) + system_length) / 4).cast("int") + F.lit(allowance)


def clean_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, f"{WS}+", " "), F.lit(NAME_EDGE_CHARS))


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Lower-case letters whose caseless form differs, derived from Unicode data: to one letter, and to several."""
    folded = [(c, c.casefold()) for c in map(chr, range(0x80, 0x110000)) if c.lower() == c and c.casefold() != c]
    single = [(a, b) for a, b in folded if len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single), [(a, b) for a, b in folded if len(b) > 1]


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _fold_tables()


def casefold(text: Column) -> Column:
    """Caseless key: lower case, then the single-letter folds, and the expanding ones where a text has such letters."""
    single = F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO)
    longer = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _FOLD_LONGER))
    letters = "[" + "".join(a for a, _ in _FOLD_LONGER) + "]"
    return F.when(single.rlike(letters), F.aggregate(longer, single, lambda t, x: F.replace(t, x["a"], x["b"]))).otherwise(single)


def substring_span(text: Column, start: Column, end: Column) -> Column:
    """Characters in [start, end), empty when the span is empty or reversed."""
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))


def keywords_between(text: Column, left_end: Column, right_start: Column) -> Column:
    picked = F.array_join(F.slice(words(substring_span(text, left_end, right_start)), 1, MAX_KEYWORD_WORDS), " ")
    return F.coalesce(F.nullif(picked, F.lit("")), F.lit(DEFAULT_KEYWORD))


def mention_description(sentence: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(sentence, 1, MAX_DESCRIPTION_CHARS), F.lit("")), name)


def truncate_summary(text: Column, limit: int = MAX_SUMMARY_CHARS) -> Column:
    """Over-long text is cut at the limit and then loses its last, possibly partial, word."""
    return let(
        text,
        lambda t: F.when(F.length(t) > limit, F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*\z", "")).otherwise(t),
    )


def jsonl_description(line: Column) -> Column:
    """`Description` of a JSON object line; '' when the object lacks it; the raw line when it is not an object."""
    parsed = F.try_parse_json(line)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    value = F.coalesce(F.get_json_object(line, "$.Description"), F.lit(""))
    return F.when(is_object, value).otherwise(line)


def summarize_descriptions(jsonl: Column) -> Column:
    lines = F.transform(F.split(jsonl, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"), py_strip)
    described = F.transform(F.filter(lines, lambda x: x != ""), lambda x: py_strip(jsonl_description(x)))
    distinct = F.array_distinct(F.filter(described, lambda x: x != ""))
    return truncate_summary(F.array_join(distinct, " "))


def prompt_input_text(prompt: Column) -> Column:
    return F.when(prompt.rlike(INPUT_TEXT_PATTERN), F.regexp_extract(prompt, INPUT_TEXT_PATTERN, 1))


def prompt_description_list(prompt: Column) -> Column:
    return F.when(prompt.rlike(DESCRIPTION_LIST_PATTERN), F.regexp_extract(prompt, DESCRIPTION_LIST_PATTERN, 1))


def prompt_route(prompt: Column) -> Column:
    """Which of the three prompt kinds the extraction role was handed."""
    return (
        F.when(prompt.rlike(INPUT_TEXT_PATTERN), "extract")
        .when(prompt.rlike(DESCRIPTION_LIST_PATTERN), "summarize")
        .otherwise("empty")
    )


def answer_prompt_route(prompt: Column, extracted_json: Column) -> Column:
    """Reply of the extraction role, given the records already extracted from the embedded text."""
    return (
        F.when(prompt.rlike(INPUT_TEXT_PATTERN), extracted_json)
        .when(prompt.rlike(DESCRIPTION_LIST_PATTERN), summarize_descriptions(prompt_description_list(prompt)))
        .otherwise(F.lit(EMPTY_RESULT))
    )


def tpm_limit(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, TPM_LIMIT_PATTERN, 1), F.lit("")).cast("int")


def retry_after_seconds(message: Column, default: float = 20.0) -> Column:
    amount = F.nullif(F.regexp_extract(message, RETRY_AFTER_PATTERN, 1), F.lit("")).try_cast("double")
    in_ms = F.regexp_extract(message, RETRY_AFTER_PATTERN, 2) == "ms"
    return F.coalesce(F.when(in_ms, amount / 1000).otherwise(amount), F.lit(default))


def is_daily_quota(message: Column) -> Column:
    lowered = F.lower(message)
    first, *rest = (F.contains(lowered, F.lit(mark)) for mark in DAILY_QUOTA_MARKS)
    for other in rest:
        first = first | other
    return first


def provider_base(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"/v1\z", ""), r"/+\z", "")


def without_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(url, r"/\z", "")


def split_list(setting: Column) -> Column:
    return F.filter(F.transform(F.split(setting, ","), py_strip), lambda x: x != "")


def has_model(models: Column, wanted: Column) -> Column:
    """A pulled model counts with or without its tag."""
    return F.exists(models, lambda m: (m == wanted) | (F.split_part(m, F.lit(":"), F.lit(1)) == wanted))


def entity_key(name: Column, entity_type: Column) -> Column:
    return F.concat_ws(":", F.lower(entity_type), F.lower(name))


def relationship_key(source: Column, relation_type: Column, target: Column) -> Column:
    return F.concat_ws("|", F.lower(source), F.lower(relation_type), F.lower(target))


def falsy(value: Column, fallback: Column) -> Column:
    """The fallback for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def pasted_name(title: Column, text: Column) -> Column:
    stripped_start = F.substring(py_strip(text), 1, PASTED_NAME_CHARS)
    return F.coalesce(
        F.nullif(py_strip(title), F.lit("")), F.nullif(stripped_start, F.lit("")), F.lit("Pasted text")
    )


def upload_label(title: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(py_strip(title), F.lit("")), F.substring(text, 1, UPLOAD_LABEL_CHARS))


def doc_id_from_hash(digest: Column) -> Column:
    """Repeatable document id, so that a retried task writes the same id again."""
    return F.concat(F.lit("doc-"), F.substring(digest, 1, 32))


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def kilobytes(size: Column) -> Column:
    return F.format_string("%.1f KB", size.cast("double") / 1024)


def ingest_message(deduped: Column, file_name: Column, chunk_count: Column) -> Column:
    known = F.concat(F.lit("Already in the knowledge base ("), file_name, F.lit(")."))
    plural = F.when(chunk_count == 1, "").otherwise("s")
    added = F.concat(F.lit('Added "'), file_name, F.lit('" — '), chunk_count.cast("string"), F.lit(" chunk"), plural, F.lit("."))
    return F.when(deduped, known).otherwise(added)


def resolve_coreferences(query: Column) -> Column:
    """Identity: the rewrite step is a place holder, the history is only looked at."""
    return query


def budget_exceeds_rate(budget: Column, tokens_per_minute: Column) -> Column:
    return (budget + ANSWER_HEADROOM_TOKENS) > tokens_per_minute


def join_columns(parts: Sequence[Column], sep: str) -> Column:
    return F.concat_ws(sep, *parts)
