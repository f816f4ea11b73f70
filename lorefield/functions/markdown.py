"""Chat Markdown subset to HTML, as column expressions over the lines of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorefield.functions.arrays import let

# --- fixed values ---
HEADING = r"^(#{1,3})\s+(.*)"
BULLET = r"^[-*]\s+(.*)"
NUMBERED = r"^\d+[.)]\s+(.*)"
INLINE = (
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
    (r"(?<!\*)\*([^*]+)\*(?!\*)", "<em>$1</em>"),
    (r"\[([^\]]+)\]\((https?://[^\s)]+)\)", '<a href="$2" target="_blank" rel="noopener noreferrer">$1</a>'),
)
# --------------------


def inline_html(text: Column) -> Column:
    """Escape first, then the inline marks."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for pattern, target in INLINE:
        out = F.regexp_replace(out, pattern, target)
    return out


def render(source: Column) -> Column:
    """Every line becomes an element; a list opens and closes where the list kind changes from line to line."""

    def classify(line: Column) -> Column:
        kind = (
            F.when(line.rlike(HEADING), "h").when(line.rlike(BULLET), "ul").when(line.rlike(NUMBERED), "ol")
            .when(F.trim(line) == "", "").otherwise("p")
        )
        level = F.length(F.regexp_extract(line, HEADING, 1)) + 2
        html = (
            F.when(kind == "h", F.concat(F.lit("<h"), level, F.lit(">"), inline_html(F.regexp_extract(line, HEADING, 2)), F.lit("</h"), level, F.lit(">")))
            .when(kind == "ul", F.concat(F.lit("<li>"), inline_html(F.regexp_extract(line, BULLET, 1)), F.lit("</li>")))
            .when(kind == "ol", F.concat(F.lit("<li>"), inline_html(F.regexp_extract(line, NUMBERED, 1)), F.lit("</li>")))
            .when(kind == "p", F.concat(F.lit("<p>"), inline_html(line), F.lit("</p>")))
            .otherwise("")
        )
        lists = F.when(kind.isin("ul", "ol"), kind).otherwise("")
        return F.struct(lists.alias("list"), html.alias("html"))

    def join(items: Column) -> Column:
        before = F.concat(F.array(F.struct(F.lit("").alias("list"), F.lit("").alias("html"))), items)
        after = F.concat(items, F.array(F.struct(F.lit("").alias("list"), F.lit("").alias("html"))))

        def tag(prev: Column, cur: Column) -> Column:
            changed = prev["list"] != cur["list"]
            closing = F.when(changed & (prev["list"] != ""), F.concat(F.lit("</"), prev["list"], F.lit(">"))).otherwise("")
            opening = F.when(changed & (cur["list"] != ""), F.concat(F.lit("<"), cur["list"], F.lit(">"))).otherwise("")
            return F.concat(closing, opening, cur["html"])

        return F.array_join(F.zip_with(before, after, tag), "")

    lines = F.transform(F.split(source, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\s+\z", "")))
    return let(F.transform(lines, classify), join)
