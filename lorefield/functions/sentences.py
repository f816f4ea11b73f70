"""Sentence spans, encoder windows and sentence-packed chunks, each computed inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorefield.functions.arrays import let, let_all, offsets, scan
from lorefield.functions.text import py_strip

# --- fixed values ---
SENTENCE_PATTERN = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$"
WINDOW_CHARS = 900
PACK_CHARS = 800
PACK_OVERLAP_SENTENCES = 1
# --------------------


def sentence_pieces(text: Column) -> Column:
    """Sentences with their end marks; laid end to end they give the text again."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def sentence_spans(text: Column) -> Column:
    """array<struct<s, e>> of the non-blank sentences; offsets count the blank ones too."""

    def build(pieces: Column) -> Column:
        placed = F.zip_with(
            pieces,
            offsets(pieces),
            lambda piece, at: F.when(
                py_strip(piece) != "", F.struct(at.alias("s"), (at + F.length(piece)).alias("e"))
            ),
        )
        return F.filter(placed, lambda p: p.isNotNull())

    return let(sentence_pieces(text), build)


def window_starts(spans: Column, limit: int = WINDOW_CHARS) -> Column:
    """For every sentence, the start of the greedy window it falls into."""

    def step(start: Column, span: Column) -> tuple[Column, Column]:
        opened = F.when(start.isNull() | ((span["e"] - start) > limit), span["s"]).otherwise(start)
        return opened, opened

    return scan(spans, F.lit(None).cast("int"), "int", step)


def windows(text: Column, spans: Column, limit: int = WINDOW_CHARS) -> Column:
    """array<struct<start, text>>: sentences packed greedily; an over-long sentence stands alone."""

    def build(sp: Column, starts: Column) -> Column:
        # The end of a window is the end of the last sentence before the next window opens.
        following = F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1)))
        marked = F.zip_with(sp, starts, lambda p, w: F.struct(p["e"].alias("e"), w.alias("w")))
        ends = F.filter(
            F.zip_with(marked, following, lambda p, nxt: F.when(nxt.isNull() | (nxt != p["w"]), p["e"])),
            lambda e: e.isNotNull(),
        )
        return F.zip_with(
            F.array_distinct(starts),
            ends,
            lambda s, e: F.struct(s.alias("start"), F.substring(text, s + 1, e - s).alias("text")),
        )

    return let(spans, lambda sp: let(window_starts(sp, limit), lambda starts: build(sp, starts)))


def packed_chunks(text: Column, target: int = PACK_CHARS, overlap: int = PACK_OVERLAP_SENTENCES) -> Column:
    """Sentence chunks near `target` characters; each new chunk starts with the last `overlap` sentences."""
    empty = F.expr("cast(array() as array<string>)")

    def step(current: Column, sentence: Column) -> tuple[Column, Column]:
        filled = F.aggregate(current, F.lit(0), lambda n, s: n + F.length(s))
        full = ((filled + F.length(sentence)) > target) & (F.size(current) > 0)
        keep = F.least(F.lit(overlap), F.size(current))
        # "The last 0 sentences" keeps them all, because a slice from the end by zero is the whole list.
        carried = current if overlap == 0 else F.slice(current, F.size(current) - keep + 1, keep)
        following = F.concat(F.when(full, carried).otherwise(current), F.array(sentence))
        return F.when(full, F.array_join(current, " ")), following

    def build(sentences: Column) -> Column:
        # An end mark behind the last sentence would flush it; the open chunk is rebuilt from the state instead.
        outcome = _scan_with_state(sentences, empty, "string", step)
        return let(
            outcome,
            lambda o: F.when(
                F.size(sentences) > 0,
                F.concat(F.filter(o["out"], lambda c: c.isNotNull()), F.array(F.array_join(o["state"], " "))),
            ).otherwise(empty),
        )

    stripped = F.filter(F.transform(sentence_pieces(text), py_strip), lambda s: s != "")
    return let(stripped, build)


def _scan_with_state(items: Column, zero: Column, out_type: str, step) -> Column:
    """Scan that also returns the final state; outputs are few, so plain appending is enough."""
    nothing = F.expr(f"cast(array() as array<{out_type}>)")

    def one(acc: Column, item: Column) -> Column:
        output, state = step(acc["state"], item)
        return let_all(
            [output, state],
            lambda out, nxt: F.struct(
                F.when(out.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(out))).alias("out"),
                nxt.alias("state"),
            ),
        )

    return F.aggregate(items, F.struct(nothing.alias("out"), zero.alias("state")), one)
