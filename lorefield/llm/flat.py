"""Many texts as one flat array: word bounds and word hashes without an object per word."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
# Odd 64-bit multipliers of the word hash and the seed of its byte table; any others would do.
STEP = 0x9E3779B97F4A7C15
SEED = 20240229


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    if not len(texts) or bounds is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, bounds - bounds[0]


def text_chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offsets of the texts."""
    flat, bounds = text_bytes(texts)
    leads = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
    return np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), leads[bounds]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about `limit` bytes of text, so that memory follows the run and not the batch."""
    for batch in batches:
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_bounds(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of `inside`; no run crosses a text's end."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    edge[1:n] |= inside[1:] != inside[:-1]
    start = np.flatnonzero(inside & edge[:n])
    end = np.flatnonzero(inside & edge[1:]) + 1
    return start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, STEP, np.uint64)
    down = np.full(n, pow(STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte values, from prefix sums, so it depends on the bytes alone."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = 1 << max(16, int(len(flat)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_letters()[flat] * up[: len(flat)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start])


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return _LOWER[flat]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space that separates words in the shingle and language-model contracts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII digits, lower-case letters and every byte of a longer character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Code point ranges of scripts (fixed values of the Unicode block chart); number 1 is any other letter.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("indic", ((0x980, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3134F))),
)


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script number of every code point: 0 for no letter, 1 for a letter of no listed script, then the listed ones."""
    table = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.uint8, 0x110000)
    for number, (_, ranges) in enumerate(SCRIPTS, 2):
        for low, high in ranges:
            table[low : high + 1] *= number
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of every code point whose lower case is one code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table
