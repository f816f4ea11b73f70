"""URL identity and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorefield.functions.arrays import let
from lorefield.functions.text import py_strip

# --- fixed values ---
VIDEO_HOST_PATTERN = r"(?i)(?:youtube\.com|youtu\.be)"
VIDEO_ID_PATTERN = r"(?:v=|/)([0-9A-Za-z_-]{11})(?:[?&/]|$)"
CACHE_KEY_CHARS = 16
# The generic URI split: scheme, authority, path, query, fragment.
URI_PATTERN = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
CLIPPABLE_PATTERN = r"^https?://"
# --------------------


def is_video_url(url: Column) -> Column:
    return url.rlike(VIDEO_HOST_PATTERN)


def video_id(url: Column) -> Column:
    """Eleven-character video id, null when there is none."""
    return F.nullif(F.regexp_extract(url, VIDEO_ID_PATTERN, 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, trailing slashes and fragment dropped, query kept."""

    def build(clean: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(clean, URI_PATTERN, group)

        scheme = F.lower(part(1))
        authority = F.lower(part(2))
        query = part(4)
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
            F.regexp_replace(part(3), r"/+\z", ""),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        )

    return let(py_strip(url), build)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(canonical_url(url), 256), 1, CACHE_KEY_CHARS)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(py_strip(url), URI_PATTERN, 2))


def is_clippable(url: Column) -> Column:
    return url.rlike(CLIPPABLE_PATTERN)
