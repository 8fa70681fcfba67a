"""Text, identifier and hash functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scenelake.lookups import PLATFORM_ALIASES

# A word character is a letter, a number or "_" of any script.
WORD = r"\p{L}\p{N}_"
WORD_RUN = f"[{WORD}]+"
HYPHENATED = f"[{WORD}](?:[{WORD}\\-]*[{WORD}])?"

# RFC 4122 DNS namespace.
UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def words(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def hyphenated_words(text: Column) -> Column:
    """Lower-case tokens that may carry inner hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(HYPHENATED), F.lit(0))


def years(text: Column) -> Column:
    """Sorted distinct years 2010..2029 named in the text."""
    found = F.filter(words(text), lambda w: w.rlike("^20[12][0-9]$"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: w.cast("int"))))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the rest.

    ``initcap`` breaks at blanks only, so hyphens are widened to blanks and restored.
    """
    spaced = F.initcap(F.regexp_replace(text, "-", "\u0001 "))
    return F.regexp_replace(spaced, "\u0001 ", "-")


def uuid5_dns(name: Column) -> Column:
    """Name-based (SHA-1) UUID in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def sha256_bucket(text: Column, buckets: int) -> Column:
    """First 32 bits of the SHA-256 of the text, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def tile_id(scene: Column, x: Column, y: Column) -> Column:
    return F.concat(scene, F.lit("_x"), x.cast("string"), F.lit("_y"), y.cast("string"))


def region_id(analysis: Column, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(analysis, F.lit("_reg_"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))


def normalize_platform(raw: Column) -> Column:
    """Trimmed lower-case platform with ``-`` separators and aliases resolved."""
    plain = F.replace(F.trim(F.lower(raw)), F.lit("_"), F.lit("-"))
    aliases = F.create_map(*[F.lit(x) for pair in PLATFORM_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def normalize_crs(raw: Column) -> Column:
    """``EPSG:n`` for digit texts, the text itself otherwise, ``EPSG:4326`` where empty."""
    text = F.when(raw != "", raw)
    return F.when(text.rlike("^[0-9]+$"), F.concat(F.lit("EPSG:"), text)).otherwise(F.coalesce(text, F.lit("EPSG:4326")))
