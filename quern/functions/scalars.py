"""Scalar functions as column expressions; nothing here leaves the JVM but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_query(text: Column) -> Column:
    """Lower case, white space runs to one space, trimmed; NFKC first where the text has characters that it changes."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return fold_space(nfkc(text))


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4)


def clean_heading(text: Column) -> Column:
    """Without a trailing {#id} and without backticks."""
    return F.trim(F.replace(F.regexp_replace(text, r"\s*\{#[^}]*\}\s*$", ""), F.lit("`"), F.lit("")))


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def title_from_path(path: Column) -> Column:
    """The humanised file stem: separators to spaces, first letter upper."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")
    words = F.trim(F.regexp_replace(stem, r"[-_\s]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def embedding_text(heading: Column, content: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) == "", content).otherwise(F.concat(heading, F.lit("\n\n"), content))


def stored_content(text: Column, limit: int) -> Column:
    """struct(content, truncated): at most `limit` bytes, cut where a character ends."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # bytes of an incomplete last character: continuation bytes, then its lead byte
    whole = F.regexp_replace(F.decode(cut, "ISO-8859-1"), "(?:[\xc0-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf7][\x80-\xbf]{0,2})$", "")
    short = F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")
    over = F.octet_length(text) > limit
    return F.struct(F.when(over, short).otherwise(text).alias("content"), over.alias("truncated"))


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens, at most 60 characters."""
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 60)


def cursor(text: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), r"=+$|\s", "")


def from_cursor(text: Column) -> Column:
    """The text of a cursor; null unless encoding it again gives the same cursor."""
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    back = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when(cursor(back) == text, back)


def fnv1a(text: Column) -> Column:
    """FNV-1a over code points, 32 bits, as eight hex digits."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(points, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def hmac_sha256(key_hex: str, message: Column) -> Column:
    """HMAC-SHA-256 in hex under a literal key, from two SHA-256 calls over padded blocks."""
    key = bytes.fromhex(key_hex).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def source_url(url: Column) -> Column:
    """http(s) only, user information and fragment stripped, at most 2048 characters; else null."""
    u = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^(https?://)[^/?#]*@", "$1")
    return F.when(u.rlike(r"^https?://[^/?#\s]+") & (F.length(u) <= 2048), u)


def parse_since(text: Column) -> Column:
    """A strict ISO date or date-time (zone optional, UTC assumed) as a timestamp; null for anything else, also for days
    that the calendar does not have."""
    t = F.trim(text)
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(t, r"(T\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00")))


def overlap_budget(max_tokens: Column, reserve: Column, heading_tokens: Column, least: int = 16) -> Column:
    return F.greatest(max_tokens - reserve - heading_tokens, F.lit(least))
