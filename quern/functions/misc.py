"""Smaller text, network and presentation functions."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wiki_flavour(text: Column) -> Column:
    """Notes of wiki editors as plain Markdown: links to their text, embeds and comments dropped, callouts to quotes."""
    t = F.regexp_replace(text, r"(?s)%%.*?%%", "")
    t = F.regexp_replace(t, r"!\[\[[^\]]*\]\]", "")
    t = F.regexp_replace(t, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[\[([^\]#|]*)#?[^\]]*\]\]", "$1")
    return F.regexp_replace(t, r"(?m)^>\s*\[!(\w+)\][-+]?[ \t]*(.*)$", "> **$1** $2")


def export_name(path: Column) -> Column:
    """Path of an exported page without the 32-digit identifiers behind its parts."""
    return F.regexp_replace(path, r"[ _-][0-9a-f]{32}(?=$|[./])", "")


def fence(text: str, word: str = "document") -> str:
    """The text between markers that do not occur in it."""
    n = 0
    while (mark := f"{word}{'-' + str(n) if n else ''}") and (f"<{mark}>" in text or f"</{mark}>" in text):
        n += 1
    return f"<{mark}>\n{text}\n</{mark}>"


def document_uri(project: Column, path: Column) -> Column:
    """docs://project/path with every segment percent-encoded."""
    enc = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    return F.concat(F.lit("docs://"), enc(project), F.lit("/"), F.array_join(F.transform(F.split(path, "/"), enc), "/"))


def parse_uri(uri: Column) -> Column:
    """struct(project, path) of a document URI; nulls for anything else."""
    ok = uri.rlike(r"^docs://[^/]+/.+$")
    part = lambda i: F.url_decode(F.regexp_extract(uri, r"^docs://([^/]+)/(.+)$", i))
    return F.struct(F.when(ok, part(1)).alias("project"), F.when(ok, part(2)).alias("path"))


@F.pandas_udf(T.BooleanType())
def in_networks(address: pd.Series, networks: pd.Series) -> pd.Series:
    """Whether an address lies in one of the comma-separated networks; an empty list admits all, a bad address none."""

    def test(a, n):
        nets = [x.strip() for x in (n or "").split(",") if x.strip()]
        if not nets:
            return True
        try:
            ip = ipaddress.ip_address(a)
            ip = ip.ipv4_mapped or ip if ip.version == 6 else ip
            return any(ip.version == (w := ipaddress.ip_network(x, strict=False)).version and ip in w for x in nets)
        except (ValueError, TypeError):
            return False

    return pd.Series([test(a, n) for a, n in zip(address, networks)])


def exposition(histogram: DataFrame, name: str, label: str, bounds: list[float]) -> DataFrame:
    """Text lines of a cumulative histogram (columns le_0.., le_inf, total) in the exposition format."""
    lines = [F.format_string(f'{name}_bucket{{{label}="%s",le="{b:g}"}} %d', F.col(label), F.col(f"le_{i}")) for i, b in enumerate(bounds)]
    lines.append(F.format_string(f'{name}_bucket{{{label}="%s",le="+Inf"}} %d', F.col(label), F.col("le_inf")))
    lines.append(F.format_string(f'{name}_sum{{{label}="%s"}} %s', F.col(label), F.col("total").cast("string")))
    lines.append(F.format_string(f'{name}_count{{{label}="%s"}} %d', F.col(label), F.col("le_inf")))
    return histogram.select(F.posexplode(F.array(*lines)).alias("i", "line"), F.col(label).alias("series"))


def safe_root(path: str, roots: list[str]) -> bool:
    """Whether a real path lies inside one of the allowed roots (driver side)."""
    import os

    real = os.path.realpath(path)
    return any(real == r or real.startswith(r.rstrip("/") + "/") for r in (os.path.realpath(x) for x in roots))
