"""Pattern-and-checksum scans for secrets and personal identifiers."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_FINDINGS = 100

# The length of an IBAN by country, from the public ISO 13616 registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def valid_iban(text: str) -> bool:
    """The registry's length for the country, and remainder 1 of the rearranged number; no spaces, capital letters."""
    if len(text) != IBAN_LENGTHS.get(text[:2], 0):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban_pattern(length: int) -> re.Pattern:
    """An IBAN of that length in groups of four, each after one space or none, up to where a group ends."""
    groups, rest = divmod(length - 4, 4)
    last = f"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}(?![A-Z0-9])")


_IBANS = {country: _iban_pattern(length) for country, length in IBAN_LENGTHS.items()}


def valid_citizen_number(text: str) -> bool:
    """Eleven digits, the first not zero, the last two check digits."""
    d = [int(c) for c in text]
    if len(d) != 11 or d[0] == 0:
        return False
    odd, even = sum(d[0:9:2]), sum(d[1:8:2])
    return (odd * 7 - even) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def valid_jwt(text: str) -> bool:
    """The first part decodes to a JSON object with a string alg."""
    head = text.split(".")[0]
    try:
        x = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


def _whole(candidate: str) -> str | None:
    return candidate


def _iban(candidate: str) -> str | None:
    """The IBAN that a candidate begins with: it may have taken a following word along."""
    pattern = _IBANS.get(candidate[:2])
    m = pattern.match(candidate) if pattern else None
    return m[0] if m and valid_iban(m[0].replace(" ", "")) else None


# The rules' names and the shapes of candidates; each with what a candidate is accepted as.
RULES = [
    ("aws_access_key", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), _whole),
    ("github_token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82})(?![A-Za-z0-9])"), _whole),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY(?: BLOCK)?-----"), _whole),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{4,4096}\.eyJ[A-Za-z0-9_-]{4,4096}\.[A-Za-z0-9_-]{1,4096}(?![A-Za-z0-9_-])"), lambda c: c if valid_jwt(c) else None),
    ("tckn", re.compile(r"(?<![A-Za-z0-9])[1-9][0-9]{10}(?![A-Za-z0-9])"), lambda c: c if valid_citizen_number(c) else None),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
]
KEY_WINDOW, KEY_CHARS = 8192, 4096


@dataclass
class Finding:
    rule: str
    start: int  # in UTF-16 units
    length: int
    line: int  # from 1
    col: int  # from 1, in characters
    preview: str
    normalized: str


def shown(rule: str, value: str, after: str) -> tuple[str, str]:
    """Preview (at most four characters beyond a fixed prefix) and the form a value is keyed in. A private key's header
    is the same for all keys, so it is keyed by what follows, up to its end mark."""
    if rule == "private_key":
        body = re.sub(r"\s+", "", after[:KEY_WINDOW].split("-----END")[0])[:KEY_CHARS]
        return value, body or value
    if rule == "iban":
        solid = value.replace(" ", "")
        return solid[:2] + "…" + solid[-4:], solid
    if rule == "tckn":
        return "*" * 9 + value[-2:], value
    if rule == "jwt":
        return value[:7] + "…", value
    return value[: 11 if value.startswith("github_pat_") else 4] + "…" + value[-4:], value


def scan_text(text: str, most: int = MAX_FINDINGS) -> tuple[list[Finding], int, bool]:
    """Findings in order, their full number, and whether the list was cut. Overlaps: the earlier match, then the longer."""
    found = []
    for rule, pattern, accept in RULES:
        for m in pattern.finditer(text):
            value = accept(m[0])
            if value:
                found.append((m.start(), -len(value), rule, value))
    kept, end = [], 0
    for start, minus, rule, value in sorted(found, key=lambda f: f[:2]):
        if start >= end:
            kept.append((start, rule, value))
            end = start - minus
    out, at, line, units, line_start = [], 0, 1, 0, 0
    for start, rule, value in kept[:most]:
        gap = text[at:start]
        line += gap.count("\n")
        if "\n" in gap:
            line_start = at + gap.rindex("\n") + 1
        units += len(gap) + sum(c > "\uffff" for c in gap)
        at = start
        stop = start + len(value)
        out.append(Finding(rule, units, len(value), line, start - line_start + 1, *shown(rule, value, text[stop : stop + KEY_WINDOW])))
    return out, len(kept), len(kept) > most


def scan_table(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MAX_FINDINGS) -> DataFrame:
    """One row per finding: key, rule, start, length, line, col, preview, normalized, total, capped. Null texts have none."""
    names = ["key", "rule", "start", "length", "line", "col", "preview", "normalized", "total", "capped"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_()]

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                found, total, capped = scan_text(t, most)
                for f in found:
                    for col, v in zip(rows, (str(k), f.rule, f.start, f.length, f.line, f.col, f.preview, f.normalized, total, capped)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return docs.select(key, text).mapInArrow(run, "key string, rule string, start int, length int, line int, col int, preview string, normalized string, total int, capped boolean")
