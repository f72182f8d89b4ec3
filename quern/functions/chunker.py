"""Heading-aware splitting of Markdown into passages, and the operators that apply it to a document table."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_TOKENS, OVERLAP, LEAST = 96, 24, 16
CODE_LEAST, FRAGMENT = 20, 20
_HEADING = re.compile(r"^(#{1,4})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def estimate_tokens(text: str) -> int:
    """A quarter of the length in UTF-16 units, rounded up."""
    return -(-(len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2) // 4)


@dataclass
class Chunk:
    heading: str
    content: str
    tokens: int


class Fences:
    """Follows fenced code line by line: feed() says whether the line belongs to a fence (its markers included)."""

    def __init__(self) -> None:
        self.open: str | None = None

    def feed(self, line: str) -> bool:
        m = _FENCE.match(line)
        if self.open is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                self.open = m[1]
                return True
            return False
        if m and m[1][0] == self.open[0] and len(m[1]) >= len(self.open) and not m[2].strip():
            self.open = None
        return True


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The leading --- block as key: value pairs with quotes stripped, and the rest."""
    m = re.match(r"---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    pairs = {}
    for line in m[1].split("\n"):
        k, colon, v = line.partition(":")
        if colon and re.fullmatch(r"[\w-]+", k.strip()):
            v = v.strip()
            pairs[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return pairs, text[m.end() :]


def strip_mdx(text: str) -> str:
    """Without import and export lines and lines that are JSX tags alone, outside fences."""
    fences, out = Fences(), []
    for line in text.split("\n"):
        if fences.feed(line) or not re.match(r"\s*(?:(?:import|export)\s|</?[A-Z][\w.]*(?:\s[^>]*)?/?>\s*$)", line):
            out.append(line)
    return "\n".join(out)


def clean_heading(text: str) -> str:
    return re.sub(r"\s*\{#[^}]*\}\s*$", "", text).replace("`", "").strip()


def title_of(meta: dict[str, str], body: str, path: str) -> tuple[str, bool]:
    """The title (front matter, else first level-one heading, else the humanised file stem) and whether the body has an H1."""
    fences, first = Fences(), None
    for line in body.split("\n"):
        if not fences.feed(line):
            m = _HEADING.match(line)
            if m and len(m[1]) == 1 and clean_heading(m[2]):
                first = clean_heading(m[2])
                break
    stem = re.sub(r"[-_\s]+", " ", re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])).strip()
    return meta.get("title") or first or stem[:1].upper() + stem[1:], first is not None


def sections(body: str, title: str, has_h1: bool) -> list[tuple[str, str]]:
    """(breadcrumb, text) of each heading's own text; headings of levels one to four outside fences split."""
    stack: list[str | None] = [None if has_h1 else title, None, None, None]
    out: list[tuple[str, list[str]]] = [(" > ".join(x for x in stack if x), [])]
    fences = Fences()
    for line in body.split("\n"):
        m = None if fences.feed(line) else _HEADING.match(line)
        if m:
            level = len(m[1])
            stack[level - 1 :] = [clean_heading(m[2]) or None] + [None] * (4 - level)
            out.append((" > ".join(x for x in stack if x), []))
        out[-1][1].append(line)
    texts = [(crumb, "\n".join(lines).strip("\n")) for crumb, lines in out]
    return [(c, t) for c, t in texts if t.strip()]


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text): paragraphs between blank lines and whole fences."""
    out: list[tuple[str, str]] = []
    fences, kind, lines = Fences(), "text", []

    def flush() -> None:
        if "\n".join(lines).strip():
            out.append((kind, "\n".join(lines)))
        lines.clear()

    for line in text.split("\n"):
        was = fences.open is not None
        inside = fences.feed(line)
        if inside and not was:
            flush()
            kind = "code"
        elif not inside and not line.strip():
            flush()
            continue
        lines.append(line)
        if inside and fences.open is None:
            flush()
            kind = "text"
    flush()
    return out


class Splitter:
    def __init__(self, max_tokens: int, overlap: int, reserve: int, count: Callable[[str], int]):
        self.max, self.overlap, self.reserve = max_tokens, overlap, reserve
        self.count = lru_cache(4096)(count)

    def hard(self, text: str, budget: int) -> list[str]:
        """Pieces of a sentence without a stop: cut near a space, shrinking by a quarter until the piece fits."""
        out = []
        while self.count(text) > budget:
            n = max(16, budget * 4)
            while n > 16 and self.count(text[:n]) > budget:
                n = max(16, int(n * 0.75))
            at = text.rfind(" ", 16, n + 1)
            at = at if at > 0 else n
            if at >= len(text):
                break
            out.append(text[:at].rstrip())
            text = text[at:].lstrip()
        return [*out, text] if text else out

    def fill(self, parts: list[str], joint: str, budget: int) -> list[str]:
        out: list[str] = []
        for p in parts:
            if out and self.count(out[-1] + joint + p) <= budget:
                out[-1] += joint + p
            else:
                out.append(p)
        return out

    def split_text(self, text: str, budget: int) -> list[str]:
        lines: list[str] = []
        for line in text.split("\n"):
            if self.count(line) <= budget:
                lines.append(line)
                continue
            parts = [x for s in _SENTENCE.split(line) for x in (self.hard(s, budget) if self.count(s) > budget else [s])]
            lines += self.fill(parts, " ", budget)
        return [x for x in self.fill(lines, "\n", budget) if x.strip()]

    def split_code(self, text: str, budget: int) -> list[str]:
        lines = text.split("\n")
        m = _FENCE.match(lines[0])
        mark = m[1] if m else "```"
        closed = len(lines) > 1 and lines[-1].strip() and set(lines[-1].strip()) == {mark[0]}
        body = lines[1 : len(lines) - (1 if closed else 0)]
        room = max(CODE_LEAST, budget - self.count(lines[0] + "\n\n" + mark))
        parts = [x for line in body for x in (self.hard(line, room) if self.count(line) > room else [line])]
        return [f"{lines[0]}\n{x}\n{mark}" for x in self.fill(parts, "\n", room)]

    def tail(self, text: str) -> str:
        """The last lines that fit the overlap; a fence stops it."""
        kept: list[str] = []
        for line in reversed(text.split("\n")):
            if _FENCE.match(line) or self.count("\n".join([line, *kept])) > self.overlap:
                break
            kept.insert(0, line)
        return "\n".join(kept).strip("\n")

    def section(self, crumb: str, text: str) -> list[str]:
        budget = max(self.max - self.reserve - (self.count(crumb + "\n\n") if crumb else 0), LEAST)
        if self.count(text) <= budget:
            return [text]
        pieces = []
        for kind, b in blocks(text):
            if self.count(b) <= budget:
                pieces.append((kind, b))
            else:
                pieces += [(kind, x) for x in (self.split_code if kind == "code" else self.split_text)(b, budget)]
        out: list[str] = []
        cur: list[tuple[str, str]] = []
        size = 0
        carried = False  # cur holds nothing but the overlap of the chunk before

        def flush() -> None:
            out.append("\n\n".join(x for _, x in cur))

        for kind, b in pieces:
            cost = self.count(b) + 1
            if cur and size + cost > budget:
                if carried:
                    cur, size = [], 0
                else:
                    flush()
                    rest = self.tail(cur[-1][1]) if cur[-1][0] == "text" and self.overlap > 0 else ""
                    cur, size = ([("text", rest)], self.count(rest) + 1) if rest else ([], 0)
                    if cur and size + cost > budget:
                        cur, size = [], 0
                carried = bool(cur)
            cur.append((kind, b))
            size += cost
            carried = False
        if cur and not carried:
            flush()
        return out


def chunk_markdown(source: str, path: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, reserve: int = 0, count: Callable[[str], int] = estimate_tokens) -> tuple[str, list[Chunk]]:
    """The title and the passages of one document. Empty sources have no passages."""
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    meta, body = front_matter(text)
    if path.lower().endswith(".mdx"):
        body = strip_mdx(body)
    title, has_h1 = title_of(meta, body, path)
    s = Splitter(max_tokens, overlap, reserve, count)
    out: list[Chunk] = []
    for crumb, text in sections(body, title, has_h1):
        for piece in s.section(crumb, text):
            solid = len(re.sub(r"\s", "", piece))
            if out and solid < FRAGMENT:
                out[-1].content += "\n\n" + piece
            elif out and len(re.sub(r"\s", "", out[-1].content)) < FRAGMENT:
                out[-1] = Chunk(crumb, out[-1].content + "\n\n" + piece, 0)
            else:
                out.append(Chunk(crumb, piece, 0))
    for c in out:
        c.tokens = count(c.content)
    return title, out


def chunk_table(docs: DataFrame, path: str = "relative_path", text: str = "content", **options) -> DataFrame:
    """path, title, chunk_index, heading_path, content, token_count: documents split where they stand, no shuffle. Null
    texts have no passages."""

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                title, chunks = chunk_markdown(t, p or "", **options)
                for i, c in enumerate(chunks):
                    for col, v in zip(rows, (p, title, i, c.heading, c.content, c.tokens)):
                        col.append(v)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["path", "title", "chunk_index", "heading_path", "content", "token_count"])

    return docs.select(path, text).mapInArrow(run, "path string, title string, chunk_index int, heading_path string, content string, token_count int")


def overlapping_lines(before: str, after: str, most: int = 60) -> int:
    """How many last lines of one passage are the first of the next."""
    a, b = before.split("\n"), after.split("\n")
    for n in range(min(len(a), len(b), most), 0, -1):
        if a[-n:] == b[:n]:
            return n
    return 0


def join_chunks(parts: list[str]) -> str:
    """Passages in order with their overlaps taken once."""
    out = ""
    for i, p in enumerate(parts):
        n = overlapping_lines(out, p) if i else 0
        rest = "\n".join(p.split("\n")[n:]).lstrip("\n") if n else p
        out = p if not i else f"{out}\n{rest}" if n and rest else out if n else f"{out}\n\n{p}"
    return out


def truncate_to_tokens(text: str, budget: int, count: Callable[[str], int] = estimate_tokens) -> tuple[str, bool]:
    """Whole lines from the start that fit the budget (part of the first line if even it does not), and whether it was cut."""
    if count(text) <= budget:
        return text, False
    lines = text.split("\n")
    lo, hi = 0, len(lines)
    while lo < hi:  # the longest run of lines that fits
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if count("\n".join(lines[:mid])) <= budget else (lo, mid - 1)
    if lo:
        return "\n".join(lines[:lo]), True
    n = budget * 4
    while n > 1 and count(text[:n]) > budget:
        n = int(n * 0.75)
    return text[:n], True


def prefix_within(parts: list[str], budget: int, count: Callable[[str], int] = estimate_tokens) -> int:
    """How many first passages, joined, fit the budget; one at least."""
    n = 1
    while n < len(parts) and count(join_chunks(parts[: n + 1])) <= budget:
        n += 1
    return min(n, len(parts))


_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def prose_sentences(text: str) -> list[str]:
    """Sentences of the running text: without fences, tables, headings, list marks, link targets and inline marks."""
    fences, lines = Fences(), []
    for line in text.split("\n"):
        if fences.feed(line) or line.lstrip().startswith(("|", "#", ">", "<")):
            continue
        line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", _LIST.sub("", line))
        lines.append(re.sub(r"[*_`]+", "", line))
    return [s.strip() for s in re.split(r"(?<=[.!?。！？])\s*", " ".join(lines)) if len(s.split()) > 3 or len(s) > 12]


def probe(text: str, words: int = 8) -> str | None:
    """A test question made from the middle sentence: its last words."""
    s = prose_sentences(text)
    if not s:
        return None
    w = s[len(s) // 2].rstrip(".!?。！？").split()
    return " ".join(w[-words:]) if w else None
