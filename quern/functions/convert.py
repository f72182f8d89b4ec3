"""Converters from document formats to Markdown, and their dispatch by file extension. Standard library only."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_OUTPUT = 8 << 20
MAX_UNPACKED = 64 << 20
CSV_ROWS = 200


class ConversionError(ValueError):
    """The document cannot be converted; the message says why."""


class Budget:
    """Refuses expansions past a limit of bytes."""

    def __init__(self, limit: int = MAX_OUTPUT):
        self.left = limit

    def take(self, text: str) -> str:
        self.left -= len(text.encode())
        if self.left < 0:
            raise ConversionError("the output is larger than the limit")
        return text


def decode_utf8(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


def cell(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().replace("|", "\\|")


def md_table(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is the header, short rows are padded."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    lines.insert(1, "|" + " --- |" * width)
    return "\n".join(lines)


def sniff_delimiter(text: str) -> str:
    """The candidate that splits the first records into the most columns, the same number in each."""
    best, most = ",", 1
    for d in ",;\t|":
        rows = [r for _, r in zip(range(10), csv.reader(io.StringIO(text), delimiter=d)) if r]
        widths = {len(r) for r in rows}
        if rows and min(widths) > most and len(widths) == 1:
            best, most = d, min(widths)
    if most == 1:
        head = text.split("\n", 1)[0]
        best = max(",;\t|", key=head.count) if any(c in head for c in ",;\t|") else ","
    return best


def from_csv(data: bytes, name: str = "") -> str:
    text = decode_utf8(data)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text)) if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    head = [*rows[0], *[f"Column {i + 1}" for i in range(len(rows[0]), width)]]
    body = rows[1:]
    budget, out = Budget(), []
    for i in range(0, max(1, len(body)), CSV_ROWS):
        part = body[i : i + CSV_ROWS]
        title = f"## Rows {i + 1}–{i + len(part)}\n\n" if len(body) > CSV_ROWS else ""
        out.append(budget.take(title + md_table([head, *part])))
    return "\n\n".join(out)


_SKIP = {"script", "style", "noscript", "template", "nav", "footer", "iframe", "head", "form", "button"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.prefix = ""
        self.lists: list[list] = []
        self.skip = 0
        self.pre = False
        self.tables: list[list[list[str]]] = []
        self.in_cell = False
        self.href: list[tuple[str, int]] = []

    def flush(self, tight: bool = False) -> None:
        text = "".join(self.line)
        self.line = []
        if not self.pre:
            text = re.sub(r"\s+", " ", text).strip()
        if text.strip():
            self.out.append(self.prefix + text + ("\n" if tight else "\n\n"))
        self.prefix = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip or (tag in _SKIP):
            if tag not in _VOID:
                self.skip += 1
            return
        if self.in_cell and tag not in ("td", "th", "tr", "table", "img", "a"):
            if tag in ("br", "p", "li", "div"):
                self.line.append(" ")
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("p", "div", "section", "article", "main", "header", "blockquote", "figure", "dl", "dt", "dd", "body", "html", "aside"):
            self.flush()
            if tag == "blockquote":
                self.prefix = "> "
        elif tag in ("ul", "ol"):
            self.flush(bool(self.lists))
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush(True)
            if self.lists:
                self.lists[-1][1] += 1
                mark = "-" if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}."
                self.prefix = "  " * (len(self.lists) - 1) + mark + " "
        elif tag == "pre":
            self.flush()
            self.pre = True
            self.out.append("```\n")
        elif tag == "br":
            self.line.append("\n" if self.pre else " ")
        elif tag == "img" and a.get("alt"):
            self.line.append(a["alt"])
        elif tag in ("strong", "b") and not self.pre:
            self.line.append("**")
        elif tag in ("em", "i") and not self.pre:
            self.line.append("*")
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a":
            self.href.append((a.get("href") or "", len(self.line)))
        elif tag == "table":
            self.flush()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.line, self.in_cell = [], True

    def handle_endtag(self, tag):
        if self.skip:
            if tag not in _VOID:
                self.skip -= 1
            return
        if tag in ("td", "th") and self.tables and self.in_cell:
            self.tables[-1][-1].append("".join(self.line))
            self.line, self.in_cell = [], False
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if r]
            if rows:
                self.out.append(md_table(rows) + "\n\n")
        elif self.in_cell and tag != "a":
            return
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "section", "article", "main", "header", "blockquote", "figure", "dl", "dt", "dd", "aside"):
            self.flush()
        elif tag == "li":
            self.flush(True)
        elif tag in ("ul", "ol"):
            self.flush(True)
            if self.lists:
                self.lists.pop()
            if not self.lists:
                self.out.append("\n")
        elif tag == "pre":
            self.out.append("".join(self.line).strip("\n") + "\n```\n\n")
            self.line, self.pre = [], False
        elif tag in ("strong", "b") and not self.pre:
            self.line.append("**")
        elif tag in ("em", "i") and not self.pre:
            self.line.append("*")
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a" and self.href:
            url, at = self.href.pop()
            text = "".join(self.line[at:]).strip()
            if text and re.match(r"https?:", url):
                self.line[at:] = [f"[{text}]({url})"]

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data)


def from_html(data: bytes | str, name: str = "") -> str:
    """Markdown of an HTML page: headings, lists, tables, code; image text is kept, scripts, styles and menus are not."""
    p = _Markdown()
    p.feed(decode_utf8(data) if isinstance(data, bytes) else data)
    p.close()
    p.flush()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


def from_ipynb(data: bytes, name: str = "") -> str:
    """Markdown cells as they are, code cells fenced in the kernel's language, outputs dropped."""
    try:
        book = json.loads(decode_utf8(data))
        cells = book["cells"] if "cells" in book else [c for w in book.get("worksheets", []) for c in w.get("cells", [])]
    except (ValueError, TypeError, KeyError) as e:
        raise ConversionError("not a notebook") from e
    lang = book.get("metadata", {}).get("kernelspec", {}).get("language") or book.get("metadata", {}).get("language_info", {}).get("name") or "python"
    out, budget = [], Budget()
    for c in cells:
        src = c.get("source", c.get("input", ""))
        src = ("".join(src) if isinstance(src, list) else str(src)).strip("\n")
        if not src.strip():
            continue
        if c.get("cell_type") == "markdown":
            out.append(budget.take(src))
        elif c.get("cell_type") == "code":
            mark = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", src)), default=0))
            out.append(budget.take(f"{mark}{lang}\n{src}\n{mark}"))
    return "\n\n".join(out)


_RST_LINE = re.compile(r"^([!-/:-@\[-`{-~])\1{2,}\s*$")
_ADMONITIONS = {"note", "warning", "tip", "important", "caution", "danger", "hint", "attention", "error", "seealso"}


def _rst_inline(t: str) -> str:
    t = re.sub(r"``([^`]+)``", r"`\1`", t)
    t = re.sub(r"`([^`<]+?)\s*<([^>`]+)>`__?", r"[\1](\2)", t)
    t = re.sub(r":[\w:+-]+:`([^`<]+?)\s*(?:<[^>`]*>)?`", r"`\1`", t)
    return re.sub(r"(?<![\w`])`([^`]+)`_(?!\w)", r"\1", t)


def from_rst(data: bytes, name: str = "") -> str:
    """Headings by order of adornment, literal blocks and code directives fenced, admonitions, simple, grid and CSV tables."""
    lines = decode_utf8(data).replace("\r\n", "\n").expandtabs(4).split("\n")
    levels: list[str] = []
    out: list[str] = []
    i = 0

    def indented(k: int) -> tuple[list[str], int]:
        block = []
        while k < len(lines) and (not lines[k].strip() or lines[k].startswith(" ")):
            block.append(lines[k])
            k += 1
        while block and not block[-1].strip():
            block.pop()
        pad = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
        return [x[pad:] for x in block], k

    def heading(text: str, style: str) -> None:
        if style not in levels:
            levels.append(style)
        out.append("#" * min(6, levels.index(style) + 1) + " " + _rst_inline(text.strip()) + "\n")

    while i < len(lines):
        line = lines[i]
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if _RST_LINE.match(line) and nxt.strip() and i + 2 < len(lines) and lines[i + 2].strip() == line.strip():
            heading(nxt, "over" + line[0])
            i += 3
        elif line.strip() and not line.startswith(" ") and _RST_LINE.match(nxt) and not _RST_LINE.match(line) and len(nxt.strip()) >= len(line.strip()) - 2:
            heading(line, nxt[0])
            i += 2
        elif m := re.match(r"^\.\. ([\w-]+)::\s*(.*)$", line):
            kind, arg = m[1].lower(), m[2].strip()
            block, i = indented(i + 1)
            while block and re.match(r"^:[\w-]+:", block[0]):
                block.pop(0)
            while block and not block[0].strip():
                block.pop(0)
            body = "\n".join(block)
            if kind in ("code-block", "code", "sourcecode", "highlight", "parsed-literal", "literalinclude"):
                out.append(f"```{arg if ' ' not in arg else ''}\n{body}\n```\n")
            elif kind in _ADMONITIONS:
                inner = from_rst(("\n".join(filter(None, [arg, body]))).encode())
                out.append(f"> **{kind.capitalize()}:** " + inner.replace("\n", "\n> ") + "\n")
            elif kind == "csv-table":
                rows = [r for r in csv.reader(io.StringIO(body), skipinitialspace=True) if r]
                out.append((f"**{arg}**\n\n" if arg else "") + md_table(rows) + "\n")
            elif kind == "list-table":
                rows, row = [], None
                for x in block:
                    if m2 := re.match(r"^\* - (.*)$", x):
                        row = [m2[1]]
                        rows.append(row)
                    elif (m2 := re.match(r"^\s+- ?(.*)$", x)) and row is not None:
                        row.append(m2[1])
                    elif x.strip() and row:
                        row[-1] += " " + x.strip()
                out.append(md_table(rows) + "\n")
            elif kind in ("image", "figure", "toctree", "contents", "index", "meta", "include", "raw"):
                if kind == "figure" and body:
                    out.append(_rst_inline(body) + "\n")
            elif body or arg:
                out.append(from_rst("\n".join(filter(None, [arg, "", body])).encode()) + "\n")
        elif line.startswith(".. "):  # comments, targets
            _, i = indented(i + 1)
        elif re.match(r"^\+[-=+]+\+\s*$", line):
            rows, cur = [], None
            while i < len(lines) and lines[i].startswith(("+", "|")):
                if lines[i].startswith("+"):
                    cur = None
                else:
                    cells = [c.strip() for c in lines[i].strip().strip("|").split("|")]
                    if cur is None:
                        cur = cells
                        rows.append(cur)
                    else:
                        for k, c in enumerate(cells[: len(cur)]):
                            cur[k] = (cur[k] + " " + c).strip()
                i += 1
            out.append(md_table(rows) + "\n")
        elif re.match(r"^=+(?: +=+)+\s*$", line):
            at = [(m.start(), m.end()) for m in re.finditer("=+", line)]
            rows = []
            i += 1
            rules = 1
            while i < len(lines) and rules < 3 and lines[i].strip():
                if re.match(r"^=+(?: +=+)+\s*$", lines[i]):
                    rules += 1
                else:
                    rows.append([lines[i][a : (b if k + 1 < len(at) else None)].strip() for k, (a, b) in enumerate(at)])
                i += 1
            out.append(md_table(rows) + "\n")
        elif line.rstrip().endswith("::") and (not nxt.strip() or nxt.startswith(" ")) and not line.startswith(".."):
            text = line.rstrip()[:-2].rstrip()
            if text:
                out.append(_rst_inline(text) + ":\n")
            block, i = indented(i + 1)
            while block and not block[0].strip():
                block.pop(0)
            if block:
                out.append("```\n" + "\n".join(block) + "\n```\n")
        else:
            out.append(_rst_inline(line))
            i += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def from_adoc(data: bytes, name: str = "") -> str:
    """Titles, attributes, listing blocks, tables, admonitions, links of AsciiDoc."""
    attrs: dict[str, str] = {}
    out: list[str] = []
    lines = decode_utf8(data).replace("\r\n", "\n").split("\n")

    def inline(t: str) -> str:
        t = re.sub(r"\{([\w-]+)\}", lambda m: attrs.get(m[1].lower(), m[0]), t)
        t = re.sub(r"(?:link:)?(https?://[^\s\[]+)\[([^\]]*)\]", lambda m: f"[{m[2] or m[1]}]({m[1]})", t)
        t = re.sub(r"<<([^,>]+)(?:,\s*([^>]+))?>>", lambda m: m[2] or m[1], t)
        t = re.sub(r"image:{1,2}[^\[]+\[([^\],]*)[^\]]*\]", r"\1", t)
        return re.sub(r"(?<![\w*])\*([^*\s][^*]*)\*(?![\w*])", r"**\1**", t)

    i, style = 0, ""
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := re.match(r"^:([\w-]+):\s*(.*)$", line):
            attrs[m[1].lower()] = m[2].strip()
        elif line.startswith("////"):
            while i < len(lines) and not lines[i].startswith("////"):
                i += 1
            i += 1
        elif line.startswith("//"):
            continue
        elif m := re.match(r"^(=+|#+)\s+(.*)$", line):
            out.append("#" * min(6, len(m[1])) + " " + inline(m[2]))
        elif m := re.match(r"^\[([^\]]*)\]\s*$", line):
            style = m[1]
        elif re.match(r"^(-{4,}|\.{4,}|`{3,})", line):
            mark = line.strip()
            body = []
            while i < len(lines) and lines[i].strip() != re.match(r"^(-{4,}|\.{4,}|`{3,})", mark)[1]:
                body.append(lines[i])
                i += 1
            i += 1
            lang = style.split(",")[1].strip() if style.startswith("source,") else ""
            out.append(f"```{lang}\n" + "\n".join(body) + "\n```")
            style = ""
        elif re.match(r"^[|,:!]={3,}", line):
            cells: list[list[str]] = []
            while i < len(lines) and not re.match(r"^[|,:!]={3,}", lines[i]):
                if lines[i].strip():
                    parts = re.split(r"(?<!\\)(?:\d*[.+]?\d*[<^>]?[adehlmsv]?)\|", lines[i])
                    if lines[i].lstrip().startswith("|") or "|" in lines[i]:
                        cells.append([inline(x.strip()) for x in parts[1:]])
                    elif cells and cells[-1]:
                        cells[-1][-1] += " " + inline(lines[i].strip())
                i += 1
            i += 1
            width = len(cells[0]) if cells else 0
            if m := re.search(r'cols="?(\d+)\*|cols="([^"]+)"', style):
                width = int(m[1]) if m[1] else len(m[2].split(","))
            flat = [c for r in cells for c in r]
            rows = [flat[k : k + width] for k in range(0, len(flat), width)] if width else []
            out.append(md_table(rows))
            style = ""
        elif m := re.match(r"^(NOTE|TIP|IMPORTANT|WARNING|CAUTION):\s+(.*)$", line):
            out.append(f"> **{m[1].capitalize()}:** {inline(m[2])}")
        elif re.match(r"^={4,}\s*$", line):
            if style.upper() in ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION"):
                out.append(f"> **{style.capitalize()}:**")
            style = ""
        elif m := re.match(r"^([*.]+)\s+(.*)$", line):
            out.append("  " * (len(m[1]) - 1) + ("- " if m[1][0] == "*" else "1. ") + inline(m[2]))
        elif m := re.match(r"^\.(\w.*)$", line):
            out.append(f"**{inline(m[1])}**\n")
        else:
            out.append("" if line.strip() == "+" else inline(line))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ConversionError("not a zip container") from e
    if sum(x.file_size for x in z.infolist()) > MAX_UNPACKED:
        raise ConversionError("the container unpacks to more than the limit")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.namelist():
        return None
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096]:
        raise ConversionError("document types are not allowed in parts")
    return ET.fromstring(raw)


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _kids(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e if _local(x) == name]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def from_docx(data: bytes, name: str = "") -> str:
    """Paragraphs, headings by style, lists and tables of the body."""
    z = _open(data)
    doc = _xml(z, "word/document.xml")
    if doc is None:
        raise ConversionError("no document part")
    styles = {}
    if (s := _xml(z, "word/styles.xml")) is not None:
        for x in s.iter():
            if _local(x) == "style":
                n = next((_attr(y, "val") or "" for y in x if _local(y) == "name"), "")
                if m := re.match(r"(?i)heading (\d)|(title)", n):
                    styles[_attr(x, "styleId")] = int(m[1]) if m[1] else 1
    out: list[str] = []

    def text(p: ET.Element) -> str:
        parts = []
        for x in p.iter():
            if _local(x) == "t":
                parts.append(x.text or "")
            elif _local(x) in ("tab", "br"):
                parts.append(" ")
        return "".join(parts).strip()

    def walk(body: ET.Element) -> None:
        for x in body:
            if _local(x) == "p":
                t = text(x)
                if not t:
                    continue
                pr = next(iter(_kids(x, "pPr")), None)
                style = next((_attr(y, "val") for y in pr if _local(y) == "pStyle"), None) if pr is not None else None
                level = styles.get(style) or (int(m[1]) if style and (m := re.match(r"(?i)heading(\d)$", style)) else 0)
                listed = pr is not None and any(_local(y) == "numPr" for y in pr)
                out.append("#" * level + " " + t if level else "- " + t if listed else t)
            elif _local(x) == "tbl":
                rows = [[" ".join(text(p) for p in c.iter() if _local(p) == "p").strip() for c in _kids(r, "tc")] for r in _kids(x, "tr")]
                out.append(md_table(rows))
            elif _local(x) in ("sdt", "sdtContent", "body"):
                walk(x)

    walk(doc)
    return Budget().take("\n\n".join(out))


def from_pptx(data: bytes, name: str = "") -> str:
    """Slides in their order: title, text, tables, notes."""
    z = _open(data)
    pres, rels = _xml(z, "ppt/presentation.xml"), _xml(z, "ppt/_rels/presentation.xml.rels")
    order: list[str] = []
    if pres is not None and rels is not None:
        target = {_attr(r, "Id"): _attr(r, "Target") or "" for r in rels}
        ids = [v for x in pres.iter() if _local(x) == "sldId" for k, v in x.attrib.items() if k.endswith("}id")]
        order = ["ppt/" + target[i].removeprefix("/ppt/").removeprefix("ppt/") for i in ids if i in target]
    order = order or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out, budget = [], Budget()

    def paragraphs(e: ET.Element) -> list[str]:
        return [t for p in e.iter() if _local(p) == "p" for t in ["".join(x.text or "" for x in p.iter() if _local(x) == "t").strip()] if t]

    for n, part in enumerate(order, 1):
        s = _xml(z, part)
        if s is None:
            continue
        title, body = "", []
        for x in s.iter():
            if _local(x) == "sp":
                kind = next((_attr(y, "type") for y in x.iter() if _local(y) == "ph"), None)
                t = paragraphs(x)
                if kind in ("title", "ctrTitle") and t and not title:
                    title = " ".join(t)
                elif kind not in ("sldNum", "dt", "ftr"):
                    body += [f"- {y}" if len(t) > 1 else y for y in t]
            elif _local(x) == "tbl":
                body.append(md_table([[" ".join(paragraphs(c)) for c in _kids(r, "tc")] for r in _kids(x, "tr")]))
        text = f"## {title or f'Slide {n}'}\n\n" + "\n".join(body)
        rel = _xml(z, re.sub(r"slides/([^/]+)$", r"slides/_rels/\1.rels", part))
        for r in rel if rel is not None else []:
            if "notesSlide" in (_attr(r, "Type") or ""):
                notes = _xml(z, "ppt/notesSlides/" + (_attr(r, "Target") or "").rsplit("/", 1)[-1])
                if notes is not None:
                    lines = [t for x in notes.iter() if _local(x) == "sp" and any(_local(y) == "ph" and _attr(y, "type") == "body" for y in x.iter()) for t in paragraphs(x)]
                    text += "\n\n**Notes:** " + " ".join(lines) if lines else ""
        out.append(budget.take(text.strip()))
    return "\n\n".join(out)


def from_xlsx(data: bytes, name: str = "") -> str:
    """Visible sheets as tables: shared and inline strings, cached values of formulas."""
    z = _open(data)
    book, rels = _xml(z, "xl/workbook.xml"), _xml(z, "xl/_rels/workbook.xml.rels")
    if book is None or rels is None:
        raise ConversionError("no workbook part")
    target = {_attr(r, "Id"): (_attr(r, "Target") or "").removeprefix("/xl/") for r in rels}
    shared: list[str] = []
    if (s := _xml(z, "xl/sharedStrings.xml")) is not None:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _kids(s, "si")]
    out, budget = [], Budget()
    for sheet in (x for x in book.iter() if _local(x) == "sheet"):
        if _attr(sheet, "state") in ("hidden", "veryHidden"):
            continue
        rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        part = _xml(z, "xl/" + target.get(rid, ""))
        if part is None:
            continue
        rows = []
        for r in (x for x in part.iter() if _local(x) == "row"):
            row: dict[int, str] = {}
            for c in _kids(r, "c"):
                ref = re.match(r"([A-Z]+)", _attr(c, "r") or "")
                col = 0
                for ch in ref[1] if ref else "":
                    col = col * 26 + ord(ch) - 64
                col = col - 1 if ref else len(row)
                v = next((y.text or "" for y in c if _local(y) == "v"), "")
                kind = _attr(c, "t")
                if kind == "s" and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                elif kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                row[col] = v
            if any(x.strip() for x in row.values()):
                rows.append([row.get(k, "") for k in range(max(row) + 1)])
        if rows:
            out.append(budget.take(f"## {_attr(sheet, 'name')}\n\n" + md_table(rows)))
    return "\n\n".join(out)


def from_confluence(data: bytes | str, name: str = "") -> str:
    """Storage format: code and panel macros, then as HTML."""
    t = decode_utf8(data) if isinstance(data, bytes) else data

    def macro(m: re.Match) -> str:
        kind, body = m[1], m[2]
        text = re.search(r"<ac:plain-text-body>\s*<!\[CDATA\[(.*?)\]\]>", body, re.S)
        rich = re.search(r"<ac:rich-text-body>(.*)</ac:rich-text-body>", body, re.S)
        if kind in ("code", "noformat") and text:
            return f"<pre>{html.escape(text[1])}</pre>"
        if rich:
            return f"<blockquote><strong>{kind.capitalize()}:</strong> {rich[1]}</blockquote>" if kind in ("info", "note", "warning", "tip") else rich[1]
        return ""

    t = re.sub(r'<ac:structured-macro[^>]*ac:name="([\w-]+)"[^>]*>(.*?)</ac:structured-macro>', macro, t, flags=re.S)
    t = re.sub(r"<ac:link[^>]*>.*?(?:<!\[CDATA\[(.*?)\]\]>|<ac:link-body>(.*?)</ac:link-body>).*?</ac:link>", lambda m: m[1] or m[2] or "", t, flags=re.S)
    return from_html(re.sub(r"</?(?:ac|ri):[^>]*>", "", t))


def from_notion(blocks: list[dict], depth: int = 0) -> str:
    """Blocks with nested children to Markdown."""

    def rich(b: dict) -> str:
        out = []
        for r in b.get("rich_text", []):
            t, a = r.get("plain_text", ""), r.get("annotations", {})
            t = f"`{t}`" if a.get("code") else f"**{t}**" if a.get("bold") else f"*{t}*" if a.get("italic") else t
            out.append(f"[{t}]({r['href']})" if r.get("href") else t)
        return "".join(out)

    out, number = [], 0
    for b in blocks:
        kind = b.get("type", "")
        x = b.get(kind, {})
        pad = "  " * depth
        number = number + 1 if kind == "numbered_list_item" else 0
        kids = from_notion(b.get("children", []), depth + 1 if kind.endswith("list_item") or kind == "to_do" else depth)
        if m := re.fullmatch(r"heading_([123])", kind):
            line = "#" * int(m[1]) + " " + rich(x)
        elif kind == "bulleted_list_item":
            line = f"{pad}- {rich(x)}"
        elif kind == "numbered_list_item":
            line = f"{pad}{number}. {rich(x)}"
        elif kind == "to_do":
            line = f"{pad}- [{'x' if x.get('checked') else ' '}] {rich(x)}"
        elif kind == "code":
            line = f"```{x.get('language', '')}\n{''.join(r.get('plain_text', '') for r in x.get('rich_text', []))}\n```"
        elif kind in ("quote", "callout"):
            line = "> " + rich(x).replace("\n", "\n> ")
        elif kind == "divider":
            line = "---"
        elif kind == "table":
            line, kids = md_table([["".join(r.get("plain_text", "") for r in c) for c in row.get("table_row", {}).get("cells", [])] for row in b.get("children", [])]), ""
        else:
            line = rich(x)
        joint = "\n" if kind.endswith("list_item") or kind == "to_do" else "\n\n"
        out.append((line + ("\n" + kids if kids and joint == "\n" else "\n\n" + kids if kids else "") + joint) if line or kids else "")
    return "".join(out).strip("\n")


def plain(data: bytes, name: str = "") -> str:
    return decode_utf8(data)


CONVERTERS = {
    "md": plain, "mdx": plain, "markdown": plain, "txt": plain, "csv": from_csv, "tsv": from_csv, "html": from_html, "htm": from_html, "ipynb": from_ipynb, "rst": from_rst,
    "adoc": from_adoc, "asciidoc": from_adoc, "docx": from_docx, "pptx": from_pptx, "xlsx": from_xlsx,
}


def convert(path: str, data: bytes, limit: int = MAX_OUTPUT) -> str:
    """Markdown of a file by its extension; refuses unknown kinds, files past the limit and files without text."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext not in CONVERTERS:
        raise ConversionError(f"no converter for .{ext}")
    if len(data) > limit:
        raise ConversionError("the file is larger than the limit")
    text = CONVERTERS[ext](data, path)
    if not text.strip():
        raise ConversionError("no text")
    return text


def convert_table(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, markdown, error: one row per file, where it stands. A file that cannot be converted has its reason in error."""

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts.append(convert(p or "", d or b""))
                    errors.append(None)
                except (ConversionError, ET.ParseError, KeyError, ValueError, RecursionError) as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "markdown", "error"])

    return files.select(path, content).mapInArrow(run, "path string, markdown string, error string")
