"""Documents of several formats as Markdown, with what was found and what was lost.

Parsing is by the standard library, one document at a time, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType()), T.StructField("stats", T.MapType(T.StringType(), T.LongType())), T.StructField("warnings", T.ArrayType(T.StringType()))])
#: Elements whose content is left out.
DROPPED = frozenset("script style nav header footer head noscript template svg form".split())
#: Confluence panels and how they are marked.
PANELS = {"info": "INFO", "note": "NOTE", "warning": "WARNING", "tip": "TIP", "panel": "NOTE"}


def _tidy(lines: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip() + "\n"


def from_text(text: str) -> dict:
    """Plain text by rules: the first line is the title; underlined, numbered or colon-ended
    lines are headings; dashes and bullets make lists; indented lines make code; runs of
    `key: value` lines make a table."""
    stats, out, code, pairs = Counter(), [], [], []
    title = None

    def flush() -> None:
        if code:
            out.extend(["```", *(x[4:] if x.startswith("    ") else x.lstrip("\t") for x in code), "```", ""])
            stats["code"] += 1
            code.clear()
        if len(pairs) > 1:
            out.extend(["| key | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in pairs), ""])
            stats["table"] += 1
        elif pairs:
            out.append(f"{pairs[0][0]}: {pairs[0][1]}")
        pairs.clear()

    lines = text.replace("\r\n", "\n").split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        following = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if re.match(r"(?: {4}|\t)\S", line):
            if pairs:
                flush()
            code.append(line)
            continue
        if not s:
            flush()
            out.append("")
            continue
        if re.fullmatch(r"[=-]{3,}", s):
            continue
        if m := re.match(r"([^:]{1,40}):\s+(\S.*)", s):
            if code:
                flush()
            pairs.append((m[1].strip(), m[2].strip()))
            continue
        flush()
        if title is None:
            title = s.lstrip("# ")
            out.append(f"# {title}")
        elif re.fullmatch(r"[=-]{3,}", following) or re.match(r"\d+\.\s+\S.{0,60}$", s) and not following or re.fullmatch(r".{1,60}:", s):
            out.extend(["", f"## {s.rstrip(':')}"])
            stats["heading"] += 1
        elif m := re.match(r"(?:[-*•·]|\d+[.)])\s+(.*)", s):
            out.append(f"- {m[1]}")
            stats["list_item"] += 1
        else:
            out.append(s)
            stats["paragraph"] += 1
    flush()
    return {"markdown": _tidy(out), "title": title, "stats": dict(stats), "warnings": []}


class _Markdown(HTMLParser):
    """HTML, and Confluence storage markup with it, as Markdown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line = ""
        self.stats: Counter = Counter()
        self.warnings: list[str] = []
        self.title: str | None = None
        self.skip: list[str] = []
        self.lists: list[tuple[str, int]] = []
        self.rows: list[list[str]] | None = None
        self.cell: str | None = None
        self.pre = 0
        self.quote = 0
        self.in_title = False
        self.href: list[str] = []
        self.macro: list[str] = []
        self.param = ""

    def flush(self, prefix: str = "") -> None:
        s = self.line if self.pre else " ".join(self.line.split())
        self.line = ""
        if s:
            self.out.append("> " * self.quote + prefix + s)

    def say(self, s: str) -> None:
        if self.cell is not None:
            self.cell += s
        else:
            self.line += s

    def item(self) -> None:
        """What is said so far as an item of the innermost list."""
        if self.line.strip():
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            if self.lists:
                self.lists[-1] = (kind, n + 1)
            self.flush("  " * max(0, len(self.lists) - 1) + (f"{n + 1}. " if kind == "ol" else "- "))
            self.stats["list_item"] += 1

    def handle_starttag(self, tag, attrs) -> None:
        a = dict(attrs)
        if tag == "title":
            self.in_title = True
            return
        if tag in DROPPED and tag != "head":
            self.skip.append(tag)
        if self.skip:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.out.append("")
        elif tag in ("p", "div", "section", "article", "ac:layout", "ac:rich-text-body", "ac:task-body"):
            if self.cell is None:
                self.flush()
        elif tag in ("ul", "ol"):
            self.item() if self.lists else self.flush()
            self.lists.append((tag, 0))
        elif tag == "li":
            self.item() if self.lists else self.flush()
        elif tag == "br":
            self.say(" " if self.cell is not None or not self.pre else "\n")
        elif tag == "hr":
            self.flush()
            self.out += ["", "---", ""]
        elif tag in ("pre", "ac:plain-text-body"):
            self.flush()
            self.pre += 1
            self.out += ["", "```"]
        elif tag == "blockquote":
            self.flush()
            self.quote += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.cell = ""
        elif tag in ("strong", "b"):
            self.say("**")
        elif tag in ("em", "i"):
            self.say("*")
        elif tag == "code" and not self.pre:
            self.say("`")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.say("[")
        elif tag in ("img", "ri:attachment", "ri:url"):
            src = a.get("src") or a.get("ri:filename") or a.get("ri:value") or ""
            self.say(f"![{a.get('alt') or ''}]({src})")
            self.stats["image"] += 1
        elif tag == "ri:page":
            self.say(a.get("ri:content-title") or "")
        elif tag == "ac:structured-macro":
            name = a.get("ac:name") or ""
            self.macro.append(name)
            self.flush()
            if name in PANELS:
                self.out.append(f"> [!{PANELS[name]}]")
                self.quote += 1
                self.stats["panel"] += 1
            elif name not in ("code", "expand", "noformat", "toc"):
                self.warnings.append(f"unsupported macro: {name}")
        elif tag == "ac:parameter":
            self.param = a.get("ac:name") or ""
            self.skip.append(tag)
        elif tag == "ac:task":
            self.flush()

    def handle_endtag(self, tag) -> None:
        if tag == "title":
            self.in_title = False
            return
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if m := re.fullmatch(r"h([1-6])", tag):
            head = " ".join(self.line.split())
            self.line = ""
            if head:
                self.out += ["#" * int(m[1]) + " " + head, ""]
                self.stats["heading"] += 1
                self.title = self.title or head
        elif tag in ("p", "div", "section", "article", "ac:rich-text-body"):
            if self.cell is None:
                if self.line.strip() and tag == "p":
                    self.stats["paragraph"] += 1
                self.flush()
                self.out.append("")
        elif tag == "li":
            self.item()
        elif tag in ("ul", "ol"):
            if self.lists:
                self.item()
                self.lists.pop()
            if not self.lists:
                self.out.append("")
        elif tag in ("pre", "ac:plain-text-body") and self.pre:
            if self.line.strip():
                self.out.append(self.line.strip("\n"))
            self.line = ""
            self.pre -= 1
            self.out += ["```", ""]
            self.stats["code"] += 1
        elif tag == "blockquote" and self.quote:
            self.flush()
            self.quote -= 1
        elif tag in ("td", "th") and self.rows is not None and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join(self.cell.split()).replace("|", "\\|"))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows = [r for r in self.rows if r]
            width = max(map(len, rows), default=0)
            for k, r in enumerate(rows):
                self.out.append("| " + " | ".join([*r, *[""] * (width - len(r))]) + " |")
                if k == 0:
                    self.out.append("|" + "---|" * width)
            self.out.append("")
            self.stats["table"] += 1
            self.rows = None
        elif tag in ("strong", "b"):
            self.say("**")
        elif tag in ("em", "i"):
            self.say("*")
        elif tag == "code" and not self.pre:
            self.say("`")
        elif tag == "a":
            self.say(f"]({self.href.pop() if self.href else ''})")
            self.stats["link"] += 1
        elif tag == "ac:structured-macro" and self.macro:
            if self.macro.pop() in PANELS and self.quote:
                self.flush()
                self.quote -= 1
                self.out.append("")
        elif tag == "ac:task-body":
            self.flush("- [ ] ")
            self.stats["list_item"] += 1

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title = self.title or data.strip() or None
        elif not self.skip:
            self.say(data)

    def unknown_decl(self, data) -> None:
        if data.startswith("CDATA[") and not self.skip:
            self.say(data[6:])


def from_html(text: str) -> dict:
    """HTML as Markdown. The title is that of the head, else the first heading."""
    p = _Markdown()
    p.feed(text)
    p.close()
    p.flush()
    return {"markdown": _tidy(p.out), "title": p.title, "stats": dict(p.stats), "warnings": sorted(set(p.warnings))}


def from_confluence(text: str) -> dict:
    """Confluence storage markup as Markdown; macros without a counterpart are warned of."""
    return from_html(re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: m[1].replace("&", "&amp;").replace("<", "&lt;"), text, flags=re.S))


def convert(name: str | None, text: str | None) -> dict:
    """By extension, else by looks."""
    t, n = text or "", (name or "").lower()
    if n.endswith((".md", ".markdown")):
        head = re.search(r"(?m)^#\s+(.+)$", t)
        return {"markdown": t, "title": head[1].strip() if head else None, "stats": {"heading": len(re.findall(r"(?m)^#+\s", t))}, "warnings": []}
    if n.endswith(".txt"):
        return from_text(t)
    if n.endswith(".xml") or "<ac:" in t or "<ri:" in t:
        return from_confluence(t)
    if n.endswith((".html", ".htm")) or re.match(r"(?is)\s*(?:<!doctype html|<html|<body|<h1|<p)\b", t):
        return from_html(t)
    return from_text(t)


def decode(raw: bytes | None, most: int = 2 << 20) -> str:
    """Bytes as text: UTF-8, else the two Korean code pages, else UTF-8 with losses. More than
    `most` bytes are refused."""
    raw = raw or b""
    if len(raw) > most:
        raise ValueError(f"more than {most} bytes")
    for code in ("utf-8-sig", "cp949", "euc-kr"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def converted(name: Column, text: Column) -> Column:
    """Struct (markdown, title, stats, warnings) of documents; null text is an empty document."""
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("markdown", pa.string()), ("title", pa.string()), ("stats", pa.map_(pa.string(), pa.int64())), ("warnings", pa.list_(pa.string()))])
        for names, texts in batches:
            rows = [convert(n.as_py(), t.as_py()) for n, t in zip(names, texts, strict=True)]
            yield pa.array([r | {"stats": sorted(r["stats"].items())} for r in rows], kind)

    return run(name.cast("string"), text.cast("string"))
