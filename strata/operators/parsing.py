"""Documents of many formats to Markdown. A document that cannot be parsed gets a parse_error, it never fails the job."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MAX_BYTES = 50 << 20
PLAIN = ("txt", "md", "markdown", "log", "ini", "cfg", "conf", "env")
UNSUPPORTED, TOO_LARGE, EMPTY, FAILED = "unsupported_format", "too_large", "empty", "parse_failed"


def pipe_table(rows: list[list[str]], rule: str = " --- |") -> str:
    """Rows padded to the widest; the first is the header, with a rule under each column."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(c.replace("\n", "<br>") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + rule * width, *map(line, rows[1:])])


def parse_csv(text: str) -> str:
    return pipe_table([r for r in csv.reader(io.StringIO(text)) if r], "---|")


def scalar(v) -> str:
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        v = int(v)
    return "<nil>" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def outline(value, depth: int = 0, key: str = "") -> list[str]:
    """Sorted keys, scalars before what is nested; a heading for each nested key, arrays numbered, their maps set apart by a blank line. The words
    for what is empty or null are fixed values."""
    if not isinstance(value, (dict, list)):
        return [f"- **{key}**: {scalar(value)}" if key else scalar(value)]
    if not value:
        return [f"- **{key}**: (empty)"] if key else []
    out = ["", f"{'#' * min(depth + 1, 6)} {key}", ""] if key else []
    if isinstance(value, dict):
        for k in sorted(value, key=lambda k: (isinstance(value[k], (dict, list)), k)):
            out += outline(value[k], depth + 1, k)
        return out
    for i, v in enumerate(value, 1):
        if isinstance(v, dict):
            out += ["", *outline(v, depth)]
        else:
            first, *rest = outline(v, depth) or [""]
            out += [f"{i}. {first}", *rest]
    return out


def parse_json(text: str) -> str:
    return "\n".join(outline(json.loads(text)))


def parse_yaml(text: str) -> str:
    import yaml

    return "\n".join(outline(json.loads(json.dumps(yaml.safe_load(text), default=str))))


def parse_toml(text: str) -> str:
    return "\n".join(outline(json.loads(json.dumps(tomllib.loads(text), default=str))))


def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_label(e) -> str:
    attrs = ", ".join(f"{bare(k)}={v}" for k, v in e.attrib.items())
    return bare(e.tag) + (f" ({attrs})" if attrs else "")


def xml_outline(e, depth: int) -> list[str]:
    out = ["#" * min(depth, 6) + " " + xml_label(e)]
    if (e.text or "").strip():
        out += ["", e.text.strip()]
    groups: dict[str, list] = {}
    for c in e:
        groups.setdefault(bare(c.tag), []).append(c)
    flat = lambda x: len(x) == 0
    for name, items in sorted(groups.items(), key=lambda g: not all(map(flat, g[1]))):
        if all(map(flat, items)):
            if len(items) == 1:
                out += ["", f"- **{xml_label(items[0])}**: {(items[0].text or '').strip()}"]
            else:
                out += ["", f"**{name}**", "", *[f"{i}. {(c.text or '').strip()}" for i, c in enumerate(items, 1)]]
        elif len(items) > 1 and all(len(c) and all(map(flat, c)) for c in items) and len({tuple(bare(x.tag) for x in c) for c in items}) == 1:
            out += ["", f"**{name}**", "", pipe_table([[bare(x.tag) for x in items[0]], *[[(x.text or "").strip() for x in c] for c in items]])]
        else:
            for c in items:
                out += ["", *xml_outline(c, depth + 1)]
    return out


def parse_xml(text: str) -> str:
    return "\n".join(xml_outline(ElementTree.fromstring(text), 1))


class Markdown(HTMLParser):
    """HTML to Markdown in one pass over its tags."""

    SKIP = frozenset(("script", "style", "noscript", "head", "title", "meta", "link"))
    VOID = frozenset(("meta", "link", "br", "hr", "img", "input"))
    BLOCK = frozenset(("p", "div", "section", "article", "nav", "footer", "header", "main"))
    INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.table: list[list[str]] | None = None
        self.marks: list[int] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.SKIP:
            self.skip += tag not in self.VOID
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCK:
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in self.INLINE:
            self.out.append(self.INLINE[tag])
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code":
            self.out.append("" if self.pre else "`")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "blockquote":
            self.marks.append(len(self.out))
        elif tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.marks.append(len(self.out))

    def taken(self) -> str:
        k = self.marks.pop()
        text = "".join(self.out[k:]).strip()
        del self.out[k:]
        return text

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip -= self.skip > 0 and tag not in self.VOID
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            self.out.append("\n\n")
        elif tag in self.INLINE:
            self.out.append(self.INLINE[tag])
        elif tag == "pre":
            self.pre -= self.pre > 0
            self.out.append("\n```\n\n")
        elif tag == "code":
            self.out.append("" if self.pre else "`")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("" if self.lists else "\n\n")
        elif tag == "blockquote" and self.marks:
            self.out.append("\n\n" + "\n".join("> " + x for x in self.taken().split("\n")) + "\n\n")
        elif tag in ("td", "th") and self.table and self.marks:
            self.table[-1].append(self.taken())
        elif tag == "table" and self.table is not None:
            self.out.append("\n\n" + pipe_table([r for r in self.table if r]) + "\n\n")
            self.table = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.pre:
            self.out.append(data)
            return
        text = re.sub(r"\s+", " ", data).strip()
        if text:
            last = next((x for x in reversed(self.out) if x), "")
            self.out.append((" " if re.search(r"[A-Za-z0-9]$", last) else "") + text)


def parse_html(text: str) -> str:
    m = Markdown()
    m.feed(text)
    m.close()
    return "".join(m.out)


#: Parsers by extension; the first registration holds.
PARSERS: dict[str, Callable[[str], str]] = {**{e: str for e in PLAIN}, "csv": parse_csv, "json": parse_json, "yaml": parse_yaml, "yml": parse_yaml, "toml": parse_toml, "xml": parse_xml, "html": parse_html, "htm": parse_html}


def register(ext: str, parser: Callable[[str], str]) -> None:
    PARSERS.setdefault(ext.lower(), parser)


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def parsed(content: Column, ext: Column, parsers: dict[str, Callable[[str], str]] | None = None) -> Column:
    """struct<content, parse_error> of text by extension (txt if empty)."""
    table = dict(parsers or PARSERS)

    @F.pandas_udf("content string, parse_error string")
    def run(texts: pd.Series, exts: pd.Series) -> pd.DataFrame:
        out = []
        for t, e in zip(texts, exts):
            try:
                text = tidy(table[(e or "txt").lower()](t))
                out.append((text, None) if text else (None, EMPTY))
            except KeyError:
                out.append((None, UNSUPPORTED))
            except Exception:  # noqa: BLE001  whatever a parser of foreign text raises
                out.append((None, FAILED))
        return pd.DataFrame(out, columns=["content", "parse_error"])

    return run(content, ext)


def gate(raw: Column, ext: Column, most: int = MAX_BYTES) -> Column:
    """Why raw bytes are not parsed at all; null if they are."""
    known = F.coalesce(F.nullif(F.lower(ext), F.lit("")), F.lit("txt")).isin(*PARSERS)
    return F.when(~known, UNSUPPORTED).when(F.octet_length(raw) > most, TOO_LARGE).when(F.coalesce(F.octet_length(raw), F.lit(0)) == 0, EMPTY).when(~F.is_valid_utf8(raw.cast("string")), FAILED)


def parse_documents(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files(name, ext, content) with Markdown content and parse_error."""
    checked = files.withColumn("_e", gate(F.col("content"), F.col("ext"), most))
    out = checked.withColumn("_p", parsed(F.when(F.col("_e").isNull(), F.col("content").cast("string")).otherwise(F.lit("")), F.col("ext")))
    return out.withColumn("parse_error", F.coalesce("_e", "_p.parse_error")).withColumn("content", F.when(F.col("parse_error").isNull(), F.col("_p.content"))).drop("_e", "_p")
