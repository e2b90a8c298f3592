"""HTML as Markdown or plain text, and what format bytes are in."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "head", "template", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "table", "ul", "ol", "blockquote", "pre", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}


class _Writer(HTMLParser):
    def __init__(self, plain: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.plain, self.out, self.hidden, self.lists, self.pre, self.link, self.cells = plain, [], 0, [], 0, None, None

    def emit(self, text: str) -> None:
        if not self.hidden:
            (self.out if self.cells is None else self.cells[-1] if self.cells else self.out).append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "br":
            self.emit("\n" if self.cells is None else " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.emit("" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.emit("\n" + "  " * depth + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            if self.cells is not None:
                self.cells.append([])
        elif tag in _BLOCKS:
            self.emit("\n\n")
            if tag == "pre":
                self.pre += 1
                self.emit("" if self.plain else "```\n")
            elif tag == "hr":
                self.emit("" if self.plain else "---\n\n")
            elif len(tag) == 2 and tag[0] == "h" and not self.plain:
                self.emit("#" * int(tag[1]) + " ")
            elif tag == "blockquote" and not self.plain:
                self.emit("> ")
        elif tag in ("b", "strong", "i", "em", "code") and not self.plain and not self.pre:
            self.emit({"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}[tag])
        elif tag == "a":
            self.link = dict(attrs).get("href")
            if self.link and not self.plain:
                self.emit("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.emit("" if self.lists else "\n\n")
        elif tag == "tr" and self.cells is not None:
            row, self.cells = [" ".join("".join(c).split()) for c in self.cells], None
            self.emit("\n" + (" | ".join(row) if self.plain else "| " + " | ".join(row) + " |"))
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.emit("\n\n" if self.plain else "\n```\n\n")
        elif tag in _BLOCKS:
            self.emit("\n\n")
        elif tag in ("b", "strong", "i", "em", "code") and not self.plain and not self.pre:
            self.emit({"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}[tag])
        elif tag == "a" and self.link:
            self.emit(f" ({self.link})" if self.plain else f"]({self.link})")
            self.link = None

    def handle_data(self, data: str) -> None:
        if not self.pre:
            data = re.sub(r"\s+", " ", data)
            if self.cells is None and (not self.out or self.out[-1][-1:] in ("\n", " ", "")):
                data = data.lstrip(" ")
        self.emit(data)


def _written(html: str, plain: bool) -> str:
    writer = _Writer(plain)
    writer.feed(html)
    writer.close()
    text = re.sub(r"[ \t]+(?=\n)", "", "".join(writer.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_to_markdown(html: str) -> str:
    return _written(html, False)


def html_to_text(html: str) -> str:
    return _written(html, True)


def sniff(content: Column) -> Column:
    """The format of bytes by their first ones; null if none is known. Members of ZIP files tell Office formats apart."""
    head = F.substring(content, 1, 8)
    start = lambda h: F.startswith(F.hex(head), F.lit(h))
    holds = lambda name: F.contains(F.hex(content), F.lit(name.encode().hex().upper()))
    text = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    zipped = F.when(holds("mimetypeapplication/epub+zip"), "epub").when(holds("opendocument.text"), "odt").when(holds("opendocument.spreadsheet"), "ods").when(holds("opendocument.presentation"), "odp")
    zipped = zipped.when(holds("word/document.xml"), "docx").when(holds("xl/workbook.xml"), "xlsx").when(holds("ppt/presentation.xml"), "pptx")
    return F.when(start("25504446"), "pdf").when(start("7B5C727466"), "rtf").when(start("D0CF11E0A1B11AE1"), "ole").when(start("504B0304"), zipped).when(F.rlike(text, F.lit(r"^\s*(<!doctype html|<html|<head|<body|<\?xml[^>]*>\s*<html)")), "html")
