"""DOCX, XLSX, PPTX, ODT, ODS, ODP, EPUB, RTF and CSV as Markdown or plain text.

Each reader gives blocks, ("h", level, runs), ("p", runs), ("li", depth, number or None, runs) or ("table", rows of cells),
which one writer renders. Runs are (text, bold, italic, link). Whatever can't be read raises ValueError.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

from lexloom.functions.markup import html_to_markdown, html_to_text

FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "rtf", "csv", "html")
#: Inflated bytes that one package may have.
MOST_INFLATED = 512 << 20
#: Cells that a sheet's repeat counts may add to a row.
MOST_REPEATS = 16_384


def _name(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _get(e, key: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == key), default)


def _child(e, *names: str):
    for n in names:
        e = next((c for c in e if _name(c) == n), None) if e is not None else None
    return e


class _Package:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.left = MOST_INFLATED

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as f:
            data = f.read(self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise ValueError("the package inflates to too many bytes")
        return data

    def xml(self, name: str):
        data = self.read(name)
        if b"<!ENTITY" in data:
            raise ValueError("a part declares entities")
        return ElementTree.fromstring(data)

    def links(self, part: str) -> dict[str, str]:
        """Relation id -> target; those inside the package as its member."""
        folder, _, file = part.rpartition("/")
        rels = f"{folder}/_rels/{file}.rels".lstrip("/")
        if rels not in self.names:
            return {}
        place = lambda r: r.get("Target", "") if r.get("TargetMode") == "External" else posixpath.normpath(posixpath.join("/", folder, r.get("Target", "")))[1:]
        return {r.get("Id"): place(r) for r in self.xml(rels)}


# --- Office Open XML
def _on(properties, name: str) -> bool:
    e = _child(properties, name) if properties is not None else None
    return e is not None and _get(e, "val", "1") not in ("0", "false", "none")


def _ooxml_runs(p, links: dict[str, str]) -> list:
    runs, todo = [], [(c, None) for c in reversed(p)]
    while todo:
        e, link = todo.pop()
        kind = _name(e)
        if kind in ("r", "fld"):
            props = _child(e, "rPr")
            click = _child(props, "hlinkClick") if props is not None else None
            here = links.get(_get(click, "id")) if click is not None else link
            bold = _on(props, "b") or (props is not None and props.get("b") == "1")
            italic = _on(props, "i") or (props is not None and props.get("i") == "1")
            text = "".join({"t": c.text or "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}.get(_name(c), "") for c in e)
            runs.append((text, bold, italic, here))
        elif kind == "br":
            runs.append(("\n", False, False, None))
        elif kind not in ("del", "moveFrom", "Fallback", "pPr"):
            here = links.get(_get(e, "id")) if kind == "hyperlink" else link
            todo += [(c, here) for c in reversed(e)]
    return runs


def _flat(blocks) -> list:
    """All runs of some paragraphs, a space between them."""
    out = []
    for b in blocks:
        out += [(" ", False, False, None)] * bool(out) + b
    return out


def _docx(z: _Package) -> Iterator[tuple]:
    part = "word/document.xml"
    links = z.links(part)
    heads, kinds, counts = {}, {}, {}
    if "word/styles.xml" in z.names:
        for s in z.xml("word/styles.xml"):
            named = _child(s, "name") if _name(s) == "style" else None
            found = re.fullmatch(r"heading ([1-6])", (_get(named, "val", "") if named is not None else "").lower())
            if found:
                heads[_get(s, "styleId")] = int(found[1])
    if "word/numbering.xml" in z.names:
        tree = z.xml("word/numbering.xml")
        shapes = {_get(a, "abstractNumId"): {_get(v, "ilvl"): _get(_child(v, "numFmt"), "val") for v in a if _name(v) == "lvl" and _child(v, "numFmt") is not None} for a in tree if _name(a) == "abstractNum"}
        kinds = {_get(n, "numId"): shapes.get(_get(_child(n, "abstractNumId"), "val"), {}) for n in tree if _name(n) == "num"}
    todo = list(reversed(_child(z.xml(part), "body")))
    while todo:
        e = todo.pop()
        if _name(e) == "tbl":
            rows = [[_flat(_ooxml_runs(p, links) for p in cell.iter() if _name(p) == "p") for cell in row if _name(cell) == "tc"] for row in e if _name(row) == "tr"]
            yield "table", rows
        elif _name(e) == "p":
            style, number = _child(e, "pPr", "pStyle"), _child(e, "pPr", "numPr")
            runs = _ooxml_runs(e, links)
            level = heads.get(_get(style, "val")) if style is not None else None
            if level:
                yield "h", level, [(t, False, False, a) for t, _, _, a in runs]
            elif number is not None and _child(number, "numId") is not None and _get(_child(number, "numId"), "val") != "0":
                num, depth = _get(_child(number, "numId"), "val"), _child(number, "ilvl")
                depth = int(_get(depth, "val", "0")) if depth is not None else 0
                if kinds.get(num, {}).get(str(depth), "bullet") == "bullet":
                    yield "li", depth, None, runs
                else:
                    counts[num, depth] = counts.get((num, depth), 0) + 1
                    for deeper in [k for k in counts if k[0] == num and k[1] > depth]:
                        del counts[deeper]
                    yield "li", depth, counts[num, depth], runs
            else:
                yield "p", runs
        elif _name(e) in ("sdt", "sdtContent", "ins", "customXml"):
            todo += reversed(e)


def _plain_run(text: str) -> list:
    return [(text, False, False, None)]


def _xlsx(z: _Package) -> Iterator[tuple]:
    book = "xl/workbook.xml"
    links, shared = z.links(book), []
    if "xl/sharedStrings.xml" in z.names:
        shared = ["".join(t.text or "" for r in s if _name(r) in ("t", "r") for t in r.iter() if _name(t) == "t") for s in z.xml("xl/sharedStrings.xml")]
    for sheet in _child(z.xml(book), "sheets"):
        part = links.get(_get(sheet, "id"))
        if part not in z.names:
            continue
        rows = []
        for row in (r for r in z.xml(part).iter() if _name(r) == "row"):
            cells = []
            for c in (c for c in row if _name(c) == "c"):
                letters = re.match(r"[A-Z]{1,3}", c.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for x in letters[0]:
                        at = at * 26 + ord(x) - 64
                    at -= 1
                cells += [[]] * (at - len(cells))
                value, kind = _child(c, "v"), c.get("t")
                text = (value.text or "") if value is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if _name(t) == "t")
                elif kind == "b":
                    text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
                cells.append(_plain_run(text))
            rows.append(cells)
        yield "h", 2, _plain_run(sheet.get("name", ""))
        yield "table", rows


def _pptx(z: _Package) -> Iterator[tuple]:
    show = "ppt/presentation.xml"
    links = z.links(show)
    slides = _child(z.xml(show), "sldIdLst")
    for slide in () if slides is None else slides:
        # an id of the presentation's own stands beside the relation's
        part = next((links[v] for k, v in slide.attrib.items() if k.endswith("}id") and v in links), None)
        if part not in z.names:
            continue
        inner, todo = z.links(part), [z.xml(part)]
        while todo:
            e = todo.pop()
            if _name(e) == "tbl":
                yield "table", [[_flat(_ooxml_runs(p, inner) for p in cell.iter() if _name(p) == "p") for cell in row if _name(cell) == "tc"] for row in e if _name(row) == "tr"]
            elif _name(e) == "sp":
                holder = _child(e, "nvSpPr", "nvPr", "ph")
                title = holder is not None and holder.get("type") in ("title", "ctrTitle")
                for p in (p for p in e.iter() if _name(p) == "p"):
                    runs = _ooxml_runs(p, inner)
                    yield ("h", 1, runs) if title else ("p", runs)
            elif _name(e) != "Fallback":
                todo += reversed(e)


# --- OpenDocument
def _odf_runs(p) -> list:
    """Text with its links; notes and comments stay out."""
    runs, todo = [], [("in", p, None)]
    while todo:
        kind, e, link = todo.pop()
        if kind == "text":
            runs.append((e, False, False, link))
            continue
        name = _name(e)
        if name in ("note", "annotation", "table", "tracked-changes"):
            continue
        if name in ("s", "tab", "line-break"):
            runs.append((" " * min(int(_get(e, "c", "1")), 1000) if name == "s" else "\t" if name == "tab" else "\n", False, False, link))
        here = _get(e, "href") if name == "a" else link
        for c in reversed(e):
            if c.tail:
                todo.append(("text", re.sub(r"\s+", " ", c.tail), here))
            todo.append(("in", c, here))
        if e.text:
            todo.append(("text", re.sub(r"\s+", " ", e.text), here))
    return runs


def _odf(z: _Package) -> Iterator[tuple]:
    body = _child(z.xml("content.xml"), "body")
    todo = [(c, -1) for c in reversed(body)]
    while todo:
        e, depth = todo.pop()
        name = _name(e)
        if name == "h":
            yield "h", min(6, max(1, int(_get(e, "outline-level", "1")))), _odf_runs(e)
        elif name == "p":
            yield ("p", _odf_runs(e)) if depth < 0 else ("li", depth, None, _odf_runs(e))
        elif name == "table":
            if _get(e, "name") and _child(body, "spreadsheet") is not None:
                yield "h", 2, _plain_run(_get(e, "name"))
            rows = []
            for row in (r for r in e.iter() if _name(r) == "table-row"):
                cells = []
                for cell in (c for c in row if _name(c) in ("table-cell", "covered-table-cell")):
                    runs = _flat(_odf_runs(p) for p in cell.iter() if _name(p) in ("p", "h"))
                    cells += [runs] * min(int(_get(cell, "number-columns-repeated", "1")), MOST_REPEATS if runs else 1)
                times = min(int(_get(row, "number-rows-repeated", "1")), MOST_REPEATS if any(cells) else 1)
                rows += [cells] * times
            yield "table", rows
        elif name not in ("tracked-changes", "forms", "sequence-decls", "notes"):
            todo += [(c, depth + (name == "list")) for c in reversed(e)]


def _epub(z: _Package, plain: bool) -> str:
    root = next(e for e in z.xml("META-INF/container.xml").iter() if _name(e) == "rootfile").get("full-path")
    book, folder = z.xml(root), posixpath.dirname(root)
    items = {i.get("id"): posixpath.normpath(posixpath.join(folder, unquote(i.get("href", "")))) for i in _child(book, "manifest")}
    parts = [items.get(i.get("idref")) for i in _child(book, "spine") if i.get("linear") != "no"]
    write = html_to_text if plain else html_to_markdown
    pages = (write(z.read(p).decode("utf-8", "replace")) for p in parts if p in z.names)
    return "\n\n".join(t for t in pages if t)


# --- RTF
_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Destinations whose text is not the document's.
_RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "footnote", "annotation", "fldinst", "listtable", "listoverridetable", "generator", "themedata", "datastore", "xmlnstbl", "rsidtbl", "pntext"}
_RTF_TEXT = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "cell": "\t", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def _rtf(data: bytes) -> Iterator[tuple]:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("not RTF")
    out, state, stack, coded, page = [], (False, 1), [], bytearray(), "cp1252"
    at = skip = 0
    while found := _RTF.match(data, at):
        at = found.end()
        byte, word, number, symbol, brace, text = found.groups()
        hidden, after = state
        if coded and byte is None:
            out.append(coded.decode(page, "replace"))
            coded.clear()
        if byte is not None:
            if skip:
                skip -= 1
            elif not hidden:
                coded.append(int(byte, 16))
        elif brace == b"{":
            stack.append(state)
            skip = 0
        elif brace == b"}":
            if not stack:
                break
            state, skip = stack.pop(), 0
        elif word is not None:
            word = word.decode()
            if word in _RTF_HIDDEN:
                state = (True, after)
            elif word == "bin":
                at += max(0, int(number or 0))
            elif word == "uc":
                state = (hidden, int(number or 1))
            elif word == "ansicpg":
                page = f"cp{number.decode() if number else '1252'}"
                try:
                    "".encode(page)
                except LookupError:
                    page = "cp1252"
            elif word == "u" and number and not hidden:
                out.append(chr(int(number) % 65536))
                skip = after
            elif not hidden:
                out.append(_RTF_TEXT.get(word, ""))
        elif symbol is not None:
            if symbol == b"*":
                state = (True, after)
            elif not hidden:
                out.append({b"~": " ", b"_": "‑", b"-": "", b"\n": "\n", b"\r": "\n"}.get(symbol, symbol.decode("latin-1")))
        elif text:
            seen, skip = text[skip:], max(0, skip - len(text))
            if not hidden:
                out.append(seen.decode(page, "replace"))
    if coded:
        out.append(coded.decode(page, "replace"))
    # surrogate halves that \u gives one by one become their character
    whole = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    for line in whole.split("\n"):
        yield "p", _plain_run(line)


def _csv(data: bytes) -> Iterator[tuple]:
    text = data.decode("utf-8-sig", "replace")
    first = text.partition("\n")[0]
    by = max(",\t;|", key=first.count)
    csv.field_size_limit(MOST_INFLATED)
    yield "table", [[_plain_run(c) for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=by) if row]


# --- writing
def _inline(runs: list, plain: bool) -> str:
    out, k = [], 0
    while k < len(runs):
        j = k
        while j < len(runs) and runs[j][1:] == runs[k][1:]:
            j += 1
        text = "".join(r[0] for r in runs[k:j])
        core = text.strip()
        _, bold, italic, link = runs[k]
        k = j
        if core:
            shown = core
            if not plain:
                mark = "**" * bold + "*" * italic
                shown = mark + core + mark[::-1]
            if link:
                shown = f"{shown} ({link})" if plain else f"[{shown}]({link})"
            text = text.replace(core, shown, 1)
        out.append(text)
    return "".join(out).strip()


def _cell(runs: list, plain: bool) -> str:
    text = " ".join(_inline(runs, plain).split())
    return text if plain else text.replace("|", "\\|")


def render(blocks, plain: bool) -> str:
    out, last = [], None
    for kind, *what in blocks:
        if kind == "table":
            rows = [[_cell(c, plain) for c in row] for row in what[0]]
            rows = [r for r in rows if any(r)]
            wide = max(map(len, rows), default=0)
            rows = [r + [""] * (wide - len(r)) for r in rows]
            lines = [" | ".join(r) if plain else "| " + " | ".join(r) + " |" for r in rows]
            if lines and not plain:
                lines.insert(1, "| " + " | ".join(["---"] * wide) + " |")
            text = "\n".join(lines)
        else:
            text = _inline(what[-1], plain)
            if kind == "h" and text and not plain:
                text = "#" * what[0] + " " + " ".join(text.split())
            elif kind == "li" and text:
                text = "  " * what[0] + ("- " if what[1] is None else f"{what[1]}. ") + text
        if text:
            out.append(("" if not out else "\n" if kind == last == "li" else "\n\n") + text)
            last = kind
    return "".join(out)


_READERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "odt": _odf, "ods": _odf, "odp": _odf}


def _converted(data: bytes, kind: str, plain: bool) -> str:
    try:
        if kind in _READERS:
            return render(_READERS[kind](_Package(data)), plain)
        if kind == "epub":
            return _epub(_Package(data), plain)
        if kind == "rtf":
            return render(_rtf(data), plain)
        if kind in ("csv", "tsv"):
            return render(_csv(data), plain)
        if kind == "html":
            return (html_to_text if plain else html_to_markdown)(data.decode("utf-8", "replace"))
    except ValueError:
        raise
    except Exception as e:  # a part that is missing, cut off or not what it should be
        raise ValueError(f"unreadable {kind}: {e}") from e
    raise ValueError(f"no reader for {kind}")


def to_markdown(data: bytes, kind: str) -> str:
    return _converted(bytes(data), kind, False)


def to_text(data: bytes, kind: str) -> str:
    return _converted(bytes(data), kind, True)


def converted(data: bytes, kind: str, plain: bool = False) -> dict:
    """For columns: value, or what went wrong."""
    try:
        return {"value": _converted(bytes(data), kind, plain), "error": None}
    except ValueError as e:
        return {"value": None, "error": str(e)}
