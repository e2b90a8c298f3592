"""JSON from what models write: quotes of any kind or none, missing commas and ends, trailing commas, comments, fences."""

from __future__ import annotations

import json
import re
from typing import Any

from lexloom.functions.plain import strip_code_fences

_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_BLANK = re.compile(r"(?:\s|//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_BARE = re.compile(r"[^,\]}\n]*")
_BARE_KEY = re.compile(r"[^:,\]}\s]*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Levels of nesting at most: beyond, there is no value to repair.
MAX_DEPTH = 200


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.actions, self.depth = text, 0, [], 0

    def note(self, action: str, **more: Any) -> None:
        self.actions.append({"action": action, "at": self.at, **more})

    def peek(self) -> str:
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self) -> Any:
        c = self.peek()
        if c and c in "{[":
            if self.depth >= MAX_DEPTH:
                raise ValueError("too deep")
            self.depth += 1
            out = self.members() if c == "{" else self.items()
            self.depth -= 1
            return out
        return self.string() if c in _QUOTES else self.bare()

    def string(self, key: bool = False) -> str:
        opened = self.text[self.at]
        closing, out = _QUOTES[opened], []
        if opened != '"':
            self.note("quote_replaced")
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                e = self.text[self.at + 1]
                if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6]):
                    out.append(chr(int(self.text[self.at + 2 : self.at + 6], 16)))
                    self.at += 6
                    continue
                out.append(_ESCAPES.get(e, e))
                self.at += 2
            elif c == closing and self.ends(key):
                self.at += 1
                return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            else:
                out.append(c)
                self.at += 1
        self.note("string_closed")
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def ends(self, key: bool) -> bool:
        """A quote closes a string before a separator, a bracket, another quote, a line end or the end of all."""
        rest = self.text[self.at + 1 : self.at + 65]
        after = rest.lstrip(" \t\r")
        return not after or after[0] in (":" if key else ",}]\n") or after[0] in "/#:" or (rest != after and after[0] in _QUOTES)

    def bare(self) -> Any:
        m = _NUMBER.match(self.text, self.at)
        if m and (m.end() == len(self.text) or self.text[m.end()] in ",]}: \t\r\n"):
            self.at = m.end()
            try:
                return json.loads(m[0])
            except ValueError:
                self.note("number_fixed")
                return float(m[0])
        word = _BARE.match(self.text, self.at)[0]
        self.at += len(word)
        word = word.strip()
        if word not in ("true", "false", "null"):
            self.note("word_read", value=word)
        return _WORDS.get(word.lower(), word)

    def members(self) -> dict:
        out: dict[str, Any] = {}
        self.at += 1
        while True:
            c = self.peek()
            if not c or c == "}":
                self.at += bool(c)
                if not c:
                    self.note("object_closed")
                return out
            if c == "]":
                self.note("object_closed")
                return out
            if c == ",":
                self.at += 1
                continue
            start = self.at
            if c in _QUOTES:
                key = self.string(True)
            else:
                key = _BARE_KEY.match(self.text, self.at)[0]
                self.at += len(key)
                self.note("key_quoted", value=key)
            if self.peek() == ":":
                self.at += 1
                out[key] = "" if self.peek() in (",", "}", "") else self.value()
            elif self.at == start:
                self.at += 1
            else:
                out[key] = ""
                self.note("value_missing", value=key)
            if self.peek() and self.text[self.at] not in ",}]":
                self.note("comma_added")

    def items(self) -> list:
        out: list[Any] = []
        self.at += 1
        while True:
            c = self.peek()
            if not c or c == "]":
                self.at += bool(c)
                if not c:
                    self.note("array_closed")
                return out
            if c == "}":
                self.note("array_closed")
                return out
            if c == ",":
                self.at += 1
                continue
            out.append(self.value())
            if self.peek() and self.text[self.at] not in ",}]":
                self.note("comma_added")


def repair_json_diagnostics(text: str, skip_json_loads: bool = False) -> tuple[Any, list[dict]]:
    """(the value, what was mended); "" where no value is found, or one nested deeper than MAX_DEPTH."""
    text = strip_code_fences(text)
    if not skip_json_loads:
        try:
            return json.loads(text), []
        except (ValueError, RecursionError):
            pass
    reader = _Reader(text)
    first = re.search(r"[{\[]", text)
    if first:
        if text[: first.start()].strip():
            reader.note("prose_skipped")
        reader.at = first.start()
        try:
            out = reader.value()
        except (ValueError, RecursionError):
            return "", [{"action": "too_deep", "at": reader.at}]
    elif reader.peek() in _QUOTES and reader.peek():
        out = reader.string()
    else:
        out = reader.bare() if reader.peek() else ""
        if isinstance(out, str):
            out = ""
    if reader.peek():
        reader.note("rest_dropped")
    return out, reader.actions


def repair_json_loads(text: str, skip_json_loads: bool = False) -> Any:
    return repair_json_diagnostics(text, skip_json_loads)[0]


def repair_json(text: str, skip_json_loads: bool = False, ensure_ascii: bool = True) -> str:
    value = repair_json_loads(text, skip_json_loads)
    try:
        return "" if value == "" else json.dumps(value, ensure_ascii=ensure_ascii)
    except RecursionError:
        return ""


class JsonRepairer:
    """Chunks in, the repaired value of all so far out."""

    def __init__(self, **options: Any) -> None:
        self.options = options
        self.reset()

    def reset(self) -> None:
        self.chunks: list[str] = []
        self.done = False

    def push(self, chunk: str) -> None:
        if self.done:
            raise ValueError("pushed after the end")
        self.chunks.append(chunk)

    def snapshot(self) -> str:
        return repair_json("".join(self.chunks), **self.options)

    def end(self) -> str:
        self.done = True
        return self.snapshot()
