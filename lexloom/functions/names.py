"""NYSIIS name codes, strict: at most six letters."""

from __future__ import annotations

import re

_HEADS = (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
_TAILS = (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D"))


def nysiis(text: str, length: int = 6) -> str:
    name = re.sub("[^A-Z]", "", text.upper())
    if not name:
        return ""
    for old, new in _HEADS:
        if name.startswith(old):
            name = new + name[len(old) :]
            break
    for old, new in _TAILS:
        if name.endswith(old):
            name = name[: -len(old)] + new
            break
    letters, code = list(name), name[0]
    for i in range(1, len(letters)):
        c, before, after = letters[i], letters[i - 1], letters[i + 1] if i + 1 < len(letters) else ""
        if c == "E" and after == "V":
            letters[i : i + 2] = "AF"
        elif c in "AEIOU":
            letters[i] = "A"
        elif c in "QZM":
            letters[i] = {"Q": "G", "Z": "S", "M": "N"}[c]
        elif c == "K":
            letters[i] = "N" if after == "N" else "C"
        elif c == "S" and letters[i + 1 : i + 3] == ["C", "H"]:
            letters[i : i + 3] = "SSS"
        elif c == "P" and after == "H":
            letters[i : i + 2] = "FF"
        elif c == "H" and (before not in "AEIOU" or after not in "AEIOU" or not after):
            letters[i] = before
        elif c == "W" and before in "AEIOU":
            letters[i] = before
        if letters[i] != letters[i - 1]:
            code += letters[i]
    if len(code) > 1 and code.endswith("S"):
        code = code[:-1]
    if len(code) > 2 and code.endswith("AY"):
        code = code[:-2] + "Y"
    if len(code) > 1 and code.endswith("A"):
        code = code[:-1]
    return code[:length]
