"""English stems (the published Porter2 rules), and lemmas from a dictionary."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Words with their own stems, words that step 1a leaves as they are, suffixes of steps 2 to 4.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LONGEST2, _LONGEST3 = (sorted(x, key=len, reverse=True) for x in ([*_STEP2, "ogi", "li"], [*_STEP3, "ative"]))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_LONGEST4 = sorted([*_STEP4, "ion"], key=len, reverse=True)


def _region(word: str, start: int = 0) -> int:
    """Where what follows the first non-vowel after a vowel begins."""
    m = re.search(r"[aeiouy][^aeiouy]", word[start:])
    return start + m.end() if m else len(word)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem_english(word: str) -> str:
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) <= 2 or not w.isascii():
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    m = re.search(r"(eedly|eed)$", w)
    if m:
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if w[-1:] in ("y", "Y") and len(w) > 2 and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    found = next((s for s in _LONGEST2 if w.endswith(s)), None)
    if found and len(w) - len(found) >= r1:
        left = w[: -len(found)]
        if found == "ogi":
            w = left + "og" if left.endswith("l") else w
        elif found == "li":
            w = left if left[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = left + _STEP2[found]
    found = next((s for s in _LONGEST3 if w.endswith(s)), None)
    if found and len(w) - len(found) >= r1:
        if found != "ative":
            w = w[: -len(found)] + _STEP3[found]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    found = next((s for s in _LONGEST4 if w.endswith(s)), None)
    if found and len(w) - len(found) >= r2 and (found != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(found)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Stems of short words are kept, as texts share most of them.
_kept_stem = lru_cache(maxsize=1 << 16)(stem_english)


def apply_terms(text: str, stemmer: str | None = None, lemmas: dict[str, str] | None = None) -> str:
    """Each word (runs of letters, digits and apostrophes) in its dictionary form or stem; all else as it is."""
    if stemmer not in (None, "english"):
        raise ValueError("known stemmers: english")

    def new(m: re.Match) -> str:
        w = (lemmas or {}).get(m[0], m[0])
        return (_kept_stem if len(w) <= 64 else stem_english)(w) if stemmer and w == m[0] else w

    return re.sub(r"[^\W_]+(?:['’][^\W_]+)*", new, text)
