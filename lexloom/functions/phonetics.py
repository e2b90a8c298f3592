"""Double Metaphone (Philips 2000) and Daitch-Mokotoff Soundex. Only ASCII letters count."""

from __future__ import annotations

import re

_LETTERS = re.compile("[^A-Z]")
VOWELS = "AEIOUY"

#: The published Daitch-Mokotoff rules, letters: code at the start, before a vowel, elsewhere; | parts branches.
DAITCH_MOKOTOFF_RULES = """
ai 0 1 -
aj 0 1 -
ay 0 1 -
au 0 7 -
a 0 - -
b 7 7 7
chs 5 54 54
ch 4|5 4|5 4|5
ck 5|45 5|45 5|45
csz 4 4 4
czs 4 4 4
cs 4 4 4
cz 4 4 4
c 4|5 4|5 4|5
drz 4 4 4
drs 4 4 4
dsh 4 4 4
dsz 4 4 4
dzh 4 4 4
dzs 4 4 4
ds 4 4 4
dz 4 4 4
dt 3 3 3
d 3 3 3
ei 0 1 -
ej 0 1 -
ey 0 1 -
eu 1 1 -
e 0 - -
fb 7 7 7
f 7 7 7
g 5 5 5
h 5 5 -
ia 1 - -
ie 1 - -
io 1 - -
iu 1 - -
i 0 - -
j 1|4 -|4 -|4
ks 5 54 54
kh 5 5 5
k 5 5 5
l 8 8 8
mn 66 66 66
m 6 6 6
nm 66 66 66
n 6 6 6
oi 0 1 -
oj 0 1 -
oy 0 1 -
o 0 - -
pf 7 7 7
ph 7 7 7
p 7 7 7
q 5 5 5
rs 4|94 4|94 4|94
rz 4|94 4|94 4|94
r 9 9 9
schtsch 2 4 4
schtsh 2 4 4
schtch 2 4 4
scht 2 43 43
schd 2 43 43
sch 4 4 4
shtch 2 4 4
shtsh 2 4 4
shch 2 4 4
sht 2 43 43
shd 2 43 43
sh 4 4 4
stch 2 4 4
stsch 2 4 4
strz 2 4 4
strs 2 4 4
stsh 2 4 4
st 2 43 43
szcz 2 4 4
szcs 2 4 4
szt 2 43 43
szd 2 43 43
sc 2 4 4
sd 2 43 43
sz 4 4 4
s 4 4 4
tch 4 4 4
ttch 4 4 4
ttsch 4 4 4
th 3 3 3
trz 4 4 4
trs 4 4 4
tsch 4 4 4
tsh 4 4 4
tsz 4 4 4
ts 4 4 4
ttsz 4 4 4
tts 4 4 4
tc 4 4 4
ttz 4 4 4
tzs 4 4 4
tz 4 4 4
t 3 3 3
ui 0 1 -
uj 0 1 -
uy 0 1 -
ue 0 1 -
u 0 - -
v 7 7 7
w 7 7 7
x 5 54 54
y 1 - -
zdzh 2 4 4
zdz 2 4 4
zhdzh 2 4 4
zhd 2 43 43
zd 2 43 43
zsch 4 4 4
zsh 4 4 4
zh 4 4 4
zs 4 4 4
z 4 4 4
"""
_RULES = {p: [[c.replace("-", "") for c in codes.split("|")] for codes in rest] for p, *rest in (r.split() for r in DAITCH_MOKOTOFF_RULES.strip().split("\n"))}
_PATTERN = re.compile("|".join(sorted(_RULES, key=len, reverse=True)))


def daitch_mokotoff(text: str) -> list[str]:
    """All codes of six digits, the branches in the order of the rules; a code repeated by the next letters counts once."""
    name = _LETTERS.sub("", text.upper()).lower()
    found: dict[tuple[str, str], None] = {("", ""): None}  # code so far, the last rule's digits
    for m in _PATTERN.finditer(name):
        at = 0 if m.start() == 0 else 1 if name[m.end() : m.end() + 1] in tuple("aeiou") else 2
        # M beside N sounds anew
        anew = m.start() > 0 and name[m.start() - 1] + m[0][0] in ("mn", "nm")
        following: dict[tuple[str, str], None] = {}
        for code, last in found:
            for digits in dict.fromkeys(_RULES[m[0]][at]):
                longer = code if digits and last.endswith(digits) and not anew else code + digits
                following[longer[:6], digits] = None
        found = following
    return list(dict.fromkeys((code + "000000")[:6] for code, _ in found))


class _Word:
    """A name read from left to right, with both of its codes."""

    def __init__(self, word: str):
        self.word, self.at, self.codes = word, 0, ["", ""]
        self.slavic = bool(re.search("W|K|CZ|WITZ", word))

    def is_(self, start: int, *parts: str) -> bool:
        """Whether one of the parts stands `start` letters from here."""
        return self.at + start >= 0 and any(self.word.startswith(p, self.at + start) for p in parts)

    def vowel(self, start: int) -> bool:
        i = self.at + start
        return 0 <= i < len(self.word) and self.word[i] in VOWELS

    def letter(self, start: int) -> str:
        i = self.at + start
        return self.word[i] if 0 <= i < len(self.word) else ""

    def add(self, first: str, step: int, second: str | None = None) -> None:
        self.codes[0] += first
        self.codes[1] += first if second is None else second
        self.at += step

    def end(self, start: int = 0) -> bool:
        return self.at + start >= len(self.word) - 1

    def germanic(self) -> bool:
        return self.word.startswith(("VAN ", "VON ", "SCH"))


def _c(w: _Word) -> None:
    if w.at > 1 and not w.vowel(-2) and w.is_(-1, "ACH") and w.letter(2) != "I" and (w.letter(2) != "E" or w.is_(-2, "BACHER", "MACHER")):
        w.add("K", 2)
    elif w.at == 0 and w.is_(0, "CAESAR"):
        w.add("S", 2)
    elif w.is_(0, "CH"):
        if w.at > 0 and w.is_(0, "CHAE"):
            w.add("K", 2, "X")
        elif w.at == 0 and (w.is_(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM")) and not w.is_(0, "CHORE"):
            w.add("K", 2)
        elif w.germanic() or w.is_(-2, "ORCHES", "ARCHIT", "ORCHID") or w.letter(2) in ("T", "S") or ((w.letter(-1) in tuple("AOUE") or w.at == 0) and (w.letter(2) in tuple("LRNMBHFVW") or w.end(1))):
            w.add("K", 2)
        elif w.at > 0:
            w.add("K", 2) if w.word.startswith("MC") else w.add("X", 2, "K")
        else:
            w.add("X", 2)
    elif w.is_(0, "CZ") and not w.is_(-2, "WICZ"):
        w.add("S", 2, "X")
    elif w.is_(1, "CIA"):
        w.add("X", 3)
    elif w.is_(0, "CC") and not (w.at == 1 and w.word[0] == "M"):
        if w.letter(2) in tuple("IEH") and not w.is_(2, "HU"):
            w.add("KS", 3) if (w.at == 1 and w.letter(-1) == "A") or w.is_(-1, "UCCEE", "UCCES") else w.add("X", 3)
        else:
            w.add("K", 2)
    elif w.is_(0, "CK", "CG", "CQ"):
        w.add("K", 2)
    elif w.is_(0, "CI", "CE", "CY"):
        w.add("S", 2, "X") if w.is_(0, "CIO", "CIE", "CIA") else w.add("S", 2)
    else:
        w.add("K", 2 if w.letter(1) in ("C", "K", "Q") and not w.is_(1, "CE", "CI") else 1)


def _g(w: _Word) -> None:
    if w.letter(1) == "H":
        if w.at > 0 and not w.vowel(-1):
            w.add("K", 2)
        elif w.at == 0:
            w.add("J" if w.letter(2) == "I" else "K", 2)
        elif w.letter(-2) in ("B", "H", "D") and w.at > 1 or w.letter(-3) in ("B", "H", "D") and w.at > 2 or w.letter(-4) in ("B", "H") and w.at > 3:
            w.at += 2
        elif w.at > 2 and w.letter(-1) == "U" and w.letter(-3) in tuple("CGLRT"):
            w.add("F", 2)
        else:
            w.add("K" if w.at > 0 and w.letter(-1) != "I" else "", 2)
    elif w.letter(1) == "N":
        if w.at == 1 and w.vowel(-1) and not w.slavic:
            w.add("KN", 2, "N")
        elif not w.is_(2, "EY") and w.letter(1) != "Y" and not w.slavic:
            w.add("N", 2, "KN")
        else:
            w.add("KN", 2)
    elif w.is_(1, "LI") and not w.slavic:
        w.add("KL", 2, "L")
    elif w.at == 0 and (w.letter(1) == "Y" or w.is_(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        w.add("K", 2, "J")
    elif (w.is_(1, "ER") or w.letter(1) == "Y") and not w.word.startswith(("DANGER", "RANGER", "MANGER")) and w.letter(-1) not in ("E", "I") and not w.is_(-1, "RGY", "OGY"):
        w.add("K", 2, "J")
    elif w.letter(1) in ("E", "I", "Y") or w.is_(-1, "AGGI", "OGGI"):
        if w.germanic() or w.is_(1, "ET"):
            w.add("K", 2)
        elif w.is_(1, "IER"):
            w.add("J", 2)
        else:
            w.add("J", 2, "K")
    else:
        w.add("K", 2 if w.letter(1) == "G" else 1)


def _j(w: _Word) -> None:
    if w.is_(0, "JOSE"):
        w.add(*(("H", 1) if w.at == 0 and len(w.word) == 4 else ("J", 1, "H")))
        return
    step = 2 if w.letter(1) == "J" else 1
    if w.at == 0:
        w.add("J", step, "A")
    elif w.vowel(-1) and not w.slavic and w.letter(1) in ("A", "O"):
        w.add("J", step, "H")
    elif w.end():
        w.add("J", step, "")
    else:
        w.add("J" if w.letter(1) not in tuple("LTKSNMBZ") and w.letter(-1) not in ("S", "K", "L") else "", step)


def _l(w: _Word) -> None:
    if w.letter(1) != "L":
        w.add("L", 1)
        return
    spanish = (w.at == len(w.word) - 3 and w.is_(-1, "ILLO", "ILLA", "ALLE")) or ((w.word.endswith(("AS", "OS")) or w.word[-1] in "AO") and w.is_(-1, "ALLE"))
    w.add("L", 2, "" if spanish else None)


def _s(w: _Word) -> None:
    if w.is_(-1, "ISL", "YSL"):
        w.at += 1
    elif w.at == 0 and w.is_(0, "SUGAR"):
        w.add("X", 1, "S")
    elif w.is_(0, "SH"):
        w.add("S" if w.is_(1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X", 2)
    elif w.is_(0, "SIO", "SIA", "SIAN"):
        w.add("S", 3, None if w.slavic else "X")
    elif (w.at == 0 and w.letter(1) in ("M", "N", "L", "W")) or w.letter(1) == "Z":
        w.add("S", 2 if w.letter(1) == "Z" else 1, "X")
    elif w.is_(0, "SC"):
        if w.letter(2) == "H":
            if w.is_(3, "OO", "ER", "EN", "UY", "ED", "EM"):
                w.add(*(("X", 3, "SK") if w.is_(3, "ER", "EN") else ("SK", 3)))
            else:
                w.add("X", 3, "S" if w.at == 0 and len(w.word) > 3 and w.word[3] not in VOWELS and w.word[3] != "W" else None)
        else:
            w.add("S" if w.letter(2) in ("I", "E", "Y") else "SK", 3)
    else:
        w.add("" if w.end() and w.is_(-2, "AI", "OI") else "S", 2 if w.letter(1) in ("S", "Z") else 1, "S")


def _t(w: _Word) -> None:
    if w.is_(0, "TION", "TIA", "TCH"):
        w.add("X", 3)
    elif w.is_(0, "TH", "TTH"):
        w.add(*(("T", 2) if w.is_(2, "OM", "AM") or w.germanic() else ("0", 2, "T")))
    else:
        w.add("T", 2 if w.letter(1) in ("T", "D") else 1)


def _w(w: _Word) -> None:
    if w.is_(0, "WR"):
        w.add("R", 2)
    elif w.at == 0 and (w.vowel(1) or w.is_(0, "WH")):
        w.add("A", 1, "F" if w.vowel(1) else "A")
    elif (w.end() and w.vowel(-1)) or w.is_(-1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.word.startswith("SCH"):
        w.add("", 1, "F")
    elif w.is_(0, "WICZ", "WITZ"):
        w.add("TS", 4, "FX")
    else:
        w.at += 1


def _h(w: _Word) -> None:
    w.add(*(("H", 2) if (w.at == 0 or w.vowel(-1)) and w.vowel(1) else ("", 1)))


def _d(w: _Word) -> None:
    if w.is_(0, "DG"):
        w.add(*(("J", 3) if w.letter(2) in ("I", "E", "Y") else ("TK", 2)))
    else:
        w.add("T", 2 if w.is_(0, "DT", "DD") else 1)


def _m(w: _Word) -> None:
    w.add("M", 2 if w.letter(1) == "M" or (w.is_(-1, "UMB") and (w.end(1) or w.is_(2, "ER"))) else 1)


def _p(w: _Word) -> None:
    w.add(*(("F", 2) if w.letter(1) == "H" else ("P", 2 if w.letter(1) in ("P", "B") else 1)))


def _r(w: _Word) -> None:
    mute = w.end() and not w.slavic and w.is_(-2, "IE") and not w.is_(-4, "ME", "MA")
    w.add("" if mute else "R", 2 if w.letter(1) == "R" else 1, "R")


def _x(w: _Word) -> None:
    if w.at == 0:
        w.add("S", 1)
    else:
        mute = w.end() and (w.is_(-3, "IAU", "EAU") or w.is_(-2, "AU", "OU"))
        w.add("" if mute else "KS", 2 if w.letter(1) in ("C", "X") else 1)


def _z(w: _Word) -> None:
    if w.letter(1) == "H":
        w.add("J", 2)
    else:
        other = w.is_(1, "ZO", "ZI", "ZA") or (w.slavic and w.at > 0 and w.letter(-1) != "T")
        w.add("S", 2 if w.letter(1) == "Z" else 1, "TS" if other else None)


_SOUNDS = {"C": _c, "D": _d, "G": _g, "H": _h, "J": _j, "L": _l, "M": _m, "P": _p, "R": _r, "S": _s, "T": _t, "W": _w, "X": _x, "Z": _z}
_PLAIN = {"B": "P", "F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}


def double_metaphone(text: str, length: int = 4) -> tuple[str, str]:
    """(primary code, alternate), `length` letters at most."""
    word = _LETTERS.sub("", text.upper())
    if not word:
        return "", ""
    w = _Word(word)
    if word.startswith(("GN", "KN", "PN", "WR", "PS")):
        w.at = 1
    while w.at < len(word) and min(map(len, w.codes)) < length:
        c = word[w.at]
        if c in VOWELS:
            w.add("A" if w.at == 0 else "", 1)
        elif c in _PLAIN:
            w.add(_PLAIN[c], 2 if w.letter(1) == c else 1)
        else:
            _SOUNDS[c](w)
    return w.codes[0][:length], w.codes[1][:length]


def metaphone(text: str) -> str:
    """The primary code of double_metaphone."""
    return double_metaphone(text)[0]
