"""References to statute articles in free text: splitting, numerals and names.

A reference is a name and an article number (`N` or `N-M`); paragraph, item and wording after the
number do not matter. Null, empty and unparseable values give no reference.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# Numerals.
DIGITS = {"〇": 0, "零": 0, "○": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}

# Simplified and variant characters of legal titles and their traditional form.
VARIANTS = {
    "条": "條", "项": "項", "灋": "法", "诉": "訴", "讼": "訟", "债": "債", "编": "編", "则": "則", "总": "總", "权": "權",
    "费": "費", "护": "護", "亲": "親", "属": "屬", "继": "繼", "国": "國", "华": "華", "违": "違", "参": "參", "据": "據",
    "证": "證", "险": "險", "劳": "勞", "动": "動", "产": "產", "业": "業", "务": "務", "强": "強", "执": "執", "仓": "倉",
    "赁": "賃", "买": "買", "卖": "賣", "议": "議", "类": "類", "实": "實", "质": "質", "责": "責", "处": "處", "适": "適",
}

# Words before a statute's name, and of a country before it.
LEAD_INS = ("類推適用", "參照", "依照", "依據", "根據", "違反", "適用", "準用", "按", "依", "見", "同", "又", "及", "暨", "參")
COUNTRIES = ("中華民國", "我國", "現行", "台灣", "臺灣")

# Usual short names of statutes.
SHORT_NAMES = {
    "民訴": "民事訴訟法", "民訴法": "民事訴訟法", "消保法": "消費者保護法",
    "民總施行法": "民法總則施行法", "總則施行法": "民法總則施行法",
    "債編施行法": "民法債編施行法", "民債施行法": "民法債編施行法", "民債編施行法": "民法債編施行法",
    "物權編施行法": "民法物權編施行法", "民物施行法": "民法物權編施行法", "民物權施行法": "民法物權編施行法",
    "民訴施行法": "民事訴訟法施行法", "民訴法施行法": "民事訴訟法施行法",
}

_NUM = "[0-9〇零○一二兩两三四五六七八九十百千]+"
_MARKED = re.compile(rf"(?P<name>.*?)(?:_*第_*|§+|,?art(?:icle)?s?\.?)(?P<n>{_NUM})(?:[-‐-―−_]?[-之‐-―−](?P<m>{_NUM}))?(?P<rest>_?條?(?:之(?P<m2>{_NUM})(?![項款]))?)", re.I | re.S)
_BARE = re.compile(rf"(?P<name>.*?[^0-9])(?P<n>[0-9]+)(?:[-之](?P<m>{_NUM}))?條?(?:之(?P<m2>{_NUM}))?$", re.S)
_EDGES = "「」『』《》〈〉()[]{}“”\"'.,;:、。，；：_ 　"


class _Same(dict):
    def __missing__(self, code):
        return code


_FOLD = _Same({ord(a): b for a, b in VARIANTS.items()})


def numeral(token: str) -> int | None:
    """The value of a numeral in digits, in positional or in unit notation; None if it is none."""
    if not token:
        return None
    if token.isascii() and token.isdigit():
        return int(token)
    if not any(c in UNITS for c in token):
        return int("".join(c if c.isdigit() else str(DIGITS[c]) for c in token)) if all(c.isdigit() or c in DIGITS for c in token) else None
    total, now = 0, None
    for c in token:
        if c in UNITS:
            total += (1 if now is None else now) * UNITS[c]
            now = None
        elif c in DIGITS:
            now = DIGITS[c]
        elif c.isdigit():
            now = (now or 0) * 10 + int(c)
        else:
            return None
    return total + (now or 0)


def squash(text: str) -> str:
    """Half width, lower case, no white space or invisible characters, variants folded."""
    wide = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in wide if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc")).translate(_FOLD)


def bare_name(name: str) -> str:
    """The statute's name without brackets, lead-ins and the country."""
    name = name.strip(_EDGES)
    for words in (LEAD_INS, COUNTRIES):
        for word in words:
            if name.startswith(word) and len(name) > len(word):
                name = name[len(word) :].strip(_EDGES)
                break
    return name


def split_reference(raw: str | None) -> tuple[str, str] | None:
    """(name, number) of a reference, the name squashed and bare (may be empty), the number `N` or `N-M`; None if there is no number."""
    if not raw:
        return None
    text = squash(raw)
    match = _MARKED.match(text) or _BARE.match(text.rstrip(_EDGES))
    if not match:
        return None
    n, m = numeral(match["n"]), numeral(match["m"] or match["m2"] or "")
    if n is None:
        return None
    return bare_name(match["name"]), f"{n}-{m}" if m else str(n)


def spellings_of(name: str, english: str | None) -> list[tuple[str, str, int]]:
    """(squashed spelling, statute, rank) of a statute's own name (0), its usual short names (1) and its English name (2)."""
    own = squash(name)
    found = [(own, name, 0), *((short, name, 1) for short, full in SHORT_NAMES.items() if full == own)]
    return found + ([(squash(english).strip(_EDGES), name, 2)] if english else [])


def name_entries(names: Iterable[tuple[str, str | None]]) -> dict[str, str]:
    """Squashed spelling -> statute of (name, English name) rows; of two statutes with one spelling the one of the lesser rank, then name."""
    rows = sorted((rank, law, entry) for a, b in set(names) if a for entry, law, rank in spellings_of(a, b))
    return {entry: law for _, law, entry in reversed(rows)}


def tolerance(name: str) -> int:
    """Edits a misspelt name may be away from an entry: one for ideographs, one in eight letters for Latin script."""
    return max(1, len(name) // 8) if name.isascii() else 1


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def plausible(name: str, entry: str, distance: int) -> bool:
    """Whether a name at that distance can mean the entry. A two-character name may gain or lose a character, not change one: 刑法 is not 民法."""
    if distance == 0:
        return True
    short = min(len(name), len(entry))
    return short >= 2 and distance <= tolerance(entry) and (short > 2 or len(name) != len(entry))


class StatuteNames:
    """Nearest statute of a name among entries that are held, with a memory of names seen."""

    def __init__(self, entries: dict[str, str]):
        self.entries, self.seen = entries, {}
        self.by_length: dict[int, list[str]] = {}
        for e in entries:
            self.by_length.setdefault(len(e), []).append(e)

    def nearest(self, name: str) -> tuple[int, str, str] | None:
        """(distance, entry, statute), the first in code-point order among equals."""
        if name in self.entries:
            return 0, name, self.entries[name]
        if name not in self.seen:
            most = max(1, (len(name) + 1) // 7)
            near = (e for n in range(len(name) - most, len(name) + most + 1) for e in self.by_length.get(n, ()))
            best = min(((d, e) for e in near if plausible(name, e, d := edit_distance(name, e, tolerance(e)))), default=None)
            self.seen[name] = (*best, self.entries[best[1]]) if best else None
        return self.seen[name]

    def find(self, name: str) -> str | None:
        hit = self.nearest(name)
        return hit[2] if hit else None
