"""Problem 3: noise in text from scanned pages, found and repaired.

Lines are told apart first: page numbers by the one style a file numbers its pages in, running headers
as lines that return within a file up to misread characters, the rest is the text itself. Counts of
characters and of words with their neighbours over the whole text of all files give skip-gram
vectors (the factors of the positive pointwise mutual information, which is what skip-gram training
with negative samples approaches). A character that stands where another is far more usual is linked to the frequent
one if the vector of these places is like that one's and it explains most of them (`Model._links`); a table of
look-alike glyphs only lowers what is asked. It is corrected where its context has the frequent one far more
often. A rare word is corrected to a frequent one a glyph edit away if its vector and its neighbours
agree (`Model.word`). Then furniture is dropped, cut words are joined and lines reflowed.

Null and empty texts have no noise and are repaired to ''. Counts come from every file; repeated rows
of a file count once. A file of one page has no line that returns, hence no header.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import small_batches, spread, stage

#: Entries of the context model that may travel to the workers; more are refused, as a part of the counts would flag sound text.
MODEL_ENTRIES = 1_000_000
DIMENSIONS = 64
#: How much more frequent than a misread form a word must be, and the least cosine of their vectors (9 in 10 single occurrences of a word have it, 1 in 8 of another).
WORD_RATIO = 20
LIKE = 0.25
#: A context says another character if it has that one so often, and so many times as often as the one read.
USUAL, CONTEXT_RATIO = 4, 15
#: (least cosine, least share of the odd contexts explained, least number of them) of a link of a character that has hardly any other use; either will do.
RARE_LINKS = ((0.6, 0.7, 1), (0.3, 0.9, 20))
#: The same for a character that is usual elsewhere, with the least number of occurrences, and for a pair of the table.
COMMON_LINK, COMMON_TIMES, LISTED_LINK = (0.92, 0.9, 1), 20, (0.25, 0.3, 1)

# Ideographs (and one mark) that recognition takes for one another; left: as read, right: as meant.
GLYPHS = """
末未 未末 斯期 入人 人入 兀元 遝還 氷水 永水 如知 膳繕 茭交 文交 抻押 檐擔 擅擔 士土 土士 捐損 絛條 崖屋 曰日 目日 白日 起匙 椐據
賈買 買賣 賣買 佥金 全金 干千 终終 上止 埋理 钓約 釣約 誰證 貨賃 賃貨 己已 已己 巳已 大太 太大 犬大 天夫 夫天 石右 右石 戶尸
住往 往住 住佳 待侍 侍待 第弟 弟第 間問 問間 間聞 門鬥 開閉 閉開 力刀 刀力 方万 王玉 玉王 主王 甲由 由甲 申甲 田由 日目 口囗 因困
困因 囚因 回囬 刊判 刑列 列刑 別刖 到倒 付什 代伐 任仕 仕任 件仵 仟任 他池 便使 使便 依衣 侵浸 俗谷 值植 健建 傳傅 傅傳 催摧 償賞
價僧 元无 光先 先光 免兔 再冉 冷泠 准淮 凍涷 刻剌 則財 財則 副剮 助肋 勞榮 勢執 執勢 勿匆 包句 匯滙 升井 午牛 牛午 半平 平乎 卻腳
原厚 厚原 收妝 受愛 爰受 叉又 名各 各名 告吉 吉告 吋时 呆保 哪那 員貝 商啇 嘗賞 因团 圓園 圖圆 地池 坪坏 址扯 垂乖 埋里 堂當 場塲
塗途 壁璧 壞壤 處虚 夜液 失矢 奉秦 契挈 委秀 妥姿 始治 姐妲 存孖 安妄 完宗 宋宗 官宮 宜宣 宣宜 家冢 密蜜 寶實 實寶 封對 專傳 尚向
""".split()  # fmt: skip

# Glyph runs of Latin script that look alike, each mapped to one stand-in, in this order.
LATIN = (("rn", "m"), ("in", "m"), ("vv", "w"), ("cl", "d"), ("0", "o"), ("1", "l"), ("5", "s"), ("|", "l"), ("i", "l"), ("t", "l"), ("f", "l"), ("e", "c"), ("h", "b"))
DIGIT_LIKE = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8", "Z": "2"}

_N = "[0-9OolIQ|]{1,4}"
_CN = "[一二三四五六七八九十百〇]{1,4}"
#: Styles of page numbers; a file uses one.
PAGE_STYLES = {
    "dash": rf"^[-–—]\s*{_N}\s*[-–—]$", "tilde": rf"^[～~]\s*{_N}\s*[～~]$", "di": rf"^第\s*{_N}\s*[頁貝真页]$", "di_cn": rf"^第\s*{_CN}\s*[頁貝页]\s*[，,、]?\s*共\s*{_CN}\s*[頁貝页]$",
    "di_of": rf"^第\s*{_N}\s*[頁页]\s*[，,/、]?\s*共\s*{_N}\s*[頁页]$", "di_only_cn": rf"^第\s*{_CN}\s*[頁貝页]$", "page_of": rf"^[PF][ao]g[ec]\s*{_N}\s*(?:[o0]f|/)\s*{_N}$", "page": rf"^[PF][ao]g[ec]\s*{_N}$",
    "p": rf"^[pP]\s*\.\s*{_N}$", "slash": rf"^{_N}\s*/\s*{_N}$", "bracket": rf"^[\[(（【]\s*{_N}\s*[\])）】]$", "bare": rf"^{_N}$",
}
_STYLES = {k: re.compile(v) for k, v in PAGE_STYLES.items()}
_AMOUNT = re.compile(r"^(?:NT\$|\$)?[0-9OolI]{1,3}(?:[,，.][0-9OolI]{3})+$|^[0-9OolI]{4,}$")
_HEADING = re.compile(r"^(?:第\s*[0-9OolI一二三四五六七八九十百〇]+\s*.(?:\s|（|\(|$)|(?:[a-z1l]{5,8})\s*[0-9oil]+\s+[a-z0-9]+$|[0-9oil]+\s*[.、]\s*\S|附表|附件)", re.I)
_SENTENCE = re.compile(r"[，。；]")
_INITIAL = re.compile(r"\b[A-Za-z]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_ENDS = re.compile(r"[。，；：！？!?,.;:、]$")
_CUT = re.compile(r"[A-Za-z0-9]([-‐‑–­¬])[ \t]*$")


def _is_han(c: str) -> bool:
    return "一" <= c <= "鿿" or "㐀" <= c <= "䶿"


def latin_shape(text: str) -> str:
    text = text.lower()
    for a, b in LATIN:
        text = text.replace(a, b)
    return text


_SINGLE = str.maketrans({a: b for a, b in LATIN if len(a) == 1})
_RUNS = [(a.translate(_SINGLE), b) for a, b in LATIN if len(a) > 1]


def word_shapes(word: str) -> set[str]:
    """The shapes of a word under every order of folding that matters: runs before letters, and letters before runs."""
    shapes, folded = {latin_shape(word)}, word.lower().translate(_SINGLE)
    for runs in (_RUNS, _RUNS[::-1]):
        shape = folded
        for a, b in runs:
            shape = shape.replace(a, b)
        shapes.add(shape)
    return shapes


def _holes(word: str) -> list[str]:
    """The word with each of its letters left open; two words that differ in one letter share one."""
    return [word[:i] + "*" + word[i + 1 :] for i in range(len(word))]


_GLYPH_CLASS: dict[str, str] = {}


def _classes() -> dict[str, str]:
    """A stand-in for each group of characters linked by GLYPHS."""
    if not _GLYPH_CLASS:
        parent: dict[str, str] = {}

        def top(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for a, b in GLYPHS:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
        _GLYPH_CLASS.update({c: top(c) for pair in GLYPHS for c in pair})
    return _GLYPH_CLASS


def line_shape(line: str) -> str:
    """The line without white space, with characters that are easily confused folded together."""
    wide = unicodedata.normalize("NFKC", line)
    known = _classes()
    return latin_shape("".join(known.get(c, c) for c in wide if not c.isspace()))


def _near(a: str, b: str) -> bool:
    """Whether two line shapes are the same but for a few misread characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5:
        return False
    if _NO_DIGIT.sub("", a) != _NO_DIGIT.sub("", b):
        return False
    most = max(1, len(a) // 6)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= most
    from lexmill.functions.articles import edit_distance

    return edit_distance(a, b, most) <= most


def _by_digits(shapes) -> dict[tuple[str, int], list[str]]:
    """Line shapes by their digits and length, as `_near` ones have the same digits and lengths that differ by 2 at most."""
    held = defaultdict(list)
    for s in shapes:
        held[_NO_DIGIT.sub("", s), len(s)].append(s)
    return held


def _any_near(shape: str, held: dict[tuple[str, int], list[str]]) -> bool:
    """Whether another of the shapes is near."""
    digits = _NO_DIGIT.sub("", shape)
    return any(s != shape and _near(shape, s) for d in (0, -1, 1, -2, 2) for s in held.get((digits, len(shape) + d), ()))


def _may_head(line: str) -> bool:
    """Whether a line can be a running header: short, no heading, figure or page number, and no part of a sentence."""
    if not 3 <= len(line) <= 60 or _ENDS.search(line) or _SENTENCE.search(line) or _HEADING.match(line) or _AMOUNT.match(line):
        return False
    words = _INITIAL.findall(line)
    if len(words) >= 4 and sum(w.islower() for w in words) * 2 >= len(words):
        return False
    return not any(s.match(line) for s in _STYLES.values())


def file_furniture(text: str | None) -> tuple[str, list[str]]:
    """(style of the page numbers or '', shapes of the running headers) of a file's text."""
    lines = [x.strip() for x in (text or "").split("\n")]
    counts: Counter = Counter()
    for i, line in enumerate(lines):
        for name, style in _STYLES.items():
            if line and style.match(line) and not (name == "bare" and _in_table(lines, i)):
                counts[name] += 1
                break
    style = max(counts, key=lambda k: (counts[k], k != "bare")) if counts else ""
    shapes = [line_shape(x) for x in lines if _may_head(x)]
    distinct = Counter(shapes)
    held = _by_digits(distinct)
    return style, [shape for shape, n in distinct.items() if n > 1 or _any_near(shape, held)]


def _in_table(lines: list[str], i: int) -> bool:
    """Whether a bare number is the running number of a table row: an amount follows it."""
    after = next((x for x in lines[i + 1 : i + 4] if x), "")
    return bool(_AMOUNT.match(after))


def label_lines(lines: list[str], style: str, heads: list[str]) -> list[str]:
    """`page_no`, `header`, `blank` or `text` for every line of a text whose file has that style and those headers."""
    out, known, held = [], set(heads), _by_digits(heads)
    stripped = [x.strip() for x in lines]
    for i, line in enumerate(stripped):
        if not line:
            out.append("blank")
        elif style and _STYLES[style].match(line) and not (style == "bare" and _in_table(stripped, i)):
            out.append("page_no")
        elif heads and _may_head(line) and ((s := line_shape(line)) in known or _any_near(s, held)):
            out.append("header")
        else:
            out.append("text")
    return out


def own_text(lines: list[str], labels: list[str]) -> tuple[str, bool]:
    """(the contract's own text as one line, whether a word of it is cut): furniture dropped, cut words joined."""
    own = [x.strip() for x, k in zip(lines, labels) if k == "text"]
    out, cut = "", False
    for i, line in enumerate(own):
        match = _CUT.search(line)
        if match and i + 1 < len(own) and re.match(r"[0-9]?[a-z]", own[i + 1]):
            out += line[: match.start(1)]
            cut = True
        elif i + 1 < len(own) and _HAN.search(line) and _HAN.search(own[i + 1]):
            out += line  # ideographs, and figures wrapped among them, are joined without a space
        else:
            out += line + " "
    return out, cut


_HAN = re.compile("[㐀-䶿一-鿿]")
_AROUND = re.compile("(?=(.[㐀-䶿一-鿿].))", re.S)
_WORD = re.compile(r"[A-Za-z0-9]+")


def words_around(text: str) -> list[tuple[re.Match, str, str]]:
    """(match, word before, word after) of the words and numbers of a text; '' where none is near, '#' for a number."""
    found = list(_WORD.finditer(text))
    names = ["#" if m.group().isdigit() else m.group().lower() for m in found]
    near = [0 < b.start() - a.end() <= 3 and not _HAN.search(text, a.end(), b.start()) for a, b in zip(found, found[1:])]
    return [(m, names[i - 1] if i and near[i - 1] else "", names[i + 1] if i < len(near) and near[i] else "") for i, m in enumerate(found)]


def contexts(text: str) -> Counter:
    """Counts of characters with both neighbours where the middle one is an ideograph, of words (`w:` before them), and of neighbouring words (`p:`)."""
    counts: Counter = Counter(m.group(1) for m in _AROUND.finditer(text))
    for m, _, after in words_around(text):
        w = "#" if m.group().isdigit() else m.group().lower()
        if w != "#":
            counts["w:" + w] += 1
        if after and not w == after == "#":
            counts["p:" + w + " " + after] += 1
    return counts


class Model:
    """What frequent contexts say of a character or word. counts: the contexts of all files that occur more than once."""

    def __init__(self, counts: dict[str, int]):
        self.tri = {k: v for k, v in counts.items() if k[:2] not in ("w:", "p:")}
        self.words = {k[2:]: v for k, v in counts.items() if k.startswith("w:")}
        self.left, self.right, self.n = Counter(), Counter(), Counter()
        for k, v in self.tri.items():
            self.left[k[:2]] += v
            self.right[k[1:]] += v
            self.n[k[1]] += v
        self.listed: dict[str, set[str]] = defaultdict(set)
        for a, b in GLYPHS:
            if b in self.n:
                self.listed[a].add(b)
        self._char_vectors()
        self.links, self.judged = self._links()
        #: The characters that have hardly any use of their own, and what they are misread from.
        self.never = {c: b for c, of in self.links.items() for b, rare in of.items() if rare}
        self.meant = {c: set(self.links.get(c, ())) | {b for b in self.listed.get(c, ()) if (c, b) not in self.judged} for c in {*self.links, *self.listed}}
        self.pairs = {k[2:]: v for k, v in counts.items() if k.startswith("p:")}
        self.around: dict[str, dict[str, int]] = defaultdict(dict)
        for k, v in self.pairs.items():
            a, b = k.split(" ")
            self.around[a][">" + b] = self.around[b]["<" + a] = v
        self.shapes: dict[str, list[str]] = defaultdict(list)
        self.holes: dict[str, list[str]] = defaultdict(list)
        for w, v in self.words.items():
            if w.isalpha() and v >= WORD_RATIO:
                for s in word_shapes(w):
                    self.shapes[s].append(w)
                for s in _holes(w) if len(w) >= 5 else ():
                    self.holes[s].append(w)
        self.maybe: dict[str, list[tuple[str, bool]]] = {}
        self._word_vectors()
        self.watch = re.compile("[" + "".join(sorted(self.meant)) + "]") if self.meant else None

    def _char_vectors(self) -> None:
        """Skip-gram vectors of the characters, and what takes contexts to a vector."""
        cells: Counter = Counter()
        self.char_at = {c: i for i, c in enumerate(c for c, v in self.n.items() if v >= 8)}
        self.char_col: dict[str, int] = {}
        for k, v in self.tri.items():
            if k[1] in self.char_at:
                for x in ("<" + k[0], ">" + k[2]):
                    cells[self.char_at[k[1]], self.char_col.setdefault(x, len(self.char_col))] += v
        self.char_vectors = np.zeros((0, 0))
        if len(self.char_at) >= 20:
            rows, cols, values = (np.array(x) for x in zip(*((r, c, v) for (r, c), v in cells.items())))
            self.char_vectors, self.char_basis = factors(rows, cols, values.astype(np.float32), (len(self.char_at), len(self.char_col)), 0.5)
            self.char_seen = np.bincount(cols, values, len(self.char_col)) ** 0.75
            self.char_seen /= self.char_seen.sum()

    def _place_vector(self, contexts: dict[str, int]) -> np.ndarray | None:
        """The vector of a character that has these contexts (`<` or `>` and the neighbour); None if none is known."""
        known = [(self.char_col[x], v) for x, v in contexts.items() if x in self.char_col]
        if not known or not len(self.char_vectors):
            return None
        cols, counts = (np.array(x) for x in zip(*known))
        made = np.maximum(np.log(counts / (counts.sum() * self.char_seen[cols])), 0) @ self.char_basis[cols]
        return made / (np.linalg.norm(made) + 1e-9)

    def _links(self) -> tuple[dict[str, dict[str, bool]], set[tuple[str, str]]]:
        """(character -> {the frequent one it is misread from: whether it has hardly any use of its own}, the pairs judged).

        The odd contexts of a character are those where another is USUAL and CONTEXT_RATIO times as frequent.
        Their vector is held against that of each such other one.
        """
        holes: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for k, v in self.tri.items():
            if v >= USUAL:
                holes[k[0] + k[2]].append((v, k[1]))
        odd: dict[str, Counter] = defaultdict(Counter)
        told: dict[str, dict[str, list[int]]] = defaultdict(dict)
        for k, v in self.tri.items():
            others = [b for w, b in holes.get(k[0] + k[2], ()) if b != k[1] and w >= CONTEXT_RATIO * v]
            if others:
                odd[k[1]].update({"": v, "n": 1, "<" + k[0]: v, ">" + k[2]: v})
            for b in others:
                of = told[k[1]].setdefault(b, [0, 0])
                of[0] += 1
                of[1] += v
        links: dict[str, dict[str, bool]] = {}
        judged = set()
        for c, contexts in odd.items():
            times, n = contexts.pop(""), contexts.pop("n")
            if (place := self._place_vector(contexts)) is None:
                continue
            rare = times >= 0.7 * self.n[c]
            for b, (k, v) in told[c].items():
                if b not in self.char_at:
                    continue
                judged.add((c, b))
                like = float(self.char_vectors[self.char_at[b]] @ place)
                asked = [LISTED_LINK] if b in self.listed.get(c, ()) else list(RARE_LINKS) if rare else [COMMON_LINK] if v >= COMMON_TIMES else []
                if any(like >= cosine and k >= share * n and k >= least for cosine, share, least in asked):
                    links.setdefault(c, {})[b] = rare
        return links, judged

    def correction(self, text: str, i: int) -> str | None:
        """What the character at i was meant to be, if its context says it was misread."""
        c = text[i]
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        own = self.tri.get(before + c + after, 0)
        best: tuple[int, str] | None = None
        for b in self.meant[c]:
            n = self.tri.get(before + b + after, 0)
            lb, rb, lc, rc = self.left[before + b], self.right[b + after], self.left[before + c], self.right[c + after]
            linked = self.links.get(c, {}).get(b)
            sure, weight = bool(linked), 1
            if n >= USUAL and n >= CONTEXT_RATIO * own:
                weight = n
            elif not (lb >= 5 and rb >= 5 and (lb * rb >= (30 if sure else 400) * max(1, lc) * max(1, rc)) and lb >= 4 * lc and rb >= 4 * rc) and not (
                sure and (lb >= 20 * max(1, lc) and lb >= 40 or rb >= 20 * max(1, rc) and rb >= 40)):
                continue
            if linked is not None or self._fits(b, before, after):
                best = max(best or (0, ""), (weight, b))
        return best[1] if best else None

    def _fits(self, b: str, before: str, after: str) -> bool:
        """Whether a place is like the vector of a character: what decides for a pair of the table that the counts haven't judged."""
        place = self._place_vector({"<" + before: 1, ">" + after: 1})
        return place is None or b not in self.char_at or float(self.char_vectors[self.char_at[b]] @ place) >= LIKE

    def _word_vectors(self) -> None:
        """Skip-gram vectors of the frequent words, and what takes the contexts of a rare one to its vector."""
        names = sorted({w for held in self.shapes.values() for w in held})
        at = {w: i for i, w in enumerate(names)}
        col: dict[str, int] = {}
        cells = [(at[w], col.setdefault(c, len(col)), v) for w in names for c, v in self.around.get(w, {}).items()]
        self.col, self.vectors = col, {}
        if cells:
            rows, cols, values = (np.array(x) for x in zip(*cells))
            vectors, self.basis = factors(rows, cols, values.astype(np.float32), (len(names), len(col)), 1.0)
            self.seen = np.bincount(cols, values, len(col)) ** 0.75
            self.seen /= self.seen.sum()
            self.vectors = {w: vectors[i] for w, i in at.items()}

    def likeness(self, contexts: dict[str, int], word: str) -> float | None:
        """Cosine of a rare word's vector, made from its contexts, and a frequent one's; None if it has no contexts."""
        if not contexts or word not in self.vectors:
            return None
        known = [(self.col[c], v) for c, v in contexts.items() if c in self.col]
        if not known:
            return 0.0
        cols, counts = (np.array(x) for x in zip(*known))
        made = np.maximum(np.log(counts / (counts.sum() * self.seen[cols])), 0) @ self.basis[cols]
        return float(made @ self.vectors[word] / (np.linalg.norm(made) + 1e-9))

    def candidates(self, low: str) -> list[tuple[str, bool]]:
        """(frequent word, whether the table of look-alikes explains the edit) a rare word may be a misread form of."""
        if (held := self.maybe.get(low)) is None:
            enough = WORD_RATIO * max(1, self.words.get(low, 0))
            near = {b for s in word_shapes(low) for b in self.shapes.get(s, ()) if b != low and self.words[b] >= enough}
            other = {b for s in (_holes(low) if low.isalpha() and len(low) >= 5 else ()) for b in self.holes.get(s, ()) if b != low and self.words[b] >= enough} - near
            held = self.maybe[low] = [(b, True) for b in sorted(near)] + [(b, False) for b in sorted(other)]
        return held

    def _known(self, word: str) -> str:
        """A neighbour as the counts know it, as meant if it is misread itself; '' if they don't know it."""
        meant = next((b for b, listed in self.candidates(word) if listed), word)
        return meant if meant == "#" or meant in self.words else ""

    def word(self, word: str, before: str = "", after: str = "") -> str | None:
        """What a word between two others was meant to be.

        A frequent word a glyph edit away is meant if vector and neighbours agree: it stands by one of the
        neighbours that is known far more often than the word as read does, or its vector is like. An edit
        that isn't in the table needs both, by every known neighbour. Without any known neighbour the
        frequencies alone decide, for an edit of the table.
        """
        low = word.lower()
        if len(low) < 2 and not (word in "lOo"):
            return None
        number = None
        if any(c.isdigit() for c in word) and any(c in DIGIT_LIKE for c in word) and all(c.isdigit() or c in DIGIT_LIKE for c in word):
            number = "".join(DIGIT_LIKE.get(c, c) for c in word)
        if not number and not self.candidates(low):
            return {"l": "1", "O": "0", "o": "0"}.get(word)
        own = self.around.get(low, {})
        sides = [side + c for side, x in (("<", before), (">", after)) if (c := self._known(x))]
        best: tuple | None = None
        for b, listed in self.candidates(low):
            fits = [v for c in sides if (v := self.around.get(b, {}).get(c, 0)) >= 4 * max(1, own.get(c, 0))]
            like = self.likeness({**own, **{c: max(1, own.get(c, 0)) for c in sides}}, b)
            if listed and (like is None or fits or like >= LIKE) or not listed and sides and len(fits) == len(sides) and like is not None and like >= LIKE:
                best = max(best or (False,), (listed, sum(fits), like or 0.0, self.words[b], b))
        if number and (best is None or sum(self.around.get("#", {}).get(c, 0) for c in sides) >= best[1]):
            return number
        if best:
            return best[-1].capitalize() if word[0].isupper() else best[-1]
        return {"l": "1", "O": "0", "o": "0"}.get(word)

    def corrections(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, meant) of the misread characters and words of one line of own text, in order."""
        found = []
        if self.watch:
            found += [(m.start(), m.end(), b) for m in self.watch.finditer(text) if (b := self.correction(text, m.start()))]
        found += [(m.start(), m.end(), b) for m, before, after in words_around(text) if not m.group().isdigit() and (b := self.word(m.group(), before, after))]
        return sorted(found)


def factors(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, shape: tuple[int, int], power: float, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the rows, basis that takes a row of the matrix to its vector) from the positive pointwise mutual information, by subspace iteration.

    Only the cells that are not 0 are given and held, so that no column need be left out. power: of the singular values in the vectors.
    """
    total = counts.sum()
    by_row, by_col = np.bincount(rows, counts, shape[0]), np.bincount(cols, counts, shape[1]) ** 0.75
    by_col *= total / by_col.sum()
    pmi = np.maximum(np.log(counts * total / (by_row[rows] * by_col[cols])), 0)

    def times(q, into, by, size):
        return np.stack([np.bincount(into, pmi * column[by], size) for column in q.T], axis=1)

    q = np.random.default_rng(3).standard_normal((shape[1], min(dimensions, *shape)))
    for _ in range(4):
        q, _ = np.linalg.qr(times(times(q, rows, cols, shape[0]), cols, rows, shape[1]))
    u, s, v = np.linalg.svd(times(q, rows, cols, shape[0]), full_matrices=False)
    vectors = u * s**power
    return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9), q @ v.T * (s + 1e-9) ** (power - 1)


def repaired(text: str, style: str, heads: list[str], model: Model) -> str:
    """Continuous paragraphs: furniture dropped, cut words joined, misread characters corrected."""
    lines = (text or "").split("\n")
    labels = label_lines(lines, style, heads)
    own = [x.strip() for x, k in zip(lines, labels) if k == "text"]
    width = max((len(x) for x in own), default=0)
    blocks: list[list[str]] = []
    for i, line in enumerate(own):
        fresh = not blocks or _HEADING.match(line) or _HEADING.match(own[i - 1]) or (re.search(r"[。.!?！？]$", own[i - 1]) and len(own[i - 1]) < 0.8 * width)
        blocks.append([line]) if fresh else blocks[-1].append(line)
    out = []
    for block in blocks:
        joined = own_text(block, ["text"] * len(block))[0].strip()
        at, parts = 0, []
        for start, end, meant in model.corrections(joined):
            if start >= at:
                parts += [joined[at:start], meant]
                at = end
        out.append("".join([*parts, joined[at:]]))
    return "\n".join(out)


def context_model(files: DataFrame, key: str, text: str, entries: int = MODEL_ENTRIES) -> dict[str, int]:
    """All contexts that occur more than once in the own text of all files, behind a check of their number; counts are summed by the executors."""

    def count(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                lines = (t or "").split("\n")
                total.update(contexts(own_text(lines, label_lines(lines, *file_furniture(t)))[0]))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["k", "n"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = files.where(F.length(text) > 0).select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t"))
    once = marked.repartition(parts, "h").groupBy("h").agg(F.first("t").alias("t")).select("t")
    counts = once.mapInArrow(count, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1")
    # one entry more than may be held shows that there are too many
    table = counts.limit(entries + 1).toArrow()
    if table.num_rows > entries:
        raise ValueError(f"the files hold more than {entries} contexts that occur more than once: scan them in several calls")
    return dict(zip(table.column("k").to_pylist(), table.column("n").to_pylist()))


def _furniture(files: DataFrame, key: str, text: str) -> DataFrame:
    """(file, style, heads) of each file; of several texts of a file the first with furniture."""
    kind = files.schema[key].dataType.simpleString()

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            found = [file_furniture(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))], ["file", "style", "heads"])

    rows = files.select(F.col(key).alias("file"), F.col(text).alias("t")).mapInArrow(find, f"file {kind}, style string, heads array<string>")
    return rows.where("file is not null").groupBy("file").agg(F.max(F.struct(F.size("heads").alias("n"), "style", "heads")).alias("b")).select("file", "b.style", "b.heads")


def _with_furniture(files: DataFrame, clauses: DataFrame) -> DataFrame:
    small_batches(files.sparkSession)
    files, clauses = spread(files.select("file_id", "text")), spread(clauses.select("clause_id", "file_id", "text"))
    known = stage(_furniture(files, "file_id", "text"), "furniture")
    docs = files.select(F.lit("extracted_docs").alias("src_table"), F.col("file_id").alias("record_id"), F.col("file_id").alias("file"), F.col("text").alias("t"))
    parts = clauses.select(F.lit("clauses").alias("src_table"), F.col("clause_id").alias("record_id"), F.col("file_id").alias("file"), F.col("text").alias("t"))
    return docs.unionByName(parts).join(known, "file", "left")


def noise_kinds(files: DataFrame, clauses: DataFrame) -> DataFrame:
    """(src_table, record_id, noise_kind) of every kind of noise in every record, each once.

    A clause whose file isn't there is judged without page numbers and headers.
    """
    spark = files.sparkSession
    rows = _with_furniture(files, clauses)
    held = spark.sparkContext.broadcast(Model(context_model(files, "file_id", "text")))

    def judge(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            at, kinds = [], []
            for i, (t, style, heads) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "style", "heads")))):
                lines = (t or "").split("\n")
                labels = label_lines(lines, style or "", heads or [])
                text, cut = own_text(lines, labels)
                found = {x for x in ("page_no", "header") if x in labels} | ({"hyphen"} if cut else set()) | ({"misread"} if model.corrections(text) else set())
                at += [i] * len(found)
                kinds += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column("src_table").take(pa.array(at, pa.int64())), batch.column("record_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string())], ["src_table", "record_id", "noise_kind"])

    return rows.mapInArrow(judge, "src_table string, record_id bigint, noise_kind string").distinct()


def repaired_texts(files: DataFrame, clauses: DataFrame) -> DataFrame:
    """(src_table, record_id, text) with every record's text as continuous paragraphs."""
    spark = files.sparkSession
    rows = _with_furniture(files, clauses)
    held = spark.sparkContext.broadcast(Model(context_model(files, "file_id", "text")))

    def repair(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [repaired(t or "", s or "", h or [], held.value) for t, s, h in zip(*(batch.column(c).to_pylist() for c in ("t", "style", "heads")))]
            yield pa.RecordBatch.from_arrays([batch.column("src_table"), batch.column("record_id"), pa.array(texts, pa.string())], ["src_table", "record_id", "text"])

    return rows.mapInArrow(repair, "src_table string, record_id bigint, text string").distinct()
