"""Problem 4: broken prompt and response pairs.

A response is cut into clauses (sentence-like segments). A linear-chain conditional random field tags
each as answer, refusal, echo, foreign or unfinished from features of its wording, script, overlap
with the prompt, ending and place; the shares of the tags decide the pair's defect. The field is
trained where it is used, on sequences made from a bounded sample of rows (TRAIN_ROWS): sound
responses, the same cut short, prompts echoed, set phrases of refusal, and text of other languages.

A null, blank or placeholder response, or JSON without any content, is `empty` and needs no tags. JSON
may be fenced; JSON that breaks off is read as far as it goes. A null or empty prompt can't be echoed
and has no language. Repeated rows give one result.
"""

import json
import random
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread

#: Bound of the training sample: so many rows, those with the least hash of the key.
TRAIN_ROWS = 500
EPOCHS = 6
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")

# Texts that stand for no content, without marks and white space.
PLACEHOLDERS = {"", "無", "空白", "null", "none", "na", "nil", "nan", "undefined", "tbd", "todo", "待補", "略", "從略", "不適用", "無內容", "未填", "沒有", "empty", "blank", "xxx", "待填", "暫無", "尚無"}

# Cues of declining in several languages, and of a machine speaking of itself.
REFUSAL = re.compile(
    r"(?:抱歉|對不起|对不起|遺憾|遗憾|不好意思)(?=[，,。！!\s]|$)|無法(?:提供|回答|協助|就|為|回應)|无法(?:提供|回答|协助)|不便(?:就|作|回|提)|恕(?:不|難|无|無)|不能代替|無權|无权|沒有辦法|没有办法|超出我|語言模型|语言模型|敏感內容|敏感内容|使用政策|不予(?:作答|回答|置評)|無可奉告|尋(?:求)?(?:律師|專業)|洽專業"
    r"|\bsorry\b|\bcan(?:no|')t\b|\bcan not\b|\bunable\b|\bnot able to\b|\bdecline\b|\bunfortunately\b|\bas an ai\b|language model|\bi (?:am|must|won't|will not|do not)\b|legal advice|against (?:my|our) polic|(?:outside|beyond) (?:my|our|what)\b|(?:can|to) (?:help|assist)\b|seek (?:a lawyer|professional)"
    r"|\bleider\b|entschuldigung|kann (?:ich )?nicht (?:antworten|beantworten|helfen)|désolé|je ne peux pas|lo siento|no puedo|mi dispiace|non posso|xin lỗi|không thể (?:trả lời|cung cấp|hỗ trợ)|申し訳|お答えでき|ごめんなさい|죄송|답변할 수 없",
    re.I,
)

# Fragments of which every match of REFUSAL holds one (lower case).
_FRAGMENTS_HAN = ("抱歉", "對不起", "对不起", "遺憾", "遗憾", "不好意思", "無法", "无法", "不便", "恕", "代替", "無權", "无权", "沒有辦法", "没有办法", "超出我", "模型", "敏感", "政策", "不予", "奉告", "尋", "洽專業", "申し訳", "お答え", "ごめん", "죄송", "답변")
_FRAGMENTS_LATIN = ("sorry", "can", "unable", "able to", "decline", "unfortunate", "ai", "language model", "i ", "legal advice", "against", "my", "our", "what", "help", "assist", "seek", "leider", "entschuldigung", "désolé", "peux", "siento", "puedo", "dispiace", "posso", "xin lỗi", "không thể")


def cues(text: str) -> int:
    """Number of different cues of declining in the text."""
    low = text.lower()
    if any(f in low for f in _FRAGMENTS_LATIN) or (not low.isascii() and any(f in low for f in _FRAGMENTS_HAN)):
        return len(set(REFUSAL.findall(low)))
    return 0


# Common words of English.
ENGLISH = set("the a an of to in and or for on by with at from as is are was were be been not no it its this that these those which who if then than into under over within without before after between during upon shall must may can will would should any all each per about against through there their such other only also we you i he she they have has had do does".split())

# Sentences of other languages that the field learns foreign script and words from.
FOREIGN = [
    "Der Mieter muss die Kaution bis zum Ende des Monats an den Vermieter zahlen.", "Die Verkäuferin darf den Vertrag nicht ohne Zustimmung kündigen.", "Das Gericht hat die Klage der Eigentümer abgewiesen.",
    "Le locataire doit rendre les clés au propriétaire avant la fin du bail.", "La garantie reste valable pendant deux années.", "Cette clause présente un risque élevé pour l'acheteur.",
    "El arrendatario debe pagar la renta dentro de los primeros cinco días.", "La cláusula no protege los derechos del comprador.", "O inquilino deve devolver o imóvel nas mesmas condições.", "Il venditore deve consegnare l'immobile entro trenta giorni.",
    "Bên thuê phải trả tiền thuê nhà đúng hạn cho bên cho thuê.", "Người bán có thể yêu cầu bồi thường thiệt hại.", "Penyewa wajib membayar uang jaminan kepada pemilik rumah.",
    "賃借人は契約の終了時に物件を返還しなければなりません。", "売主は買主に対して責任を負うものとする。", "この条項には高いリスクがあります。", "임차인은 계약 종료 시 보증금을 돌려받을 수 있다.", "매도인은 서면으로 통지하여야 한다.",
    "Арендатор обязан вернуть помещение в срок.", "Продавец не вправе расторгнуть договор.", "ผู้เช่าต้องชำระค่าเช่าตรงเวลา", "يجب على المستأجر دفع الإيجار في موعده.",
]
REFUSALS = [
    "抱歉，我無法提供這項條款的法律意見。", "對不起，這個要求超出我能協助的範圍。", "很遺憾，基於使用政策，不便作出評估。", "恕不作答。", "我只是語言模型，不能代替律師。", "沒有辦法回應您的請求。", "無權就此表示意見，請另尋律師。", "我無法回答。", "恕無法提供建議。", "這個問題無法協助。", "不便回覆。",
    "I'm sorry, but I can't assist with this.", "Sorry, I cannot answer that.", "As an AI system I am not able to give legal advice.", "I must decline to comment.", "Unfortunately this request is outside my scope.", "I am unable to help with that.",
    "Leider kann ich nicht antworten.", "Désolé, je ne peux pas répondre.", "Lo siento, no puedo ayudar.", "Xin lỗi, tôi không thể trả lời.", "申し訳ありませんが、お答えできません。", "죄송하지만 답변할 수 없습니다.",
]

_SEGMENT = re.compile(r"[^。！？!?\n\r；;.]*(?:[。！？!?；;]+|\.(?=\s|$)|[\n\r]+|\.(?!\s)|$)[」』”\"’'）)]*\s*")
_END = re.compile(r"[。！？!?.][」』”\"’'）)\s*]*$")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
_PARTIAL = re.compile(r'"(?:[^"\\]|\\.)*"\s*:\s*"((?:[^"\\]|\\.)*)"?', re.S)


class _Core(dict):
    def __missing__(self, code):
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        self[code] = c = "".join(x for x in c if x.isalnum())
        return c


_CORE = _Core()


def core(text: str) -> str:
    """Letters, digits and ideographs only, half width, lower case."""
    return text.translate(_CORE)


def segments(text: str) -> list[str]:
    """Sentence-like pieces of the text in order, without blank ones; a dot inside a number or word doesn't end one."""
    out, held = [], ""
    for match in _SEGMENT.finditer(text):
        held += match.group()
        if held.strip() and (not held.rstrip().endswith(".") or _END.search(held) and (match.end() == len(text) or held[-1:].isspace())):
            out.append(held.strip())
            held = ""
    if held.strip():
        out.append(held.strip())
    return out


def read_response(raw: str | None) -> tuple[list[str], bool]:
    """(texts, broken): the contents of a plain, JSON or fenced JSON response, and whether its JSON breaks off."""
    if raw is None:
        return [], False
    text = raw.strip()
    bare = _FENCE.sub("", text).strip() if text.startswith("```") else text
    if not bare.startswith(("{", "[")) and bare != "null":
        return [bare], False
    try:
        value = json.loads(bare)
    except ValueError:
        closed = bare.rstrip().endswith(("}", "]"))
        parts = [m.group(1) for m in _PARTIAL.finditer(bare)]
        return (parts or [bare.strip("{}[] \n")]), not closed
    todo, found = [value], []
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            todo = [*x.values(), *todo]
        elif isinstance(x, list):
            todo = [*x, *todo]
        elif x is not None:
            found.append(str(x))
    return found, False


def is_empty(texts: list[str]) -> bool:
    return all(core(t) in PLACEHOLDERS for t in texts)


class _Kinds(dict):
    """Code point -> one letter for its script, or a blank."""

    def __missing__(self, n):
        c = chr(n)
        if 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF:
            kind = "h"
        elif 0x3040 <= n <= 0x30FF:
            kind = "k"
        elif 0xAC00 <= n <= 0xD7AF:
            kind = "g"
        elif not c.isalpha():
            kind = " "
        else:
            kind = "l" if n < 0x250 or 0x1E00 <= n <= 0x1EFF else "o"
        self[n] = kind
        return kind


_KINDS = _Kinds()
_LETTERS = re.compile("[A-Za-z]+")


_LATIN_WORD = re.compile("[a-zß-öø-ɏḁ-ỿ]+")


def script(text: str) -> str:
    """zh, ja, ko, en, latin (another language in Latin letters), other, or '' if there is too little to tell."""
    if text.isascii():
        han = kana = hangul = other = 0
        latin = sum(map(len, _LETTERS.findall(text)))
    else:
        kinds = text.translate(_KINDS)
        han, kana, hangul, latin, other = (kinds.count(k) for k in "hkglo")
    most = max(han * 2 + kana, kana * 3, hangul * 2, latin / 2, other)
    if most < 2:
        return ""
    if kana * 5 >= han + kana and kana >= 2:
        return "ja"
    if most == han * 2 + kana:
        return "zh"
    if most == hangul * 2:
        return "ko"
    if most == other:
        return "other"
    # ideographs between Latin words, as of a page number that a scan left there, are no words of another language
    words = _LATIN_WORD.findall(text.lower())
    if len(words) < 3:
        return ""
    strange = sum(any(ord(c) > 127 for c in w) for w in words)
    return "en" if sum(w in ENGLISH for w in words) * 8 >= len(words) and strange * 10 <= len(words) else "latin"


FEATURES = ["bias", "echo0", "echo1", "echo2", "echo3", "same", "unlike", "strange", "unclear", "cue0", "cue1", "cue2", "ended", "open", "comma", "dots", "first", "last", "alone", "last_open", "last_comma", "short", "long", "json_open"]
_AT = {name: i for i, name in enumerate(FEATURES)}


class Prompt:
    """The prompt's overlap and language, made once for both fields of a row."""

    def __init__(self, text: str | None):
        self.core = core(text or "")
        self.grams: dict[int, set[str]] = {}
        self.script = script(text or "")

    def overlap(self, c: str) -> float:
        """Share of the runs of a segment's core that the prompt holds."""
        k = 10 if c.isascii() else 4  # letters tell less than ideographs
        if len(c) < k:
            return float(bool(c) and len(self.core) >= k and c in self.core)
        if k not in self.grams:
            self.grams[k] = {self.core[i : i + k] for i in range(len(self.core) - k + 1)}
        return sum(map(self.grams[k].__contains__, [c[i : i + k] for i in range(len(c) - k + 1)])) / (len(c) - k + 1)


def features(parts: list[str], prompt: Prompt, broken: bool) -> tuple[tuple[int, ...], ...]:
    """For every segment the indices of its features."""
    out = []
    for i, part in enumerate(parts):
        on = ["bias"]
        c = core(part)
        o = prompt.overlap(c)
        on.append("echo3" if o >= 0.9 else "echo2" if o >= 0.6 else "echo1" if o >= 0.25 else "echo0")
        kind = script(part)
        on.append("unclear" if not kind or not prompt.script else "same" if kind == prompt.script else "unlike")
        if kind not in ("", "zh", "en", prompt.script):
            on.append("strange")
        n = cues(part)
        on.append("cue2" if n > 1 else "cue1" if n else "cue0")
        last = i == len(parts) - 1
        ended = bool(_END.search(part)) and not re.search(r"(?:…|\.{3})[」”\"]*$", part)
        on.append("ended" if ended else "open")
        if re.search(r"[，,、：:；;\-]$", part):
            on += ["comma"] + ["last_comma"] * last
        if re.search(r"(?:…|\.{3})$", part):
            on.append("dots")
        on += ["first"] * (i == 0) + ["last"] * last + ["alone"] * (len(parts) == 1) + ["last_open"] * (last and not ended) + ["json_open"] * (last and broken)
        size = len(c)
        on += ["short"] * (size < 8) + ["long"] * (size > 60)
        out.append(tuple(_AT[x] for x in on))
    return tuple(out)


class Field:
    """A linear-chain conditional random field over binary features."""

    def __init__(self, n_features: int = len(FEATURES), n_tags: int = len(TAGS)):
        self.w, self.t = np.zeros((n_features, n_tags)), np.zeros((n_tags, n_tags))
        self.start = np.zeros(n_tags)
        self.seen: dict = {}

    def _scores(self, seq) -> np.ndarray:
        return np.array([self.w[list(on)].sum(axis=0) for on in seq])

    def train(self, data: list[tuple[tuple, list[int]]], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4) -> "Field":
        """Ascends the conditional log likelihood, one sequence at a time, with a rate per weight (AdaGrad)."""
        sums = [np.full_like(x, 1e-2) for x in (self.w, self.t, self.start)]
        rng = random.Random(4)
        for _ in range(epochs):
            for seq, tags in rng.sample(data, len(data)):
                e = self._scores(seq)
                n = len(seq)
                a, b = np.zeros_like(e), np.zeros_like(e)
                a[0] = e[0] + self.start
                for i in range(1, n):
                    a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + self.t, axis=0)
                for i in range(n - 2, -1, -1):
                    b[i] = np.logaddexp.reduce(self.t + (e[i + 1] + b[i + 1])[None, :], axis=1)
                z = np.logaddexp.reduce(a[-1])
                p = np.exp(a + b - z)
                gw, gt, gs = -decay * self.w, -decay * self.t, -decay * self.start
                for i in range(n):
                    d = -p[i]
                    d[tags[i]] += 1
                    gw[list(seq[i])] += d
                    if i:
                        gt -= np.exp(a[i - 1][:, None] + self.t + (e[i] + b[i])[None, :] - z)
                        gt[tags[i - 1], tags[i]] += 1
                gs -= p[0]
                gs[tags[0]] += 1
                for x, g, s in zip((self.w, self.t, self.start), (gw, gt, gs), sums):
                    s += g * g
                    x += rate * g / np.sqrt(s)
        self.seen = {}
        return self

    def tag(self, seq: tuple) -> list[int]:
        """The most probable tags; sequences of the same features are remembered."""
        if seq not in self.seen:
            e = self._scores(seq)
            best, back = e[0] + self.start, []
            for i in range(1, len(seq)):
                all_ = best[:, None] + self.t
                back.append(all_.argmax(axis=0))
                best = all_.max(axis=0) + e[i]
            out = [int(best.argmax())]
            for pointers in reversed(back):
                out.append(int(pointers[out[-1]]))
            if len(self.seen) > 200_000:
                self.seen = {}
            self.seen[seq] = out[::-1]
        return self.seen[seq]


def training_data(rows: list[tuple[str | None, str | None, str | None]]) -> list[tuple[tuple, list[int]]]:
    """Tagged sequences made from (prompt, response, response) rows; deterministic."""
    rng, data = random.Random(44), []
    tag = {t: i for i, t in enumerate(TAGS)}
    sound = []
    for prompt_text, *responses in rows:
        for raw in responses:
            texts, broken = read_response(raw)
            parts = [s for t in texts for s in segments(t)]
            if prompt_text and parts and not broken and not is_empty(texts):
                p = Prompt(prompt_text)
                if p.script and not any(cues(s) or p.overlap(core(s)) > 0.6 or script(s) not in ("", p.script) for s in parts) and _END.search(parts[-1]):
                    sound.append((prompt_text, p, parts))

    def add(parts, prompt, tags, broken=False):
        if parts:
            data.append((features(parts, prompt, broken), tags))

    scripts: dict[str, list] = {}
    for _, p, parts in sound:
        scripts.setdefault(p.script, []).append(parts)
    for text, p, parts in sound or [("租約。", Prompt("承租人應給付租金。"), ["風險低。"])]:
        n = len(parts)
        add(parts, p, [tag["answer"]] * n)
        if rng.random() < 0.4:  # breaks off
            k = rng.randrange(n)
            body = parts[k].rstrip("。.!?！？ ")
            cut = body[: max(2, int(len(body) * rng.uniform(0.2, 0.9)))] + rng.choice(["", "", "，", "，", "…", "及"] if p.script == "zh" else ["", "", ",", ",", "...", " and"])
            add([*parts[:k], cut], p, [tag["answer"]] * k + [tag["unfinished"]], rng.random() < 0.4)
        if rng.random() < 0.4:  # nothing but the prompt
            echo = segments(re.sub(r"\s*\n\s*", rng.choice(["", " ", "\n"]), text))
            if rng.random() < 0.4 and echo:
                echo[0] = rng.choice(["條款內容：", "> ", "The clause reads: "]) + echo[0]
            if rng.random() < 0.2 and echo:
                echo[-1] = echo[-1].rstrip("。.")
            add(echo, p, [tag["echo"]] * len(echo))
        if rng.random() < 0.4:
            said = [rng.choice(REFUSALS if rng.random() < 0.6 else REFUSALS[-6:])] + ([rng.choice(["謝謝。", "如有需要請另行諮詢。"])] if rng.random() < 0.4 else [])
            rest = parts[:1] if rng.random() < 0.3 else []
            add([*said, *rest], p, [tag["refusal"]] * len(said) + [tag["answer"]] * len(rest))
        if rng.random() < 0.5:
            others = [x for s, x in scripts.items() if s != p.script]
            strange = rng.choice(rng.choice(others)) if others and rng.random() < 0.5 else rng.sample(FOREIGN, rng.randrange(1, 4))
            add(strange, p, [tag["foreign"]] * len(strange))
        if rng.random() < 0.3:  # sound answers may quote some words
            words = re.sub(r"\s+", "", text) if p.script == "zh" else text.replace("\n", " ")
            at = rng.randrange(max(1, len(words) - 14))
            add([f"條款稱「{words[at : at + rng.randrange(5, 13)]}」，" + parts[0], *parts[1:]], p, [tag["answer"]] * n)
        if rng.random() < 0.3:  # others may refuse, be sorry or unable in a sound answer
            k = rng.randrange(n)
            said = rng.choice(["出賣人拒絕回覆時，", "房東無法提供發票者，", "縱有歉意之函件，", "承租人無權轉租，"] if p.script == "zh" else ["If the lessor cannot answer, ", "The buyer is unable to pay; ", "A letter that says sorry changes nothing, and "])
            add([*parts[:k], said + parts[k], *parts[k + 1 :]], p, [tag["answer"]] * n)
        if rng.random() < 0.2:
            add([rng.choice(["No material risk.", "OK.", "No change is needed."] if p.script == "en" else ["風險低。", "無須修正。", "建議刪除本條。"])], p, [tag["answer"]])
    return data


def defect(raw: str | None, prompt: Prompt, field: Field) -> str | None:
    """The defect of one response, or None if it is sound."""
    texts, broken = read_response(raw)
    if not texts or is_empty(texts):
        return "empty"
    parts = [s for t in texts for s in segments(t) if s.strip()]
    if not parts:
        return "empty"
    tags = [TAGS[t] for t in field.tag(features(parts, prompt, broken))]
    size = [max(1, len(core(s))) for s in parts]
    share = {t: sum(n for n, x in zip(size, tags) if x == t) / sum(size) for t in set(tags)}
    if share.get("refusal", 0) >= (0.1 if tags[0] == "refusal" else 0.5):
        return "refusal"
    if share.get("echo", 0) >= 0.8:
        return "copies_prompt"
    if share.get("foreign", 0) >= 0.5:
        return "other_language"
    if broken or tags[-1] == "unfinished":
        return "truncated"
    return None


def trained_field(pairs: DataFrame, key: str, prompt: str, responses: list[str], rows: int = TRAIN_ROWS) -> Field:
    # a share of the keys by hash first, so that what comes to the driver doesn't grow with the partitions
    share = max(1, pairs.count() // (4 * rows))
    some = pairs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0).select(key, prompt, *responses)
    sample = some.dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(rows).collect()
    return Field().train(training_data([(r[prompt], *(r[c] for c in responses)) for r in sample]))


def pair_defects(pairs: DataFrame, key: str = "analysis_id", prompt: str = "clause_text", responses: tuple[str, ...] = ("analysis", "conclusion"), rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, field, defect): one row for each defective response of each key, each distinct one once."""
    spark = pairs.sparkSession
    responses = list(responses)
    held = spark.sparkContext.broadcast(trained_field(pairs, key, prompt, responses, rows))
    kind = pairs.schema[key].dataType.simpleString()

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i + 1).to_pylist() for i in range(1 + len(responses))]
            at, names, kinds = [], [], []
            for i, (text, *answers) in enumerate(zip(*columns)):
                p = Prompt(text)
                for name, raw in zip(responses, answers):
                    if found := defect(raw, p, held.value):
                        at.append(i)
                        names.append(name)
                        kinds.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(kinds, pa.string())], ["k", "field", "defect"])

    rows_ = pairs.select(F.col(key).alias("k"), F.col(prompt).alias("p"), *(F.col(c).alias(f"r{i}") for i, c in enumerate(responses)))
    found = spread(rows_).mapInArrow(judge, f"k {kind}, field string, defect string").withColumnRenamed("k", key)
    # the rows of a key are repeats; should they differ, the first defect in code-point order is given
    return found.groupBy(key, "field").agg(F.min("defect").alias("defect"))
