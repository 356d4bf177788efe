import random

import pytest

from lexmill.llm import scan as s

PEOPLE = ["承租人", "出租人", "買受人", "保證人", "所有權人"]
ACTS = ["返還", "給付", "修繕", "解除", "負擔", "催告"]
THINGS = ["押租金", "房屋", "契約正本", "土地持分", "排水管線", "收據"]
NOUNS = "tenant landlord deposit furniture elevator ledger balcony schedule boiler purchaser".split()
VERBS = "records delivers terminates acknowledges certifies reimburses".split()


def sentence(rng, lang):
    if lang == "zh":
        return f"{rng.choice(PEOPLE)}未{rng.choice(ACTS)}{rng.choice(THINGS)}逾{rng.randrange(10, 99)}日，{rng.choice(PEOPLE)}應{rng.choice(ACTS)}{rng.choice(THINGS)}。"
    return f"The {rng.choice(NOUNS)} of unit {rng.randrange(10, 99)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} without the {rng.choice(NOUNS)}."


def wrapped(text, lang, width, rng, cut):
    if lang == "zh":
        return [text[i : i + width] for i in range(0, len(text), width)]
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            k = len(word) // 2
            if cut and rng.random() < 0.5 and len(word) > 6:
                lines.append((line + " " + word[:k]).strip() + rng.choice(["-", "\xad", "¬", "- "]))
                line = word[k:]
                continue
            lines.append(line)
            line = ""
        line = (line + " " + word).strip()
    return [*lines, line]


def make(seed, n=240):
    """(id, text, kinds, own sentences) of made files."""
    rng, out = random.Random(seed), []
    swaps = {"未": "末", "買": "賈", "還": "遝", "繕": "膳", "據": "椐"}
    for k in range(n):
        lang = "zh" if k % 2 else "en"
        kinds, own = set(), [sentence(rng, lang) for _ in range(18)]
        noisy, cut, head, page = (rng.random() < p for p in (0.3, 0.5, 0.5, 0.5))
        body = list(own)
        if noisy:
            i = rng.randrange(len(body))
            swapped = body[i].replace("furniture", "fumiture").replace("elevator", "e1evator").replace("ledger", "leclger").replace("The", "Thc")
            if lang == "zh":
                a = rng.choice([c for c in swaps if c in body[i]])
                swapped = body[i].replace(a, swaps[a], 1)
            if swapped != body[i]:
                kinds.add("misread")
            body[i] = swapped
        lines = []
        style = rng.choice(["- {} -", "第 {} 頁", "Page {} of 3", "{}"])
        for p in range(3):
            if head:
                lines.append(f"編號 {k}　租賃契約" if lang == "zh" else f"File {k} LEASE AGREEMENT")
            part = wrapped(("" if lang == "zh" else " ").join(body[p * 6 : p * 6 + 6]), lang, 31, rng, cut)
            if any(x.rstrip()[-1] in "-\xad¬" for x in part):
                kinds.add("hyphen")
            lines += part
            if rng.random() < 0.3:
                lines += ["附表：", "1", "45,100", "2", "85,800"]
            if page:
                lines.append(style.format(p + 1))
        kinds |= ({"header"} if head else set()) | ({"page_no"} if page else set())
        out.append((k, "\n".join(lines), kinds, own))
    return out


@pytest.fixture(scope="module")
def found(request):
    return make(11)


def test_kinds_of_made_files(spark, found):
    files = spark.createDataFrame([(k, t, "ocr") for k, t, _, _ in found] + [(900, None, None), (901, "", "")], "file_id bigint, text string, source string")
    clauses = spark.createDataFrame([(5000 + k, k, t.split("\n", 3)[3]) for k, t, _, _ in found[:60]] + [(9000, 77777, "租約\n- 1 -"), (9001, None, None)], "clause_id bigint, file_id bigint, text string")
    got = {}
    for r in s.noise_kinds(files, clauses).collect():
        got.setdefault((r["src_table"], r["record_id"]), set()).add(r["noise_kind"])
    for kind in ("header", "page_no", "hyphen", "misread"):
        want = {k for k, _, kinds, _ in found if kind in kinds}
        have = {k for (src, k), kinds in got.items() if src == "extracted_docs" and kind in kinds}
        assert len(want & have) >= 0.95 * len(want), kind
        assert len(want & have) >= 0.95 * len(have), kind
    assert ("extracted_docs", 900) not in got and ("clauses", 9000) not in got
    assert any(src == "clauses" for src, _ in got)
    fixed = {r["record_id"]: r["text"] for r in s.repaired_texts(files, clauses).where("src_table = 'extracted_docs'").collect()}
    assert fixed[900] == fixed[901] == ""
    good = sum(x.rstrip(".。") in fixed[k] for k, _, _, own in found for x in own)
    assert good >= 0.97 * sum(len(own) for _, _, _, own in found)


def test_empty(spark):
    files = spark.createDataFrame([], "file_id bigint, text string, source string")
    clauses = spark.createDataFrame([], "clause_id bigint, file_id bigint, text string")
    assert s.noise_kinds(files, clauses).collect() == []


def test_lines():
    text = "租賃契約 12\n第一條（稅費）\n甲乙丙。\n附表：\n1\n45,100\n1\n租貨契約 12\n第二條（稅費）\n丁。\n2"
    style, heads = s.file_furniture(text)
    assert style == "bare" and len(heads) == 1
    assert [k for k in s.label_lines(text.split("\n"), style, heads)] == ["header", "text", "text", "text", "text", "text", "page_no", "header", "text", "text", "page_no"]
    assert s.file_furniture(None) == ("", [])
