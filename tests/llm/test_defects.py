import random

from lexmill.llm import defects as d

WORDS = ["承租人", "出賣人", "應", "得", "返還", "租金", "押金", "房屋", "管理費", "逾期", "如期", "解除", "契約", "稅捐", "登記", "隱名", "新任", "按月"]
NOUNS = "tenant owner deposit notice garage lease balcony penalty invoice broker agent receipt ledger".split()
VERBS = "pays returns records shows keeps moves signs stores accepts refuses".split()


def sentence(rng, lang):
    if lang == "zh":
        return "".join(rng.choice(WORDS) for _ in range(9)) + "。"
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} of unit {rng.randrange(99)} before the {rng.choice(NOUNS)} {rng.choice(VERBS)} it."


def made(seed, n=400):
    """(prompt, response, defect) of texts that the training rows don't hold."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        lang = rng.choice(["zh", "zh", "en"])
        joint = "" if lang == "zh" else " "
        prompt, answer = (joint.join(sentence(rng, lang) for _ in range(3)) for _ in range(2))
        kind = rng.choice([None, None, "empty", "refusal", "copies_prompt", "other_language", "truncated"])
        if kind == "empty":
            answer = rng.choice([None, "", " \n", "N/A", "（空白）", "-", '{"issue": "", "rule": null}', "{}", "null"])
        elif kind == "refusal":
            answer = rng.choice(["抱歉，我無法回答。", "I'm sorry, I can't help with that.", "恕無法提供意見。", "Unfortunately I am unable to comment.", "Je ne peux pas répondre."])
        elif kind == "copies_prompt":
            answer = rng.choice(["", "> ", "條款："]) + prompt.replace("。", "。 ")
        elif kind == "other_language":
            answer = rng.choice(["Der Käufer muss die Wohnung räumen und den Schlüssel abgeben.", "買主は代金を支払わなければならない。", sentence(rng, "en" if lang == "zh" else "zh"), "Người thuê phải trả nhà cho chủ nhà."])
        elif kind == "truncated":
            answer = rng.choice([answer[: len(answer) - 5], '{"issue": "' + answer + '", "rule": "' + answer[:12]])
        out.append((prompt, answer, kind))
    return out


def test_held_out_accuracy():
    field = d.Field().train(d.training_data([(p, a, None) for p, a, _ in made(1, 300)]))
    wrong = [(a, k, got) for p, a, k in made(2) if (got := d.defect(a, d.Prompt(p), field)) != k]
    assert len(wrong) <= 12, wrong[:5]


def test_reading():
    assert d.read_response('```json\n{"a": "x", "b": ["y", null]}\n```') == (["x", "y"], False)
    assert d.read_response('{"a": "x", "b": "y') == (["x", "y"], True)
    assert d.read_response(None) == ([], False)
    assert d.segments("甲乙。丙 1.5 丁；End. Next one") == ["甲乙。", "丙 1.5 丁；", "End.", "Next one"]
    assert [d.script(t) for t in ("租金應返還", "The tenant shall pay the rent", "Der Mieter muss zahlen und gehen", "物件を返還しなければ", "임차인은", "", "5")] == ["zh", "en", "latin", "ja", "ko", "", ""]


def test_query(spark):
    rows = [(i, p, a, "OK。", "x") for i, (p, a, _) in enumerate(made(3, 60))] + [(1000, None, None, "風險低。", "x"), (1001, "", "null", None, "x"), (1002, "租金", "租" * 200_000, "ok.", "x")]
    frame = spark.createDataFrame(rows + rows[-3:], "analysis_id bigint, clause_text string, analysis string, conclusion string, field string")
    got = {(r[0], r[1]): r[2] for r in d.pair_defects(frame).collect()}
    assert got[1000, "analysis"] == got[1001, "analysis"] == got[1001, "conclusion"] == "empty" and (1000, "conclusion") not in got
    assert got[1002, "analysis"] == "truncated"
    assert d.pair_defects(frame.limit(0)).collect() == []


def test_page_numbers_in_a_clause_do_not_change_its_language():
    clause = "第 2 頁\n\nWithin 100 days the disputed occupant renovates the agreed account and returns the keys.\n第三頁，共三頁"
    assert d.script(clause) == "en" and d.script("Der Mieter muss die Kaution zahlen, sofern nötig.") == "latin" and d.script("Bên thuê phải trả tiền đúng hạn") == "latin"
