import random

from lexmill.llm import leaks


def brute(docs, items, least=50):
    out = set()
    for d, text in docs:
        norm = leaks.normal(text)
        for i, passage in items:
            p = leaks.normal(passage)
            if any(p[j : j + least] in norm for j in range(len(p) - least + 1)):
                out.add((d, i))
    return out


def test_fold():
    assert leaks.normal("ＡＢ　c，１２。a​ﾀ") == "abc12aタ"
    assert leaks.normal(None) == ""


def test_found_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda m: "".join(rng.choice("租約第條甲乙丙丁ab c,。１") for _ in range(m))
    items = [(i, word(rng.randrange(40, 160))) for i in range(30)] + [(30, None), (31, ""), (32, "租" * 70), (33, "租" * 70)]
    docs = [(0, None), (1, ""), (2, "租" * 49), (3, "租，" * 50)]
    for d in range(4, 160):
        p = rng.choice(items[:30])[1]
        a = rng.randrange(max(1, len(p) - 40))
        docs.append((d, word(60) + p[a : a + rng.randrange(30, 100)].upper().replace("a", "，ａ ") + word(30)))
    docs.append((200, "\n".join(p for _, p in items if p)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    held = spark.createDataFrame([(i, "test", "q", p, "A") for i, p in items], "item_id bigint, split string, question string, passage string, answer string")
    got = {tuple(r) for r in leaks.leaked_documents(frame, held).collect()}
    assert got == brute(docs, items) and len(got) > 60
    for r in leaks.leak_spans(frame, held).collect():
        text, passage = dict(docs)[r["doc"]], leaks.normal(dict(items)[r["item"]])
        assert leaks.normal(text[r["start"] : r["end"]]) in passage
    report = {r["item_id"]: r["n_documents"] for r in leaks.leak_report(frame, held).collect()}
    assert report[30] == 0 and report[32] == 2 and len(report) == 34


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    held = spark.createDataFrame([(1, "dev", "q", None, "A")], "item_id bigint, split string, question string, passage string, answer string")
    assert leaks.leaked_documents(none, held).collect() == []
