from lexmill.llm import leaks


def test_short_questions_are_searched(spark):
    docs = spark.createDataFrame([(1, "甲。押金何時退還？乙"), (2, "押金何時 退還"), (3, "無關"), (4, None)], "doc_id bigint, text string")
    held = spark.createDataFrame([(1, "dev", "押金何時退還？", "長", "A"), (2, "dev", "租金？", None, "B"), (3, "dev", "？", None, None)], "item_id bigint, split string, question string, passage string, answer string")
    assert {r["item_id"]: r["n_questions"] for r in leaks.leak_report(docs, held).collect()} == {1: 2, 2: 0, 3: 0}


def test_answers_count_after_their_question(spark):
    docs = spark.createDataFrame([(1, "問：押金何時退還？答：Ｂ，其餘不論"), (2, "押金何時退還 A"), (3, "B")], "doc_id bigint, text string")
    held = spark.createDataFrame([(1, "dev", "押金何時退還？答：", None, "b"), (2, "dev", "押金何時退還", None, "a"), (3, "dev", "押金何時退還", None, None)], "item_id bigint, split string, question string, passage string, answer string")
    rows = {r["item_id"]: (r["n_questions"], r["n_answered"]) for r in leaks.leak_report(docs, held).collect()}
    assert rows == {1: (1, 1), 2: (2, 1), 3: (2, 0)}


def test_several_automata_give_the_same(spark):
    word = lambda i, m: "".join(chr(0x4E00 + (i * 97 + j * j * 31) % 2000) for j in range(m))
    docs = spark.createDataFrame([(d, word(d % 9, 80) + "x" + word(d % 7, 60)) for d in range(40)], "doc_id bigint, text string")
    held = spark.createDataFrame([(i, word(i, 70)) for i in range(12)], "item_id bigint, passage string")
    one, many = ({tuple(r) for r in leaks.leak_spans(docs, held, block_chars=n).collect()} for n in (10**6, 100))
    assert one == many and len(one) > 40
