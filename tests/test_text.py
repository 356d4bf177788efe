import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as t


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("token,value", [("425", "425"), ("0425", "425"), ("４２５", "425"), ("四二五", "425"), ("四百二十五", "425"), ("十", "10"), ("百十", "110"), ("一百零五", "105"), ("一千零五十", "1050"), ("甲", None), (None, None)])
def test_numeral(spark, token, value):
    assert one(spark, token, t.numeral) == value


@pytest.mark.parametrize("text,articles", [
    ("依民法第四百二十五條之一及民法 第 425-1 條、民事訴訟法第２條", ["民法第425-1條", "民事訴訟法第2條"]), ("第5條", []), ("公司法第5條", []), ("民法債編施行法第3條", ["民法債編施行法第3條"]), (None, None), ("", []),
])
def test_articles(spark, text, articles):
    assert one(spark, text, t.article_list) == articles


def test_articles_with_default_law(spark):
    assert one(spark, "第5條、消費者保護法第11條之1", lambda c: t.article_list(c, "民法")) == ["民法第5條", "消費者保護法第11-1條"]


@pytest.mark.parametrize("raw,day,month", [("1110512", "2022-05-12", "2022-05"), ("20220512", "2022-05-12", "2022-05"), ("2022/05/12", "2022-05-12", "2022-05"), ("2022.05.12", "2022-05-12", "2022-05"), ("", "", "unknown"), (None, "", "unknown"), ("garbage", "garbage", "unknown")])
def test_dates(spark, raw, day, month):
    assert one(spark, raw, t.date) == day and one(spark, raw, t.month) == month


def test_pii(spark):
    assert one(spark, "A123456789 0912-345-678 02-23456789 12", t.mask_pii) == "[身分證] [手機] [電話] 12"


def test_clean_and_layout(spark):
    assert one(spark, " 　a\t\n b　", t.clean) == "a b"
    assert one(spark, "\n a  b\t\tc\n\n\n\nd ", t.layout) == "a b c\n\nd"


def greedy(parts, limit):
    out, buf = [], ""
    for part in parts:
        if len(buf) + len(part) > limit and buf:
            out.append(buf)
            buf = part
        else:
            buf += part
    return [x for x in (s.strip() for s in [*out, buf]) if x]


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="甲乙丙。！ ab", max_size=60), min_size=1, max_size=8), limit=st.integers(3, 20))
def test_packing(spark, texts, limit):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").select("c", t.packed(t.sentences(F.col("c")), limit).alias("p")).collect()
    for r in rows:
        assert r["p"] == greedy([s for s in re.split("(?<=[。！？])", r["c"]) if s.strip(" ")], limit)


def test_sections(spark):
    got = one(spark, "法院判決 主 文 被告給付。事實及理由 原告主張。", t.sections)
    assert [(s["label"], s["body"]) for s in got] == [("主文", "主 文 被告給付。"), ("事實", "事實及"), ("理由", "理由 原告主張。")]
    assert [(s["label"], s["body"]) for s in one(spark, "無標題", t.sections)] == [("全文", "無標題")]


def test_clauses(spark):
    text = "前言\n第一條 租金每月一萬元整，按月給付。\n第二條之一：押金為二個月租金總額。\n第3條 短"
    got = one(spark, text, t.clauses)
    assert [(c["label"], c["body"]) for c in got] == [("第一條", "租金每月一萬元整，按月給付。"), ("第二條之一", "押金為二個月租金總額。")]
    assert text[got[1]["at"] :].startswith("第二條之一")
    assert one(spark, "沒有條號", t.clauses) == []


def test_json(spark):
    f = lambda c: t.robust_json(c, "a string, b array<string>")
    assert one(spark, '{"a": "x", "b": ["y"]}', f)["b"] == ["y"]
    assert one(spark, 'so: ```{"a": "x"}``` done', f)["a"] == "x"
    assert one(spark, '{"a": "x', f) is None and one(spark, "", f) is None and one(spark, None, f) is None


def test_tokens(spark):
    assert one(spark, "Rent 租金條 a1 約", t.bigrams_and_words) == ["rent", "a1", "租金", "金條", "約"] and one(spark, None, t.bigrams_and_words) is None


def test_groups(spark):
    assert one(spark, "返還押租金", lambda c: t.first_group(c, t.CAUSE_GROUPS, t.OTHER_GROUP)) == "押金返還與時效"
    assert one(spark, None, lambda c: t.first_group(c, t.CAUSE_GROUPS, t.OTHER_GROUP)) == t.OTHER_GROUP


def test_small_forms(spark):
    assert one(spark, "民法第425-1條", t.short_label) == "民425-1" and one(spark, "消費者保護法第11條", t.short_label) == "消保11"
    assert one(spark, "第 425-1 條", t.digits_only) == "425-1" and one(spark, " 第 1\n條", t.squash) == "第1條"
    assert one(spark, "消保法第2條", t.alias_law) == "消費者保護法第2條"
    assert [one(spark, x, lambda c: t.binary(c, ("high",))) for x in (" High. ", "low", "", None)] == [1, 0, None, None]


def test_wide_marks(spark):
    assert one(spark, "甲, 乙;丙 `a,乙,丙` a, b", t.widen_marks) == "甲，乙；丙 `a,乙,丙` a, b"
    assert one(spark, None, t.widen_marks) is None
