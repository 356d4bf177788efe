import pytest

from lexmill.llm import scan as s


def test_too_many_contexts_are_refused(spark):
    files = spark.createDataFrame([(k, "甲乙丙丁戊己庚辛壬癸，甲乙丙丁戊己庚辛壬癸。") for k in range(3)], "file_id bigint, text string")
    held = s.context_model(files, "file_id", "text", entries=1000)
    assert held["甲乙丙"] == 6
    assert s.context_model(files, "file_id", "text", entries=len(held)) == held
    with pytest.raises(ValueError, match="contexts"):
        s.context_model(files, "file_id", "text", entries=len(held) - 1)


def test_links_by_contexts_rarer_than_4000_others():
    chars = [chr(0x4E00 + i) for i in range(5000) if chr(0x4E00 + i) not in "地堤"]
    middles, sides, own = chars[:60], chars[100:4400], chars[4500:4512]
    counts = {a + middles[i % 60] + b: 50 for i, (a, b) in enumerate(zip(sides, sides[::-1]))}
    for a, b in zip(own[:6], own[6:]):
        counts[a + "地" + b], counts[a + "堤" + b] = 30, 2
    assert s.Model(counts).never.get("堤") == "地"
