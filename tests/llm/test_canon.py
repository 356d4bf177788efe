import random

from lexmill.functions.articles import edit_distance, tolerance
from lexmill.llm import canon


def test_tree_equals_brute_force():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(400)}
    tree = canon.BKTree(sorted(words))
    for _ in range(200):
        value, most = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))), rng.randrange(3)
        assert tree.within(value, most) == sorted((d, w) for w in words if (d := edit_distance(value, w, 20)) <= most)


def test_shards_give_the_same(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9)))
    entries = spark.createDataFrame([(word(),) for _ in range(300)] + [(None,), ("",)], "entry string")
    values = spark.createDataFrame([(word(),) for _ in range(300)] + [(None,), ("",), ("abcd",), ("abcd",)], "value string")
    one = {tuple(r) for r in canon.nearest_entries(values, entries).collect()}
    many = {tuple(r) for r in canon.nearest_entries(values, entries, shard_entries=40).collect()}
    assert one == many and any(r[1] for r in one) and any(r[1] is None for r in one)
    for value, entry, d in one:
        if entry:
            assert edit_distance(value, entry, 20) == d <= tolerance(entry)


def test_articles(spark):
    statutes = spark.createDataFrame([("民法__第_1_條", "民法", "Civil Code", "第 1 條"), ("民法__第_2-1_條", "民法", "Civil Code", "第 2-1 條"), ("民法債編施行法__第_3_條", "民法債編施行法", "Enforcement Act of the Part of Obligations of the Civil Code", "第 3 條"), ("消費者保護法__第_7_條", "消費者保護法", "Consumer Protection Act", "第 7 條")],
        "chunk_id string, law_name string, law_name_en string, article_no string")
    cases = {
        "民法第一條": 0, " 參照我國民法法 §1": 0, "Civil Code Art. 2-1": 1, "民灋第二條之一": 1, "債編施行法第３条": 2, "民法债编施行法第三條第2項": 2, "消保法第7條": 3, "消費這保護法第七條": 3,
        "刑法第1條": None, "民法第99條": None, "第1條": None, "無": None, "民法債編通則": None, "星際仲裁法第1條": None, "?": None,
    }
    raw = spark.createDataFrame([(v,) for v in [*cases, *cases, None, ""]], "raw_value string")
    ids = [r[0] for r in statutes.collect()]
    got = {r[0]: r[1] for r in canon.canonical_articles(raw, statutes).collect()}
    assert got == {v: "" if n is None else ids[n] for v, n in cases.items()}
    assert canon.canonical_articles(raw.limit(0), statutes).collect() == []
    assert {r[1] for r in canon.canonical_articles(raw, statutes.limit(0)).collect()} == {""}
