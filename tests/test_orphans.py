import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.functions.articles import StatuteNames, edit_distance, name_entries, numeral, split_reference
from lexmill.operators import keyfilter, orphans


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("token,value", [("425", 425), ("四二五", 425), ("四百二十五", 425), ("十", 10), ("百十", 110), ("一百零五", 105), ("一千零五十", 1050), ("", None), ("甲", None)])
def test_numeral(token, value):
    assert numeral(token) == value


@pytest.mark.parametrize("raw,parts", [
    ("民法第654條", ("民法", "654")), ("民訴　第634条", ("民訴", "634")), ("民 法第802-3條", ("民法", "802-3")), ("民法第八百二十五條之一", ("民法", "825-1")),
    ("Code of Civil Procedure, Article 418-1", ("codeofcivilprocedure", "418-1")), ("民法第430條第2項但書", ("民法", "430")), ("民法__第_906-2_條", ("民法", "906-2")),
    ("「民事訴訟 法第３５７－１條」", ("民事訴訟法", "357-1")), ("違反民法第311條之規定", ("民法", "311")), ("民法_第183之2條", ("民法", "183-2")), ("第5條", ("", "5")),
    ("Civil Code generally", None), ("", None), (None, None),
])
def test_split(raw, parts):
    assert split_reference(raw) == parts


def test_names():
    names = StatuteNames(name_entries([("民法", "Civil Code"), ("民事訴訟法", "Code of Civil Procedure"), ("消費者保護法", None)]))
    assert [names.find(n) for n in ("民法", "民法法", "刑法", "民訴", "民事訴訟發", "消費保護法", "civilcode", "civlcode", "某法")] == ["民法", "民法", None, "民事訴訟法", "民事訴訟法", "消費者保護法", "民法", "民法", None]
    assert edit_distance("abc", "abd", 1) == 1 and edit_distance("abc", "xyz", 1) == 2


@pytest.mark.parametrize("sizes", [(8 << 20, 64 << 20), (8, 64 << 20), (8, 0)])
def test_reasons(spark, sizes):
    refs = [(1, "a", day(5), "x"), (1, "b", day(5), "x"), (2, "c", day(5), "x"), (2, "d", day(5), "x"), (3, None, day(5), "x"), (4, "e", None, "x"), (5, "f", day(5), "x")]
    parents = [("a", day(1), None), ("b", day(9), None), ("c", day(1), day(5)), ("a", day(9), day(2)), ("e", day(1), day(2)), ("f", None, None), (None, day(1), None)]
    found = orphans.orphan_references(
        spark.createDataFrame(refs, "record_id long, key string, at timestamp, since string"), spark.createDataFrame(parents, "key string, since timestamp, until timestamp"), "at", *sizes)
    assert sorted((r["record_id"], r["key"], r["reason"]) for r in found.collect()) == [(1, "b", "later"), (2, "c", "deleted"), (2, "d", "missing")]


@pytest.mark.parametrize("sizes,held", [((8 << 20, 64 << 20), True), ((2000, 64 << 20), True), ((2000, 1000), False)])
def test_filter_holds_every_key_and_keeps_its_rate(spark, sizes, held):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    got = keyfilter.key_filter(keys, *sizes)
    assert (got.held is not None) == held and got.n_bytes >= 5000 * keyfilter.BITS_PER_KEY // 8
    asked = spark.range(20000).selectExpr("id", "'x' AS _s", "xxhash64(id) AS h")
    rows = got.mark(asked.repartition(3), F.col("h"), "may").select("id", "may").collect()
    assert len(rows) == 20000 and all(r["may"] for r in rows if r["id"] < 5000)
    assert sum(r["may"] for r in rows if r["id"] >= 5000) < 15000 * 0.03 and 0 < got.rate() < 0.03


def test_filter_of_no_key(spark):
    got = keyfilter.key_filter(spark.range(0).selectExpr("id"))
    assert not any(r["may"] for r in got.mark(spark.range(5), F.xxhash64("id"), "may").collect()) and got.rate() == 0


def test_hot_shard_is_copied(spark, monkeypatch):
    monkeypatch.setattr(keyfilter, "ROUTED_ROWS", 100)
    got = keyfilter.key_filter(spark.range(3000).selectExpr("xxhash64(id)"), 1000, 0)
    rows = got.mark(spark.range(2000).selectExpr("id", "xxhash64(id % 2 * 5000) AS h"), F.col("h"), "may").collect()
    assert len(rows) == 2000 and {r["id"] % 2 for r in rows if not r["may"]} == {1}


def test_names_in_blocks(spark):
    statutes = spark.createDataFrame([("民法", "Civil Code"), ("民事訴訟法", "Code of Civil Procedure"), ("消費者保護法", None)], "law_name string, law_name_en string")
    names = spark.createDataFrame([("民法",), ("民訴",), ("民事訴訟發",), ("civlcode",), ("某某",), ("",), (None,)], "n string")
    spellings = orphans.statute_spellings(statutes)
    whole = sorted(tuple(r) for r in orphans.statutes_named(names, spellings).collect())
    assert whole == sorted(tuple(r) for r in orphans.statutes_named(names, spellings, 20).collect())
    assert whole == [("civlcode", "民法"), ("民事訴訟發", "民事訴訟法"), ("民法", "民法"), ("民訴", "民事訴訟法")]


def test_legal(spark):
    statutes = spark.createDataFrame([("民法__第_1_條", "民法", "Civil Code", "第 1 條", day(0), None), ("民法__第_2_條", "民法", "Civil Code", "第 2 條", day(0), day(3)), ("民法__第_3-1_條", "民法", "Civil Code", "第 3-1 條", day(9), None)],
        "chunk_id string, law_name string, law_name_en string, article_no string, loaded_at timestamp, deleted_at timestamp")
    analyses = spark.createDataFrame([(1, ["民法第一條", "civil code art.2", " 民法第3條之1", "民法第9條第1項", "刑法第1條", "", None, "無"], day(5)), (1, ["民法第一條"], day(5)), (2, None, day(5)), (3, ["民法第9條"], None)],
        "analysis_id bigint, cited_articles array<string>, created_at timestamp")
    queries = spark.createDataFrame([("q", ["A,1,訴,2__理由_0", "A,1,訴,2__理由_1", "A,1,訴,2__理由_2", "民法__第_1_條"], day(5)), ("r", [], day(5))], "id string, relevant_ids array<string>, created_at timestamp")
    chunks = spark.createDataFrame([("A,1,訴,2__理由_0", day(1)), ("A,1,訴,2__理由_0", day(8)), ("A,1,訴,2__理由_1", day(8))], "chunk_id string, ingested_at timestamp")
    found = orphans.legal_orphans(analyses, queries, statutes, chunks)
    assert {tuple(r) for r in found.collect()} == {
        ("clause_analyses", "2025-01", "1", "civil code art.2", "deleted"), ("clause_analyses", "2025-01", "1", " 民法第3條之1", "later"),
        ("clause_analyses", "2025-01", "1", "民法第9條第1項", "missing"), ("clause_analyses", "unknown", "3", "民法第9條", "missing"),
        ("gold_queries", "2025-01", "q", "A,1,訴,2__理由_1", "later"), ("gold_queries", "2025-01", "q", "A,1,訴,2__理由_2", "missing"),
    }
    assert {tuple(r)[3:] for r in orphans.orphan_counts(found, "src_table", "month_key").where("reason = 'missing' and month_key = '2025-01'").collect()} == {(1, 1)}
    assert orphans.legal_orphans(analyses.limit(0), queries.limit(0), statutes.limit(0), chunks.limit(0)).collect() == []
