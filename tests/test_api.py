from pyspark.sql import functions as F

from lexmill.api import Engine


def test_engine(spark, tmp_path):
    # a toy embedder: counts of three characters
    embed = lambda c: F.array(*(F.length(F.regexp_replace(c, f"[^{x}]", "")).cast("double") for x in "租押修"))
    texts = [(1, "民法第421條", "租租租"), (2, "民法第429條", "修修租"), (3, "民法第247-1條", "押押")]
    statutes = spark.createDataFrame(texts, "vec_id bigint, article string, text string").withColumn("embedding", embed(F.col("text")))
    judgements = statutes.where("vec_id < 3")
    engine = Engine(spark, statutes, judgements, embed)
    queries = spark.createDataFrame([(10, "租金租金"), (11, "修繕依民法第247-1條")], "query_id bigint, text string")
    hits = {(r["query_id"], r["rk"]): r["vec_id"] for r in engine.retrieve(queries, 2, boost=1.0).collect()}
    assert hits[10, 1] == 1 and hits[11, 1] == 3
    cross = {r["query_id"]: r["cross"] for r in engine.triangulate(queries).collect()}
    assert set(cross[10]) == {"民法第421條", "民法第429條"}
    done = engine.judge(engine.analyse(queries))
    assert {r["source"] for r in done.collect()} == {"mock"} and engine.health().first()["model"] == "mock"
    (tmp_path / "a.txt").write_text("第一條 租金每月給付新臺幣一萬元。\n第二條 押金為二個月租金總額。\n第三條 承租人應將房屋返還出租人。", encoding="utf-8")
    assert engine.clauses(engine.upload(str(tmp_path))).count() == 3
