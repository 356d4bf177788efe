import json

from pyspark.sql import functions as F

from lexmill.operators import audit, embedding, graph
from lexmill.operators import model_steps as m
from lexmill.streaming import clauses as s


def test_pairs_of_modes(spark):
    rows = [("i1", "a", 1.0), ("i1", "b", 2.0), ("i2", "a", 3.0), ("i3", "b", 1.0), ("i3", "c", 0.0), ("i4", "a", None), ("i4", "b", 1.0), (None, "a", 1.0), (None, "b", 1.0)]
    frame = spark.createDataFrame(rows, "item string, mode string, v double")
    got = {tuple(r) for r in audit.paired(frame, "item", "mode", "v", [("a", "b"), ("b", "c")]).collect()}
    assert got == {("a", "b", "i1", 1.0, 2.0), ("b", "c", "i3", 1.0, 0.0)}
    assert audit.paired(frame.limit(0), "item", "mode", "v", [("a", "b")]).collect() == []


def test_summary_leaves_out_the_stand_in(spark):
    frame = spark.createDataFrame([("x", "live", 1.0), ("x", "mock", 0.0), ("x", None, 0.5), ("y", "mock", 1.0)], "mode string, source string, f double")
    got = {r["mode"]: tuple(r)[1:] for r in audit.mode_summary(frame, "mode", "source", {"f": "mean_f"}).collect()}
    assert got == {"x": (3, 1, 2, 0.75), "y": (1, 1, 0, None)}


def test_audit_by_a_client_that_reads_the_prompt(spark):
    rows = spark.createDataFrame([(1, ["民法第1條", "民法第9條", "刑法第2條"], ["民法第1條"]), (2, [], None)], "id int, claims array<string>, evidence array<string>")
    got = {r["id"]: r for r in m.audit(rows, audit.audit_prompt(F.col("claims"), F.col("evidence")), audit.EvidenceClient).collect()}
    assert (got[1]["n_supported"], got[1]["n_partial"], got[1]["n_unsupported"], got[1]["source"]) == (1, 1, 1, "live")
    assert (got[2]["n_supported"], got[2]["n_unsupported"]) == (0, 0)


def test_debate_answers_what_was_said_before(spark):
    rows = spark.createDataFrame([(1, "claim")], "id int, claim string")
    said = m.debate(rows, F.col("claim"), audit.EchoClient).first()["objections"]
    assert len(said) == 3 and len(set(said)) == 3  # each prompt holds the objections before it


def test_boost_only_where_an_article_is_named(spark):
    hits = [{"chunk_id": f"c{i}", "score": 1 - i / 10} for i in range(6)]
    rows = spark.createDataFrame([("named", hits, ["c4"]), ("none", hits, None), ("empty", None, ["c4"])], "q string, hits array<struct<chunk_id string, score double>>, keys array<string>")
    top = audit.pooled_hits(F.col("hits"), F.col("keys"), lambda c: c, 2)
    got = {r["q"]: [h["chunk_id"] for h in r["top"] or []] for r in rows.select("q", top.alias("top")).collect()}
    assert got["none"] == ["c0", "c1"] and got["empty"] == []
    raised = audit.pooled_hits(F.col("hits"), F.col("keys"), lambda c: c, 2, weight=0.45)
    assert [h["chunk_id"] for h in rows.where("q = 'named'").select(raised.alias("top")).first()["top"]] == ["c4", "c0"]


def test_texts_for_an_audit(spark):
    rows = spark.sql("SELECT named_struct('issue', 'i', 'rule', '', 'application', CAST(NULL AS STRING)) AS a, 'c' AS c, array('s', NULL, 't') AS g, array(named_struct('head', 'h', 'content', repeat('x', 700))) AS hits")
    got = rows.select(audit.analysis_text(F.col("a"), F.col("c"), F.col("g")).alias("t"), audit.hits_text(F.col("hits"), "none").alias("h"), audit.hits_text(F.array().cast("array<struct<head:string,content:string>>"), "none").alias("e")).first()
    assert got["t"] == "### Issue\ni\n\n### Conclusion\nc\n\n### Suggestions\n- s\n- t" and got["h"] == "[1] h\n" + "x" * 600 and got["e"] == "none"


def test_embedder_is_asymmetric_and_of_unit_length(spark):
    rows = spark.createDataFrame([(1, "租賃契約"), (2, None), (3, " "), (4, "租賃契約")], "id int, t string")
    e = embedding.HashEmbedder(passage_prefix="passage: ", query_prefix="query: ")
    got = {r["id"]: r["embedding"] for r in embedding.embedded(rows, "id", "t", e).collect()}
    asked = {r["id"]: r["embedding"] for r in embedding.embedded(rows, "id", "t", e, "query").collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] != asked[1]
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9
    assert embedding.embedded(rows.limit(0), "id", "t", e).collect() == []


def test_reranker(spark):
    pool = spark.createDataFrame([("q", "a", "修繕房屋", "無關"), ("q", "b", "修繕房屋", "房屋應修繕"), ("q", "c", "修繕房屋", None), ("r", "a", None, "x")], "query_id string, vec_id string, query_text string, text string")
    got = [(r["query_id"], r["vec_id"], r["rk"]) for r in embedding.reranked(pool, 2, "vec_id", embedding.OverlapReranker()).collect()]
    assert sorted(got) == [("q", "a", 2), ("q", "b", 1), ("r", "a", 1)]


def test_large_groups_make_their_pairs_in_blocks(spark):
    rows = spark.createDataFrame([(g, f"i{i}") for g, n in ((1, 30), (2, 5), (3, 1)) for i in range(n)] + [(2, "i0"), (None, "i1"), (1, None)], "g int, i string")
    one, blocks = ({tuple(r) for r in graph.pair_edges(rows, "g", "i", block=b).collect()} for b in (256, 4))
    assert one == blocks and len(one) == 435 and ("i0", "i1", 2) in one


def test_ordered_stream_and_budget(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1, "b"), ("d1", 0, "a"), ("d2", 0, "c")], "doc string, clause_index int, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = s.event_stream(spark, str(tmp_path / "in"), rows.schema)
    s.ordered_stream(stream, "doc", "clause_index", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [(r["doc"], r["position"], r["event"], json.loads(r["payload"])) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["doc"] == "d1"]
    assert [(p, e) for _, p, e, _ in got] == [(0, "clause"), (1, "clause"), (2, "done")] and got[-1][3] == {"count": 2}
    calls = [s.budgeted(rows, str(tmp_path / "done"), ["doc", "clause_index"], 2, lambda part: part.select("doc", "clause_index")) for _ in range(3)]
    assert calls == [2, 1, 0]


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    first = spark.createDataFrame([(i, 1, "old") for i in range(20)], "k int, at int, v string")
    more = spark.createDataFrame([(3, 2, "new"), (3, 0, "late")], "k int, at int, v string")
    first.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    target, check = str(tmp_path / "table"), str(tmp_path / "check")
    read = lambda: s.event_stream(spark, str(tmp_path / "in" / "*"), first.schema)
    s.upsert(read(), target, ["k"], ["at"], check, buckets=4).awaitTermination()
    more.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    s.upsert(read(), target, ["k"], ["at"], check, buckets=4).awaitTermination()
    versions = s._versions(spark, target)
    assert sum(len(v) == 2 for v in versions.values()) == 1 and len(versions) == 4
    got = {r["k"]: r["v"] for r in s.newest(spark, target, first.schema).collect()}
    assert len(got) == 20 and got[3] == "new" and set(got.values()) == {"old", "new"}


def test_judged_claims_leave_out_advice_and_blanks(spark):
    answer = json.dumps({"claims": [{"claim": "a", "status": "Supported"}, {"claim": " ", "status": "partial"}, {"claim": "b", "status": "advisory"}, {"claim": "c", "status": None}]})
    rows = spark.createDataFrame([(1, f"```json\n{answer}\n```"), (2, "no json"), (3, None)], "id int, answer string")
    assert [tuple(r) for r in audit.judged_claims(rows).collect()] == [(1, "a", "supported")]
