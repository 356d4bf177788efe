import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluation as ev
from lexmill.operators import graph as g
from lexmill.operators import model_steps as m
from lexmill.operators import retrieval as rt
from lexmill.operators import statistics as st
from lexmill.operators.pairs import pairs_in_groups


def test_pairs_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(60)) for _ in range(300)] + [(None, 1), ("a", None)]
    want = set()
    for key in "ab":
        want |= set(itertools.combinations(sorted({i for k, i in rows if k == key and i is not None}), 2))
    frame = spark.createDataFrame(rows, "k string, i int")
    for block in (4, 1000):
        assert {tuple(r) for r in pairs_in_groups(frame, ["k"], "i", block).collect()} == want


@pytest.mark.parametrize("block", [4096, 3])
def test_exact_topk(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(80, 5)), 1)
    v[10] = v[11]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = {(r["query_id"], r["rk"]): r["vec_id"] for r in rt.exact_topk(frame.where("vec_id % 10 = 0"), frame, 4).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 80, 10):
        order = sorted((i for i in range(80) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4]
        assert [got[q, k + 1] for k in range(4)] == order
    assert rt.exact_topk(frame.limit(0), frame, 4).collect() == []


def test_boosts(spark):
    pool = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.75, 3)], "query_id int, id int, score double, rk int")
    assert [r["id"] for r in rt.boosted(pool.drop("rk"), F.col("id") == 12, 2, "id").orderBy("rk").collect()] == [12, 10]
    edges = spark.createDataFrame([(10, 12, 5), (10, 11, 1)], "a int, b int, w int")
    assert [r["id"] for r in rt.edge_boosted(pool, edges, 3, "id").orderBy("rk").collect()] == [12, 10, 11]
    none = rt.edge_boosted(pool, edges.limit(0), 3, "id").orderBy("rk").collect()
    assert [r["id"] for r in none] == [10, 11, 12]


def test_ir_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (3, "y", 1)], "query_id int, id string, rk int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z"), (2, "q")], "query_id int, id string")
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    got = {r["query_id"]: r for r in ev.ir_metrics(hits, relevant, "id", 3, queries).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    assert tuple(got[1])[2:] == (2, 0.6667, 0.6667, 0.5, round(dcg / (1 + 1 / math.log2(3)), 4), round(dcg / (1 + 1 / math.log2(3) + 0.5), 4))
    assert all(tuple(got[q])[2:] == (0, 0, 0, 0, 0, 0) for q in (2, 3, 4))


def test_set_scores(spark):
    rows = spark.createDataFrame([(["a", "b", "a", None], ["b", "c"]), ([], None), (None, ["x"])], "c array<string>, t array<string>")
    got = [tuple(r) for r in rows.select(*ev.set_scores(F.col("c"), F.col("t"))).collect()]
    assert got[0] == (["b"], ["a"], ["c"], 0.5, 0.5, 0.5) and got[1] == ([], [], [], 0, 0, 0) and got[2] == ([], [], ["x"], 0, 0, 0)


def test_existence_and_resolve(spark):
    cited = spark.createDataFrame([("r1", "民法第1條"), ("r2", "民法第9條"), ("r3", None)], "raw string, canonical string")
    real = spark.createDataFrame([("民法第1條",), ("民法第1條",)], "canonical string")
    assert sorted((r["raw"], r["status"]) for r in ev.existence(cited, real).collect()) == [("r1", "real"), ("r2", "nonexistent"), ("r3", "vague")]
    texts = spark.createDataFrame([("r1", "A"), ("民法第9條", "B"), ("r1", "Z")], "key string, content string")
    assert sorted((r["raw"], r["content"]) for r in ev.resolve(cited, texts).collect()) == [("r1", "A"), ("r2", "B"), ("r3", "(not found)")]


@pytest.mark.parametrize("a,b,degenerate,value", [("xyxy", "xyxy", 1.0, 1.0), ("xyxy", "xxyy", 1.0, 0.0), ("xxxx", "xxxx", 1.0, 1.0), ("xxxx", "xxxx", 0.0, 0.0)])
def test_kappa(spark, a, b, degenerate, value):
    rows = spark.createDataFrame([*zip(a, b), ("x", None)], "a string, b string")
    assert st.kappa(rows, "a", "b", degenerate=degenerate).first()["kappa"] == value
    assert st.kappa(rows.limit(0), "a", "b").collect() == []


def test_significance(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [2.0, 2.0, 5.0, 3.0, 9.0, 11.0, 6.0, 14.0]
    rows = spark.createDataFrame([("g", x, y) for x, y in zip(a, b)], "g string, a double, b double")
    got = st.wilcoxon(rows, "a", "b", ["g"]).first()
    # differences 1 0 2 -1 4 5 -1 6: ranks of |d| 2 4 2 5 6 2 7
    assert (got["n_pos"], got["n_neg"], got["w"], got["r"]) == (5, 2, 4.0, round(3 / 7, 4))
    var = 7 * 8 * 15 / 24 - (27 - 3) / 48
    assert abs(got["z"] - round((4 - 14) / math.sqrt(var), 4)) < 1e-9 and abs(got["p"] - math.erfc(-(4 - 14) / math.sqrt(var) / math.sqrt(2))) < 1e-5
    flags = spark.createDataFrame([("g", True, False)] * 7 + [("g", False, True)] * 2 + [("g", True, True)] * 5 + [("h", True, True)], "g string, a boolean, b boolean")
    mc = {r["g"]: r for r in st.mcnemar(flags, "a", "b", ["g"]).collect()}
    assert (mc["g"]["b01"], mc["g"]["b10"], mc["g"]["p"]) == (7, 2, round(2 * sum(math.comb(9, i) for i in range(3)) / 512, 6)) and mc["h"]["p"] is None
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")
    assert {r["t"]: round(r["p_holm"], 6) for r in st.holm(tests, "p", "t").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_icc_and_correlation(spark):
    # Shrout and Fleiss (1979): ICC(2,1) = .29, ICC(2,k) = .62
    table = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    rows = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(table) for j, v in enumerate(r)] + [(99, 0, 1.0)], "t int, r int, v double")
    got = st.icc(rows, "t", "r", "v").first()
    assert (got["n_targets"], got["icc_2_1"], got["icc_2_k"]) == (6, 0.2898, 0.6201)
    pair = spark.createDataFrame([("g", float(x), float(x * x)) for x in (1, 2, 2, 3, 7)], "g string, a double, b double")
    c = st.correlations(pair, "a", "b", ["g"]).first()
    assert c["spearman"] == 1.0 and c["pearson"] == round(float(np.corrcoef([1, 2, 2, 3, 7], [1, 4, 4, 9, 49])[0, 1]), 4)


def test_bootstrap(spark):
    v = np.random.default_rng(5).normal(3, 2, 4000)
    rows = spark.createDataFrame([("g", float(x)) for x in v] + [("g", None)], "g string, v double").repartition(3)
    got = st.bootstrap_ci(rows, "v", ["g"]).first()
    half = 1.96 * v.std() / math.sqrt(len(v))
    assert got["n"] == 4000 and abs(got["mean"] - v.mean()) < 1e-3 and abs(got["hi"] - v.mean() - half) < 0.015 and abs(v.mean() - got["lo"] - half) < 0.015


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(100)], "k int, s string").repartition(5)
    assert sorted(r["k"] for r in st.systematic_sample(rows, ["k"], 7).collect()) == list(range(0, 100, 7))
    got = st.round_robin_sample(rows, "s", "k", F.when(F.col("s") == "c", 0).otherwise(1), 7).collect()
    assert Counter(r["s"] for r in got) == {"c": 3, "a": 2, "b": 2}
    placed = st.global_row_number(rows, ["s", "k"], "n").collect()
    assert [r["n"] for r in sorted(placed, key=lambda r: (r["s"], r["k"]))] == list(range(1, 101))


TRIANGLES = [("a", "b", 3), ("b", "c", 3), ("a", "c", 3), ("x", "y", 4), ("y", "z", 4), ("x", "z", 4), ("c", "x", 1)]


def test_graph(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, None), (None, "a")], "g int, i string")
    assert {tuple(r) for r in g.pair_edges(items, "g", "i").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    edges = spark.createDataFrame(TRIANGLES, "a string, b string, w int")
    ranks = {r["node"]: r["rank"] for r in g.pagerank(edges, rounds=60).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["x"] > ranks["y"] and abs(ranks["y"] - ranks["z"]) < 1e-9
    assert {r["node"]: r["component"] for r in g.components(edges.where("w > 1")).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    want = {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert g.louvain(TRIANGLES) == want
    assert {r["node"]: r["community"] for r in g.communities(edges).collect()} == want


def test_long_chain_settles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a int, b int")
    assert {r["component"] for r in g.components(chain, 20).collect()} == {0}


def test_label_propagation_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(g, "COMMUNITY_EDGES", 1)
    edges = spark.createDataFrame(TRIANGLES, "a string, b string, w int")
    assert len({r["community"] for r in g.communities(edges).collect()}) <= 3


def test_suggestions(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("a", "c", 5), ("c", "d", 50), ("b", "e", 1)], "a string, b string, w int")
    cited = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "unknown"), (4, "e"), (4, "b"), (4, "a")], "query_id int, article string")
    lift = {(r["query_id"], r["article"]): r for r in g.suggest_missed(edges, cited).collect()}
    assert lift[1, "b"]["rk"] == 1 and lift[1, "c"]["score"] == round(5 / math.sqrt(10 * 55), 6) and lift[1, "b"]["anchor"] == "a"
    assert (3, "a") not in lift and {k for k in lift if k[0] == 4} == {(4, "c")}
    count = {(r["query_id"], r["article"]): r["score"] for r in g.suggest_missed(edges, cited, rank_by="count").collect()}
    assert count[1, "b"] == count[1, "c"] == 5


def test_model_steps(spark):
    class Client:
        def complete(self, prompt):
            if "fail" in prompt:
                raise m.Retryable
            return 'ok ```{"label": "partial", "score": 9, "claims": [{"status": "Supported"}]}```'

    rows = spark.createDataFrame([(1, "x"), (2, "fail")], "id int, t string")
    got = {r["id"]: r for r in m.classify(rows, F.col("t"), ["supported", "partial"], Client, wait=0.0).collect()}
    assert (got[1]["label"], got[1]["source"]) == ("partial", "live") and (got[2]["label"], got[2]["source"]) == ("supported", "mock")
    assert [r["score"] for r in m.rubric(rows.where("id = 1"), F.col("t"), Client).collect()] == [None]
    assert [r["n_supported"] for r in m.audit(rows.where("id = 1"), F.col("t"), Client).collect()] == [1]
    assert m.analyse(rows, F.col("t")).where("source = 'mock' and result.risk_level = 'medium'").count() == 2
    assert m.debate(rows, F.col("t")).first()["objections"] == ["mock 1", "mock 2", "mock 3"]
    with pytest.raises(Exception):
        m.classify(rows, F.col("t"), ["a"], Client, wait=0.0, fall_back=False).collect()
