import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import spans


def brute(docs, least):
    runs = {}
    for key, text in docs:
        for i in range(len(text or "") - least + 1):
            runs.setdefault(text[i : i + least], set()).add(key)
    return {(a, b) for keys in runs.values() for a in keys for b in keys if a < b}


def make(seed, n=60):
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice("租約第條甲乙 ab,。😀") for _ in range(m))
    shared = [word(rng.randrange(150, 190)) for _ in range(8)] + ["ab" * 100, "租" * 200]
    docs = [(0, None), (1, ""), (2, "短")]
    for key in range(3, n):
        docs.append((key, word(rng.randrange(200)) + rng.choice(shared) + word(rng.randrange(100)) + rng.choice([*shared, ""])))
    docs += [(n, docs[7][1]), (n + 1, docs[7][1]), (n + 2, word(5000))]
    return docs


def test_pairs_equal_brute_force(spark):
    docs = make(1)
    frame = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, h string")
    found = {tuple(r) for r in spans.shared_span_pairs(frame).collect()}
    assert found == brute(docs, 160) and len(found) > 50


def test_share_equals_brute_force(spark):
    docs = make(2, 30)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(frame).collect()}
    runs = {}
    for key, text in docs:
        for i in range(len(text or "") - 159):
            runs.setdefault(text[i : i + 160], set()).add(key)
    for key, text in docs:
        mask = np.zeros(len(text or ""), bool)
        for i in range(len(text or "") - 159):
            if len(runs[text[i : i + 160]]) > 1:
                mask[i : i + 160] = True
        assert got[key] == mask.sum(), key


def test_edges_survive_segments(monkeypatch):
    text = make(3)[-1][1]
    whole = list(zip(*(x.tolist() for x in spans.token_edges([text, text[700:2700]]))))
    monkeypatch.setattr(spans, "SEGMENT", 300)
    assert list(zip(*(x.tolist() for x in spans.token_edges([text, text[700:2700]])))) == whole and len(whole) > 200


def test_every_run_holds_a_common_edge():
    rng = random.Random(4)
    for _ in range(300):
        word = lambda m: "".join(rng.choice(rng.choice(("ab", "租約第條甲乙"))) for _ in range(m))
        run = word(160)
        a, b = (spans.token_edges([word(rng.randrange(90)) + run + word(rng.randrange(90))])[4] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


def test_paths_are_compacted(spark):
    rng = random.Random(5)
    word = lambda m: "".join(rng.choice("租約第條甲乙丙丁戊己") for _ in range(m))
    long, tail = word(900), word(400)
    docs = [(1, word(50) + long + word(60)), (2, word(33) + long + tail), (3, word(44) + long + tail + word(20))]
    paths = spans.SpanGraph(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 160).paths.collect()
    edges = {h for _, t in docs for h in spans.token_edges([t])[4].tolist()}
    by_visits = sorted((p["n_visits"], p["chars"]) for p in paths)
    # one path of all three texts and one of two, as the graph branches once
    assert len(paths) == 2 and [v for v, _ in by_visits] == [2, 3] and 800 < by_visits[1][1] <= 900 and len(edges) > sum(p["n_edges"] for p in paths) > 60


def test_classes_hold_what_pairs_hold(spark):
    docs = make(6)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in spans.shared_classes(frame).collect()}
    assert set(rows) == {k for k, _ in docs}
    true = brute(docs, 160)
    linked = {(rows[a]["class_id"], rows[b]["class_id"]) for a, b in true if rows[a]["class_id"] != rows[b]["class_id"]}
    linked = {tuple(sorted(x)) for x in linked}
    for key, r in rows.items():
        assert r["n_links"] == sum(r["class_id"] in x for x in linked), key
        assert r["n_copies"] == sum(o["class_id"] == r["class_id"] for o in rows.values())


def test_equal_fingerprints_of_different_runs(spark, monkeypatch):
    # a fingerprint that can't tell runs apart must not make pairs: characters decide
    docs = make(7, 25)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    graph = spans.SpanGraph(frame, "doc_id", "text", 160)
    real = spans.run_prints
    monkeypatch.setattr(spans, "run_prints", lambda *a, **k: real(*a, **k).withColumn("fp", F.lit(7).cast("bigint")))
    found = {tuple(r) for r in spans.representative_pairs(graph).collect()}
    extra = {r["doc"] for r in graph.copies.where("doc <> rep").collect()}
    assert found <= {p for p in brute(docs, 160) if not extra & set(p)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_span_pairs(empty).collect() == []
    assert spans.shared_share(empty).collect() == []
