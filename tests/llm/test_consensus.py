import random

from lexmill.llm import consensus as c


def test_labels(spark):
    rows = [(" Supported.",), ("PARTIAL",), ("not hallucination",), (None,), ("  ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(c.clean_label("x")).collect()]
    assert got == ["supported", "partial", "not_hallucination", None, ""]


def simulate(seed, items=400):
    rng = random.Random(seed)
    accuracy = [0.95, 0.9, 0.85, 0.4, 0.38, 0.36, 0.35, 0.34]
    truth = {f"i{i}": rng.choice("abc") for i in range(items)}
    votes = []
    for item, label in truth.items():
        for rater in rng.sample(range(8), 5):
            said = label if rng.random() < accuracy[rater] else rng.choice([x for x in "abc" if x != label])
            votes.append(("t", item, f"r{rater}", said, None))
    return truth, votes, accuracy


def test_better_than_majority_and_near_the_optimum(spark):
    import math
    from collections import defaultdict

    truth, votes, accuracy = simulate(1)
    frame = spark.createDataFrame(votes + votes[:30], "task string, item string, rater string, label string, at timestamp")
    labels = spark.createDataFrame([("t", x) for x in "abc"], "task string, label string")
    items = spark.createDataFrame([("t", i) for i in [*truth, "none"]], "task string, item string")
    found, raters = c.consensus(frame, items, labels)
    got = {r["item"]: r["label"] for r in found.collect()}
    plain, best = defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(float))
    for _, item, rater, label, _ in votes:
        p = accuracy[int(rater[1:])]
        plain[item][label] += 1
        best[item][label] += math.log(2 * p / (1 - p))
    right = lambda of: sum(of[i] == x for i, x in truth.items())
    top = lambda s: {i: max(v, key=v.get) for i, v in s.items()}
    assert right(got) > right(top(plain)) + 15 and right(got) >= right(top(best)) - 8
    assert len(got) == len(truth) + 1 and got["none"] in "abc"
    for r in raters.collect():
        assert abs(r["reliability"] - accuracy[int(r["rater"][1:])]) < 0.1


def test_alpha(spark):
    # a published example with missing ratings: alpha = 0.691
    a = [None, None, None, None, None, 3, 4, 1, 2, 1, 1, 3, 3, None, 3]
    b = [1, None, 2, 1, 3, 3, 4, 3, None, None, None, None, None, None, None]
    d = [None, None, 2, 1, 3, 4, 4, None, 2, 1, 1, 3, 3, None, 4]
    rows = [("t", str(i), r, str(x)) for r, row in (("A", a), ("B", b), ("C", d)) for i, x in enumerate(row) if x]
    got = c.alpha(spark.createDataFrame(rows, "task string, item string, rater string, label string")).first()
    assert abs(got["alpha"] - 0.691) < 0.001


def test_project(spark):
    models = spark.createDataFrame([("s1", "Supported.", "partial"), ("s2", None, " ")], "sample_id string, gpt_5_mini string, gpt_4o string")
    check = spark.createDataFrame([("k1", "Hallucination", 1, 0), ("k2", None, 0, 0)], "item_key string, human_label string, human_hall int, judge_hall int")
    more = spark.createDataFrame([("s1", "r1", "SUPPORTED ", None), ("s1", "r1", "SUPPORTED ", None), ("k1", "r1", "Hallucination", None), ("s1", "r2", "skip", None), ("s9", "r2", "partial", None), (None, None, None, None)], "item_id string, rater_id string, label string, voted_at timestamp")
    votes, items, labels = c.project_votes(models, check, more)
    assert len(c.one_vote(votes).collect()) == 9
    got = {r["item"]: r["label"] for r in c.consensus(votes, items, labels)[0].collect()}
    assert got["s1"] == "supported" and got["k1"] == "hallucination" and got["k2"] == "not_hallucination" and set(got) == {"s1", "s2", "k1", "k2"}
    assert c.consensus(votes.limit(0), items.limit(0), labels)[0].collect() == []


def frames(spark, votes, truth):
    frame = spark.createDataFrame(votes, "task string, item string, rater string, label string, at timestamp")
    labels = spark.createDataFrame([("t", x) for x in "abc"], "task string, label string")
    return frame, spark.createDataFrame([("t", i) for i in truth], "task string, item string"), labels


def test_own_vote_is_left_out():
    import numpy as np

    # three annotators of weight 1, 2 and 4 on one item of three labels
    weights = np.array([1.0, 2.0, 4.0])
    args = (np.array([0, 1, 2]), np.array([0, 0, 1]), np.zeros(3, int), np.full(3, 3))
    num, den = c.left_out(*args, weights)
    for i, scores in enumerate(([2.0, 4.0, 0.0], [1.0, 4.0, 0.0], [3.0, 0.0, 0.0])):
        q = np.exp(max(scores)) / np.exp(scores).sum()
        r = (1 - q) / 2
        agrees = float(np.argmax(scores) == args[1][i])
        assert abs(num[i] - (q - r) * (agrees - r)) < 1e-12 and abs(den[i] - (q - r) ** 2) < 1e-12
    # the weight of an annotator's own vote doesn't change what is said of that vote
    again, _ = c.left_out(*args, np.array([1.0, 2.0, 40.0]))
    assert again[2] == num[2] and again[0] != num[0]


def test_held_and_joined_rounds_agree(spark):
    truth, votes, _ = simulate(3, 150)
    votes += [("t", "i0", f"x{j}", "abc"[j % 3 and 1], None) for j in range(40)]
    given = frames(spark, votes, truth)
    seen = []
    for how in ({}, {"held": 0}, {"together": 20}):
        labels, raters = c.consensus(*given, **how)
        seen.append(({r["item"]: r["label"] for r in labels.collect()}, {r["rater"]: round(r["reliability"], 6) for r in raters.collect()}, {r["stable"] for r in raters.collect()}))
    assert seen[0] == seen[1] == seen[2] and seen[0][2] == {True}


def test_reweighting_is_what_decides(spark):
    # one good annotator against two that err alike: the plain majority follows the two
    truth, votes, _ = simulate(5)
    found, _ = c.consensus(*frames(spark, votes, truth))
    rounds, c.ROUNDS = c.ROUNDS, 1
    try:
        once, _ = c.consensus(*frames(spark, votes, truth))
        right = lambda rows: sum(truth.get(r["item"]) == r["label"] for r in rows.collect())
        assert right(found) > right(once)
    finally:
        c.ROUNDS = rounds


def test_one_label_and_lone_votes(spark):
    frame = spark.createDataFrame([("one", "i", "r", "x", None), ("two", "j", "r", "a", None)], "task string, item string, rater string, label string, at timestamp")
    labels = spark.createDataFrame([("one", "x"), ("two", "a"), ("two", "b")], "task string, label string")
    found, raters = c.consensus(frame, spark.createDataFrame([("one", "i"), ("two", "j"), (None, "j")], "task string, item string"), labels)
    assert sorted((r["item"], r["label"]) for r in found.collect()) == [("i", "x"), ("j", "a")]
    assert {r["task"]: round(r["reliability"], 2) for r in raters.collect()} == {"one": 1.0, "two": 0.7}
