import itertools
import math
import random

from lexmill.operators import statistics as st


def brute_p(d):
    m = [abs(x) for x in d]
    rank = [sum(y < x for y in m) + (sum(y == x for y in m) + 1) / 2 for x in m]
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    w = min(sum(r for r, x in zip(rank, d) if x > 0), sum(r for r, x in zip(rank, d) if x < 0))
    return min(1.0, 2 * sum(s <= w for s in sums) / len(sums))


def test_signed_rank_p_is_exact_for_few(spark):
    rng = random.Random(2)
    groups = {g: [rng.choice([-3, -2, -1, 1, 2, 2, 3, 4]) for _ in range(n)] for g, n in (("a", 6), ("b", 9), (None, 4))}
    rows = [(g, 0.0, float(x)) for g, d in groups.items() for x in d] + [("a", 1.0, 1.0)]
    got = {r["g"]: r["p_exact"] for r in st.wilcoxon(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert set(got) == set(groups) and all(abs(got[g] - brute_p(d)) < 1e-6 for g, d in groups.items())


def test_mcnemar_exact_and_large(spark):
    rows = [("few", True, False)] * 3 + [("few", False, True)] * 9 + [("none", True, True)] + [("many", True, False)] * 1500 + [("many", False, True)] * 1600
    got = {r["g"]: r["p"] for r in st.mcnemar(spark.createDataFrame(rows, "g string, a boolean, b boolean"), "a", "b", ["g"]).collect()}
    exact = lambda n, low: min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
    assert got["none"] is None and abs(got["few"] - exact(12, 3)) < 1e-6 and abs(got["many"] - exact(3100, 1500)) < 1e-6


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([("g", round(rng.gauss(0, 1), 2)) for _ in range(300)] + [("h", 1.0), ("h", None)], "g string, v double")
    one, many = ([tuple(r) for r in st.bootstrap_ci(rows.repartition(n), "v", ["g"]).orderBy("g").collect()] for n in (1, 7))
    assert one == many and one[1] == ("h", 1, 1.0, 1.0, 1.0)
