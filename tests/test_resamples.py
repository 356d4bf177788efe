import numpy as np

from lexmill.operators import statistics as st


def test_the_ends_of_the_interval_hardly_depend_on_the_seed(spark):
    v = np.random.default_rng(5).normal(0, 1000, 400)
    rows = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double").coalesce(1)
    ends = [st.bootstrap_ci(rows, "v", ["g"], seed=seed).first() for seed in range(8)]
    noise = np.std([x["lo"] for x in ends] + [-x["hi"] + ends[0]["hi"] + ends[0]["lo"] for x in ends]) / (v.std() / 20)
    assert noise < 0.05
