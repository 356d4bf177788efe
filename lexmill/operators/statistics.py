"""Agreement and significance, as aggregations; nothing is gathered into one task but single-row results."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kappa(rows: DataFrame, a: str, b: str, by: list[str] | None = None, degenerate: float = 1.0) -> DataFrame:
    """Cohen's kappa of two label columns; rows with a null label are left out. `degenerate` is the value where chance agreement is 1."""
    by = by or []
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    total = pairs.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy(*by, F.col("x").alias("l")).agg(F.sum("c").alias("cx")), pairs.groupBy(*by, F.col("y").alias("l")).agg(F.sum("c").alias("cy"))
    chance = left.join(right, [*by, "l"]).groupBy(*by).agg(F.sum(F.col("cx").cast("double") * F.col("cy")).alias("exy"))
    joined = total.join(chance, by, "left") if by else total.join(chance, F.lit(True), "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("exy", F.lit(0.0)) / (F.col("n") * F.col("n"))
    value = F.when(pe == 1, F.lit(degenerate)).otherwise((po - pe) / (1 - pe))
    return joined.where("n > 0").select(*by, F.col("n").cast("bigint").alias("n"), F.round(po, 4).alias("agreement"), F.round(value, 4).alias("kappa"))


def confusion(rows: DataFrame, human: str, judge: str) -> DataFrame:
    """tp, tn, fp, fn of two 0/1 columns and the marginal rates; null votes are left out."""
    h, j = F.col(human) == 1, F.col(judge) == 1
    n = F.count(F.lit(1))
    return rows.where(F.col(human).isNotNull() & F.col(judge).isNotNull()).agg(
        n.alias("n"), F.count_if(h & j).alias("tp"), F.count_if(~h & ~j).alias("tn"), F.count_if(~h & j).alias("fp"), F.count_if(h & ~j).alias("fn"),
        F.round(F.count_if(h) / n, 4).alias("human_rate"), F.round(F.count_if(j) / n, 4).alias("judge_rate"))


def _average_rank(order: Window, peers: Window) -> Column:
    return F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2


def distributed_ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds `rank_v`, the average rank of the value within its group, through counts by distinct value.

    Rows with the same value meet in an aggregation, so a window orders distinct values only.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("rank_v", F.coalesce(F.sum("_c").over(before), F.lit(0)) + (F.col("_c") + 1) / 2)
    met = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by] + [F.col(f"l.{value}") == F.col(f"r.{value}")]
    return rows.alias("l").join(placed.select(*by, value, "rank_v", "_c").alias("r"), met).select("l.*", "rank_v", "_c")


#: Differences up to which the signed-rank distribution is counted out.
EXACT_RANKS = 25


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(ranks: pd.Series, w: pd.Series) -> pd.Series:
    """Two-sided exact p of the smaller rank sum: the share of all signs that give as small a sum, doubled."""

    def one(held, least):
        if held is None or least is None:
            return None
        steps = np.rint(np.asarray(held, float) * 2).astype(int)  # average ranks are halves
        ways = np.zeros(steps.sum() + 1)
        ways[0] = 1
        for step in steps:
            ways[step:] = ways[step:] + ways[: len(ways) - step].copy()
        return min(1.0, 2 * ways[: int(round(least * 2)) + 1].sum() / 2 ** len(steps))

    return pd.Series([one(r, x) for r, x in zip(ranks, w)], dtype=float)


def wilcoxon(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Signed-rank test of b - a per group: n_pos, n_neg, w, z (normal approximation with tie correction), r (rank-biserial by signs), p by the normal tail and p_exact. Zeros are dropped.

    p_exact counts all signs out, up to EXACT_RANKS differences; it is null beyond, where the normal tail stands for it.
    """
    d = rows.select(*by, F.round(F.col(b) - F.col(a), 9).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = distributed_ranks(d, "m", by)
    n = F.count(F.lit(1))
    ties = F.sum((F.col("_c") * F.col("_c") - 1).cast("double"))  # sum over rows of c^2 - 1 is sum over ties of c^3 - c
    agg = r.groupBy(*by).agg(F.count_if(F.col("d") > 0).alias("n_pos"), F.count_if(F.col("d") < 0).alias("n_neg"), n.alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank_v")).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col("d") < 0, F.col("rank_v")).otherwise(0.0)).alias("wn"), ties.alias("ties"))
    c = F.col
    variance = c("n") * (c("n") + 1) * (2 * c("n") + 1) / 24 - c("ties") / 48
    w = F.least("wp", "wn")
    z = F.when(variance > 0, (w - c("n") * (c("n") + 1) / 4) / F.sqrt(variance))
    tested = agg.select(*by, "n_pos", "n_neg", "n", w.alias("w"), F.round(z, 4).alias("z"), F.round((c("n_pos") - c("n_neg")) / c("n"), 4).alias("r"), two_sided(z).alias("_normal"))
    # the ranks of small groups only are gathered, at most EXACT_RANKS of each
    few = tested.where(c("n") <= EXACT_RANKS).select(*by)
    small = r.alias("r").join(few.alias("f"), [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in by], "left_semi").groupBy(*by).agg(F.collect_list("rank_v").alias("_ranks"))
    joined = tested.alias("t").join(small.alias("s"), [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by], "left")
    return joined.select(*(F.col(f"t.{k}").alias(k) for k in by), "n_pos", "n_neg", "w", "z", "r", F.round("_normal", 6).alias("p"), F.round(_signed_rank_p("_ranks", "w"), 6).alias("p_exact"))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail of z, by the complementary error function's continued approximation (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        poly = term + t * poly
    return t * F.exp(-x * x + poly)


#: Discordant pairs up to which the binomial tail is summed; beyond, the normal tail with continuity correction stands for it.
EXACT_PAIRS = 100_000


def mcnemar(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """b01 (a set, b not), b10, discordant pairs and the exact two-sided binomial p (null without any)."""
    g = rows.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b01"), F.count_if(~F.col(a) & F.col(b)).alias("b10"))
    n, low = F.col("b01") + F.col("b10"), F.least("b01", "b10")
    # each term of the tail from the one before: ln C(n, i) = ln C(n, i - 1) + ln((n - i + 1) / i)
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("tail"))

    def add(acc, i):
        term = acc["term"] + F.ln((n - i + 1) / i)
        return F.struct(term.alias("term"), (acc["tail"] + F.exp(term)).alias("tail"))

    few = F.when((low > 0) & (n <= EXACT_PAIRS), F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(few, start, add, lambda acc: acc["tail"])
    z = (F.abs(F.col("b01") - F.col("b10")) - 1) / F.sqrt(n)
    p = F.when(n == 0, None).when(n <= EXACT_PAIRS, F.least(F.lit(1.0), 2 * tail)).otherwise(two_sided(z))
    return g.select(*by, "b01", "b10", n.alias("discordant"), F.round(p, 6).alias("p"))


def holm(tests: DataFrame, p: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_holm: the running maximum of the rank-multiplied p values, at most 1; ties by label."""
    by = by or []
    order, every = Window.partitionBy(*by).orderBy(p, label), Window.partitionBy(*by)
    raised = (F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1) * F.col(p)
    up = Window.partitionBy(*by).orderBy(p, label).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_m", raised).withColumn("p_holm", F.least(F.lit(1.0), F.max("_m").over(up))).drop("_m")


def icc(ratings: DataFrame, target: str, rater: str, value: str) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of a complete (target, rater, value) table by two-way sums of squares; targets that miss a rater are left out."""
    k = ratings.select(rater).distinct().count()
    full = ratings.join(ratings.groupBy(target).agg(F.countDistinct(rater).alias("_k")).where(F.col("_k") == k).select(target), target)
    rows = full.groupBy(target).agg(F.avg(value).alias("m"))
    cols = full.groupBy(rater).agg(F.avg(value).alias("m"))
    total = full.agg(F.avg(value).alias("g"), F.var_pop(value).alias("v"), F.countDistinct(target).cast("double").alias("n"))
    ssr = rows.agg((F.var_pop("m")).alias("vr"))
    ssc = cols.agg((F.var_pop("m")).alias("vc"))
    one = total.join(ssr, F.lit(True)).join(ssc, F.lit(True))  # single rows
    n, kk = F.col("n"), F.lit(float(k))
    r, c, t = n * kk * F.col("vr"), n * kk * F.col("vc"), n * kk * F.col("v")
    msr, msc, mse = r / (n - 1), c / (kk - 1), (t - r - c) / ((n - 1) * (kk - 1))
    single = (msr - mse) / (msr + (kk - 1) * mse + kk * (msc - mse) / n)
    return one.select(n.cast("bigint").alias("n_targets"), F.lit(k).alias("n_raters"), F.round(single, 4).alias("icc_2_1"), F.round((msr - mse) / (msr + (msc - mse) / n), 4).alias("icc_2_k"))


def correlations(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson's r and Spearman's rho (average ranks) of two columns per group."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = distributed_ranks(rows.select(*by, a, b), a, by).drop("_c").withColumnRenamed("rank_v", "ra")
    ranked = distributed_ranks(ranked, b, by).drop("_c").withColumnRenamed("rank_v", "rb")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(a, b), 4).alias("pearson"), F.round(F.corr("ra", "rb"), 4).alias("spearman"))


def bootstrap_ci(rows: DataFrame, value: str, by: list[str], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, n, mean, lo, hi): percentile interval of the mean, by the Poisson bootstrap.

    Each row enters each resample a Poisson(1) number of times, hence c equal rows a Poisson(c) number, drawn
    from a hash of their columns and the seed: any partitioning gives the same interval, and equal rows cost one draw. The
    resamples are sums that partitions make locally; no group is gathered. Null values are left out, and so is a resample that draws no row.
    """
    whole = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    rows = whole.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")).withColumn("h", F.xxhash64(*by, "v"))
    keys = [f for f in rows.schema.fields if f.name in by]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), "s array<double>", "w array<double>", "n bigint", "t double"])

    def sums(batches):
        state: dict = {}
        for batch in batches:
            for key, part in batch.groupby(by, dropna=False) if by else [((), batch)]:
                s, w, n, t = state.get(key, (np.zeros(resamples), np.zeros(resamples), 0, 0.0))
                for v, c, h in zip(part["v"], part["c"], part["h"]):
                    draws = np.random.default_rng([h % (1 << 63), seed]).poisson(c, resamples)
                    s, w = s + v * draws, w + draws
                state[key] = (s, w, n + int(part["c"].sum()), t + float((part["v"] * part["c"]).sum()))
        for key, (s, w, n, t) in state.items():
            yield pd.DataFrame([[*key, s.tolist(), w.tolist(), n, t]], columns=[*by, "s", "w", "n", "t"])

    parts = rows.mapInPandas(sums, schema)
    flat = parts.select(*by, "n", "t", F.posexplode(F.arrays_zip("s", "w")).alias("i", "x"))
    totals = flat.groupBy(*by, "i").agg(F.sum("x.s").alias("s"), F.sum("x.w").alias("w"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    return totals.groupBy(*by).agg(F.max("n").alias("n"), F.round(F.max(F.col("t") / F.col("n")), 4).alias("mean"), F.round(F.percentile(F.try_divide("s", "w"), 0.025), 4).alias("lo"), F.round(F.percentile(F.try_divide("s", "w"), 0.975), 4).alias("hi"))


def systematic_sample(rows: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every step-th row in order, beginning with the first, by ranks within range partitions; no single task sorts all."""
    placed = global_row_number(rows, order, "_rn")
    return placed.where((F.col("_rn") - 1) % step == 0).drop("_rn")


def global_row_number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's number in the given total order: a range partitioning, counts by partition, and local numbers."""
    from lexmill.session import stage

    placed = stage(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_off")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_l", local).join(F.broadcast(before), "_p").withColumn(name, F.col("_l") + F.col("_off")).drop("_p", "_l", "_off")


def round_robin_sample(rows: DataFrame, stratum: str, key: str, priority: Column, n: int) -> DataFrame:
    """n rows taken from the strata in turn, each stratum in the order of its keys' hashes; strata in order of priority."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    # no stratum gives more than n, so each partition passes on its first n of each only
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).orderBy("rn", priority, stratum).limit(n)
