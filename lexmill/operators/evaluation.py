"""Evaluation: retrieval metrics, citation scores, existence, bases of an audit, claim scores."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ir_metrics(hits: DataFrame, relevant: DataFrame, key: str, k: int, queries: DataFrame) -> DataFrame:
    """(query_id, k, hits, recall, precision, mrr, ndcg, ndcg_full) of each query, rounded to 4 digits.

    hits: query_id, key, rk; relevant: query_id, key. precision divides by k; ndcg's ideal is the sorted
    retrieved list; ndcg_full's is the ideal over all relevant. A query without relevant items has 0.
    """
    mark = relevant.select("query_id", key).distinct().withColumn("rel", F.lit(True))
    marked = hits.join(mark, ["query_id", key], "left").select("query_id", "rk", F.coalesce("rel", F.lit(False)).alias("rel"))
    return marked_metrics(marked, relevant.groupBy("query_id").agg(F.countDistinct(key).alias("n_rel")), [k], queries)


def marked_metrics(marked: DataFrame, total: DataFrame, ks: list[int], queries: DataFrame) -> DataFrame:
    """The metrics for several k in one aggregation. marked: query_id, rk, rel (whether the hit is relevant); total: query_id, n_rel."""
    each = F.explode(F.array(*map(F.lit, ks))).alias("k")
    gain = F.when(F.col("rel"), 1 / F.log2(F.col("rk") + 1)).otherwise(F.lit(0.0))
    per = marked.select("query_id", "rk", "rel", each).where(F.col("rk") <= F.col("k")).groupBy("query_id", "k").agg(F.count_if("rel").alias("hits"), F.min(F.when(F.col("rel"), F.col("rk"))).alias("first"), F.sum(gain).alias("dcg"))
    joined = queries.select("query_id").distinct().select("query_id", each).join(per, ["query_id", "k"], "left").join(total, "query_id", "left").na.fill(0, ["hits", "n_rel"]).na.fill(0.0, ["dcg"])
    ideal = lambda n: F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    return joined.select(
        "query_id", "k", F.col("hits").cast("bigint").alias("hits"), share(F.col("hits"), F.col("n_rel")).alias("recall"), F.round(F.col("hits") / F.col("k"), 4).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), share(F.col("dcg"), ideal(F.col("hits"))).alias("ndcg"), share(F.col("dcg"), ideal(F.least(F.col("n_rel"), F.col("k")))).alias("ndcg_full"),
    )


def ir_report(metrics: DataFrame) -> DataFrame:
    """Means of the rounded metrics by k, rounded again."""
    # of 4-digit numbers, summed as decimals: the same whatever the order of the rows
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(12,4)")), 4).cast("double").alias(f"mean_{c}")
    return metrics.groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), *(mean(c) for c in ("recall", "precision", "mrr", "ndcg")))


def set_scores(cited: Column, truth: Column) -> list[Column]:
    """matched, spurious and missed (sorted), precision, recall and f1 (4 digits) of two arrays; null arrays count as empty."""
    none = F.array().cast("array<string>")
    a, b = F.array_distinct(F.array_compact(F.coalesce(cited, none))), F.array_distinct(F.array_compact(F.coalesce(truth, none)))
    both = F.array_intersect(a, b)
    p = F.when(F.size(a) > 0, F.size(both) / F.size(a)).otherwise(F.lit(0.0))
    r = F.when(F.size(b) > 0, F.size(both) / F.size(b)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [F.array_sort(both).alias("matched"), F.array_sort(F.array_except(a, b)).alias("spurious"), F.array_sort(F.array_except(b, a)).alias("missed"), F.round(p, 4).alias("precision_v"), F.round(r, 4).alias("recall_v"), F.round(f, 4).alias("f1_v")]


def existence(cited: DataFrame, real: DataFrame) -> DataFrame:
    """(raw, canonical, status): `real`, `nonexistent` or `vague` (no canonical article) of each row of `cited`."""
    known = real.select(F.col("canonical")).distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("canonical").isNull(), "vague").when(F.col("_there"), "real").otherwise("nonexistent")
    return cited.join(known, "canonical", "left").withColumn("status", status).drop("_there")


def existence_summary(rows: DataFrame, *by: str) -> DataFrame:
    n, c = F.count(F.lit(1)), lambda s: F.count_if(F.col("status") == s)
    rate = lambda s: F.round(c(s) / n, 4)
    return rows.groupBy(*by).agg(n.alias("n_cited"), *(c(s).alias(f"n_{s}") for s in ("real", "nonexistent", "vague")), *(rate(s).alias(f"{s}_rate") for s in ("real", "nonexistent", "vague")))


def resolve(keys: DataFrame, texts: DataFrame, raw: str = "raw", canonical: str = "canonical") -> DataFrame:
    """Left outer lookup of a text by the raw key, else by the canonical key, else a placeholder.

    texts: key, content; the first content by code points wins where a key comes twice.
    """
    one = texts.groupBy("key").agg(F.min("content").alias("content"))
    a = one.select(F.col("key").alias(raw), F.col("content").alias("_a"))
    b = one.select(F.col("key").alias(canonical), F.col("content").alias("_b"))
    found = keys.join(a, raw, "left").join(b, canonical, "left")
    return found.withColumn("content", F.coalesce("_a", "_b", F.lit("(not found)"))).drop("_a", "_b")


#: Modes of one experiment; each item is repeated for each.
MODES = 1000


def basis(gold: DataFrame, cited: DataFrame, how: str) -> DataFrame:
    """(mode, item, content): what each mode's answer is audited against. gold: item, content; cited: mode, item, content.

    `gold`: the gold texts alone; `union`: with the mode's own; `shared`: with those of all modes. Equal
    contents count once.
    """
    modes = [r[0] for r in cited.select("mode").distinct().limit(MODES + 1).collect()]
    if len(modes) > MODES:
        raise ValueError(f"more than {MODES} modes are no modes of one experiment")
    of = F.explode(F.array(*map(F.lit, modes)).cast("array<string>")).alias("mode")
    base = gold.select(of, "item", "content")
    if how == "gold":
        return base.distinct()
    if how == "union":
        return base.unionByName(cited.select("mode", "item", "content")).distinct()
    if how == "shared":
        every = cited.select("item", "content").distinct().select(of, "item", "content")
        return base.unionByName(every).distinct()
    raise ValueError(f"unknown basis: {how}")


def claim_scores(s: Column, p: Column, u: Column) -> tuple[Column, Column]:
    """(faithfulness, hallucination rate) of counts of supported, partial and unsupported claims; 0 without any."""
    n = s + p + u
    return F.when(n > 0, (s + 0.5 * p) / n).otherwise(F.lit(0.0)), F.when(n > 0, u / n).otherwise(F.lit(0.0))


def overall(faithful: Column, citation: Column, reasoning: Column) -> Column:
    """Weights .4, .3 and .3 with a reasoning score, else .6 and .4."""
    return F.when(reasoning.isNotNull(), 0.4 * faithful + 0.3 * citation + 0.3 * reasoning).otherwise(0.6 * faithful + 0.4 * citation)


def reasoning(rubric: Column, cosine: Column) -> Column:
    return 0.6 * rubric / 5 + 0.4 * cosine


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))
