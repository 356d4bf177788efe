"""Problem 7: one label per item from several annotators who disagree.

Iteratively reweighted voting, in rounds of two steps. First every vote is held against the weighted
consensus of the other votes on its item: the annotator's own vote is subtracted from the item's scores, and
the label that leads without it is the consensus left. Then an annotator's accuracy is the share of agreement
with it, corrected for chance and for the consensus' own errors, and smoothed to the task's mean by
SMOOTHING votes; the weight of a vote is the accuracy's log odds. The rounds end when no accuracy moves by
STABLE or more.

The correction: where the others' leading label is right with the chance q (its share of the exponentials
of the scores), an annotator of accuracy p agrees with the chance p q + (1 - p)(1 - q)/(k - 1). With
r = (1 - q)/(k - 1) and c = q - r that is r + c p, so p is the least-squares slope sum c (agrees - r) / sum c c.
Votes against an undecided rest (c = 0) say nothing; labels that tie for the lead share the agreement.

Agreement is Krippendorff's alpha for nominal labels, which allows missing ratings.

A vote that is null, blank or no label of the task is none. A repeated vote counts once; of several
different votes of one annotator on one item the last counts, then the greatest label. An item
without a vote gets the task's most supported label. Ties go to the label with more support in the
task, then to the first in code-point order.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.statistics import global_row_number
from lexmill.session import stage

STABLE = 1e-3
SMOOTHING = 6.0
START = 0.7
#: Rounds after which the accuracies are reported as not stable; each round from the tenth on goes half the way.
ROUNDS = 200
#: Annotators whose weights travel to the tasks as one array (8 bytes each); more are joined to the votes.
RATERS_HELD = 1_000_000
#: Votes of one item that are held together; items with more are scored by sums and joins.
ITEM_VOTES = 1_000
_TIE = 1e-12


def clean_label(column: str | Column) -> Column:
    """Lower case without white space and marks at the ends and with single spaces or `_` inside."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{P}]+|[\s\p{P}]+$", ""), r"[\s_\-]+", "_")


def one_vote(votes: DataFrame) -> DataFrame:
    """(task, item, rater, label) with the last vote of each annotator on each item; votes: also `at`, which may be null."""
    last = F.max(F.struct(F.coalesce(F.col("at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("at"), "label"))
    return votes.where("task is not null and item is not null and rater is not null and label is not null").groupBy("task", "item", "rater").agg(last.alias("v")).select("task", "item", "rater", "v.label")


def _weight(accuracy: Column, k: Column) -> Column:
    p = F.least(F.greatest(accuracy, F.lit(0.02)), F.lit(0.98))
    return F.log(p * (k - 1) / (1 - p))


def _scores(weighed: DataFrame) -> DataFrame:
    """(task, item, li, score, votes) summed over the votes."""
    return weighed.groupBy("task", "item", "li").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("votes"))


def left_out(rater: np.ndarray, label: np.ndarray, item: np.ndarray, k: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c (agrees - r) and c c of every vote against the consensus of the others; item numbers ascend from 0, k is the number of labels of each vote's task."""
    n, width = int(item[-1]) + 1 if len(item) else 0, int(k.max()) if len(k) else 0
    w, at = weights[rater], np.arange(len(item))
    scores = np.zeros((n, width))
    np.add.at(scores, (item, label), w)
    others = scores[item]
    others[at, label] -= w
    others[np.arange(width) >= k[:, None]] = -np.inf
    top = others.max(axis=1, keepdims=True)
    leads = others >= top - _TIE
    q = 1 / np.exp(others - top).sum(axis=1)
    agrees = leads[at, label] / leads.sum(axis=1)
    return _told(q, agrees, k)


def _told(q, agrees, k):
    r = (1 - q) / (k - 1)
    return (q - r) * (agrees - r), (q - r) * (q - r)


def _held_round(blocks: DataFrame, weights: np.ndarray) -> DataFrame:
    """(rid, num, den) of the votes held together by item, with the weights as one array in every task."""
    held = blocks.sparkSession.sparkContext.broadcast(weights)  # bounded by RATERS_HELD

    def told(batches):
        import pyarrow as pa

        num, den = np.zeros(len(held.value)), np.zeros(len(held.value))
        for batch in batches:
            votes = batch.column("votes")
            sizes = np.diff(votes.offsets.to_numpy())
            flat = votes.flatten()
            item = np.repeat(np.arange(len(sizes)), sizes)
            rater, label = flat.field("rid").to_numpy(), flat.field("li").to_numpy()
            a, b = left_out(rater, label, item, batch.column("k").to_numpy()[item], held.value)
            num += np.bincount(rater, a, len(num))
            den += np.bincount(rater, b, len(den))
        some = np.flatnonzero(den)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(num[some]), pa.array(den[some])], ["rid", "num", "den"])

    return blocks.mapInArrow(told, "rid bigint, num double, den double")


def _joined_round(votes: DataFrame, now: DataFrame) -> DataFrame:
    """(rid, num, den) of the votes, scored by sums over the items and joins; the same numbers as `_held_round`."""
    weighed = votes.join(now.select("rid", F.col("weight").alias("w")), "rid")
    scores = _scores(weighed).groupBy("task", "item").agg(F.map_from_entries(F.collect_list(F.struct("li", "score"))).alias("of"), F.sum("votes").alias("n"))
    each = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.coalesce(F.try_element_at("of", x), F.lit(0.0)) - F.when(x == F.col("li"), F.col("w")).otherwise(F.lit(0.0)))
    rows = weighed.join(scores.where("n > 1"), ["task", "item"]).select("rid", "k", "li", each.alias("others")).withColumn("top", F.array_max("others"))
    rows = rows.withColumn("q", 1 / F.aggregate("others", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).withColumn("leads", F.size(F.filter("others", lambda x: x >= F.col("top") - _TIE)))
    agrees = F.when(F.get("others", F.col("li")) >= F.col("top") - _TIE, 1 / F.col("leads")).otherwise(F.lit(0.0))
    num, den = _told(F.col("q"), agrees, F.col("k"))
    return rows.select("rid", num.alias("num"), den.alias("den"))


def _smoothed(num, den, task_num, task_den):
    """Accuracy of an annotator, smoothed to the task's mean, and that to START where the task has few votes."""
    mean = (task_num + SMOOTHING * START) / (task_den + SMOOTHING)
    return (num + SMOOTHING * mean) / (den + SMOOTHING)


def _sums(rounds: list[DataFrame]) -> DataFrame:
    rows = rounds[0]
    for more in rounds[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("rid").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def _step(turn: int) -> float:
    return 1.0 if turn < 10 else 0.5


def reliabilities(votes: DataFrame, stable: float = STABLE, held: int = RATERS_HELD, together: int = ITEM_VOTES) -> DataFrame:
    """(task, rater, k, rid, n_votes, reliability, weight, stable) of every annotator.

    votes: (task, item, rater, li, k), one vote of an annotator on an item; li is the label's number
    among the task's k labels. Items are held together once, so that a round is one map over them and one sum by annotator. A task
    of one label has accuracy 1 and weight 0. `stable` tells whether the last round moved no accuracy by the bound.
    """
    raters = global_row_number(votes.groupBy("task", "rater", "k").agg(F.count(F.lit(1)).alias("n_votes")), ["task", "rater"], "_n").withColumn("rid", F.col("_n").cast("bigint") - 1).drop("_n")
    raters = stage(raters.withColumn("reliability", F.when(F.col("k") > 1, F.lit(START)).otherwise(F.lit(1.0))), "raters")
    rows = votes.where("k > 1").join(raters.select("task", "rater", "rid"), ["task", "rater"]).select("task", "item", "rid", "li", "k")
    if raters.count() > held:
        return _by_joins(raters, stage(rows, "coded"), stable)
    large = stage(rows.groupBy("task", "item").count().where(F.col("count") > together).select("task", "item"), "large")
    rest = None
    if not large.isEmpty():
        rest = stage(rows.join(large, ["task", "item"], "left_semi"), "coded")
        rows = rows.join(large, ["task", "item"], "left_anti")
    blocks = stage(rows.groupBy("task", "item", "k").agg(F.collect_list(F.struct("rid", "li")).alias("votes")).where(F.size("votes") > 1).select("k", "votes"), "blocks")
    known = raters.toPandas().sort_values("rid", ignore_index=True)  # bounded by RATERS_HELD
    k, task = known.k.to_numpy(), known.task.factorize()[0]
    now, several, moved = known.reliability.to_numpy(float), k > 1, 0.0
    weigh = lambda p: np.where(several, np.log(np.clip(p, 0.02, 0.98) * np.maximum(k - 1, 1) / (1 - np.clip(p, 0.02, 0.98))), 0.0)
    for turn in range(ROUNDS):
        parts = [_held_round(blocks, weigh(now))]
        if rest is not None:
            parts.append(_joined_round(rest, votes.sparkSession.createDataFrame(known[["rid"]].assign(weight=weigh(now)))))
        said = _sums(parts).toPandas()
        num, den = (np.bincount(said.rid, said[c], len(k)) for c in ("num", "den"))
        whole = np.clip(_smoothed(num, den, np.bincount(task, num)[task], np.bincount(task, den)[task]), 0, 1) if len(k) else now
        change = np.where(several, whole - now, 0.0)
        now, moved = now + _step(turn) * change, np.abs(change).max(initial=0.0)
        if moved < stable:
            break
    out = votes.sparkSession.createDataFrame(known.assign(reliability=now, weight=weigh(now), stable=bool(moved < stable)), raters.schema.add("weight", "double").add("stable", "boolean"))
    return stage(out, "raters")


def _by_joins(raters: DataFrame, votes: DataFrame, stable: float) -> DataFrame:
    """The same rounds where there are too many annotators to be held: their accuracies stay a table."""
    weigh = lambda rows: rows.withColumn("weight", F.when(F.col("k") > 1, _weight(F.col("reliability"), F.col("k"))).otherwise(F.lit(0.0)))
    now, moved = stage(weigh(raters), "raters"), 0.0
    for turn in range(ROUNDS):
        told = now.join(_sums([_joined_round(votes, now)]), "rid", "left").na.fill(0.0, ["num", "den"])
        means = told.groupBy("task").agg(F.sum("num").alias("tn"), F.sum("den").alias("td"))
        whole = F.least(F.greatest(_smoothed(F.col("num"), F.col("den"), F.col("tn"), F.col("td")), F.lit(0.0)), F.lit(1.0))
        change = F.when(F.col("k") > 1, whole - F.col("reliability")).otherwise(F.lit(0.0))
        fresh = told.join(means, "task").select("task", "rater", "k", "n_votes", "rid", F.abs(change).alias("change"), (F.col("reliability") + _step(turn) * change).alias("reliability"))
        now = stage(weigh(fresh), "raters")
        moved = now.agg(F.max("change")).first()[0] or 0.0
        if moved < stable:
            break
    return now.drop("change").withColumn("stable", F.lit(moved < stable))


def coded(votes: DataFrame, items: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((task, item, rater, li, k) of the votes that count, (task, label, li, k) of the labels)."""
    order = Window.partitionBy("task").orderBy("label")  # the labels of a task are its fixed list
    listed = labels.distinct().withColumn("li", F.row_number().over(order) - 1)
    listed = listed.join(labels.distinct().groupBy("task").agg(F.count(F.lit(1)).cast("int").alias("k")), "task")
    known = one_vote(votes).join(items.select("task", "item").distinct(), ["task", "item"], "left_semi")
    return known.join(listed, ["task", "label"]).select("task", "item", "rater", "li", "k"), listed


def consensus(votes: DataFrame, items: DataFrame, labels: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """((task, item, label, score, share, n_votes) of every item of `items`, the reliabilities); how: arguments of `reliabilities`."""
    rows, listed = coded(votes, items, labels)
    rows, listed = stage(rows, "votes"), stage(listed, "labels")
    raters = reliabilities(rows, **how)
    scores = _scores(rows.join(raters.select("task", "rater", F.col("weight").alias("w")), ["task", "rater"]))
    support = listed.join(rows.groupBy("task", "li").agg(F.count(F.lit(1)).alias("support")), ["task", "li"], "left").na.fill(0, ["support"])
    # a label without a vote has score 0: it wins where all votes speak against theirs
    every = items.select("task", "item").distinct().join(support, "task").join(scores, ["task", "item", "li"], "left").na.fill(0, ["score", "votes"])
    best = F.max_by(F.col("label"), F.struct(F.round("score", 9), "support", -F.col("li")))
    out = every.groupBy("task", "item").agg(best.alias("label"), F.max("score").alias("score"), F.sum("votes").alias("n_votes"), F.sum(F.exp("score")).alias("z"))
    return out.select("task", "item", "label", "score", (F.exp("score") / F.col("z")).alias("share"), "n_votes"), raters


def alpha(votes: DataFrame) -> DataFrame:
    """(task, n_items, n_votes, observed, expected, alpha): Krippendorff's alpha over items with at least two votes; alpha is 1 where only one label occurs."""
    counts = votes.groupBy("task", "item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy("task", "item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("m > 1")
    paired = counts.join(items.select("task", "item", "m"), ["task", "item"])
    by_label = paired.groupBy("task", "label").agg(F.sum("c").alias("n"))
    expected = by_label.groupBy("task").agg((1 - (F.sum(F.col("n") * F.col("n")) - F.sum("n")) / (F.sum("n") * (F.sum("n") - 1))).alias("expected"))
    seen = items.groupBy("task").agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_votes"), (F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)) / F.sum("m")).alias("observed"))
    value = F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).otherwise(F.lit(1.0))
    return seen.join(expected, "task").select("task", "n_items", "n_votes", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(value, 6).alias("alpha"))


# The tasks, their labels, and the labels that others are spelt as.
TASKS = {"claim": ("supported", "partial", "unsupported"), "hallucination": ("hallucination", "not_hallucination")}
SAME = {"accurate": "not_hallucination", "incomplete": "not_hallucination"}


def _labelled(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with the columns' labels cleaned, each once, and spelt as the task spells them."""
    return rows.withColumns({c: clean_label(c) for c in columns}).replace(SAME, subset=list(columns))


def project_votes(models: DataFrame, checkpoint: DataFrame, further: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(votes, items, labels) of the evaluation tables; human_label and human_hall are one vote, the label first."""
    spark = models.sparkSession
    labels = spark.createDataFrame([(t, x) for t, xs in TASKS.items() for x in xs], "task string, label string")
    items = models.select(F.lit("claim").alias("task"), F.col("sample_id").alias("item")).unionByName(checkpoint.select(F.lit("hallucination").alias("task"), F.col("item_key").alias("item"))).where("item is not null").distinct()
    flag = lambda c: F.when(F.col(c) == 1, "hallucination").when(F.col(c) == 0, "not_hallucination")
    never = F.lit(None).cast("timestamp")

    def vote(rows, task, item, rater, label, at=never):
        return rows.select(F.lit(task).alias("task"), F.col(item).alias("item"), rater.alias("rater"), label.alias("label"), at.cast("timestamp").alias("at"))

    models, checkpoint = _labelled(models, "gpt_5_mini", "gpt_4o"), _labelled(checkpoint, "human_label")
    human = F.when(F.col("human_label").isin(*TASKS["hallucination"]), F.col("human_label")).otherwise(flag("human_hall"))
    votes = vote(models, "claim", "sample_id", F.lit("gpt_5_mini"), F.col("gpt_5_mini"))
    votes = votes.unionByName(vote(models, "claim", "sample_id", F.lit("gpt_4o"), F.col("gpt_4o")))
    votes = votes.unionByName(vote(checkpoint, "hallucination", "item_key", F.lit("human"), human)).unionByName(vote(checkpoint, "hallucination", "item_key", F.lit("judge"), flag("judge_hall")))
    # the further votes are read once: the label tells the task
    more = _labelled(further.select(F.col("item_id").alias("item"), F.col("rater_id").alias("rater"), "label", F.col("voted_at").cast("timestamp").alias("at")), "label").join(labels, "label")
    votes = votes.unionByName(more.select("task", "item", "rater", "label", "at"))
    return votes.join(labels, ["task", "label"], "left_semi").select("task", "item", "rater", "label", "at"), items, labels
