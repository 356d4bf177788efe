"""Comparison of modes on the same items, audits against several bases, and model clients that answer from their prompt."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import robust_json
from lexmill.operators import statistics as st
from lexmill.operators.model_steps import AUDIT


def paired(scores: DataFrame, item: str, mode: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(mode_a, mode_b, item, a, b): the values of items that have one in both modes of a pair.

    scores: one row an item and mode. Rows with a null item, mode or value are in no pair.
    """
    rows = scores.where(F.col(item).isNotNull() & F.col(value).isNotNull())
    wanted = F.explode(F.array(*(F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b")) for a, b in pairs)))
    # both sides of a pair meet in one aggregation by item and pair, without a self-join
    placed = rows.withColumn("_p", wanted).where((F.col(mode) == F.col("_p.mode_a")) | (F.col(mode) == F.col("_p.mode_b")))
    side = lambda m: F.max(F.when(F.col(mode) == F.col(f"_p.{m}"), F.col(value)))
    both = placed.groupBy(F.col("_p.mode_a").alias("mode_a"), F.col("_p.mode_b").alias("mode_b"), F.col(item)).agg(side("mode_a").alias("a"), side("mode_b").alias("b"))
    return both.where("a is not null and b is not null")


def paired_report(pairs: DataFrame) -> DataFrame:
    """Per pair of modes: number of items, means, signed-rank test and its p corrected by Holm over the pairs."""
    by = ["mode_a", "mode_b"]
    means = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 4).alias("mean_a"), F.round(F.avg("b"), 4).alias("mean_b"))
    tested = st.wilcoxon(pairs, "a", "b", by)
    tests = st.holm(tested.withColumn("p", F.coalesce("p_exact", "p")).drop("p_exact"), "p", "mode_b")
    return means.join(tests, by, "left")


def mode_summary(rows: DataFrame, mode: str, source: str, measures: dict[str, str]) -> DataFrame:
    """Per mode: all rows, rows of a stand-in (`mock`), judged rows, and the measures' means over the judged ones; measures: column -> name."""
    judged = F.coalesce(F.col(source) != "mock", F.lit(True))
    mean = lambda c: F.round(F.avg(F.when(judged, F.col(c)).cast("decimal(18,6)")), 4).cast("double")
    return rows.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), F.count_if(~judged).alias("n_mock"), F.count_if(judged).alias("n_judged"), *(mean(c).alias(name) for c, name in measures.items()))


def audit_prompt(claims: Column, evidence: Column) -> Column:
    """A prompt with the claims and the evidence as JSON, both arrays of strings."""
    return F.concat(F.lit("Say of each claim whether the evidence supports it.\n"), F.to_json(F.struct(claims.alias("claims"), evidence.alias("evidence"))))


def judged_claims(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """One row a claim of an audit's answer, with `claim` and `status`; advisory claims, blank ones and those without a status are left out."""
    claims = F.coalesce(robust_json(F.col(answer), AUDIT)["claims"], F.array().cast("array<struct<claim string, status string, anchor string, rationale string>>"))
    each = rows.withColumn("_c", F.explode(claims)).drop(answer)
    told = each.select(*[c for c in each.columns if c != "_c"], F.col("_c.claim").alias("claim"), F.lower("_c.status").alias("status"))
    return told.where("trim(claim) <> '' and status <> '' and status <> 'advisory'")


class EvidenceClient:
    """Answers an audit prompt from the prompt itself: a claim that is in the evidence is supported, one whose words before the first digit begin an evidence is partial."""

    def complete(self, prompt: str) -> str:
        asked = json.loads(prompt[prompt.index("{") :])
        evidence = set(asked.get("evidence") or [])
        starts = {self._start(e) for e in evidence}
        told = [{"claim": c, "status": "supported" if c in evidence else "partial" if self._start(c) in starts else "unsupported"} for c in asked.get("claims") or []]
        return "Audit:\n```json\n" + json.dumps({"claims": told}, ensure_ascii=False) + "\n```"

    @staticmethod
    def _start(text: str) -> str:
        return text[: next((i for i, c in enumerate(text) if c.isdigit()), len(text))]


class EchoClient:
    """Answers with JSON made of the prompt: its length, the lines that hold a marker, and a score and label drawn from the length."""

    def __init__(self, labels: tuple[str, ...] = (), fields: tuple[str, ...] = ()):
        self.labels, self.fields = labels, fields

    def complete(self, prompt: str) -> str:
        n = len(prompt)
        answer = {"score": n % 5 + 1, "objection": f"{n} characters are no proof", **{f: prompt[:40] for f in self.fields}}
        if self.labels:
            answer["label"] = self.labels[n % len(self.labels)].upper()
        return json.dumps(answer, ensure_ascii=False)


def kappa_levels(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Agreement and kappa of two label columns by group, with Landis and Koch's word for it."""
    from lexmill.functions.text import kappa_level

    return st.kappa(rows, a, b, by).withColumn("level", kappa_level(F.col("kappa")))


def pooled_hits(hits: Column, keys: Column, key_of, k: int, pool: int = 20, weight: float = 0.2) -> Column:
    """The k best of an array of (chunk_id, score): where the query names an article, `weight` is added to the hits of its articles within the pool of max(k, pool) hits; else the first k stay.

    Ties go to the earlier chunk_id. keys: array of the query's article keys; key_of(chunk_id) -> key of a hit.
    """
    named = F.coalesce(F.size(keys), F.lit(0)) > 0
    first = F.slice(by_score(hits), 1, F.when(named, F.lit(max(k, pool))).otherwise(F.lit(k)))
    raised = F.transform(first, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), F.round(h["score"] + F.when(named & F.array_contains(keys, key_of(h["chunk_id"])), weight).otherwise(0.0), 6).alias("score")))
    return F.slice(by_score(raised), 1, k)


def by_score(hits: Column) -> Column:
    """Hits by falling score, then chunk_id, each once; null hits are left out."""
    ranked = F.array_sort(F.array_distinct(F.transform(F.array_compact(hits), lambda h: F.struct((-h["score"]).alias("s"), h["chunk_id"].alias("c")))))
    return F.transform(ranked, lambda x: F.struct(x["c"].alias("chunk_id"), (-x["s"]).alias("score")))


def list_metrics(found: Column, relevant: Column, k: int) -> dict[str, Column]:
    """recall, precision (by k) and reciprocal rank of an ordered array against a set; all 0 without relevant items."""
    hit = F.filter(found, lambda x: F.array_contains(relevant, x))
    first = F.array_min(F.transform(hit, lambda x: F.array_position(found, x)))
    n = F.size(relevant)
    zero = F.lit(0.0)
    return {
        "recall": F.round(F.when(n > 0, F.size(F.array_distinct(hit)) / n).otherwise(zero), 4),
        "precision": F.round(F.size(F.array_distinct(hit)) / k, 4),
        "mrr": F.round(F.coalesce(1 / first, zero), 4),
    }


def analysis_text(analysis: Column, conclusion: Column, suggestions: Column) -> Column:
    """An analysis as headed paragraphs; empty fields are left out. analysis: struct of issue, rule, application."""
    from lexmill.functions.text import first_nonempty

    parts = [("Issue", analysis["issue"]), ("Rule", analysis["rule"]), ("Application", analysis["application"]), ("Conclusion", conclusion)]
    blocks = F.array_compact(F.array(*(F.concat(F.lit(f"### {name}\n"), first_nonempty(c)) for name, c in parts)))
    listed = F.array_join(F.transform(F.array_compact(F.coalesce(suggestions, F.array().cast("array<string>"))), lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.concat(F.array_join(blocks, "\n\n"), F.when(listed != "", F.concat(F.lit("\n\n### Suggestions\n"), listed)).otherwise(F.lit("")))


def hits_text(hits: Column, empty: str, most: int = 600) -> Column:
    """Numbered hits for an audit; hits: array of (head, content), contents cut to `most` characters."""
    lines = F.transform(hits, lambda h, i: F.format_string("[%d] %s\n%s", i + 1, h["head"], F.substring(F.coalesce(h["content"], F.lit("")), 1, most)))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, F.lit(empty)).otherwise(F.array_join(lines, "\n\n"))
