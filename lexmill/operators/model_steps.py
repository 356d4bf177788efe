"""Model steps over rows with a pluggable client; offline a deterministic payload stands in.

A client is any object with `complete(prompt: str) -> str`. Every step is a narrow map: prompts are
built by column expressions, calls are made per partition with bounded retries, answers are parsed in
the JVM. `source` is `live` or `mock`, so that mock rows can be kept out of every aggregate.
"""

import json
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import mask_pii, robust_json


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class Retryable(Exception):
    """Raised by a client for rate limits and server errors."""


MOCK_ANALYSIS = {"issue": "mock", "rule": "mock", "application": "mock", "conclusion": "mock", "risk_level": "medium", "suggestions": "", "cited_articles": []}
MOCK_AUDIT = {"claims": [], "summary": {"supported": 0, "partial": 0, "unsupported": 0, "advisory": 0}}
MOCK_RUBRIC = {"score": 3, "rationale": "mock"}
MOCK_LABEL = {"label": "partial"}

ANALYSIS = "issue string, rule string, application string, conclusion string, risk_level string, suggestions string, cited_articles array<string>"
AUDIT = "claims array<struct<claim string, status string, anchor string, rationale string>>"


def complete(rows: DataFrame, prompt: Column, make_client: Callable[[], Client] | None, mock: dict, attempts: int = 3, wait: float = 2.0, fall_back: bool = True) -> DataFrame:
    """Adds `answer` and `source`. No client gives the mock; a call that fails retryably `attempts` times gives the mock too, or raises."""
    stand_in = json.dumps(mock, ensure_ascii=False)
    if make_client is None:
        return rows.withColumn("answer", F.lit(stand_in)).withColumn("source", F.lit("mock"))
    named = rows.withColumn("_prompt", prompt)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def call(batches):
        client = make_client()
        for batch in batches:
            answers, sources = [], []
            for text in batch["_prompt"]:
                for n in range(attempts):
                    try:
                        answers.append(client.complete(text))
                        sources.append("live")
                        break
                    except Retryable:
                        if n + 1 < attempts:
                            time.sleep(wait * 2**n)
                else:
                    if not fall_back:
                        raise RuntimeError(f"the model failed {attempts} times")
                    answers.append(stand_in)
                    sources.append("mock")
            yield batch.drop(columns="_prompt").assign(answer=answers, source=sources)

    return named.mapInPandas(call, f"{fields}, answer string, source string")


def hit_block(hits: Column, mark: str, empty: str) -> Column:
    """Numbered hits `[L1] ...` with their similarity to two decimals; hits: array of (text, score)."""
    lines = F.transform(hits, lambda h, i: F.format_string(f"[{mark}%d] (%.2f) %s", i + 1, h["score"], h["text"]))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) == 0, F.lit(empty)).otherwise(F.array_join(lines, "\n\n"))


def analysis_prompt(clause: Column, laws: Column, cases: Column) -> Column:
    """Prompt for an analysis of a clause, personal data masked, case texts cut to 500 characters."""
    short = F.transform(cases, lambda h: F.struct(F.substring(h["text"], 1, 500).alias("text"), h["score"].alias("score")))
    return F.concat(F.lit("Clause:\n"), mask_pii(F.coalesce(clause, F.lit(""))), F.lit("\n\nStatutes:\n"), hit_block(laws, "L", "(none)"), F.lit("\n\nJudgements:\n"), hit_block(short, "J", "(none)"), F.lit("\n\nAnswer in JSON with issue, rule, application, conclusion, risk_level, suggestions, cited_articles."))


def analyse(rows: DataFrame, prompt: Column, make_client=None, **options) -> DataFrame:
    """Adds the parsed analysis as `result` (null where the answer holds no JSON), `answer` and `source`."""
    return complete(rows, prompt, make_client, MOCK_ANALYSIS, **options).withColumn("result", robust_json(F.col("answer"), ANALYSIS))


def _is(value: str):
    return lambda x: x == value


def audit(rows: DataFrame, prompt: Column, make_client=None, **options) -> DataFrame:
    """Adds counts of supported, partial, unsupported and advisory claims, recounted from the claims themselves."""
    got = complete(rows, prompt, make_client, MOCK_AUDIT, **options).withColumn("_c", F.coalesce(robust_json(F.col("answer"), AUDIT)["claims"], F.array().cast("array<struct<claim string, status string, anchor string, rationale string>>")))
    for status in ("supported", "partial", "unsupported", "advisory"):
        got = got.withColumn(f"n_{status}", F.size(F.filter(F.transform("_c", lambda c: F.lower(c["status"])), _is(status))))
    return got.drop("_c")


def rubric(rows: DataFrame, prompt: Column, make_client=None, **options) -> DataFrame:
    """Adds `score` from 1 to 5; others are null."""
    got = complete(rows, prompt, make_client, MOCK_RUBRIC, **options)
    score = robust_json(F.col("answer"), "score int")["score"]
    return got.withColumn("score", F.when(score.between(1, 5), score))


def classify(rows: DataFrame, prompt: Column, labels: list[str], make_client=None, **options) -> DataFrame:
    """Adds `label`, one of the labels or null."""
    got = complete(rows, prompt, make_client, {"label": labels[0]}, **options)
    label = F.lower(F.trim(robust_json(F.col("answer"), "label string")["label"]))
    return got.withColumn("label", F.when(label.isin(*labels), label))


def debate(rows: DataFrame, claim: Column, make_client=None, rounds: int = 3, **options) -> DataFrame:
    """Rounds of objection to a claim, each answering the one before; adds `objections` in order."""
    out = rows.withColumn("_said", F.array().cast("array<string>"))
    for i in range(rounds):
        before = F.when(F.size("_said") > 0, F.concat(F.lit("\nEarlier: "), F.array_join("_said", " / "))).otherwise(F.lit(""))
        asked = complete(out, F.concat(F.lit(f"Round {i + 1}. Object to: "), claim, before), make_client, {"objection": f"mock {i + 1}"}, **options)
        said = F.coalesce(robust_json(F.col("answer"), "objection string")["objection"], F.col("answer"))
        out = asked.withColumn("_said", F.concat("_said", F.array(said))).drop("answer", "source" if i + 1 < rounds else "_none")
    return out.withColumnRenamed("_said", "objections")
