"""Queries of mode comparison, audits, evidence texts, keys and labels, with their SQL."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import audit as au
from lexmill.operators import embedding as em
from lexmill.operators import evaluation as ev
from lexmill.operators import model_steps as m
from lexmill.operators import retrieval as rt
from lexmill.operators import statistics as st
from lexmill.plans.retrieval_queries import _LAB, _TOKENS, _canon_sql, _kappa_sql, _label
from lexmill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- modes against each other: an item is a contract, its value the mean f1 of its analyses in the mode
MODE_PAIRS = [("baseline", "rag"), ("rag", "triangulation"), ("baseline", "triangulation")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in MODE_PAIRS)
_SCORES = "f AS (SELECT analysis_id, min(file_id) AS file_id FROM clause_analyses GROUP BY 1), r AS (SELECT DISTINCT analysis_id, rag_mode, f1 FROM citation_results), s AS (SELECT file_id, rag_mode, round(avg(f1), 9) AS v FROM r JOIN f USING (analysis_id) WHERE file_id IS NOT NULL AND f1 IS NOT NULL GROUP BY 1, 2)"
_PAIRED = f"{_SCORES}, pr AS (SELECT * FROM (VALUES {_VALUES}) AS x(mode_a, mode_b)), p AS (SELECT mode_a, mode_b, a.file_id, a.v AS a, b.v AS b FROM pr JOIN s a ON a.rag_mode = mode_a JOIN s b ON b.rag_mode = mode_b AND b.file_id = a.file_id)"


def _pairs(spark, root):
    files = table(spark, root, "clause_analyses").groupBy("analysis_id").agg(F.min("file_id").alias("file_id"))
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "f1").distinct().join(files, "analysis_id").where("file_id is not null and f1 is not null")
    scores = rows.groupBy("file_id", "rag_mode").agg(F.round(F.avg("f1"), 9).alias("v"))
    return au.paired(scores, "file_id", "rag_mode", "v", MODE_PAIRS)


@query(f"WITH {_PAIRED} SELECT mode_a, mode_b, file_id, round(a, 6) AS a, round(b, 6) AS b FROM p")
def paired_modes(spark, root):
    return _pairs(spark, root).select("mode_a", "mode_b", "file_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


_RANKED = """d AS (SELECT mode_a, mode_b, round(b - a, 9) AS d FROM p WHERE round(b - a, 9) <> 0), c AS (SELECT mode_a, mode_b, abs(d) AS m, count(*) AS c FROM d GROUP BY ALL),
 k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY mode_a, mode_b ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rk FROM c),
 g AS (SELECT d.mode_a, d.mode_b, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wn, sum(c * c - 1) AS t FROM d JOIN k ON d.mode_a = k.mode_a AND d.mode_b = k.mode_b AND abs(d.d) = k.m GROUP BY d.mode_a, d.mode_b),
 w AS (SELECT mode_a, mode_b, n_pos, n_neg, CAST(least(wp, wn) AS DOUBLE) AS w, round((least(wp, wn) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2e0 * n + 1) / 24e0 - t / 48e0), 4) AS z, round((n_pos - n_neg) / n, 4) AS r FROM g)"""


@query(f"WITH {_PAIRED}, {_RANKED}, a AS (SELECT mode_a, mode_b, count(*) AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b FROM p GROUP BY 1, 2) SELECT * FROM a LEFT JOIN w USING (mode_a, mode_b)")
def paired_wilcoxon(spark, root):
    """Signed-rank test of every pair of modes on the same contracts."""
    return au.paired_report(_pairs(spark, root)).drop("p", "p_holm")


@query()
def paired_significance(spark, root):
    """The same with p (exact for few pairs), Holm's correction, and the bootstrap interval of the differences."""
    pairs = _pairs(spark, root)
    ends = st.bootstrap_ci(pairs.withColumn("d", F.col("b") - F.col("a")), "d", ["mode_a", "mode_b"])
    return au.paired_report(pairs).join(ends.select("mode_a", "mode_b", F.col("mean").alias("mean_diff"), "lo", "hi"), ["mode_a", "mode_b"])


_BINOM = f"sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * {math.log(2)!r}))"


@query(f"""WITH {_PAIRED}, c AS (SELECT mode_a, mode_b, count(*) FILTER (a < 0.5 AND b >= 0.5) AS b01, count(*) FILTER (a >= 0.5 AND b < 0.5) AS b10 FROM p GROUP BY 1, 2), x AS (SELECT *, b01 + b10 AS n, unnest(range(0, least(b01, b10) + 1)) AS i FROM c)
SELECT mode_a, mode_b, b01, b10, n AS discordant, round(CASE WHEN n > 0 THEN least(1e0, 2 * {_BINOM}) END, 6) AS p FROM x GROUP BY mode_a, mode_b, b01, b10, n""")
def paired_mcnemar(spark, root):
    """Contracts that are poor (mean f1 under 0.5) in one mode only, with the exact binomial p."""
    rows = _pairs(spark, root).select("mode_a", "mode_b", (F.col("a") < 0.5).alias("x"), (F.col("b") < 0.5).alias("y"))
    return st.mcnemar(rows, "x", "y", ["mode_a", "mode_b"])


@query(f"WITH {_PAIRED}, q AS (SELECT file_id, bool_and(b > a) AS up, count(*) AS n FROM p GROUP BY file_id) SELECT count(*) AS n_items, count(*) FILTER (up) AS n_up FROM q WHERE n = {len(MODE_PAIRS)}")
def paired_direction(spark, root):
    """Contracts present in all modes, and those where every pair goes up."""
    per = _pairs(spark, root).groupBy("file_id").agg(F.every(F.col("b") > F.col("a")).alias("up"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(MODE_PAIRS))
    return per.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("up").alias("n_up"))


# ---- citations against gold, audits by basis and mode
_KEYS = f"k AS (SELECT DISTINCT analysis_id, rag_mode, {_canon_sql('x')} AS key FROM (SELECT analysis_id, rag_mode, unnest(cited) AS x FROM citation_results) WHERE x <> '')"
_GOLD = "g AS (SELECT DISTINCT analysis_id, x AS key FROM (SELECT analysis_id, unnest(grounded) AS x FROM citation_results) WHERE x IS NOT NULL)"


def _cited_keys(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", F.explode("cited").alias("x")).where("x <> ''")
    return rows.select("analysis_id", "rag_mode", F.get(t.article_list(F.col("x")), F.lit(0)).alias("key")).where("key is not null").distinct()


def _gold_keys(spark, root):
    return table(spark, root, "citation_results").select("analysis_id", F.explode("grounded").alias("key")).where("key is not null").distinct()


@query(f"""WITH {_KEYS}, {_GOLD}, i AS (SELECT DISTINCT analysis_id, rag_mode FROM citation_results WHERE analysis_id IS NOT NULL AND rag_mode IS NOT NULL),
 c AS (SELECT analysis_id, rag_mode, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1, 2), h AS (SELECT analysis_id, count(*) AS n FROM g GROUP BY 1), b AS (SELECT k.analysis_id, rag_mode, count(*) AS n FROM k JOIN g USING (analysis_id, key) GROUP BY 1, 2),
 n AS (SELECT i.analysis_id, i.rag_mode, coalesce(c.n, 0) AS n_cited, coalesce(h.n, 0) AS n_gold, coalesce(b.n, 0) AS n_matched FROM i LEFT JOIN c USING (analysis_id, rag_mode) LEFT JOIN h USING (analysis_id) LEFT JOIN b USING (analysis_id, rag_mode))
SELECT *, round(CASE WHEN n_cited > 0 THEN n_matched / n_cited ELSE 0e0 END, 4) AS precision_v, round(CASE WHEN n_gold > 0 THEN n_matched / n_gold ELSE 0e0 END, 4) AS recall_v, round(CASE WHEN n_cited + n_gold > 0 THEN 2 * n_matched / (n_cited + n_gold) ELSE 0e0 END, 4) AS f1_v FROM n""")
def citation_vs_gold(spark, root):
    """Citations as typed, in canonical form, against the gold articles of each result."""
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode").where("analysis_id is not null and rag_mode is not null").distinct()
    cited, gold = _cited_keys(spark, root), _gold_keys(spark, root)
    n = lambda rows, by, name: rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    both = ["analysis_id", "rag_mode"]
    joined = rows.join(n(cited, both, "n_cited"), both, "left").join(n(gold, ["analysis_id"], "n_gold"), "analysis_id", "left").join(n(cited.join(gold, ["analysis_id", "key"]), both, "n_matched"), both, "left").na.fill(0)
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 4)
    c, g, hit = F.col("n_cited"), F.col("n_gold"), F.col("n_matched")
    return joined.select(*both, "n_cited", "n_gold", "n_matched", share(hit, c).alias("precision_v"), share(hit, g).alias("recall_v"), share(2 * hit, c + g).alias("f1_v"))


@query("""WITH a AS (SELECT analysis_id, min(llm_source) AS src, min(duration_sec) AS sec FROM clause_analyses GROUP BY 1), r AS (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score, f1 FROM citation_results), j AS (SELECT r.*, src, sec, coalesce(src <> 'mock', true) AS judged FROM r LEFT JOIN a USING (analysis_id))
SELECT rag_mode, count(*) AS n, count(*) FILTER (NOT judged) AS n_mock, count(*) FILTER (judged) AS n_judged, round(avg(CAST(precision_score AS DECIMAL(18, 6))) FILTER (judged), 4) AS mean_precision, round(avg(CAST(recall_score AS DECIMAL(18, 6))) FILTER (judged), 4) AS mean_recall, round(avg(CAST(f1 AS DECIMAL(18, 6))) FILTER (judged), 4) AS mean_f1, round(avg(CAST(sec AS DECIMAL(18, 6))) FILTER (judged), 4) AS mean_seconds FROM j GROUP BY rag_mode""")
def generation_by_mode(spark, root):
    """Means by mode over results whose analysis wasn't made by the stand-in, which are counted."""
    made = table(spark, root, "clause_analyses").groupBy("analysis_id").agg(F.min("llm_source").alias("src"), F.min("duration_sec").alias("sec"))
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score", "f1").distinct().join(made, "analysis_id", "left")
    return au.mode_summary(rows, "rag_mode", "src", {"precision_score": "mean_precision", "recall_score": "mean_recall", "f1": "mean_f1", "sec": "mean_seconds"})


_ITEM = "f AS (SELECT analysis_id, min(file_id) AS item, min(llm_source) AS src FROM clause_analyses GROUP BY 1)"
_STARTS = "regexp_extract(key, '^[^0-9]*')"


@query(f"""WITH {_ITEM}, {_KEYS}, {_GOLD}, c AS (SELECT DISTINCT item, rag_mode AS mode, key FROM k JOIN f USING (analysis_id) WHERE key IS NOT NULL AND src <> 'mock' AND item IS NOT NULL AND rag_mode IS NOT NULL), o AS (SELECT DISTINCT item, key FROM g JOIN f USING (analysis_id) WHERE item IS NOT NULL), ms AS (SELECT DISTINCT mode FROM c),
 b AS (SELECT DISTINCT 'gold' AS basis, mode, item, key FROM o, ms UNION SELECT 'union', mode, item, key FROM o, ms UNION SELECT 'union', mode, item, key FROM c UNION SELECT 'shared', mode, item, key FROM o, ms UNION SELECT 'shared', ms.mode, c.item, c.key FROM c, ms),
 st AS (SELECT DISTINCT basis, mode, item, {_STARTS} AS s FROM b), bs AS (SELECT unnest(['gold', 'union', 'shared']) AS basis),
 j AS (SELECT bs.basis, c.mode, c.item, b.key IS NOT NULL AS sup, st.s IS NOT NULL AS par FROM bs CROSS JOIN c LEFT JOIN b ON b.basis = bs.basis AND b.mode = c.mode AND b.item = c.item AND b.key = c.key LEFT JOIN st ON st.basis = bs.basis AND st.mode = c.mode AND st.item = c.item AND st.s = regexp_extract(c.key, '^[^0-9]*')),
 n AS (SELECT basis, mode, item, count(*) FILTER (sup) AS s, count(*) FILTER (NOT sup AND par) AS p, count(*) FILTER (NOT sup AND NOT par) AS u FROM j GROUP BY ALL)
SELECT basis, mode, count(*) AS n_audited, CAST(sum(s + p + u) AS BIGINT) AS n_claims, round(avg((s + 0.5e0 * p) / (s + p + u)), 4) AS faithfulness, round(avg(u / (s + p + u)), 4) AS hallucination FROM n GROUP BY basis, mode""")
def fair_audit_by_mode(spark, root):
    """Every mode's cited articles of a contract, audited through the model step against the gold, union and shared basis.

    The client answers from the prompt: cited articles in the basis are supported, those of a statute in it partial. Analyses of the stand-in are left out.
    """
    made = table(spark, root, "clause_analyses").groupBy("analysis_id").agg(F.min("file_id").alias("item"), F.min("llm_source").alias("src"))
    cited = _cited_keys(spark, root).join(made.where("src <> 'mock'"), "analysis_id").where("item is not null and rag_mode is not null").select(F.col("rag_mode").alias("mode"), "item", F.col("key").alias("content")).distinct()
    gold = _gold_keys(spark, root).join(made, "analysis_id").where("item is not null").select("item", F.col("key").alias("content")).distinct()
    claims = cited.groupBy("mode", "item").agg(F.array_sort(F.collect_set("content")).alias("claims"))
    out = None
    for how in ("gold", "union", "shared"):
        held = ev.basis(gold, cited, how).groupBy("mode", "item").agg(F.array_sort(F.collect_set("content")).alias("evidence"))
        part = claims.join(held, ["mode", "item"], "left").withColumn("basis", F.lit(how))
        out = part if out is None else out.unionByName(part)
    told = m.audit(out, au.audit_prompt(F.col("claims"), F.coalesce("evidence", F.array().cast("array<string>"))), au.EvidenceClient)
    faithful, hall = ev.claim_scores(F.col("n_supported"), F.col("n_partial"), F.col("n_unsupported"))
    n = F.col("n_supported") + F.col("n_partial") + F.col("n_unsupported")
    return told.groupBy("basis", "mode").agg(F.count(F.lit(1)).alias("n_audited"), F.sum(n).cast("bigint").alias("n_claims"), F.round(F.avg(faithful), 4).alias("faithfulness"), F.round(F.avg(hall), 4).alias("hallucination"))


@query(f"""WITH {_ITEM}, {_KEYS}, {_GOLD}, c AS (SELECT DISTINCT item, rag_mode AS mode, key FROM k JOIN f USING (analysis_id) WHERE key IS NOT NULL AND src <> 'mock' AND item IS NOT NULL AND rag_mode IS NOT NULL), o AS (SELECT DISTINCT item, key FROM g JOIN f USING (analysis_id) WHERE item IS NOT NULL), st AS (SELECT DISTINCT item, {_STARTS} AS s FROM o)
SELECT c.mode, c.item, c.key AS claim, CASE WHEN o.key IS NOT NULL THEN 'supported' WHEN st.s IS NOT NULL THEN 'partial' ELSE 'unsupported' END AS status FROM c LEFT JOIN o ON o.item = c.item AND o.key = c.key LEFT JOIN st ON st.item = c.item AND st.s = regexp_extract(c.key, '^[^0-9]*')""")
def audited_claims(spark, root):
    """The claims of the audit against the gold basis, one row each."""
    made = table(spark, root, "clause_analyses").groupBy("analysis_id").agg(F.min("file_id").alias("item"), F.min("llm_source").alias("src"))
    cited = _cited_keys(spark, root).join(made.where("src <> 'mock'"), "analysis_id").where("item is not null and rag_mode is not null")
    claims = cited.groupBy(F.col("rag_mode").alias("mode"), "item").agg(F.array_sort(F.collect_set("key")).alias("claims"))
    gold = _gold_keys(spark, root).join(made, "analysis_id").where("item is not null").groupBy("item").agg(F.array_sort(F.collect_set("key")).alias("evidence"))
    asked = claims.join(gold, "item", "left").select("mode", "item", au.audit_prompt(F.col("claims"), F.coalesce("evidence", F.array().cast("array<string>"))).alias("prompt"))
    return au.judged_claims(m.complete(asked, F.col("prompt"), au.EvidenceClient, m.MOCK_AUDIT)).select("mode", "item", "claim", "status")


_PROMPT = "CAST(length(coalesce(claim, '')) + 7 AS INTEGER)"


@query(f"SELECT sample_id, 'live' AS source, CAST({_PROMPT} % 5 + 1 AS INTEGER) AS score, ['supported', 'partial', 'unsupported'][{_PROMPT} % 3 + 1] AS label FROM cross_model_judge")
def rubric_classify(spark, root):
    """Rubric score and label of each claim by a client that answers from its prompt."""
    prompt = F.concat(F.lit("Claim: "), F.coalesce("claim", F.lit("")))
    labels = ("supported", "partial", "unsupported")
    rows = m.rubric(table(spark, root, "cross_model_judge").select("sample_id", "claim"), prompt, au.EchoClient).drop("answer", "source")
    return m.classify(rows, prompt, list(labels), lambda: au.EchoClient(labels)).select("sample_id", "source", "score", "label")


_MASKED = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Z][12][0-9]{8}', '[身分證]', 'g'), '09[0-9]{2}[-\\s]?[0-9]{3}[-\\s]?[0-9]{3}', '[手機]', 'g'), '0[0-9]{1,2}[-\\s]?[0-9]{6,8}', '[電話]', 'g')"


@query(f"SELECT clause_id, 'live' AS source, substr('Clause:' || chr(10) || {_MASKED} || chr(10) || chr(10) || 'Statutes:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Judgements:', 1, 40) AS issue FROM clauses")
def analysis_from_prompt(spark, root):
    """Analyses by a client that gives the beginning of its prompt back: prompt, masking, answer and parser in one."""
    rows = table(spark, root, "clauses").select("clause_id", "text")
    none = F.array().cast("array<struct<text string, score double>>")
    got = m.analyse(rows, m.analysis_prompt(F.col("text"), none, none), lambda: au.EchoClient(fields=("issue", "rule", "application", "conclusion")))
    return got.select("clause_id", "source", "result.issue")


@query("""WITH a AS (SELECT sample_id, 20 + length(claim) AS n FROM cross_model_judge WHERE claim IS NOT NULL), b AS (SELECT *, n || ' characters are no proof' AS s1 FROM a), c AS (SELECT *, (n + 10 + length(s1)) || ' characters are no proof' AS s2 FROM b)
SELECT sample_id, [s1, s2, (n + 10 + length(s1) + 3 + length(s2)) || ' characters are no proof'] AS objections FROM c""")
def devil_rounds(spark, root):
    """Three rounds of objection, each prompt holding the objections before it, by a client that counts its prompt."""
    rows = table(spark, root, "cross_model_judge").select("sample_id", "claim").where("claim is not null")
    return m.debate(rows, F.col("claim"), au.EchoClient).select("sample_id", "objections")


_BAGS = "d AS (SELECT DISTINCT analysis_id, conclusion, clause_text FROM clause_analyses WHERE conclusion <> '' AND clause_text <> ''), v AS (SELECT analysis_id, conclusion, list_distinct(" + _TOKENS.replace("{0}", "conclusion") + ") AS a, list_distinct(" + _TOKENS.replace("{0}", "clause_text") + ") AS b FROM d)"


@query(f"WITH {_BAGS} SELECT DISTINCT analysis_id, CAST(length(conclusion) % 5 + 1 AS INTEGER) AS rubric, round(len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 4) AS cosine, round(0.6e0 * (length(conclusion) % 5 + 1) / 5 + 0.4e0 * len(list_intersect(a, b)) / sqrt(len(a) * len(b)), 4) AS reasoning FROM v WHERE len(a) > 0 AND len(b) > 0")
def reasoning_scores(spark, root):
    """Reasoning score of each conclusion: the rubric a client gives and the cosine of its terms with the clause's."""
    rows = table(spark, root, "clause_analyses").select("analysis_id", "conclusion", "clause_text").distinct().where("conclusion <> '' and clause_text <> ''")
    bags = rows.select("analysis_id", "conclusion", F.array_distinct(t.bigrams_and_words(F.col("conclusion"))).alias("a"), F.array_distinct(t.bigrams_and_words(F.col("clause_text"))).alias("b")).where("size(a) > 0 and size(b) > 0")
    cosine = F.size(F.array_intersect("a", "b")) / F.sqrt(F.size("a") * F.size("b"))
    scored = m.rubric(bags.select("analysis_id", "conclusion", cosine.alias("c")), F.col("conclusion"), au.EchoClient)
    return scored.select("analysis_id", F.col("score").alias("rubric"), F.round("c", 4).alias("cosine"), F.round(ev.reasoning(F.col("score"), F.col("c")), 4).alias("reasoning")).distinct()


# ---- samples judged by two, sheets against keys
@query(f"WITH v AS (SELECT DISTINCT item_id, rater_id, {_LAB.replace('{0}', 'label')} AS x FROM rater_labels), s AS (SELECT rater_id, count(*) FILTER (coalesce(x, '') = '') AS n_blank, count(*) FILTER (x <> '' AND x NOT IN ('supported', 'partial', 'unsupported')) AS n_invalid FROM v GROUP BY rater_id), k AS (SELECT DISTINCT sample_id, {_LAB.replace('{0}', 'gpt_4o')} AS y FROM cross_model_judge), j AS (SELECT rater_id, x, y FROM v JOIN k ON item_id = sample_id WHERE x IN ('supported', 'partial', 'unsupported') AND y IS NOT NULL), t AS (SELECT rater_id, x, y, count(*) AS c FROM j GROUP BY ALL), n AS (SELECT rater_id, sum(c) AS n, coalesce(sum(c) FILTER (x = y), 0) AS same FROM t GROUP BY 1), e AS (SELECT rater_id, sum(CAST(cx AS DOUBLE) * cy) AS e FROM (SELECT rater_id, x AS l, sum(c) AS cx FROM t GROUP BY 1, 2) JOIN (SELECT rater_id, y AS l, sum(c) AS cy FROM t GROUP BY 1, 2) USING (rater_id, l) GROUP BY 1), q AS (SELECT rater_id, CAST(n AS BIGINT) AS n, round(same / n, 4) AS agreement, round(CASE WHEN coalesce(e, 0) / (n * n) = 1 THEN 1 ELSE (same / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) END, 4) AS kappa FROM n LEFT JOIN e USING (rater_id)) SELECT rater_id, n_blank, n_invalid, n, agreement, kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS level FROM q JOIN s USING (rater_id)")
def label_sheet_join(spark, root):
    """Each rater's sheet joined with the key by sample: blanks, invalid labels, agreement, kappa and its level."""
    valid = ("supported", "partial", "unsupported")
    sheet = table(spark, root, "rater_labels").select("item_id", "rater_id", _label("label").alias("x")).distinct()
    tally = sheet.groupBy("rater_id").agg(F.count_if(F.coalesce("x", F.lit("")) == "").alias("n_blank"), F.count_if((F.col("x") != "") & ~F.col("x").isin(*valid)).alias("n_invalid"))
    key = table(spark, root, "cross_model_judge").select(F.col("sample_id").alias("item_id"), _label("gpt_4o").alias("y")).distinct()
    return tally.join(au.kappa_levels(sheet.where(F.col("x").isin(*valid)).join(key, "item_id"), "x", "y", ["rater_id"]), "rater_id")


@query(f"SELECT DISTINCT sample_id, x AS label_a, y AS label_b, x = y AS agree3, (x = 'supported') = (y = 'supported') AS agree2 FROM (SELECT sample_id, {_LAB.replace('{0}', 'gpt_5_mini')} AS x, {_LAB.replace('{0}', 'gpt_4o')} AS y FROM cross_model_judge) WHERE x IS NOT NULL AND y IS NOT NULL")
def cross_agreement_rows(spark, root):
    """Per sample whether two judges agree on three classes and on supported or not."""
    rows = table(spark, root, "cross_model_judge").select("sample_id", _label("gpt_5_mini").alias("label_a"), _label("gpt_4o").alias("label_b")).where("label_a is not null and label_b is not null")
    return rows.withColumn("agree3", F.col("label_a") == F.col("label_b")).withColumn("agree2", (F.col("label_a") == "supported") == (F.col("label_b") == "supported")).distinct()


_THREE = ("r01", "r02", "r03")


@query(f"WITH v AS (SELECT DISTINCT item_id, rater_id, {_LAB.replace('{0}', 'label')} AS x FROM rater_labels WHERE rater_id IN {_THREE}), k AS (SELECT item_id, rater_id, min(x) AS x FROM v WHERE x IN ('supported', 'partial', 'unsupported', 'hallucination', 'accurate', 'incomplete') GROUP BY 1, 2) SELECT item_id, list(x ORDER BY rater_id) AS labels, count(DISTINCT x) = 1 AS all_agree FROM k GROUP BY item_id HAVING count(*) = 3")
def judges_in_common(spark, root):
    """Items that three raters all labelled, with their labels in the raters' order."""
    known = ("supported", "partial", "unsupported", "hallucination", "accurate", "incomplete")
    rows = table(spark, root, "rater_labels").where(F.col("rater_id").isin(*_THREE)).select("item_id", "rater_id", _label("label").alias("x")).where(F.col("x").isin(*known))
    one = rows.groupBy("item_id", "rater_id").agg(F.min("x").alias("x"))
    sets = one.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rater_id", "x"))).alias("l")).where("size(l) = 3")
    return sets.select("item_id", F.col("l.x").alias("labels"), (F.size(F.array_distinct("l.x")) == 1).alias("all_agree"))


_HUMAN = "CASE WHEN regexp_matches(lower(human_label), 'halluc|incorrect|unfaithful|incomplete|unsupported') OR lower(trim(human_label)) IN ('1', 'true', 'yes') THEN 'hallucination' WHEN trim(human_label) <> '' THEN 'accurate' END"


@query(_kappa_sql(f"SELECT {_HUMAN} AS x, CASE WHEN judge_hall >= 0.5 THEN 'hallucination' WHEN judge_hall IS NOT NULL THEN 'accurate' END AS y FROM (SELECT DISTINCT item_key, human_label, judge_hall FROM reglab_checkpoint)"))
def judge_validation(spark, root):
    """Agreement of a judge, binarised by a threshold, with human labels binarised by their words."""
    rows = table(spark, root, "reglab_checkpoint").select("item_key", "human_label", "judge_hall").distinct()
    low = F.lower("human_label")
    human = F.when(low.rlike("halluc|incorrect|unfaithful|incomplete|unsupported") | F.trim(low).isin("1", "true", "yes"), "hallucination").when(F.trim("human_label") != "", "accurate")
    judge = F.when(F.col("judge_hall") >= 0.5, "hallucination").when(F.col("judge_hall").isNotNull(), "accurate")
    return st.kappa(rows.select(human.alias("x"), judge.alias("y")), "x", "y")


@query("WITH j AS (SELECT analysis_id, list_distinct(list_filter(flatten(list(coalesce(grounded, []))), lambda x: x IS NOT NULL)) AS a FROM citation_results GROUP BY 1), e AS (SELECT analysis_id, list_distinct(list_transform(list_filter(flatten(list(coalesce(cross_corroborated, []))), lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '^(.*)__第_([0-9-]+)_條$', '\\1第\\2條'))) AS b FROM triangulated_evidence GROUP BY 1), r AS (SELECT list_intersect(a, b) AS i, list_distinct(a || b) AS u, list_min(a) AS first, b FROM j JOIN e USING (analysis_id)) SELECT count(*) AS n, round(avg(CASE WHEN len(u) > 0 THEN len(i) / len(u) ELSE 1 END), 4) AS mean_jaccard, round(avg(CASE WHEN len(i) > 0 THEN 1e0 ELSE 0 END), 4) AS hit_any_rate, round(avg(CASE WHEN coalesce(list_contains(b, first), false) THEN 1e0 ELSE 0 END), 4) AS hit_primary_rate FROM r")
def reproducibility_summary(spark, root):
    """Means of the overlap of grounded and corroborated articles: Jaccard, any hit, hit of the first article."""
    none = F.array().cast("array<string>")
    gather = lambda n, c: F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.coalesce(c, none))))).alias(n)
    a = table(spark, root, "citation_results").groupBy("analysis_id").agg(gather("a", F.col("grounded")))
    named = F.transform("cross_corroborated", lambda x: F.regexp_replace(x, "^(.*)__第_([0-9-]+)_條$", "$1第$2條"))
    both = a.join(table(spark, root, "triangulated_evidence").groupBy("analysis_id").agg(gather("b", named)), "analysis_id")
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ev.jaccard(F.col("a"), F.col("b"))), 4).alias("mean_jaccard"), rate(F.arrays_overlap("a", "b")).alias("hit_any_rate"), rate(F.coalesce(F.array_contains("b", F.array_min("a")), F.lit(False))).alias("hit_primary_rate"))


# ---- gold sets
SUBSTANTIVE = ("民法", "消費者保護法", "民法總則施行法", "民法債編施行法", "民法物權編施行法")  # Fixed values: statutes of substantive law.
_BOIL = ", ".join(f"'民法__第_{n}_條'" for n in t.BOILERPLATE_NUMBERS)
_SUBST = f"g AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(relevant_ids) AS x FROM gold_queries) WHERE regexp_matches(x, '^({'|'.join(SUBSTANTIVE)})') AND x NOT IN ({_BOIL}))"


def _substantive(spark, root):
    rows = table(spark, root, "gold_queries").select("id", F.explode("relevant_ids").alias("x")).distinct()
    return rows.where(F.col("x").rlike(f"^({'|'.join(SUBSTANTIVE)})") & ~F.col("x").isin(*(f"民法__第_{n}_條" for n in t.BOILERPLATE_NUMBERS)))


@query(f"WITH {_SUBST}, q AS (SELECT id, min(query_text) AS query_text FROM gold_queries GROUP BY id) SELECT g.id, substr(query_text, 1, 500) AS query_text, count(*) AS n_articles FROM g JOIN q ON q.id IS NOT DISTINCT FROM g.id WHERE query_text IS NOT NULL GROUP BY g.id, query_text HAVING count(*) >= 2")
def substantive_gold(spark, root):
    """Gold queries with a text and at least two articles of substantive law that aren't boilerplate; the text cut to 500 characters."""
    texts = table(spark, root, "gold_queries").groupBy(F.col("id").alias("qid")).agg(F.min("query_text").alias("query_text"))
    per = _substantive(spark, root).groupBy("id").agg(F.count(F.lit(1)).alias("n_articles")).where("n_articles >= 2")
    return per.join(texts, F.col("id").eqNullSafe(F.col("qid"))).where("query_text is not null").select("id", F.substring("query_text", 1, 500).alias("query_text"), "n_articles")


@query(f"WITH {_SUBST}, n AS (SELECT round(count(*) / count(DISTINCT coalesce(id, '')), 2) AS mean_articles FROM g), c AS (SELECT x, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, x) AS rk FROM g GROUP BY x) SELECT CAST(rk AS INTEGER) AS rk, x AS article, n, mean_articles FROM c, n WHERE rk <= 10")
def gold_summary(spark, root):
    """Mean number of substantive articles of a gold query, and the ten most frequent."""
    rows = _substantive(spark, root)
    mean = rows.agg(F.round(F.count(F.lit(1)) / F.countDistinct(F.coalesce("id", F.lit(""))), 2).alias("mean_articles"))
    top = rows.groupBy(F.col("x").alias("article")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "article").limit(10)
    return top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n"), "article"))).join(mean, F.lit(True)).select("rk", "article", "n", "mean_articles")


@query("""WITH g AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(relevant_ids) AS x FROM gold_queries) WHERE x <> ''), s AS (SELECT chunk_id, min(law_name) AS law, min(article_no) AS no, min(content) AS content FROM statute_articles GROUP BY 1)
SELECT id, 'GOLD::' || law || no AS chunk_id, 1e0 AS score, law || ' ' || no || '：' || content AS text FROM g JOIN s ON s.chunk_id = x""")
def oracle_hits(spark, root):
    """Gold articles as hits with score 1, in the form retrieval gives."""
    keys = table(spark, root, "gold_queries").select("id", F.explode("relevant_ids").alias("x")).where("x <> ''").distinct()
    texts = table(spark, root, "statute_articles").groupBy(F.col("chunk_id").alias("x")).agg(F.min("law_name").alias("law"), F.min("article_no").alias("no"), F.min("content").alias("content"))
    return keys.join(texts, "x").select("id", F.concat(F.lit("GOLD::"), "law", "no").alias("chunk_id"), F.lit(1.0).alias("score"), F.concat("law", F.lit(" "), "no", F.lit("："), "content").alias("text"))


@query("SELECT id, query_text FROM (SELECT id, min(query_text) AS query_text FROM gold_queries WHERE id IS NOT NULL GROUP BY id) ORDER BY id LIMIT 20")
def first_gold(spark, root):
    """The first 20 gold queries by id: a preview, which is what the limit is for."""
    rows = table(spark, root, "gold_queries").where("id is not null").groupBy("id").agg(F.min("query_text").alias("query_text"))
    return rows.orderBy("id").limit(20)


@query("""WITH a AS (SELECT DISTINCT file_id, clause_index, analysis_id, coalesce(label, '') AS label, coalesce(risk_level, '') AS risk_level FROM clause_analyses WHERE llm_source <> 'mock' AND file_id IS NOT NULL AND clause_index IS NOT NULL)
SELECT file_id, count(*) AS n_clauses, to_json(list({'clause_index': clause_index, 'analysis_id': analysis_id, 'label': label, 'risk_level': risk_level} ORDER BY clause_index, analysis_id, label, risk_level)) AS report FROM a GROUP BY file_id""")
def nested_report(spark, root):
    """One JSON report a contract from its live analyses, clauses in order."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = table(spark, root, "clause_analyses").where("llm_source <> 'mock' and file_id is not null and clause_index is not null").select("file_id", "clause_index", "analysis_id", blank("label"), blank("risk_level")).distinct()
    parts = F.array_sort(F.collect_list(F.struct("clause_index", "analysis_id", "label", "risk_level")))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.to_json(parts).alias("report"))


# ---- hits of the evidence table
_EVID = "t AS (SELECT analysis_id, law_hits, judgement_hits FROM triangulated_evidence WHERE analysis_id IS NOT NULL), u AS (SELECT DISTINCT analysis_id, h.chunk_id AS chunk_id, round(h.score, 4) AS score, kind FROM (SELECT analysis_id, unnest(law_hits) AS h, 'law' AS kind FROM t UNION ALL SELECT analysis_id, unnest(judgement_hits), 'judgement' FROM t) WHERE h IS NOT NULL)"


@query(f"WITH {_EVID} SELECT analysis_id, kind, chunk_id, score, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY score DESC, chunk_id, kind) AS INTEGER) AS place FROM u")
def all_hits(spark, root):
    """Law and judgement hits of an analysis in one list by score, scores to 4 digits."""
    e = table(spark, root, "triangulated_evidence").where("analysis_id is not null")
    kind = lambda c, name: F.transform(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<struct<chunk_id:string,score:double>>"))), lambda h: F.struct(F.lit(name).alias("kind"), h["chunk_id"].alias("chunk_id"), F.round(h["score"], 4).alias("score")))
    rows = e.select("analysis_id", F.explode(F.concat(kind("law_hits", "law"), kind("judgement_hits", "judgement"))).alias("h")).select("analysis_id", "h.*").distinct()
    order = Window.partitionBy("analysis_id").orderBy(F.desc("score"), "chunk_id", "kind")
    return rows.withColumn("place", F.row_number().over(order))


_LAWHITS = "l AS (SELECT DISTINCT analysis_id, h.chunk_id AS c, h.score AS s FROM (SELECT analysis_id, unnest(law_hits) AS h FROM triangulated_evidence WHERE analysis_id IS NOT NULL) WHERE h IS NOT NULL)"


def _law_hits(spark, root):
    """(analysis_id, hits): all law hits of an analysis, of repeated rows too."""
    e = table(spark, root, "triangulated_evidence").where("analysis_id is not null")
    return e.groupBy("analysis_id").agg(F.flatten(F.collect_list(F.coalesce("law_hits", F.array().cast("array<struct<chunk_id:string,score:double>>")))).alias("hits"))


@query(f"""WITH {_LAWHITS}, q AS (SELECT DISTINCT analysis_id, regexp_replace({_canon_sql('x')}, '^(.*)第([0-9-]+)條$', '\\1__第_\\2_條') AS key FROM (SELECT analysis_id, unnest(cited_articles) AS x FROM clause_analyses) WHERE x <> ''), n AS (SELECT DISTINCT analysis_id FROM q WHERE key IS NOT NULL),
 r AS (SELECT l.*, n.analysis_id IS NOT NULL AS named, row_number() OVER (PARTITION BY l.analysis_id ORDER BY s DESC, c) AS rk FROM l LEFT JOIN n USING (analysis_id)), p AS (SELECT r.analysis_id, c, named, round(s + CASE WHEN named AND q.key IS NOT NULL THEN 0.2e0 ELSE 0e0 END, 6) AS s FROM r LEFT JOIN q ON q.analysis_id = r.analysis_id AND q.key = r.c WHERE rk <= CASE WHEN named THEN 20 ELSE 3 END),
 z AS (SELECT analysis_id, c AS chunk_id, s AS score, row_number() OVER (PARTITION BY analysis_id ORDER BY s DESC, c) AS rk FROM p) SELECT analysis_id, chunk_id, round(score, 4) AS score, CAST(rk AS INTEGER) AS rk FROM z WHERE rk <= 3""")
def article_boost_topk(spark, root):
    """Top 3 law hits with 0.2 added where the analysis cites the hit's article; a pool of 20 only where it cites any."""
    cited = table(spark, root, "clause_analyses").select("analysis_id", F.explode("cited_articles").alias("x")).where("x <> ''")
    keys = cited.select("analysis_id", t.article_key(F.get(t.article_list(F.col("x")), F.lit(0))).alias("key")).where("key is not null").groupBy("analysis_id").agg(F.collect_set("key").alias("keys"))
    rows = _law_hits(spark, root).join(keys, "analysis_id", "left")
    top = au.pooled_hits(F.col("hits"), F.col("keys"), lambda c: c, 3)
    return rows.select("analysis_id", F.posexplode(top).alias("p", "h")).select("analysis_id", "h.chunk_id", F.round("h.score", 4).alias("score"), (F.col("p") + 1).alias("rk"))


@query(f"""WITH {_LAWHITS}, r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY s DESC, c) AS rk FROM l), {_GOLD}, gk AS (SELECT DISTINCT analysis_id, regexp_replace(key, '^(.*)第([0-9-]+)條$', '\\1__第_\\2_條') AS c FROM g), ng AS (SELECT analysis_id, count(*) AS n FROM gk GROUP BY 1),
 i AS (SELECT DISTINCT t.analysis_id FROM triangulated_evidence t JOIN citation_results USING (analysis_id)), x AS (SELECT r.analysis_id, count(*) AS hits, min(rk) AS first FROM r JOIN gk USING (analysis_id, c) WHERE rk <= 3 GROUP BY 1),
 cc AS (SELECT DISTINCT analysis_id, x FROM (SELECT analysis_id, unnest(cross_corroborated) AS x FROM triangulated_evidence) WHERE x IS NOT NULL), cm AS (SELECT cc.analysis_id, count(*) AS n, count(gk.c) AS m FROM cc LEFT JOIN gk ON gk.analysis_id = cc.analysis_id AND gk.c = cc.x GROUP BY 1),
 v AS (SELECT i.analysis_id, round(CASE WHEN ng.n > 0 THEN coalesce(hits, 0) / ng.n ELSE 0e0 END, 4) AS recall, round(coalesce(hits, 0) / 3, 4) AS precision, round(coalesce(1 / first, 0), 4) AS mrr, coalesce(cm.n, 0) AS n_cross, coalesce(cm.m, 0) AS n_match FROM i LEFT JOIN ng USING (analysis_id) LEFT JOIN x USING (analysis_id) LEFT JOIN cm USING (analysis_id))
SELECT count(*) AS n, round(avg(recall), 4) AS recall_at_k, round(avg(precision), 4) AS precision_at_k, round(avg(mrr), 4) AS mrr, round(avg(n_cross), 2) AS mean_cross, count(*) FILTER (n_match > 0) AS n_with_match FROM v""")
def triangulation_vs_gold(spark, root):
    """Law hits of triangulation against the gold articles (k = 3), and how many analyses have a corroborated gold article."""
    gold = _gold_keys(spark, root).select("analysis_id", t.article_key(F.col("key")).alias("k")).groupBy("analysis_id").agg(F.collect_set("k").alias("gold"))
    results = table(spark, root, "citation_results").select("analysis_id").distinct()
    none = F.array().cast("array<string>")
    cross = table(spark, root, "triangulated_evidence").groupBy("analysis_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.coalesce("cross_corroborated", none))))).alias("cross"))
    rows = _law_hits(spark, root).join(results, "analysis_id", "left_semi").join(cross, "analysis_id").join(gold, "analysis_id", "left").withColumn("gold", F.coalesce("gold", none))
    found = F.transform(F.slice(au.by_score(F.col("hits")), 1, 3), lambda h: h["chunk_id"])
    per = rows.select(*(c.alias(n) for n, c in au.list_metrics(found, F.col("gold"), 3).items()), F.size("cross").alias("n_cross"), F.size(F.array_intersect("cross", "gold")).alias("n_match"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 4).alias("recall_at_k"), F.round(F.avg("precision"), 4).alias("precision_at_k"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("n_cross"), 2).alias("mean_cross"), F.count_if(F.col("n_match") > 0).alias("n_with_match"))


@query(f"""WITH {_LAWHITS}, s AS (SELECT chunk_id, min(law_name) AS law, min(article_no) AS no, min(content) AS content FROM statute_articles GROUP BY 1), r AS (SELECT l.*, row_number() OVER (PARTITION BY analysis_id ORDER BY s DESC, c) AS rk, law || ' ' || no AS head, content FROM l JOIN s ON s.chunk_id = c)
SELECT analysis_id, count(*) AS n_hits, string_agg('[L' || rk || '] (' || printf('%.2f', round(CAST(s AS DECIMAL(18, 6)), 2)) || ') ' || head, chr(10) || chr(10) ORDER BY rk) AS prompt_block, md5(string_agg('[' || rk || '] ' || head || chr(10) || substr(content, 1, 600), chr(10) || chr(10) ORDER BY rk)) AS audit_md5 FROM r GROUP BY analysis_id""")
def evidence_blocks(spark, root):
    """Law hits of each analysis as the numbered block of a prompt and as the text of an audit (its md5)."""
    texts = table(spark, root, "statute_articles").groupBy("chunk_id").agg(F.concat(F.min("law_name"), F.lit(" "), F.min("article_no")).alias("head"), F.min("content").alias("content"))
    rows = _law_hits(spark, root).select("analysis_id", F.explode(au.by_score(F.col("hits"))).alias("h")).select("analysis_id", "h.*").join(texts, "chunk_id")
    listed = rows.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "head", "content"))).alias("l"))
    hits = F.transform("l", lambda x: F.struct(x["head"].alias("text"), (-x["s"]).alias("score")))
    bodies = F.transform("l", lambda x: F.struct(x["head"].alias("head"), x["content"].alias("content")))
    return listed.select("analysis_id", F.size("l").cast("bigint").alias("n_hits"), m.hit_block(hits, "L", "").alias("prompt_block"), F.md5(au.hits_text(bodies, "")).alias("audit_md5"))


@query("""WITH a AS (SELECT DISTINCT analysis_id, TRY_CAST(analysis AS JSON) AS j, conclusion, suggestions FROM clause_analyses WHERE json_valid(analysis) AND analysis LIKE '{%'),
 p AS (SELECT analysis_id, [nullif(j->>'issue', ''), nullif(j->>'rule', ''), nullif(j->>'application', ''), nullif(conclusion, '')] AS v, list_filter(coalesce(suggestions, []), lambda s: s IS NOT NULL) AS sg FROM a),
 b AS (SELECT analysis_id, list_filter(list_transform([1, 2, 3, 4], lambda i: CASE WHEN v[i] IS NOT NULL THEN '### ' || ['Issue', 'Rule', 'Application', 'Conclusion'][i] || chr(10) || v[i] END), lambda x: x IS NOT NULL) AS l, array_to_string(list_transform(sg, lambda s: '- ' || s), chr(10)) AS g FROM p)
SELECT DISTINCT analysis_id, md5(coalesce(array_to_string(l, chr(10) || chr(10)), '') || CASE WHEN coalesce(g, '') <> '' THEN chr(10) || chr(10) || '### Suggestions' || chr(10) || g ELSE '' END) AS text_md5 FROM b""")
def analysis_texts(spark, root):
    """Analyses that are JSON as headed paragraphs for an audit (md5 of the text)."""
    rows = table(spark, root, "clause_analyses").select("analysis_id", "analysis", "conclusion", "suggestions").distinct().where("analysis like '{%'")
    parsed = rows.withColumn("_bad", F.from_json("analysis", "issue string, rule string, application string, _corrupt_record string", {"mode": "PERMISSIVE"})).where("_bad._corrupt_record is null")
    return parsed.select("analysis_id", F.md5(au.analysis_text(F.col("_bad"), F.col("conclusion"), F.col("suggestions"))).alias("text_md5")).distinct()


# ---- keys and labels
_KEYED = "SELECT DISTINCT regexp_replace(chunk_id, '^(.*)__第_([0-9-]+)_條$', '\\1第\\2條') AS article FROM statute_articles WHERE regexp_matches(chunk_id, '__第_[0-9-]+_條$')"


@query(f"""WITH a AS ({_KEYED}) SELECT article, regexp_replace(regexp_replace(regexp_replace(article, '^民法第', '民'), '^消費者保護法第', '消保'), '條$', '') AS short_label, CASE WHEN article LIKE '消費者保護法第%' THEN '消' || regexp_replace(replace(article, '消費者保護法第', ''), '條$', '') ELSE regexp_replace(replace(article, '民法第', ''), '條$', '') END AS number_label, CASE WHEN article LIKE '消費者保護法第%' THEN regexp_replace(article, '^消費者保護法第(.*)條$', '消保法\\1') WHEN article LIKE '民法第%' THEN regexp_replace(article, '^民法第(.*)條$', '民法\\1') ELSE article END AS repro_key, regexp_extract(article, '第([0-9-]+)條$', 1) AS bare_key FROM a""")
def article_labels(spark, root):
    """Short label, number label, key for reproducibility and bare number of every article."""
    named = F.regexp_replace("chunk_id", "^(.*)__第_([0-9-]+)_條$", "$1第$2條")
    rows = table(spark, root, "statute_articles").where("chunk_id rlike '__第_[0-9-]+_條$'").select(named.alias("article")).distinct()
    a = F.col("article")
    return rows.select("article", t.short_label(a).alias("short_label"), t.number_label(a).alias("number_label"), t.repro_key(a).alias("repro_key"), t.bare_number(a).alias("bare_key"))


@query("SELECT law_name, article_no, CAST(row_number() OVER (PARTITION BY law_name ORDER BY CAST(regexp_extract(article_no, '[0-9]+') AS INTEGER), coalesce(TRY_CAST(nullif(regexp_extract(article_no, '-([0-9]+)', 1), '') AS INTEGER), 0)) AS INTEGER) AS place FROM (SELECT DISTINCT law_name, article_no FROM statute_articles)")
def numeric_key_order(spark, root):
    """Article numbers, kept as text, in the order of their numbers."""
    rows = table(spark, root, "statute_articles").select("law_name", "article_no").distinct()
    main, sub = F.regexp_extract("article_no", "[0-9]+", 0).cast("int"), F.regexp_extract("article_no", "-([0-9]+)", 1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("law_name").orderBy(main, F.coalesce(F.when(sub != "", sub.cast("int")), F.lit(0)))))


@query("SELECT DISTINCT chunk_id, CAST(regexp_extract(content, '逾(?:第)?([0-9]{1,9})日', 1) AS INTEGER) AS days FROM judgement_chunks WHERE regexp_matches(content, '逾(?:第)?([0-9]{1,9})日') AND CAST(regexp_extract(content, '逾(?:第)?([0-9]{1,9})日', 1) AS INTEGER) > 60")
def quantity_over(spark, root):
    """Chunks whose first stated delay is over a bound (60 days): the quantity next to a term, compared with a cap."""
    rows = table(spark, root, "judgement_chunks").select("chunk_id", t.quantity(F.col("content"), "逾(?:第)?", "日").alias("days"))
    return rows.where("days > 60").distinct()


@query("SELECT DISTINCT chunk_id, CASE WHEN regexp_matches(content, '修繕') THEN 'repair' WHEN regexp_matches(content, '押金|押租金') THEN 'deposit' WHEN regexp_matches(content, '瑕疵') THEN 'defect' ELSE '' END AS rule FROM judgement_chunks WHERE content IS NOT NULL")
def first_rule(spark, root):
    """The first of a list of keyword rules a text meets, '' for none."""
    rules = ((("修繕",), "repair"), (("押金", "押租金"), "deposit"), (("瑕疵",), "defect"))
    return table(spark, root, "judgement_chunks").where("content is not null").select("chunk_id", t.first_rule(F.col("content"), rules).alias("rule")).distinct()


@query()
def style_normalize(spark, root):
    """Documents without bold marks and with full-width marks next to ideographs (tested against a character-wise version)."""
    rows = table(spark, root, "documents").select("doc_id", "text", t.styled(F.col("text")).alias("styled"))
    return rows.select("doc_id", "styled", (F.col("styled") != F.col("text")).alias("changed"))


# ---- keyword ranking against vectors, and a re-ranked pool, over the same gold queries
def _gold_asked(spark, root):
    return table(spark, root, "gold_queries").groupBy("id").agg(F.min("query_text").alias("query_text")).where("id is not null and query_text is not null")


def _statutes(spark, root):
    return table(spark, root, "statute_articles").groupBy("chunk_id").agg(F.min("content").alias("content"))


@query()
def bm25_vs_vector(spark, root):
    """Recall, precision, MRR and nDCG at 1, 3 and 5 of keyword ranking and of hashed n-gram vectors on the gold queries."""
    asked, texts = _gold_asked(spark, root), _statutes(spark, root)
    relevant = table(spark, root, "gold_queries").select(F.col("id").alias("query_id"), F.explode("relevant_ids").alias("chunk_id")).where("chunk_id <> ''").distinct()
    words = rt.bm25(asked, texts, 5, "id", "query_text", "chunk_id", "content")
    vectors = em.embedded(texts, "chunk_id", "content", em.HashEmbedder(passage_prefix="passage: ", query_prefix="query: "))
    of_query = em.embedded(asked, "id", "query_text", em.HashEmbedder(passage_prefix="passage: ", query_prefix="query: "), "query")
    near = rt.exact_topk(of_query.withColumnRenamed("id", "chunk_id"), vectors, 5, key="chunk_id")
    queries = asked.select(F.col("id").alias("query_id"))
    out = None
    for name, hits in (("bm25", words), ("vector", near)):
        marked = hits.join(relevant.withColumn("rel", F.lit(True)), ["query_id", "chunk_id"], "left").na.fill(False, ["rel"])
        report = ev.ir_report(ev.marked_metrics(marked, relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel")), [1, 3, 5], queries)).withColumn("ranking", F.lit(name))
        out = report if out is None else out.unionByName(report)
    return out


@query()
def reranked_topk(spark, root):
    """Top 3 of a pool of 30 keyword hits after a re-ranker."""
    asked, texts = _gold_asked(spark, root), _statutes(spark, root)
    pool = rt.bm25(asked, texts, 30, "id", "query_text", "chunk_id", "content").select("query_id", "chunk_id")
    met = pool.join(asked.select(F.col("id").alias("query_id"), "query_text"), "query_id").join(texts.withColumnRenamed("content", "text"), "chunk_id")
    return em.reranked(met, 3, "chunk_id", em.OverlapReranker()).select("query_id", "chunk_id", "score", "rk")
