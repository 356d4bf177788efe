"""Queries of the training-data problems 2 to 10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from lexmill.llm import canon, consensus, defects, leaks, pieces, scan, spans, together
from lexmill.llm.tokenize import token_ids
from lexmill.session import table


def p2_found(spark, root):
    raw = canon.typed_citations(table(spark, root, "clause_analyses"), table(spark, root, "citation_results"))
    return canon.canonical_articles(raw, table(spark, root, "statute_articles"))


def p3_found(spark, root):
    return scan.noise_kinds(table(spark, root, "extracted_docs"), table(spark, root, "clauses"))


def p3_repaired(spark, root):
    return scan.repaired_texts(table(spark, root, "extracted_docs"), table(spark, root, "clauses"))


def p4_found(spark, root):
    return defects.pair_defects(table(spark, root, "clause_analyses"))


def p4_counts(spark, root):
    """Number of defective answers by model, source, field and defect."""
    rows = table(spark, root, "clause_analyses")
    of = rows.groupBy("analysis_id").agg({"model": "min", "llm_source": "min"}).toDF("analysis_id", "model", "llm_source")
    return defects.pair_defects(rows).join(of, "analysis_id").groupBy("model", "llm_source", "field", "defect").count().withColumnRenamed("count", "n_answers")


def p5_found(spark, root):
    return pieces.oversized(table(spark, root, "judgement_chunks"))


def p5_pieces(spark, root):
    return pieces.cut_pieces(table(spark, root, "judgement_chunks").where("length(content) > 800").select("chunk_id", "content").distinct())


def p5_counts(spark, root):
    """Number of oversized chunks by section and kind of cut."""
    found = pieces.oversized(table(spark, root, "judgement_chunks"))
    sections = table(spark, root, "judgement_chunks").selectExpr("chunk_id", "coalesce(section, '') AS section").distinct()
    return found.join(sections, "chunk_id").groupBy("section", "cut_kind").count().withColumnRenamed("count", "n_chunks")


def p6_found(spark, root):
    items = together.article_items(*(table(spark, root, n) for n in ("clause_analyses", "triangulated_evidence", "statute_articles")))
    return together.lifted(items).selectExpr("field", "item_a AS article_a", "item_b AS article_b")


def p6_corroborated(spark, root):
    """Support and lift of the pairs of corroborated articles in at least four analyses."""
    pairs = together.pair_counts(together.corroborated_items(table(spark, root, "triangulated_evidence")), 4)
    return pairs.where("n_ab >= 4").selectExpr("item_a", "item_b", "n_ab", "n_a", "n_b", "round(n_ab * n / (n_a * n_b), 4) AS lift")


def _p7(spark, root):
    return consensus.project_votes(*(table(spark, root, n) for n in ("cross_model_judge", "reglab_checkpoint", "rater_labels")))


def p7_found(spark, root):
    labels, _ = consensus.consensus(*_p7(spark, root))
    return labels.selectExpr("item AS item_id", "label AS consensus")


def p7_raters(spark, root):
    _, raters = consensus.consensus(*_p7(spark, root))
    return raters.selectExpr("task", "rater", "n_votes", "round(reliability, 4) AS reliability", "stable")


def p7_agreement(spark, root):
    votes, items, _ = _p7(spark, root)
    return consensus.alpha(consensus.one_vote(votes).join(items, ["task", "item"], "left_semi"))


def p8_ids(spark, root):
    return token_ids(table(spark, root, "documents"))


def p9_found(spark, root):
    return leaks.leaked_documents(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_report(spark, root):
    return leaks.leak_report(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark, root):
    return spans.shared_span_pairs(table(spark, root, "documents"))


def p10_shared(spark, root):
    return spans.shared_share(table(spark, root, "documents"))


def p10_classes(spark, root):
    return spans.shared_classes(table(spark, root, "documents"))


def p10_paths(spark, root):
    return spans.shared_paths(table(spark, root, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_shared": p10_shared,
    "p10_classes": p10_classes,
    "p10_paths": p10_paths,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_counts": p5_counts,
    "p6_found": p6_found,
    "p6_corroborated": p6_corroborated,
    "p7_found": p7_found,
    "p7_raters": p7_raters,
    "p7_agreement": p7_agreement,
    "p8_ids": p8_ids,
}

_P5 = """WITH c AS (SELECT chunk_id, coalesce(section, '') AS section, content FROM judgement_chunks WHERE length(content) > 800),
     m AS (SELECT chunk_id, section, list_max(list_transform(string_split(regexp_replace(regexp_replace(content, '[.](\\s|$)', chr(1) || '\\1', 'g'), '[。！？；!?;\\n\\r]', chr(1), 'g'), chr(1)), lambda x: length(x))) AS longest FROM c),
     k AS (SELECT chunk_id, section, max(CASE WHEN longest > 800 THEN 'hard' ELSE 'boundary' END) AS cut_kind FROM m GROUP BY chunk_id, section)
"""

# every run of 160 characters of every text, by its digest
_RUNS = "w AS (SELECT DISTINCT doc_id, i, md5(substr(text, i, 160)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE length(text) >= 160)), s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), r AS (SELECT doc_id, i, h FROM w JOIN s USING (h))"
_LABEL = "regexp_replace(regexp_replace(lower({0}), '^[\\s[:punct:]]+|[\\s[:punct:]]+$', '', 'g'), '[\\s_-]+', '_', 'g')"
_MEANT = f"CASE WHEN {_LABEL} IN ('accurate', 'incomplete') THEN 'not_hallucination' ELSE {_LABEL} END"
_FLAG = "CASE {0} WHEN 1 THEN 'hallucination' WHEN 0 THEN 'not_hallucination' END"

SQL: dict[str, str] = {
    "p10_found": f"WITH {_RUNS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM r) a JOIN (SELECT DISTINCT doc_id, h FROM r) b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shared": f"""WITH {_RUNS}, g AS (SELECT doc_id, least(160, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 160)) AS c FROM (SELECT DISTINCT doc_id, i FROM r)), c AS (SELECT doc_id, sum(c) AS c FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(c, 0) / length(text), 4) ELSE 0e0 END AS shared_share FROM documents LEFT JOIN c USING (doc_id)""",
    "p10_classes": f"""WITH {_RUNS}, c AS (SELECT doc_id, CASE WHEN length(text) >= 160 THEN min(doc_id) OVER (PARTITION BY md5(text)) ELSE doc_id END AS class_id FROM documents), k AS (SELECT DISTINCT class_id, h FROM r JOIN c USING (doc_id)),
 l AS (SELECT class_id, count(DISTINCT other) AS n FROM (SELECT a.class_id, b.class_id AS other FROM k a JOIN k b ON a.h = b.h AND a.class_id <> b.class_id) GROUP BY 1) SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_copies, coalesce(l.n, 0) AS n_links FROM c LEFT JOIN l USING (class_id)""",
    "p7_agreement": f"""WITH v AS (SELECT 'claim' AS task, sample_id AS item, 'gpt_5_mini' AS rater, {_LABEL.replace('{0}', 'gpt_5_mini')} AS label, NULL AS voted FROM cross_model_judge UNION ALL SELECT 'claim', sample_id, 'gpt_4o', {_LABEL.replace('{0}', 'gpt_4o')}, NULL FROM cross_model_judge
 UNION ALL SELECT 'hallucination', item_key, 'human', CASE WHEN {_MEANT.replace('{0}', 'human_label')} IN ('hallucination', 'not_hallucination') THEN {_MEANT.replace('{0}', 'human_label')} ELSE {_FLAG.replace('{0}', 'human_hall')} END, NULL FROM reglab_checkpoint UNION ALL SELECT 'hallucination', item_key, 'judge', {_FLAG.replace('{0}', 'judge_hall')}, NULL FROM reglab_checkpoint
 UNION ALL SELECT t.task, item_id, rater_id, {_MEANT.replace('{0}', 'label')}, voted_at FROM rater_labels, (VALUES ('claim'), ('hallucination')) AS t(task)),
 k AS (SELECT * FROM v WHERE (task = 'claim' AND label IN ('supported', 'partial', 'unsupported') AND item IN (SELECT sample_id FROM cross_model_judge)) OR (task = 'hallucination' AND label IN ('hallucination', 'not_hallucination') AND item IN (SELECT item_key FROM reglab_checkpoint))),
 o AS (SELECT task, item, rater, label FROM k WHERE rater IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, item, rater ORDER BY coalesce(voted, TIMESTAMP '1970-01-01') DESC, label DESC) = 1),
 c AS (SELECT task, item, label, count(*) AS c FROM o GROUP BY ALL), i AS (SELECT task, item, sum(c) AS m, sum(c * c) AS sq FROM c GROUP BY 1, 2 HAVING sum(c) > 1), l AS (SELECT task, label, sum(c) AS n FROM c JOIN i USING (task, item) GROUP BY 1, 2), e AS (SELECT task, 1 - (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1)) AS expected FROM l GROUP BY 1),
 s AS (SELECT task, count(*) AS n_items, CAST(sum(m) AS BIGINT) AS n_votes, sum((m * m - sq) / (m - 1)) / sum(m) AS observed FROM i GROUP BY 1) SELECT task, n_items, n_votes, round(observed, 6) AS observed, round(expected, 6) AS expected, round(CASE WHEN expected > 0 THEN 1 - observed / expected ELSE 1 END, 6) AS alpha FROM s JOIN e USING (task)""",
    "p5_found": _P5 + "SELECT chunk_id, max(cut_kind) AS cut_kind FROM k GROUP BY chunk_id",
    "p5_counts": _P5 + "SELECT section, f.cut_kind, count(*) AS n_chunks FROM k JOIN (SELECT chunk_id, max(cut_kind) AS cut_kind FROM k GROUP BY chunk_id) f USING (chunk_id) GROUP BY 1, 2",
    "p6_corroborated": """
WITH i AS (SELECT DISTINCT analysis_id AS b, unnest(cross_corroborated) AS item FROM triangulated_evidence),
     k AS (SELECT b, item FROM i WHERE item IS NOT NULL AND item <> '' AND b IS NOT NULL),
     c AS (SELECT item, count(*) AS c FROM k GROUP BY item),
     t AS (SELECT count(DISTINCT b) AS n FROM k),
     p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM k x JOIN k y ON x.b = y.b AND x.item < y.item GROUP BY 1, 2)
SELECT item_a, item_b, n_ab, ca.c AS n_a, cb.c AS n_b, round(n_ab * n / CAST(ca.c * cb.c AS DOUBLE), 4) AS lift
FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b CROSS JOIN t WHERE n_ab >= 4""",
}
