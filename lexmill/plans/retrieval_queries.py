"""Queries of the retrieval, evaluation and statistics operators, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import evaluation as ev
from lexmill.operators import retrieval as rt
from lexmill.operators import statistics as st
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


# The query set of the vector searches: every vector whose id is divisible by 50, against all vectors.
def _asked(spark, root):
    return table(spark, root, "embeddings").where("vec_id % 50 = 0")


def _score(a="a", b="b", dims=None):
    va, vb = (f"CAST({x}.embedding AS DOUBLE[])" for x in (a, b))
    if dims:
        va, vb = f"{va}[1:{dims}]", f"{vb}[1:{dims}]"
    return f"round(list_inner_product({va}, {vb}) / sqrt(list_inner_product({va}, {va})) / sqrt(list_inner_product({vb}, {vb})), 9)"


def _top(k, where="", dims=None, name="s"):
    return f"""{name} AS (SELECT query_id, vec_id, score, rk FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_score(dims=dims)} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_score(dims=dims)} DESC, b.vec_id) AS rk
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {where} WHERE a.vec_id % 50 = 0) WHERE rk <= {k})"""


_OUT = "query_id, vec_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rk"


def _out(rows):
    return rows.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rk")


@query(f"WITH {_top(3)} SELECT {_OUT} FROM s")
def vector_topk(spark, root):
    return _out(rt.exact_topk(_asked(spark, root), table(spark, root, "embeddings"), 3))


def _label_metrics(spark, root, hits, ks):
    """Metrics of vector hits; relevant is what has the query's label, so labels meet the hits and are counted, and no pair of equal labels is made."""
    e = table(spark, root, "embeddings").select("vec_id", "label")
    asked = _asked(spark, root).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    marked = hits.join(asked, "query_id").join(e, "vec_id").select("query_id", "rk", F.coalesce(F.col("label") == F.col("own"), F.lit(False)).alias("rel"))
    total = asked.join(e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel")), F.col("own") == F.col("label")).select("query_id", "n_rel")
    return ev.marked_metrics(marked, total, ks, asked)


def _metrics_sql(k):
    return f"""
 rel AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
 m{k} AS (SELECT s.query_id, s.rk, r.vec_id IS NOT NULL AS rel FROM s LEFT JOIN rel r ON s.query_id = r.query_id AND s.vec_id = r.vec_id WHERE s.rk <= {k}),
 g{k} AS (SELECT query_id, count(*) FILTER (rel) AS hits, min(rk) FILTER (rel) AS first, coalesce(sum(1 / log2(rk + 1)) FILTER (rel), 0) AS dcg FROM m{k} GROUP BY query_id),
 e{k} AS (SELECT q.vec_id AS query_id, {k} AS k, coalesce(g.hits, 0) AS hits, coalesce(n_rel, 0) AS n_rel, first, coalesce(dcg, 0) AS dcg FROM embeddings q LEFT JOIN g{k} g ON g.query_id = q.vec_id LEFT JOIN nr ON nr.query_id = q.vec_id WHERE q.vec_id % 50 = 0),
 r{k} AS (SELECT query_id, k, CAST(hits AS BIGINT) AS hits, round(CASE WHEN n_rel > 0 THEN hits / n_rel ELSE 0 END, 4) AS recall, round(hits / k, 4) AS precision, round(coalesce(1 / first, 0), 4) AS mrr,
  round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 4) AS ndcg,
  round(CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 4) AS ndcg_full FROM e{k})"""


@query(f"WITH {_top(5)}, {_metrics_sql(5)} SELECT query_id, k, hits, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision, CAST(mrr AS DOUBLE) AS mrr, CAST(ndcg AS DOUBLE) AS ndcg, CAST(ndcg_full AS DOUBLE) AS ndcg_full FROM r5")
def ir_metrics_at_k(spark, root):
    """Vector top 5 with its retrieval metrics per query; relevant is what has the query's label."""
    hits = rt.exact_topk(_asked(spark, root), table(spark, root, "embeddings"), 5)
    return _label_metrics(spark, root, hits, [5])


def _report_sql(top):
    parts = [_metrics_sql(k) if k == 1 else ",".join(_metrics_sql(k).split("\n m")[1:]) for k in (1, 3, 5)]
    parts[1:] = [" m" + p for p in parts[1:]]
    mean = ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in ("recall", "precision", "mrr", "ndcg"))
    return f"WITH {top}, {', '.join(parts)} SELECT k, count(*) AS n_queries, {mean} FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r5) GROUP BY k"


def _report(spark, root, hits):
    return ev.ir_report(_label_metrics(spark, root, hits, [1, 3, 5]))


@query(_report_sql(_top(5)))
def ir_report_multi_k(spark, root):
    return _report(spark, root, rt.exact_topk(_asked(spark, root), table(spark, root, "embeddings"), 5))


@query(" UNION ALL ".join(f"SELECT {d} AS dims, * FROM ({_report_sql(_top(5, dims=d))})" for d in (16, 32, 64)))
def embed_compare(spark, root):
    """Retrieval reports of three embeddings: the first 16, 32 and all dimensions."""
    rows = table(spark, root, "embeddings")
    out = [_report(spark, root, rt.exact_topk(_asked(spark, root), rows, 5, dims=d)).withColumn("dims", F.lit(d)) for d in (16, 32, 64)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_top(20)}, b AS (SELECT query_id, vec_id, round(score + CASE WHEN query_id % 7 = vec_id % 7 THEN 0.2e0 ELSE 0 END, 9) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM b) SELECT {_OUT} FROM r WHERE rk <= 3")
def hybrid_boost_topk(spark, root):
    """Pool of 20 re-ranked with 0.2 added where query and candidate share a key (id modulo 7)."""
    pool = rt.exact_topk(_asked(spark, root), table(spark, root, "embeddings"), 20).drop("rk")
    return _out(rt.boosted(pool, F.col("query_id") % 7 == F.col("vec_id") % 7, 3, "vec_id"))


@query(f"""WITH {_top(3, 'AND b.vec_id % 2 = 0', name='l')}, {_top(3, 'AND b.vec_id % 2 = 1', name='j')},
 lk AS (SELECT query_id, list_sort(list(DISTINCT label)) AS x FROM l JOIN embeddings e USING (vec_id) GROUP BY query_id), jk AS (SELECT query_id, list_sort(list(DISTINCT label)) AS x FROM j JOIN embeddings e USING (vec_id) GROUP BY query_id)
SELECT q.vec_id AS query_id, coalesce(lk.x, []) AS law_keys, coalesce(jk.x, []) AS case_keys, list_sort(list_intersect(coalesce(lk.x, []), coalesce(jk.x, []))) AS "cross" FROM embeddings q LEFT JOIN lk ON lk.query_id = q.vec_id LEFT JOIN jk ON jk.query_id = q.vec_id WHERE q.vec_id % 50 = 0""")
def triangulate(spark, root):
    """Top 3 of two collections (even and odd ids) and the labels that both give."""
    e, q = table(spark, root, "embeddings"), _asked(spark, root)
    labels = e.select("vec_id", "label")
    law, case = (rt.exact_topk(q, e.where(f"vec_id % 2 = {m}"), 3).join(labels, "vec_id") for m in (0, 1))
    return rt.corroborated(law, case, "label", q.selectExpr("vec_id AS query_id"))


@query(f"WITH {_top(3, 'AND b.vec_id % 2 = 0', name='l')}, {_top(3, 'AND b.vec_id % 2 = 1', name='j')}, c AS (SELECT q.vec_id AS query_id, (SELECT count(*) FROM j WHERE j.query_id = q.vec_id) AS n_j, len(list_intersect((SELECT list(DISTINCT label) FROM l JOIN embeddings e USING (vec_id) WHERE l.query_id = q.vec_id), (SELECT list(DISTINCT label) FROM j JOIN embeddings e USING (vec_id) WHERE j.query_id = q.vec_id))) AS n_c FROM embeddings q WHERE q.vec_id % 50 = 0) SELECT round(avg(n_j), 4) AS mean_case_hits, round(avg(n_c), 4) AS mean_cross, count(*) FILTER (n_c > 0) AS n_matched FROM c")
def triangulation_summary(spark, root):
    e, q = table(spark, root, "embeddings"), _asked(spark, root)
    hits = rt.exact_topk(q, e.where("vec_id % 2 = 1"), 3)
    counts = q.selectExpr("vec_id AS query_id").join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_j")), "query_id", "left").join(triangulate(spark, root).select("query_id", F.size("cross").alias("n_c")), "query_id").na.fill(0)
    return counts.agg(F.round(F.avg("n_j"), 4).alias("mean_case_hits"), F.round(F.avg("n_c"), 4).alias("mean_cross"), F.count_if(F.col("n_c") > 0).alias("n_matched"))


@query(f"WITH {_top(30)}, b AS (SELECT s.query_id, s.vec_id, {_score(dims=16)} AS score FROM s JOIN embeddings a ON a.vec_id = s.query_id JOIN embeddings b ON b.vec_id = s.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM b) SELECT {_OUT} FROM r WHERE rk <= 5")
def rerank_pool(spark, root):
    """Pool of 30 re-ranked by a second scorer (cosine of the first 16 dimensions)."""
    e = table(spark, root, "embeddings")
    pool = rt.exact_topk(_asked(spark, root), e, 30).select("query_id", "vec_id")
    vec = lambda k, v: e.select(F.col("vec_id").alias(k), F.slice("embedding", 1, 16).cast("array<double>").alias(v))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    both = pool.join(vec("query_id", "x"), "query_id").join(vec("vec_id", "y"), "vec_id")
    scored = both.select("query_id", "vec_id", F.round(dot("x", "y") / F.sqrt(dot("x", "x")) / F.sqrt(dot("y", "y")), 9).alias("score"))
    return _out(rt.ranked(scored, 5, "vec_id"))


@query(f"""WITH {_top(30)}, n AS (SELECT vec_id AS a, UNNEST([vec_id + 1, vec_id + 7, vec_id + 50]) AS b FROM embeddings), d AS (SELECT a, b, 1 + (a + b) % 9 AS w FROM n WHERE b IN (SELECT vec_id FROM embeddings)), ed AS (SELECT a, b, w FROM d UNION ALL SELECT b, a, w FROM d),
 f AS (SELECT query_id, vec_id AS a FROM s WHERE rk = 1), l AS (SELECT s.query_id, s.vec_id, s.score, ed.w, max(ed.w) OVER (PARTITION BY s.query_id) AS m FROM s JOIN f USING (query_id) LEFT JOIN ed ON ed.a = f.a AND ed.b = s.vec_id),
 b AS (SELECT query_id, vec_id, round(score + 0.3e0 * CASE WHEN m > 0 THEN coalesce(w, 0) / m ELSE 0 END, 9) AS score FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM b) SELECT {_OUT} FROM r WHERE rk <= 5""")
def kg_boost_rerank(spark, root):
    """Pool of 30 re-ranked with the weights of a graph's edges from the first hit (edges made from ids)."""
    e = table(spark, root, "embeddings")
    d = e.select(F.col("vec_id").alias("a"), F.explode(F.array(*(F.col("vec_id") + i for i in (1, 7, 50)))).alias("b")).join(e.selectExpr("vec_id AS b"), "b", "left_semi").withColumn("w", 1 + (F.col("a") + F.col("b")) % 9)
    edges = d.select("a", "b", "w").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return _out(rt.edge_boosted(rt.exact_topk(_asked(spark, root), e, 30), edges, 5, "vec_id"))


_TOKENS = "list_filter(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+|[一-鿿]+'), lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') OR length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)), lambda z: z <> '')"


@query(f"""WITH d AS (SELECT doc_id, coalesce({_TOKENS.replace('{0}', 'text')}, []) AS ts FROM documents), z AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
 p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) GROUP BY ALL),
 f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, avgdl FROM p, z GROUP BY term, n, avgdl), i AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25e0 * avg(raw) OVER () ELSE raw END AS idf FROM f),
 q AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_TOKENS.replace('{0}', 'question')}) AS term FROM eval_items) GROUP BY ALL),
 s AS (SELECT query_id, doc_id, round(sum(qn * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term) GROUP BY query_id, doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM s) SELECT query_id, doc_id, round(score, 3) AS score, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 5""")
def bm25_topk(spark, root):
    """Top 5 documents of each evaluation question by BM25."""
    hits = rt.bm25(table(spark, root, "eval_items"), table(spark, root, "documents"), 5, "item_id", "question", "doc_id", "text")
    return hits.select("query_id", "doc_id", F.round("score", 3).alias("score"), "rk")


@query("""WITH c AS (SELECT DISTINCT analysis_id, rag_mode, list_distinct(list_filter(coalesce(matched_articles, []) || coalesce(spurious, []), lambda x: x IS NOT NULL)) AS a, list_distinct(list_filter(coalesce(grounded, []), lambda x: x IS NOT NULL)) AS b FROM citation_results),
 s AS (SELECT *, list_intersect(a, b) AS m, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS p, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS r FROM c)
SELECT analysis_id, rag_mode, list_sort(m) AS matched, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS spurious, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS missed, round(CAST(p AS DOUBLE), 4) AS precision_v, round(CAST(r AS DOUBLE), 4) AS recall_v, round(CAST(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS DOUBLE), 4) AS f1_v FROM s""")
def citation_prf(spark, root):
    """Scores of the cited (matched and spurious) against the grounded articles of each result."""
    none = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(F.col(c), none)
    cited = F.array_distinct(F.array_compact(F.concat(arr("matched_articles"), arr("spurious"))))
    grounded = F.array_distinct(F.array_compact(arr("grounded")))
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", cited.alias("a"), grounded.alias("b")).distinct()
    return rows.select("analysis_id", "rag_mode", *ev.set_scores(F.col("a"), F.col("b")))


@query("SELECT rag_mode, count(*) AS n, round(avg(precision_score), 4) AS mean_precision, round(avg(recall_score), 4) AS mean_recall, round(avg(f1), 4) AS mean_f1 FROM (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score, f1 FROM citation_results) GROUP BY rag_mode")
def citation_by_mode(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score", "f1").distinct()
    return rows.groupBy("rag_mode").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 4).alias(f"mean_{n}") for c, n in (("precision_score", "precision"), ("recall_score", "recall"), ("f1", "f1"))))


def _canon_sql(c):
    from lexmill.plans.text_queries import _ART, _number

    g = lambda i: f"regexp_extract({c}, '{_ART}', {i})"
    sub = f"CASE WHEN {g(3)} <> '' THEN {g(3)} WHEN {g(4)} <> '' THEN {g(4)} END"
    return f"nullif({g(1)}, '') || '第' || ({_number(g(2))}) || coalesce('-' || ({_number(sub)}), '') || '條'"


_CITED = f"SELECT rag_mode, raw, {_canon_sql('raw')} AS canonical FROM (SELECT DISTINCT analysis_id, rag_mode, unnest(cited) AS raw FROM citation_results) WHERE raw <> ''"


def _cited(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", F.explode("cited").alias("raw")).where("raw <> ''").distinct()
    return rows.select("rag_mode", "raw", F.get(t.article_list(F.col("raw")), F.lit(0)).alias("canonical"))


_REAL = "SELECT DISTINCT law_name || '第' || regexp_extract(article_no, '[0-9]+(-[0-9]+)?') || '條' AS canonical FROM statute_articles"


@query(f"WITH c AS ({_CITED}), r AS ({_REAL}), s AS (SELECT c.rag_mode, CASE WHEN c.canonical IS NULL THEN 'vague' WHEN r.canonical IS NOT NULL THEN 'real' ELSE 'nonexistent' END AS status FROM c LEFT JOIN r ON c.canonical = r.canonical) SELECT rag_mode, count(*) AS n_cited, " + ", ".join(f"count(*) FILTER (status = '{x}') AS n_{x}, round(count(*) FILTER (status = '{x}') / count(*), 4) AS {x}_rate" for x in ("real", "nonexistent", "vague")) + " FROM s GROUP BY rag_mode")
def citation_existence(spark, root):
    """Cited articles that are real, do not exist, or are too vague to tell, by mode."""
    real = table(spark, root, "statute_articles").select(F.concat("law_name", F.lit("第"), F.regexp_extract("article_no", "[0-9]+(-[0-9]+)?", 0), F.lit("條")).alias("canonical"))
    return ev.existence_summary(ev.existence(_cited(spark, root), real), "rag_mode")


def _basis_sql(how):
    one = "ct AS (SELECT law_name || '第' || regexp_extract(article_no, '[0-9]+(-[0-9]+)?') || '條' AS key, first(content ORDER BY loaded_at, chunk_id) AS content FROM statute_articles GROUP BY 1)"
    gold = "g AS (SELECT DISTINCT analysis_id AS item, content FROM (SELECT analysis_id, unnest(grounded) AS key FROM citation_results) JOIN ct USING (key))"
    cited = "c AS (SELECT DISTINCT rag_mode AS mode, analysis_id AS item, content FROM (SELECT rag_mode, analysis_id, unnest(matched_articles || spurious) AS key FROM citation_results) JOIN ct USING (key))"
    base = "SELECT mode, item, content FROM g, (SELECT DISTINCT mode FROM c)"
    more = {"gold": "", "union": " UNION SELECT mode, item, content FROM c", "shared": " UNION SELECT m.mode, c.item, c.content FROM c, (SELECT DISTINCT mode FROM c) m"}[how]
    return f"WITH {one}, {gold}, {cited}, b AS (SELECT DISTINCT * FROM ({base}{more})) SELECT mode, item, count(*) AS n_texts, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM b GROUP BY mode, item"


def _basis(spark, root, how):
    key = F.concat("law_name", F.lit("第"), F.regexp_extract("article_no", "[0-9]+(-[0-9]+)?", 0), F.lit("條"))
    texts = table(spark, root, "statute_articles").groupBy(key.alias("key")).agg(F.min_by("content", F.struct("loaded_at", "chunk_id")).alias("content"))  # the first one loaded
    rows = table(spark, root, "citation_results")
    gold = rows.select(F.col("analysis_id").alias("item"), F.explode("grounded").alias("key")).join(texts, "key").select("item", "content").distinct()
    cited = rows.select(F.col("rag_mode").alias("mode"), F.col("analysis_id").alias("item"), F.explode(F.concat("matched_articles", "spurious")).alias("key")).join(texts, "key").select("mode", "item", "content").distinct()
    return ev.basis(gold, cited, how).groupBy("mode", "item").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("content")).alias("n_chars"))


@query(_basis_sql("gold"))
def fair_basis_gold(spark, root):
    return _basis(spark, root, "gold")


@query(_basis_sql("union"))
def fair_basis_union(spark, root):
    return _basis(spark, root, "union")


@query(_basis_sql("shared"))
def fair_basis_shared(spark, root):
    return _basis(spark, root, "shared")


_VOTES = "v AS (SELECT DISTINCT item_id, rater_id, lower(regexp_replace(label, '^[\\s.]+|[\\s.]+$', '', 'g')) AS l FROM rater_labels), k AS (SELECT item_id, count(*) FILTER (l = 'supported') AS s, count(*) FILTER (l = 'partial') AS p, count(*) FILTER (l = 'unsupported') AS u FROM v WHERE l IN ('supported', 'partial', 'unsupported') GROUP BY item_id)"


def _vote_counts(spark, root):
    label = F.lower(F.regexp_replace("label", r"^[\s.]+|[\s.]+$", "")).alias("l")
    votes = table(spark, root, "rater_labels").select("item_id", "rater_id", label).distinct().where(F.col("l").isin("supported", "partial", "unsupported"))
    return votes.groupBy("item_id").agg(*(F.count_if(F.col("l") == x).alias(x[0]) for x in ("supported", "partial", "unsupported")))


@query(f"WITH {_VOTES} SELECT item_id, s, p, u, round((s + 0.5e0 * p) / (s + p + u), 4) AS faithfulness, round(u / (s + p + u), 4) AS hallucination FROM k")
def claim_scores(spark, root):
    faithful, hall = ev.claim_scores(F.col("s"), F.col("p"), F.col("u"))
    return _vote_counts(spark, root).select("item_id", "s", "p", "u", F.round(faithful, 4).alias("faithfulness"), F.round(hall, 4).alias("hallucination"))


@query(f"WITH {_VOTES} SELECT round(avg((s + 0.5e0 * p) / (s + p + u)), 4) AS faithfulness_macro, round(sum(s + 0.5e0 * p) / sum(s + p + u), 4) AS faithfulness_micro, round(avg(u / (s + p + u)), 4) AS hallucination_macro, round(sum(u) / sum(s + p + u), 4) AS hallucination_micro FROM k")
def claim_summary(spark, root):
    """Macro means over items beside the pooled ratios."""
    faithful, hall = ev.claim_scores(F.col("s"), F.col("p"), F.col("u"))
    n = F.sum(F.col("s") + F.col("p") + F.col("u"))
    return _vote_counts(spark, root).agg(F.round(F.avg(faithful), 4).alias("faithfulness_macro"), F.round(F.sum(F.col("s") + 0.5 * F.col("p")) / n, 4).alias("faithfulness_micro"), F.round(F.avg(hall), 4).alias("hallucination_macro"), F.round(F.sum("u") / n, 4).alias("hallucination_micro"))


@query("WITH c AS (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score, f1 FROM citation_results WHERE f1 IS NOT NULL) SELECT analysis_id, rag_mode, round(0.4e0 * precision_score + 0.3e0 * f1 + 0.3e0 * (0.6e0 * 4 / 5 + 0.4e0 * recall_score), 4) AS with_reasoning, round(0.6e0 * precision_score + 0.4e0 * f1, 4) AS without_reasoning FROM c")
def overall_score(spark, root):
    """Weighted overall scores with a reasoning score (rubric 4, cosine := recall) and without."""
    rows = table(spark, root, "citation_results").where("f1 is not null").select("analysis_id", "rag_mode", "precision_score", "recall_score", "f1").distinct()
    p, f, none = F.col("precision_score"), F.col("f1"), F.lit(None).cast("double")
    return rows.select("analysis_id", "rag_mode", F.round(ev.overall(p, f, ev.reasoning(F.lit(4.0), F.col("recall_score"))), 4).alias("with_reasoning"), F.round(ev.overall(p, f, none), 4).alias("without_reasoning"))


@query("""WITH c AS (SELECT analysis_id, list_distinct(list_filter(flatten(list(coalesce(grounded, []))), lambda x: x IS NOT NULL)) AS a FROM citation_results GROUP BY analysis_id), e AS (SELECT analysis_id, list_distinct(list_filter(flatten(list(coalesce(cross_corroborated, []))), lambda x: x IS NOT NULL)) AS b FROM triangulated_evidence GROUP BY analysis_id),
 j AS (SELECT analysis_id, a, b, list_intersect(a, b) AS i, list_distinct(a || b) AS u FROM c JOIN e USING (analysis_id))
SELECT analysis_id, round(CASE WHEN len(u) > 0 THEN len(i) / len(u) ELSE 1 END, 4) AS jaccard, len(i) > 0 AS hit_any, coalesce(list_contains(b, list_min(a)), false) AS hit_primary FROM j""")
def jaccard_repro(spark, root):
    """Overlap of grounded and corroborated articles of each analysis."""
    gather = lambda n, c: F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(n)
    a = table(spark, root, "citation_results").groupBy("analysis_id").agg(gather("a", "grounded"))
    b = table(spark, root, "triangulated_evidence").groupBy("analysis_id").agg(gather("b", "cross_corroborated"))
    both = a.join(b, "analysis_id")
    return both.select("analysis_id", F.round(ev.jaccard(F.col("a"), F.col("b")), 4).alias("jaccard"), F.arrays_overlap("a", "b").alias("hit_any"), F.coalesce(F.array_contains("b", F.array_min("a")), F.lit(False)).alias("hit_primary"))


_LAB = "lower(regexp_replace({0}, '^[\\s.]+|[\\s.]+$', '', 'g'))"


def _kappa_sql(src, degenerate="1"):
    return f"""WITH s AS ({src}), c AS (SELECT x, y, count(*) AS c FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y), n AS (SELECT sum(c) AS n, coalesce(sum(c) FILTER (x = y), 0) AS same FROM c),
 e AS (SELECT coalesce(sum(CAST(cx AS DOUBLE) * cy), 0) AS e FROM (SELECT x AS l, sum(c) AS cx FROM c GROUP BY x) JOIN (SELECT y AS l, sum(c) AS cy FROM c GROUP BY y) USING (l))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 4) AS agreement, round(CASE WHEN e / (n * n) = 1 THEN {degenerate} ELSE (same / n - e / (n * n)) / (1 - e / (n * n)) END, 4) AS kappa FROM n, e"""


def _label(c):
    return F.lower(F.regexp_replace(c, r"^[\s.]+|[\s.]+$", ""))


@query(_kappa_sql(f"SELECT {_LAB.replace('{0}', 'gpt_5_mini')} AS x, {_LAB.replace('{0}', 'gpt_4o')} AS y FROM cross_model_judge"))
def cohen_kappa_k(spark, root):
    rows = table(spark, root, "cross_model_judge").select(_label("gpt_5_mini").alias("x"), _label("gpt_4o").alias("y"))
    return st.kappa(rows, "x", "y")


@query(_kappa_sql("SELECT human_hall AS x, judge_hall AS y FROM (SELECT DISTINCT item_key, human_hall, judge_hall FROM reglab_checkpoint)", "0"))
def cohen_kappa_binary(spark, root):
    rows = table(spark, root, "reglab_checkpoint").select("item_key", "human_hall", "judge_hall").distinct()
    return st.kappa(rows, "human_hall", "judge_hall", degenerate=0.0)


@query("SELECT count(*) AS n, count(*) FILTER (human_hall = 1 AND judge_hall = 1) AS tp, count(*) FILTER (human_hall <> 1 AND judge_hall <> 1) AS tn, count(*) FILTER (human_hall <> 1 AND judge_hall = 1) AS fp, count(*) FILTER (human_hall = 1 AND judge_hall <> 1) AS fn, round(count(*) FILTER (human_hall = 1) / count(*), 4) AS human_rate, round(count(*) FILTER (judge_hall = 1) / count(*), 4) AS judge_rate FROM (SELECT DISTINCT item_key, human_hall, judge_hall FROM reglab_checkpoint) WHERE human_hall IS NOT NULL AND judge_hall IS NOT NULL")
def confusion_matrix(spark, root):
    return st.confusion(table(spark, root, "reglab_checkpoint").select("item_key", "human_hall", "judge_hall").distinct(), "human_hall", "judge_hall")


@query(f"SELECT {_LAB.replace('{0}', 'label')} AS label, count(*) AS n FROM rater_labels GROUP BY 1")
def label_distribution(spark, root):
    return table(spark, root, "rater_labels").groupBy(_label("label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Paired measures: precision and recall of the same result; raters: precision, recall and f1.
_PAIR = "d AS (SELECT rag_mode, round(recall_score - precision_score, 9) AS d FROM (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score FROM citation_results) WHERE round(recall_score - precision_score, 9) <> 0)"


@query(f"""WITH {_PAIR}, c AS (SELECT rag_mode, abs(d) AS m, count(*) AS c FROM d GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY rag_mode ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rk FROM c),
 g AS (SELECT d.rag_mode, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wn, sum(c * c - 1) AS t FROM d JOIN k ON d.rag_mode IS NOT DISTINCT FROM k.rag_mode AND abs(d.d) = k.m GROUP BY d.rag_mode)
SELECT rag_mode, n_pos, n_neg, CAST(least(wp, wn) AS DOUBLE) AS w, round((least(wp, wn) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2e0 * n + 1) / 24e0 - t / 48e0), 4) AS z, round((n_pos - n_neg) / n, 4) AS r FROM g""")
def wilcoxon_signed_rank(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score").distinct()
    return st.wilcoxon(rows, "precision_score", "recall_score", ["rag_mode"]).drop("p", "p_exact")


@query("SELECT rag_mode, count(*) FILTER (a AND NOT b) AS b01, count(*) FILTER (NOT a AND b) AS b10, count(*) FILTER (a <> b) AS discordant FROM (SELECT rag_mode, precision_score >= 0.5 AS a, recall_score >= 0.5 AS b FROM (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score FROM citation_results)) GROUP BY rag_mode")
def mcnemar_counts(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score").distinct()
    return st.mcnemar(rows.select("rag_mode", (F.col("precision_score") >= 0.5).alias("a"), (F.col("recall_score") >= 0.5).alias("b")), "a", "b", ["rag_mode"]).drop("p")


@query("""WITH p AS (SELECT court, count(*) / (SELECT count(*) FROM judgement_chunks) AS p FROM judgement_chunks WHERE court IS NOT NULL GROUP BY court), m AS (SELECT court, p, (count(*) OVER () - row_number() OVER (ORDER BY p, court) + 1) * p AS x FROM p)
SELECT court, round(p, 6) AS p, round(least(1e0, max(x) OVER (ORDER BY p, court ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM m""")
def holm_correction(spark, root):
    """Holm's correction of a p value per court (its share of the chunks)."""
    rows = table(spark, root, "judgement_chunks")
    n = rows.count()
    tests = rows.where("court is not null").groupBy("court").agg((F.count(F.lit(1)) / n).alias("p"))
    return st.holm(tests, "p", "court").select("court", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


_RATE = "SELECT analysis_id || '|' || rag_mode AS target, unnest(['p', 'r', 'f']) AS rater, unnest([precision_score, recall_score, f1]) AS v FROM (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score, f1 FROM citation_results WHERE precision_score IS NOT NULL AND recall_score IS NOT NULL AND f1 IS NOT NULL AND rag_mode IS NOT NULL)"


def _ratings(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score", "f1").dropna().distinct()
    rate = F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), F.col(c).alias("v")) for r, c in (("p", "precision_score"), ("r", "recall_score"), ("f", "f1")))))
    return rows.select(F.concat_ws("|", F.col("analysis_id").cast("string"), "rag_mode").alias("target"), rate.alias("x")).groupBy("target", "x.rater").agg(F.avg("x.v").alias("v"))


@query(f"""WITH q AS ({_RATE}), f AS (SELECT target, rater, avg(v) AS v FROM q GROUP BY target, rater), a AS (SELECT count(DISTINCT target) AS n, 3 AS k, var_pop(v) AS vt FROM f), r AS (SELECT var_pop(m) AS vr FROM (SELECT avg(v) AS m FROM f GROUP BY target)), c AS (SELECT var_pop(m) AS vc FROM (SELECT avg(v) AS m FROM f GROUP BY rater)),
 s AS (SELECT n, k, n * k * vr / (n - 1) AS msr, n * k * vc / (k - 1) AS msc, (n * k * vt - n * k * vr - n * k * vc) / ((n - 1) * (k - 1)) AS mse FROM a, r, c)
SELECT CAST(n AS BIGINT) AS n_targets, k AS n_raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 4) AS icc_2_1, round((msr - mse) / (msr + (msc - mse) / n), 4) AS icc_2_k FROM s""")
def icc(spark, root):
    return st.icc(_ratings(spark, root), "target", "rater", "v")


@query("""WITH p AS (SELECT rag_mode, precision_score AS a, recall_score AS b FROM (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score FROM citation_results) WHERE precision_score IS NOT NULL AND recall_score IS NOT NULL),
 k AS (SELECT rag_mode, a, b, rank() OVER (PARTITION BY rag_mode ORDER BY a) + (count(*) OVER (PARTITION BY rag_mode, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY rag_mode ORDER BY b) + (count(*) OVER (PARTITION BY rag_mode, b) - 1) / 2 AS rb FROM p)
SELECT rag_mode, count(*) AS n, round(corr(a, b), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM k GROUP BY rag_mode""")
def pearson_spearman(spark, root):
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score").distinct()
    return st.correlations(rows, "precision_score", "recall_score", ["rag_mode"])


@query(f"""WITH v AS (SELECT item_id, {_LAB.replace('{0}', 'label')} AS l FROM rater_labels), k AS (SELECT item_id, bool_and(l <> 'unsupported') AS up, bool_and(l = 'supported') AS full_up, count(*) AS n FROM v WHERE l IN ('supported', 'partial', 'unsupported') GROUP BY item_id)
SELECT count(*) AS n_items, count(*) FILTER (up) AS n_up, count(*) FILTER (full_up) AS n_full FROM k WHERE n > 1""")
def direction_agreement(spark, root):
    """Items with several votes where all raters agree in direction: none says unsupported; all say supported."""
    votes = table(spark, root, "rater_labels").select("item_id", _label("label").alias("l")).where(F.col("l").isin("supported", "partial", "unsupported"))
    per = votes.groupBy("item_id").agg(F.every(F.col("l") != "unsupported").alias("up"), F.every(F.col("l") == "supported").alias("full_up"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("up").alias("n_up"), F.count_if("full_up").alias("n_full"))


@query()
def bootstrap_ci(spark, root):
    """95 % interval of the mean f1 by mode (tested against the normal interval)."""
    return st.bootstrap_ci(table(spark, root, "citation_results").select("rag_mode", "f1"), "f1", ["rag_mode"])


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE (r - 1) % 100 = 0")
def systematic_sample(spark, root):
    return st.systematic_sample(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


_PRIO = "CASE x WHEN 'unsupported' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END"


@query(f"WITH c AS (SELECT DISTINCT sample_id, {_LAB.replace('{0}', 'gpt_4o')} AS x FROM cross_model_judge), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY md5(sample_id), sample_id) AS rn FROM c WHERE x IS NOT NULL) SELECT sample_id, x AS label FROM r ORDER BY rn, {_PRIO}, x LIMIT 60")
def stratified_roundrobin(spark, root):
    rows = table(spark, root, "cross_model_judge").select("sample_id", _label("gpt_4o").alias("label")).where("label is not null").distinct()
    priority = F.when(F.col("label") == "unsupported", 1).when(F.col("label") == "partial", 2).otherwise(3)
    return st.round_robin_sample(rows, "label", "sample_id", priority, 60).select("sample_id", "label")


@query("SELECT a.analysis_id, a.model FROM (SELECT DISTINCT analysis_id, model FROM clause_analyses) a WHERE NOT EXISTS (SELECT 1 FROM triangulated_evidence e WHERE e.analysis_id = a.analysis_id)")
def resume_antijoin(spark, root):
    """Analyses that are still to do: no evidence row yet."""
    rows = table(spark, root, "clause_analyses").select("analysis_id", "model").distinct()
    return rows.join(table(spark, root, "triangulated_evidence").select("analysis_id"), "analysis_id", "left_anti")


@query("""WITH g AS (SELECT id, unnest(relevant_ids) AS key FROM gold_queries), d AS (SELECT DISTINCT id, key, regexp_replace(trim(key), '[\\s_]', '', 'g') AS norm FROM g WHERE key <> ''),
 a AS (SELECT chunk_id AS key, min(content) AS content FROM statute_articles GROUP BY 1), b AS (SELECT regexp_replace(chunk_id, '[\\s_]', '', 'g') AS norm, min(content) AS content FROM statute_articles GROUP BY 1)
SELECT d.id, d.key AS raw, coalesce(a.content, b.content, '(not found)') AS content FROM d LEFT JOIN a USING (key) LEFT JOIN b ON b.norm = d.norm""")
def gold_text_lookup(spark, root):
    """Text of each relevant id by the raw key, else by its normal form, else a placeholder."""
    squash = lambda c: F.regexp_replace(F.trim(c), r"[\s_]", "")
    keys = table(spark, root, "gold_queries").select("id", F.explode("relevant_ids").alias("raw")).where("raw <> ''").distinct().withColumn("canonical", squash("raw"))
    s = table(spark, root, "statute_articles")
    texts = s.select(F.col("chunk_id").alias("key"), "content").unionByName(s.select(squash("chunk_id").alias("key"), "content"))
    return ev.resolve(keys, texts).select("id", "raw", "content")


@query("SELECT regexp_replace(article_no, '\\s+', '', 'g') AS article, count(*) AS n_laws, first(content ORDER BY loaded_at DESC, chunk_id DESC) AS snippet FROM statute_articles GROUP BY 1")
def article_snippets(spark, root):
    """Latest content by article number without white space: the last one loaded wins."""
    rows = table(spark, root, "statute_articles")
    return rows.groupBy(t.squash(F.col("article_no")).alias("article")).agg(F.count(F.lit(1)).alias("n_laws"), F.max_by("content", F.struct("loaded_at", "chunk_id")).alias("snippet"))


@query("""WITH r AS (SELECT DISTINCT id, regexp_replace(x, '[^0-9-]', '', 'g') AS num FROM (SELECT id, unnest(relevant_ids) AS x FROM gold_queries) WHERE x LIKE '%法%'),
 c AS (SELECT r.id, r.num, s.chunk_id, row_number() OVER (PARTITION BY r.id, r.num ORDER BY (substr(q.clause_type, 1, 2) = substr(s.content, 1, 2)) DESC NULLS LAST, s.chunk_id) AS rn, count(*) OVER (PARTITION BY r.id, r.num) AS n
  FROM r JOIN (SELECT id, min(clause_type) AS clause_type FROM gold_queries GROUP BY id) q ON q.id IS NOT DISTINCT FROM r.id JOIN statute_articles s ON regexp_replace(s.article_no, '[^0-9-]', '', 'g') = r.num)
SELECT id, num, chunk_id, n = 1 AS sure FROM c WHERE rn = 1""")
def reference_resolution(spark, root):
    """Article numbers alone to statutes: the only candidate, else one whose text begins like the clause type, else the first."""
    gold = table(spark, root, "gold_queries")
    refs = gold.select("id", F.explode("relevant_ids").alias("x")).where("x like '%法%'").select("id", t.digits_only(F.col("x")).alias("num")).distinct()
    kinds = gold.groupBy(F.col("id").alias("gid")).agg(F.min("clause_type").alias("clause_type"))
    statutes = table(spark, root, "statute_articles").select(t.digits_only(F.col("article_no")).alias("num"), "chunk_id", "content")
    met = refs.join(kinds, F.col("id").eqNullSafe(F.col("gid"))).join(statutes, "num")
    like = F.substring("clause_type", 1, 2) == F.substring("content", 1, 2)
    order = Window.partitionBy("id", "num").orderBy(F.desc_nulls_last(like), "chunk_id")
    return met.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id", "num"))).where("rn = 1").select("id", "num", "chunk_id", (F.col("n") == 1).alias("sure"))


@query("SELECT item_key, CASE WHEN lower(regexp_replace(human_label, '^[\\s.]+|[\\s.]+$', '', 'g')) <> '' THEN CAST(lower(regexp_replace(human_label, '^[\\s.]+|[\\s.]+$', '', 'g')) = 'hallucination' AS INTEGER) END AS flag FROM reglab_checkpoint")
def label_binarize(spark, root):
    return table(spark, root, "reglab_checkpoint").select("item_key", t.binary(F.col("human_label"), ("hallucination",)).alias("flag"))


_RANK_SUMS = f"""{_PAIR}, c AS (SELECT rag_mode, abs(d) AS m, count(*) AS c FROM d GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY rag_mode ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rk FROM c),
 g AS (SELECT d.rag_mode, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wn, sum(c * c - 1) AS t FROM d JOIN k ON d.rag_mode = k.rag_mode AND abs(d.d) = k.m GROUP BY d.rag_mode),
 z AS (SELECT *, (least(wp, wn) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2e0 * n + 1) / 24e0 - t / 48e0) AS zz FROM g)"""
# the normal tail by the same approximation of the complementary error function
_TAIL = "-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))"


@query(f"""WITH {_RANK_SUMS}, x AS (SELECT rag_mode, n_pos, n_neg, n, least(wp, wn) AS w, zz, abs(zz) / sqrt(2e0) AS x, 1 / (1 + 0.5e0 * abs(zz) / sqrt(2e0)) AS t FROM z), p AS (SELECT *, round(t * exp(-x * x + {_TAIL}), 6) AS p FROM x), h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, rag_mode) + 1) * p AS up FROM p),
 m AS (SELECT rag_mode, round(avg(precision_score), 4) AS mean_precision, round(avg(recall_score), 4) AS mean_recall FROM (SELECT DISTINCT analysis_id, rag_mode, precision_score, recall_score FROM citation_results) GROUP BY 1)
SELECT rag_mode, mean_precision, mean_recall, n_pos, n_neg, CAST(w AS DOUBLE) AS w, round(zz, 4) AS z, round((n_pos - n_neg) / n, 4) AS r, p, least(1e0, max(up) OVER (ORDER BY p, rag_mode ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h JOIN m USING (rag_mode)""")
def significance_report(spark, root):
    """Per mode: means of both measures, the signed-rank test of their difference and its p corrected by Holm."""
    rows = table(spark, root, "citation_results").select("analysis_id", "rag_mode", "precision_score", "recall_score").distinct()
    means = rows.groupBy("rag_mode").agg(F.round(F.avg("precision_score"), 4).alias("mean_precision"), F.round(F.avg("recall_score"), 4).alias("mean_recall"))
    tests = st.holm(st.wilcoxon(rows, "precision_score", "recall_score", ["rag_mode"]).drop("p_exact"), "p", "rag_mode")
    return means.join(tests, "rag_mode")
