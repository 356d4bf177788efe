"""Queries of the co-citation graph operators, with their SQL. Case := analysis, article := a retrieved statute."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import graph as g
from lexmill.operators.statistics import global_row_number
from lexmill.session import stage, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, root):
    hits = table(spark, root, "triangulated_evidence").select("analysis_id", F.explode("law_hits").alias("h"))
    return hits.select("analysis_id", F.col("h.chunk_id").alias("article")).where("article is not null")


_ITEMS = "i AS (SELECT DISTINCT analysis_id, h.chunk_id AS article FROM (SELECT analysis_id, unnest(law_hits) AS h FROM triangulated_evidence) WHERE h.chunk_id IS NOT NULL)"
_EDGES = f"{_ITEMS}, e AS (SELECT x.article AS a, y.article AS b, count(*) AS w FROM i x JOIN i y ON x.analysis_id = y.analysis_id AND x.article < y.article GROUP BY 1, 2 HAVING count(*) >= 2)"
_BOTH = f"{_EDGES}, d AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), wd AS (SELECT a AS node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM d GROUP BY a)"


def _edges(spark, root, least=2):
    return g.pair_edges(_items(spark, root), "analysis_id", "article", least)


@query(f"WITH {_EDGES} SELECT a, b, w FROM e")
def cooccurrence_edges(spark, root):
    return _edges(spark, root)


@query(f"WITH {_ITEMS} SELECT article, count(*) AS n_cases FROM i GROUP BY article")
def node_degree(spark, root):
    return _items(spark, root).distinct().groupBy("article").agg(F.count(F.lit(1)).alias("n_cases"))


@query(f"WITH {_BOTH} SELECT node, degree, weight FROM wd")
def weighted_degree(spark, root):
    return g.weighted_degree(_edges(spark, root))


def _cited(spark, root):
    rows = table(spark, root, "triangulated_evidence").select(F.col("analysis_id").alias("query_id"), F.explode("cross_corroborated").alias("article"))
    return rows.where("article is not null").distinct()


def _suggest(rank_by):
    part = "w / sqrt(CAST(wa.weight AS DOUBLE) * wb.weight)" if rank_by == "lift" else "CAST(w AS DOUBLE)"
    return f"""WITH {_BOTH}, c AS (SELECT DISTINCT analysis_id AS query_id, article FROM (SELECT analysis_id, unnest(cross_corroborated) AS article FROM triangulated_evidence) WHERE article IS NOT NULL),
 n AS (SELECT query_id, d.b, d.a, d.w, {part} AS part FROM c JOIN d ON d.a = c.article JOIN wd wa ON wa.node = d.a JOIN wd wb ON wb.node = d.b WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.query_id = c.query_id AND x.article = d.b)),
 s AS (SELECT query_id, b AS article, round(sum(part), 6) AS score, CAST(sum(w) AS BIGINT) AS co_count, first(a ORDER BY w DESC, a) AS anchor FROM n GROUP BY query_id, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article) AS rk FROM s)
SELECT query_id, article, score, co_count, anchor, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 5"""


@query(_suggest("lift"))
def suggest_missed_lift(spark, root):
    return g.suggest_missed(stage(_edges(spark, root), "edges"), _cited(spark, root))


@query(_suggest("count"))
def suggest_missed_count(spark, root):
    return g.suggest_missed(stage(_edges(spark, root), "edges"), _cited(spark, root), rank_by="count")


_RANK = f"WITH {_EDGES}, d AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), t AS (SELECT a, sum(w) AS t FROM d GROUP BY a), sh AS (SELECT d.a, d.b, d.w / t.t AS p FROM d JOIN t USING (a)), n AS (SELECT count(*) AS n FROM t), r0 AS (SELECT a AS node, 1e0 / n AS r FROM t, n)"
for _i in range(1, 6):
    _RANK += f", r{_i} AS (SELECT b AS node, 0.15e0 / any_value(n) + 0.85e0 * sum(r * p) AS r FROM sh JOIN r{_i - 1} ON node = a, n GROUP BY b)"


@query(_RANK + " SELECT node, round(r, 8) AS rank FROM r5")
def pagerank_fixed_iter(spark, root):
    return g.pagerank(_edges(spark, root), rounds=5).select("node", F.round("rank", 8).alias("rank"))


@query(_RANK + " SELECT node, round((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()), 4) AS scaled FROM r5")
def pagerank_scaled(spark, root):
    """Ranks scaled to 0..1; the extremes are aggregated, not windowed over all rows."""
    ranks = stage(g.pagerank(_edges(spark, root), rounds=5), "ranks")
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return ranks.join(ends, F.lit(True)).select("node", F.round((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")), 4).alias("scaled"))


@query(f"""WITH RECURSIVE {_EDGES}, d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c(node, reach) AS (SELECT DISTINCT a, a FROM d UNION SELECT c.node, d.b FROM c JOIN d ON d.a = c.reach)
SELECT node, min(reach) AS component FROM c GROUP BY node""".replace("HAVING count(*) >= 2", "HAVING count(*) >= 4"))
def connected_components(spark, root):
    """Components of the graph of pairs in at least four analyses."""
    return g.components(_edges(spark, root, 4))


@query(_RANK + " SELECT node, regexp_replace(regexp_replace(regexp_replace(node, '^民法__第_', '民'), '^消費者保護法__第_', '消保'), '_條$', '') AS short_label, round(r, 8) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(r, 8) DESC, node) AS rk FROM r5) WHERE rk <= 15")
def central_articles(spark, root):
    """The 15 most central articles with their short labels."""
    ranks = g.pagerank(_edges(spark, root), rounds=5).select("node", F.round("rank", 8).alias("rank")).orderBy(F.desc("rank"), "node").limit(15)
    named = F.regexp_replace("node", "^(.*)__第_([0-9-]+)_條$", "$1第$2條")
    short = F.when(F.col("node").rlike("^(民法|消費者保護法)__"), t.short_label(named)).otherwise(F.regexp_replace("node", "_條$", ""))
    return ranks.select("node", short.alias("short_label"), "rank")


@query()
def louvain_report(spark, root):
    """The eight largest communities with their eight most central articles (tested on graphs with known communities)."""
    edges = stage(_edges(spark, root), "edges")
    rows = stage(g.communities(edges).join(g.pagerank(edges, rounds=20), "node"), "members")
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(8)
    order = Window.partitionBy("community").orderBy(F.desc("rank"), "node")
    top = rows.join(sizes, "community").withColumn("rk", F.row_number().over(order)).where("rk <= 8")
    return top.select("community", "size", "rk", "node", F.round("rank", 6).alias("rank"))


@query("""WITH c AS (SELECT DISTINCT clause_id, file_id, clause_index, label FROM clauses WHERE file_id IS NOT NULL)
SELECT clause_id, file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY clause_index, clause_id) AS INTEGER) AS done, count(*) OVER (PARTITION BY file_id) AS total FROM c""")
def clause_progress(spark, root):
    """Clauses of each file in order with progress done / total."""
    rows = table(spark, root, "clauses").select("clause_id", "file_id", "clause_index", "label").where("file_id is not null").distinct()
    order = Window.partitionBy("file_id").orderBy("clause_index", "clause_id")
    return rows.select("clause_id", "file_id", F.row_number().over(order).alias("done"), F.count(F.lit(1)).over(Window.partitionBy("file_id")).alias("total"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS position FROM events")
def event_positions(spark, root):
    """Place of every event in time order: range partitions numbered by their counts."""
    rows = global_row_number(table(spark, root, "events").select("event_id", "ts"), ["ts", "event_id"], "position")
    return rows.select("event_id", F.col("position").cast("bigint").alias("position"))


@query(f"WITH {_EDGES} SELECT a, b, w, format('{{}} is cited together with {{}} in {{}} cases', b, a, w) AS reason FROM e WHERE w >= 4")
def edge_reasons(spark, root):
    """Why an edge's second article is suggested to whom cites the first."""
    return _edges(spark, root, 4).select("a", "b", "w", t.reason(F.col("a"), F.col("b"), F.col("w")).alias("reason"))
