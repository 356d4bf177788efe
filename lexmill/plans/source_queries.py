"""Queries of the readers and sinks: tables are written as the files users have, read back by the readers, and compared with SQL over the tables."""

import uuid

from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.plans.graph_queries import _EDGES, _edges
from lexmill.plans.text_queries import _CLEAN, fill
from lexmill.session import shared_folder, table
from lexmill.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_folder(spark)}/source-{name}-{uuid.uuid4().hex}"


def _renamed(spark, path: str, old: str, new: str) -> None:
    """Gives the files of a folder another suffix."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if name.endswith(old):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name.removesuffix(old)}{new}"))


_LAWS = ", ".join(f"'{x}'" for x in t.LAWS)


@query(f"""WITH a AS (SELECT DISTINCT law_name, law_category, {fill(_CLEAN, 'article_no')} AS article_no, {fill(_CLEAN, 'content')} AS content FROM statute_articles WHERE law_name IN ({_LAWS}))
SELECT law_name || '__' || replace(article_no, ' ', '_') AS chunk_id, law_name, law_category, article_no, content FROM a WHERE article_no <> '' AND content <> ''""")
def source_statutes(spark, root):
    """The statutes as one nested JSON file with a byte order mark, read by the statute reader."""
    path = _folder(spark, "statutes")
    rows = table(spark, root, "statute_articles").select("law_name", "law_category", "article_no", "content").distinct()
    article = F.struct(F.lit("A").alias("ArticleType"), F.col("article_no").alias("ArticleNo"), F.col("content").alias("ArticleContent"))
    laws = rows.groupBy(F.col("law_name").alias("LawName"), F.col("law_category").alias("LawCategory")).agg(F.collect_list(article).alias("LawArticles"))
    whole = laws.agg(F.collect_list(F.struct("LawName", "LawCategory", "LawArticles")).alias("Laws"))  # the fixed table of statutes
    whole.select(F.concat(F.lit("﻿"), F.to_json(F.struct("Laws"))).alias("value")).coalesce(1).write.text(path)
    return readers.statutes(spark, path).select("chunk_id", "law_name", "law_category", "article_no", "content").distinct()


@query('SELECT case_id AS "JID", cause AS "JTITLE", case_date AS "JDATE", content AS "JFULL" FROM judgement_chunks')
def source_judgements(spark, root):
    """Judgements as JSON lines, read by the directory reader."""
    path = _folder(spark, "judgements")
    table(spark, root, "judgement_chunks").select(F.col("case_id").alias("JID"), F.col("cause").alias("JTITLE"), F.col("case_date").alias("JDATE"), F.col("content").alias("JFULL")).write.json(path)
    _renamed(spark, path, ".json", ".jsonl")
    return readers.judgement_records(spark, path).select("JID", "JTITLE", "JDATE", "JFULL")


@query("SELECT id, query_text AS query, relevant_ids, expected_risk, clause_type, source, cat FROM gold_queries WHERE id IS NOT NULL OR query_text IS NOT NULL")
def source_gold(spark, root):
    """Gold queries as JSON lines, read by the gold reader."""
    path = _folder(spark, "gold")
    sinks.write_json(table(spark, root, "gold_queries").select("id", F.col("query_text").alias("query"), "relevant_ids", "expected_risk", "clause_type", "source", "cat"), path)
    return readers.gold_queries(spark, path)


@query("SELECT item_id, rater_id, lower(regexp_replace(coalesce(label, ''), '\\s+', '', 'g')) AS label FROM rater_labels")
def source_sheets(spark, root):
    """Labels as CSV sheets with a byte order mark, one with another column, read as one table."""
    path = _folder(spark, "sheets")
    rows = table(spark, root, "rater_labels").select("item_id", "rater_id", "label")
    odd = F.pmod(F.xxhash64("item_id"), F.lit(2)) == 1
    sinks.write_csv(rows.where(odd), f"{path}/a")
    sinks.write_csv(rows.where(~odd).withColumn("note", F.lit("x")), f"{path}/b")
    back = readers.label_sheets(spark, path)
    return back.select("item_id", "rater_id", F.lower(F.regexp_replace(F.coalesce("label", F.lit("")), r"\s+", "")).alias("label"))


@query(f"WITH {_EDGES} SELECT a, b, w FROM e WHERE w >= 6")
def source_edge_cache(spark, root):
    """Edges kept from weight 1 and read from the cache with a threshold."""
    path = _folder(spark, "edges")
    sinks.write_edges(_edges(spark, root), path)
    return sinks.read_edges(spark, path, 6)


@query("SELECT 'even' AS collection, count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS n_numbers FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'odd', count(*), CAST(sum(len(embedding)) AS BIGINT) FROM embeddings WHERE vec_id % 2 = 1")
def source_collections(spark, root):
    """Two vector collections, one written in two parts and one replaced, read back by name."""
    path = _folder(spark, "collections")
    rows = table(spark, root, "embeddings")
    for part in (0, 2):
        sinks.write_collection(rows.where(f"vec_id % 4 = {part}"), path, "even")
    sinks.write_collection(rows.where("vec_id % 2 = 0"), path, "odd")
    sinks.write_collection(rows.where("vec_id % 2 = 1"), path, "odd", reset=True)
    out = None
    for name in ("even", "odd"):
        got = sinks.read_collection(spark, path, name).agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).cast("bigint").alias("n_numbers"))
        out = got if out is None else out.unionByName(got)
    return out
