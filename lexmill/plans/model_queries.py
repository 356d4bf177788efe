"""Queries of the model steps (offline stand-ins) and report assembly."""

from pyspark.sql import functions as F

from lexmill.operators import evaluation as ev
from lexmill.operators import model_steps as m
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


@query("SELECT clause_id, 'mock' AS source, 'medium' AS risk_level, CAST(0 AS INTEGER) AS n_cited FROM clauses")
def llm_analysis_mock(spark, root):
    rows = table(spark, root, "clauses").select("clause_id", "text")
    none = F.array().cast("array<struct<text string, score double>>")
    got = m.analyse(rows, m.analysis_prompt(F.col("text"), none, none))
    return got.select("clause_id", "source", "result.risk_level", F.size("result.cited_articles").alias("n_cited"))


@query("SELECT analysis_id, 'mock' AS source, CAST(0 AS INTEGER) AS n_supported, CAST(0 AS INTEGER) AS n_unsupported, 0e0 AS faithfulness FROM clause_analyses")
def claim_audit_mock(spark, root):
    rows = table(spark, root, "clause_analyses").select("analysis_id", "analysis")
    got = m.audit(rows, F.concat(F.lit("Audit:\n"), F.coalesce("analysis", F.lit(""))))
    faithful, _ = ev.claim_scores(F.col("n_supported"), F.col("n_partial"), F.col("n_unsupported"))
    return got.select("analysis_id", "source", "n_supported", "n_unsupported", faithful.alias("faithfulness"))


@query("SELECT sample_id, ['mock 1', 'mock 2', 'mock 3'] AS objections FROM cross_model_judge")
def devil_mock(spark, root):
    return m.debate(table(spark, root, "cross_model_judge").select("sample_id", "claim"), F.col("claim")).select("sample_id", "objections")


@query("SELECT sample_id, 'mock' AS source, 3 AS score, 'supported' AS label FROM cross_model_judge")
def rubric_classify_mock(spark, root):
    rows = m.rubric(table(spark, root, "cross_model_judge").select("sample_id", "claim"), F.col("claim")).drop("answer", "source")
    return m.classify(rows, F.col("claim"), ["supported", "partial", "unsupported"]).select("sample_id", "source", "score", "label")


@query("""WITH a AS (SELECT DISTINCT analysis_id, file_id, clause_index, label, risk_level FROM clause_analyses WHERE llm_source <> 'mock' AND file_id IS NOT NULL)
SELECT file_id, count(*) AS n_clauses, count(*) FILTER (lower(trim(risk_level, ' ')) = 'high') AS n_high, list(clause_index ORDER BY clause_index, analysis_id) AS clause_order FROM a GROUP BY file_id""")
def report_assembly(spark, root):
    """One nested report per contract from its live analyses, in clause order."""
    rows = table(spark, root, "clause_analyses").select("analysis_id", "file_id", "clause_index", "label", "risk_level", "llm_source").distinct().where("llm_source <> 'mock' and file_id is not null")
    parts = F.array_sort(F.collect_list(F.struct("clause_index", "analysis_id", "label", "risk_level")))
    reports = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.count_if(F.lower(F.trim("risk_level")) == "high").alias("n_high"), parts.alias("clauses"))
    return reports.select("file_id", "n_clauses", "n_high", F.col("clauses.clause_index").alias("clause_order"))


@query("WITH t AS (SELECT count(*) AS chunks, count(DISTINCT law_name) AS laws FROM statute_articles), c AS (SELECT count(*) AS chunks, count(DISTINCT case_id) AS cases FROM judgement_chunks) SELECT 'statutes' AS collection, chunks, laws AS groups FROM t UNION ALL SELECT 'judgements', chunks, cases FROM c")
def collection_size(spark, root):
    s = table(spark, root, "statute_articles").agg(F.lit("statutes").alias("collection"), F.count(F.lit(1)).alias("chunks"), F.countDistinct("law_name").alias("groups"))
    j = table(spark, root, "judgement_chunks").agg(F.lit("judgements").alias("collection"), F.count(F.lit(1)).alias("chunks"), F.countDistinct("case_id").alias("groups"))
    return s.unionByName(j)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_clause_upsert(spark, root):
    """Last event of every user, kept by a stream over the events in four files (available-now trigger)."""
    import uuid

    from lexmill.session import shared_folder, stage
    from lexmill.streaming import clauses as s

    rows = table(spark, root, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    written = stage(rows.repartition(4), "events")
    folder = written.inputFiles()[0].rsplit("/", 1)[0]
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = s.event_stream(spark, folder, written.schema)
    done = s.upsert(stream, f"{base}/table", ["user_id"], ["ts", "event_id"], f"{base}/checkpoint", buckets=8)
    done.awaitTermination()
    return s.newest(spark, f"{base}/table", stream.schema).select("user_id", "event_id", "event_type", "value")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, root):
    """Events by type in daily windows with a watermark, through a stream into a memory-free parquet sink."""
    import uuid

    from lexmill.session import shared_folder, stage
    from lexmill.streaming import clauses as s

    # in time order, with a last file far ahead that moves the watermark past the real windows
    rows = table(spark, root, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    last = rows.agg(F.lit(-1).cast("bigint").alias("event_id"), F.lit("").alias("event_type"), (F.max("ts") + F.expr("interval 40 days")).alias("ts"))
    written, ahead = stage(rows.repartitionByRange("ts").sortWithinPartitions("ts"), "events"), stage(last, "ahead")
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    streams = [s.event_stream(spark, part.inputFiles()[0].rsplit("/", 1)[0], part.schema) for part in (written, ahead)]
    counts = s.windowed_counts(streams[0].unionByName(streams[1]), "ts", "event_type", "1 day", "30 days")
    counts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{base}/out").where("event_type <> ''")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH c AS (SELECT DISTINCT file_id, clause_index FROM clauses WHERE file_id IS NOT NULL) SELECT file_id, CAST(clause_index AS BIGINT) AS position, 'clause' AS event, NULL AS n_clauses FROM c
UNION ALL SELECT file_id, CAST(max(clause_index) + 1 AS BIGINT), 'done', count(*) FROM c GROUP BY file_id""")
def stream_ordered_clauses(spark, root):
    """A contract's clauses as events in order, closed by a `done` event with their number, through a stream."""
    import uuid

    from lexmill.session import shared_folder, stage
    from lexmill.streaming import clauses as s

    rows = table(spark, root, "clauses").select("file_id", "clause_index").where("file_id is not null").distinct()
    written = stage(rows.repartition(4, "file_id"), "clauses")
    base = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    stream = s.event_stream(spark, written.inputFiles()[0].rsplit("/", 1)[0], written.schema)
    s.ordered_stream(stream, "file_id", "clause_index", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("file_id", "position", "event", F.get_json_object("payload", "$.count").cast("bigint").alias("n_clauses"))


@query("SELECT analysis_id, 'live' AS source FROM (SELECT DISTINCT analysis_id FROM clause_analyses WHERE analysis_id IS NOT NULL ORDER BY analysis_id LIMIT 300)")
def budgeted_resume(spark, root):
    """Two runs of a model step with a budget of 150 calls each, the second going on where the first ended."""
    import uuid

    from lexmill.operators.audit import EchoClient
    from lexmill.session import shared_folder
    from lexmill.streaming import clauses as s

    rows = table(spark, root, "clause_analyses").where("analysis_id is not null").groupBy("analysis_id").agg(F.min("conclusion").alias("conclusion"))
    path = f"{shared_folder(spark)}/budgeted-{uuid.uuid4().hex}"
    for _ in range(2):
        s.budgeted(rows, path, ["analysis_id"], 150, lambda part: m.rubric(part, F.coalesce("conclusion", F.lit("")), EchoClient).select("analysis_id", "source", "score"))
    return spark.read.parquet(path).select("analysis_id", "source")
