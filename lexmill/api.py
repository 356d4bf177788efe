"""A thin facade: what a user of a document-analytics service calls, as functions that give DataFrames.

Nothing here collects rows; every function composes operators of the other modules.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import embedding, evaluation, graph, model_steps, retrieval
from lexmill.sources import readers
from lexmill.streaming import clauses as streams


class Engine:
    """Collections of statutes and judgements with vectors, and an optional model client and embedder.

    statutes and judgements: key columns `vec_id`, `embedding`, and `article` (the canonical article a row
    stands for or cites), `text`. embed: a column function text -> array<double>,
    or an object with `encode(texts, kind)` (see `operators.embedding`).
    """

    def __init__(self, spark: SparkSession, statutes: DataFrame, judgements: DataFrame, embed, make_client=None):
        self.spark, self.statutes, self.judgements, self.embed, self.make_client = spark, statutes, judgements, embed, make_client

    def _asked(self, queries: DataFrame) -> DataFrame:
        if hasattr(self.embed, "encode"):
            return embedding.embedded(queries, "query_id", "text", self.embed, "query").withColumnRenamed("query_id", "vec_id")
        return queries.select(F.col("query_id").alias("vec_id"), self.embed(F.col("text")).alias("embedding"))

    def health(self) -> DataFrame:
        return self.spark.createDataFrame([("ok", "live" if self.make_client else "mock")], "status string, model string")

    def upload(self, path: str, **plugins) -> DataFrame:
        return readers.contracts(self.spark, readers.guarded(path), **plugins)

    def clauses(self, documents: DataFrame, key: str = "path") -> DataFrame:
        return readers.contract_clauses(documents, key)

    def retrieve(self, queries: DataFrame, k: int = 3, pool: int = 20, boost: float = 0.2) -> DataFrame:
        """queries: query_id, text. (query_id, vec_id, score, rk) of statutes, boosted where the text names the article."""
        asked = self._asked(queries)
        hits = retrieval.exact_topk(asked, self.statutes, max(k, pool), exclude_self=False).drop("rk")
        named = queries.select("query_id", t.article_list(F.col("text")).alias("_named"))
        marked = hits.join(named, "query_id").join(self.statutes.select("vec_id", "article"), "vec_id")
        return retrieval.boosted(marked, F.coalesce(F.array_contains("_named", F.col("article")), F.lit(False)), k, "vec_id", boost).drop("_named", "article")

    def triangulate(self, queries: DataFrame, k: int = 3) -> DataFrame:
        asked = self._asked(queries)
        law, case = (retrieval.exact_topk(asked, c, k, exclude_self=False).join(c.select("vec_id", "article"), "vec_id") for c in (self.statutes, self.judgements))
        return retrieval.corroborated(law, case, "article", queries)

    def analyse(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """Retrieval, prompt and model answer for each clause."""
        texts = self.statutes.select("vec_id", F.col("text").alias("hit"))
        hits = self.retrieve(queries, k).join(texts, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rk", F.col("hit").alias("text"), "score"))).alias("h"))
        laws = F.transform("h", lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score")))
        none = F.array().cast("array<struct<text string, score double>>")
        rows = queries.join(hits, "query_id", "left")
        return model_steps.analyse(rows, model_steps.analysis_prompt(F.col("text"), laws, none), self.make_client).drop("h")

    def judge(self, analyses: DataFrame) -> DataFrame:
        """Audit counts, faithfulness and hallucination rate of analyses (column answer)."""
        rows = analyses.withColumnRenamed("answer", "analysis").drop("source")
        got = model_steps.audit(rows, F.concat(F.lit("Audit:\n"), F.coalesce("analysis", F.lit(""))), self.make_client)
        faithful, hall = evaluation.claim_scores(F.col("n_supported"), F.col("n_partial"), F.col("n_unsupported"))
        return got.withColumn("faithfulness", faithful).withColumn("hallucination", hall)

    def object(self, claims: DataFrame, column: str = "claim") -> DataFrame:
        return model_steps.debate(claims, F.col(column), self.make_client)

    def demo(self, documents: DataFrame, key: str = "path", n: int = 3) -> DataFrame:
        """The first clauses of the documents in order, as a preview."""
        return self.clauses(documents, key).orderBy(key, "clause_index").limit(n)

    def stream(self, clauses: DataFrame, target: str, checkpoint: str, document: str = "path", index: str = "clause_index"):
        """A stream of clauses as ordered events, each document closed by a `done` event."""
        return streams.ordered_stream(clauses, document, index, target, checkpoint)

    def evaluate(self, queries: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
        """Mean recall, precision, MRR and nDCG by k of retrieval. relevant: query_id, vec_id."""
        hits = self.retrieve(queries, max(ks))
        marked = hits.join(relevant.select("query_id", "vec_id").distinct().withColumn("rel", F.lit(True)), ["query_id", "vec_id"], "left").select("query_id", "rk", F.coalesce("rel", F.lit(False)).alias("rel"))
        total = relevant.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n_rel"))
        return evaluation.ir_report(evaluation.marked_metrics(marked, total, list(ks), queries))

    def missed(self, edges: DataFrame, cited: DataFrame, top: int = 5) -> DataFrame:
        return graph.suggest_missed(edges, cited, top)
