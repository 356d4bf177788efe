"""Retrieval: exact vector search in blocks, boosts, re-ranking, corroboration, keyword ranking."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import bigrams_and_words
from lexmill.session import spread, stage

#: Queries that are sent to the workers at once; a larger set goes in several blocks, one after the other.
QUERY_BLOCK = 4096
#: Largest size of a block's vectors that is broadcast.
BLOCK_BYTES = 128 << 20
#: Different terms of the queries of one block of a keyword search, and documents scored at once.
BLOCK_TERMS = 8192
CHUNK_DOCS = 512


def _first_k(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best entries of each row (query number), by score, ties by id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)  # where the entry's row begins
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def _top_rows(scores: np.ndarray, ids: np.ndarray, k: int):
    """Row number, id and rounded score of the k best of each row of a matrix, ties by id; entries of -inf are none."""
    rounded = np.round(scores, 9)
    if scores.shape[1] > 4 * k:
        floor = -np.partition(-rounded, k - 1, axis=1)[:, [k - 1]]
        rows, cols = np.nonzero((rounded >= floor) & (rounded > -np.inf))  # all ties of the last place
    else:
        rows, cols = np.nonzero(rounded > -np.inf)
    return _first_k(rows, ids[cols], rounded[rows, cols], k)


class _Best:
    """The k best of every query over the batches of a partition."""

    def __init__(self, k: int):
        self.k, self.held, self.size, self.full = k, [], 0, 1 << 20

    def add(self, rows, ids, scores) -> None:
        self.held.append((rows, ids, scores))
        self.size += len(rows)
        if self.size > self.full:
            self.held = [self.best()]
            self.size = len(self.held[0][0])
            self.full = max(self.full, 4 * self.size)

    def best(self):
        if not self.held:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return _first_k(*(np.concatenate(c) for c in zip(*self.held)), self.k)


def _matrix(column) -> np.ndarray:
    """An Arrow list column of vectors of one length as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _ids(column) -> np.ndarray:
    """Keys that numpy can sort: numbers as they are, others as text."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", exclude_self: bool = True, dims: int | None = None) -> DataFrame:
    """(query_id, key, score, rk) of the k nearest by cosine, ties by key; score is rounded to 9 digits.

    Queries go to the corpus in blocks of bounded size, one block at a time; every partition keeps its own k best of each
    query, so k rows a query and partition are shuffled, never all pairs. Null vectors and vectors of
    length 0 are left out.
    """
    spark = corpus.sparkSession
    kind = corpus.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * (width or 1))))
    n_blocks = max(1, -(-n // block))
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"query_id {kind}, {key} {kind}, score double"

    def unit(m):
        m = m[:, :dims] if dims else m
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(norm > 0, m / np.where(norm > 0, norm, 1), np.nan)

    def search(part: DataFrame) -> DataFrame:
        got = part.toArrow()  # one block
        held = spark.sparkContext.broadcast((_ids(got.column("q").combine_chunks()), unit(_matrix(got.column("v").combine_chunks())) if got.num_rows else None))

        def near(batches):
            import pyarrow as pa

            qs, qv = held.value
            best = _Best(k)
            for batch in batches:
                if not batch.num_rows or qv is None:
                    continue
                ids = _ids(batch.column(0))
                scores = np.nan_to_num(qv @ unit(_matrix(batch.column(1))).T, nan=-np.inf)
                if exclude_self:
                    scores[qs[:, None] == ids[None, :]] = -np.inf
                best.add(*_top_rows(scores, ids, k))
            r, ids, s = best.best()
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(qs[r]), pa.array(ids), pa.array(s)], ["query_id", key, "score"])

        return rows.mapInArrow(near, schema)

    if n_blocks == 1:
        return ranked(search(asked), k, key)
    asked = stage(asked.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(n_blocks))), "asked")
    out = None
    for b in range(n_blocks):
        found = stage(ranked(search(asked.where(F.col("b") == b).drop("b")), k, key), "found")
        out = found if out is None else out.unionByName(found)
    return out


def ranked(scored: DataFrame, k: int | None, key: str, by: str = "score", group: str = "query_id") -> DataFrame:
    """Rows with their rank `rk` by score, ties by key; the first k only if k is given."""
    order = Window.partitionBy(group).orderBy(F.desc(by), key)
    out = scored.withColumn("rk", F.row_number().over(order))
    return out.where(F.col("rk") <= k) if k else out


def boosted(pool: DataFrame, overlap: Column, k: int, key: str, weight: float = 0.2) -> DataFrame:
    """Re-ranks a pool (query_id, key, score) with `weight` added where query and candidate share a key."""
    return ranked(pool.withColumn("score", F.round(F.col("score") + F.when(overlap, F.lit(weight)).otherwise(F.lit(0.0)), 9)), k, key)


def edge_boosted(pool: DataFrame, edges: DataFrame, k: int, key: str, weight: float = 0.3) -> DataFrame:
    """Re-ranks by score + weight * w(first, candidate) / the greatest w(first, .) within the pool; edges: a, b, w in both directions."""
    first = pool.where("rk = 1").select("query_id", F.col(key).alias("a"))
    linked = pool.join(first, "query_id").join(edges.select("a", F.col("b").alias(key), "w"), ["a", key], "left")
    most = F.max("w").over(Window.partitionBy("query_id"))
    gain = F.when(most > 0, F.coalesce("w", F.lit(0)) / most).otherwise(F.lit(0.0))
    return ranked(linked.withColumn("score", F.round(F.col("score") + weight * gain, 9)).drop("rk"), k, key)


def corroborated(law_hits: DataFrame, case_hits: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """(query_id, law_keys, case_keys, cross): keys that both retrievals of a query give, sorted."""
    gather = lambda hits, name: hits.groupBy("query_id").agg(F.array_sort(F.collect_set(key)).alias(name))
    joined = queries.select("query_id").distinct().join(gather(law_hits, "law_keys"), "query_id", "left").join(gather(case_hits, "case_keys"), "query_id", "left")
    none = F.array().cast(law_hits.schema[key].dataType.simpleString().join(("array<", ">")))
    filled = joined.select("query_id", F.coalesce("law_keys", none).alias("law_keys"), F.coalesce("case_keys", none).alias("case_keys"))
    return filled.withColumn("cross", F.array_sort(F.array_intersect("law_keys", "case_keys")))


def bm25(queries: DataFrame, documents: DataFrame, k: int, query_key: str, query_text: str, key: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokens=bigrams_and_words) -> DataFrame:
    """(query_id, key, score, rk) by Okapi BM25; a negative idf becomes epsilon times the mean idf.

    Terms are counted over all documents once; then the terms of a block of queries go to the documents, each partition
    scores its own and keeps the k best of each query. A document that shares no term with a query is no hit.
    Null and empty texts have no terms but count as documents of length 0. tokens: Column of text -> Column of terms.
    """
    spark = documents.sparkSession
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(tokens(F.col(c)), none)
    rows = spread(documents.select(F.col(key).alias("doc"), F.col(text).alias("t"))).select("doc", of("t").alias("terms"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    frequency = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(size, F.lit(True))  # one row of totals
    raw = stage(frequency.select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "idf")
    mean = raw.agg(F.avg("raw").alias("mean"))
    asked = queries.select(F.col(query_key).alias("query_id"), F.explode(of(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    weights = stage(asked.join(raw, "term").join(mean, F.lit(True)).select("query_id", "term", "avgdl", (F.col("qn") * idf).alias("w")), "weights")
    n_queries, n_terms = weights.agg(F.countDistinct("query_id"), F.count(F.lit(1))).first()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK), -(-n_terms // BLOCK_TERMS))
    q_kind, kind = (f.schema[c].dataType.simpleString() for f, c in ((queries, query_key), (documents, key)))

    def search(part: DataFrame) -> DataFrame:
        got = part.toPandas()  # one block
        terms, term_at = np.unique(got["term"].to_numpy(str), return_inverse=True) if len(got) else (np.zeros(0, str), np.zeros(0, int))
        asked_ids, query_at = np.unique(got["query_id"].to_numpy(), return_inverse=True) if len(got) else (np.zeros(0), np.zeros(0, int))
        matrix = np.zeros((len(terms), len(asked_ids)))
        matrix[term_at, query_at] = got["w"]
        avgdl = float(got["avgdl"].iloc[0]) if len(got) else 1.0
        held = spark.sparkContext.broadcast((terms.tolist(), asked_ids.tolist(), matrix, avgdl))

        def score(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            terms, asked_ids, matrix, avgdl = held.value
            best, known, positive = _Best(k), pa.array(terms, pa.string()), bool((matrix >= 0).all())
            for batch in batches if len(terms) else ():
                ids, lists = _ids(batch.column(0)), batch.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                at = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
                owner = np.repeat(np.arange(len(ids)), lengths)[at >= 0]
                at = at[at >= 0]
                norm = k1 * (1 - b + b * lengths / avgdl)
                for lo in range(0, len(ids), CHUNK_DOCS):
                    first, last = np.searchsorted(owner, (lo, lo + CHUNK_DOCS))
                    n = min(CHUNK_DOCS, len(ids) - lo)
                    # only terms that these documents hold
                    here, column = np.unique(at[first:last], return_inverse=True)
                    tf = np.bincount((owner[first:last] - lo) * len(here) + column, minlength=n * len(here)).reshape(n, -1).astype(float)
                    w = matrix[here]
                    scores = np.round((tf * (k1 + 1) / (tf + norm[lo : lo + n, None])) @ w, 6)
                    met = scores > 0 if positive else (tf > 0).astype(np.float32) @ (w != 0).astype(np.float32) > 0
                    scores[~met] = -np.inf
                    best.add(*_top_rows(scores.T, ids[lo : lo + n], k))
            r, ids, s = best.best()
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([asked_ids[i] for i in r]), pa.array(ids), pa.array(s)], ["query_id", key, "score"])

        return rows.mapInArrow(score, f"query_id {q_kind}, {key} {kind}, score double")

    if n_blocks == 1:
        return ranked(search(weights), k, key)
    weights = stage(weights.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))), "weights")
    out = None
    for block in range(n_blocks):
        found = stage(ranked(search(weights.where(F.col("_b") == block).drop("_b")), k, key), "found")
        out = found if out is None else out.unionByName(found)
    return out
