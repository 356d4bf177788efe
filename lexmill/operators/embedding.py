"""Embedders and re-rankers as plug-ins, with deterministic ones that need no model.

An embedder is any object with `encode(texts, kind)`, kind `passage` or `query` (asymmetric models treat them
differently), giving one vector a text; vectors are brought to unit length here. A re-ranker is any object with
`score(query, text)` lists. Both travel to the executors, where batches of texts meet them.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.retrieval import ranked
from lexmill.session import spread


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of character n-grams by hash, with a sign; the prefixes of asymmetric models can be set."""

    width: int = 256
    grams: tuple[int, ...] = (1, 2, 3)
    passage_prefix: str = ""
    query_prefix: str = ""

    def encode(self, texts: list[str], kind: str = "passage") -> np.ndarray:
        import xxhash

        prefix = self.query_prefix if kind == "query" else self.passage_prefix
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            text = prefix + text.lower()
            for n in self.grams:
                for i in range(len(text) - n + 1):
                    h = xxhash.xxh3_64_intdigest(text[i : i + n])
                    row[h % self.width] += 1 if h >> 63 else -1
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows of zeros stay."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def embedded(rows: DataFrame, key: str, text: str, embedder, kind: str = "passage") -> DataFrame:
    """(key, embedding): vectors of unit length; null and blank texts have a null vector."""
    if kind not in ("passage", "query"):
        raise ValueError(f"unknown kind: {kind}")
    of = rows.schema[key].dataType.simpleString()

    def encode(batches):
        import pandas as pd

        for batch in batches:
            there = batch["t"].notna() & (batch["t"].str.strip() != "")
            vectors = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if there.any():
                made = unit(np.asarray(embedder.encode(batch.loc[there, "t"].tolist(), kind), float))
                vectors[there] = pd.Series(list(made), index=batch.index[there])
            yield pd.DataFrame({"key": batch["key"], "embedding": vectors})

    named = spread(rows.select(F.col(key).alias("key"), F.col(text).alias("t")))
    return named.mapInPandas(encode, f"key {of}, embedding array<double>").withColumnRenamed("key", key)


@dataclass(frozen=True)
class OverlapReranker:
    """Share of the query's character bigrams that the text holds; stands in for a cross-encoder."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts):
            grams = {q[i : i + 2] for i in range(len(q) - 1)}
            out.append(sum(g in t for g in grams) / len(grams) if grams else 0.0)
        return out


def reranked(pool: DataFrame, k: int, key: str, reranker) -> DataFrame:
    """The k best of each query's pool (query_id, key, query_text, text) by the re-ranker's score, ties by key; null texts count as empty."""

    def score(batches):
        for batch in batches:
            yield batch.assign(score=[float(x) for x in reranker.score(batch["query_text"].fillna("").tolist(), batch["text"].fillna("").tolist())])

    named = [f.name for f in pool.schema if f.name != "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema if f.name != "score")
    scored = pool.select(*named).mapInPandas(score, f"{schema}, score double").withColumn("score", F.round("score", 9))
    return ranked(scored, k, key)
