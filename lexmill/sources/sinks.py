"""Sinks: vector collections, reports as JSON, JSONL, CSV and Markdown, and the cache of graph edges."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_collection(rows: DataFrame, root: str, name: str, reset: bool = False) -> None:
    """Adds rows to the named collection (a partition of the table at root), or replaces it."""
    rows.write.mode("overwrite" if reset else "append").parquet(f"{root.rstrip('/')}/collection={name}")


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/collection={name}")


def collection_size(spark: SparkSession, root: str, name: str) -> int:
    return read_collection(spark, root, name).count()


def write_json(rows: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; `single` puts a report that is small by nature in one file."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, mark: bool = True, single: bool = False) -> None:
    """CSV with a header; with `mark` the first column's name begins with a byte order mark, which spreadsheets read as UTF-8. Nested columns become JSON."""
    flat = rows.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes))
    if mark and flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, title: str | None = None) -> str:
    """A Markdown table of a report; reports are small, the caller limits others."""
    out = [f"# {title}", ""] if title else []
    out += ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows.toLocalIterator()]
    return "\n".join(out) + "\n"


def write_edges(edges: DataFrame, path: str) -> None:
    """All edges from weight 1, so that any threshold can be read."""
    edges.write.mode("overwrite").parquet(path)


def read_edges(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """Edges of at least the weight; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("w") >= least)
