"""Pairs of the members of groups, without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def pair_rows(members: DataFrame, keys: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """(keys, item_a, item_b), item_a < item_b, once for each group that holds both; null keys and items make none.

    A group of m items is spread over ceil(m / block) blocks by the item's hash; a pair is made only
    in the task of its two blocks, so a task holds about two blocks of a group at most.
    """
    rows = members.select(*keys, F.col(item).alias("_i")).dropna().distinct()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    spread = rows.join(sizes, keys).withColumn("_nb", F.ceil(F.col("_m") / block).cast("int")).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_nb")).cast("int"))
    cells = spread.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(*keys, F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), "_i", "_b")
    on = [*keys, "_lo", "_hi"]
    left, right = cells.withColumnsRenamed({"_i": "item_a", "_b": "_ba"}), cells.withColumnsRenamed({"_i": "item_b", "_b": "_bb"})
    met = left.join(right, on).where("item_a < item_b and ((_lo = _hi) or _ba <> _bb)")
    return met.select(*keys, "item_a", "item_b")


def pairs_in_groups(members: DataFrame, keys: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """Distinct (item_a, item_b), item_a < item_b, of items that share a group; null keys and items make none."""
    return pair_rows(members, keys, item, block).select("item_a", "item_b").distinct()
