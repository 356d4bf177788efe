"""Problem 2: freely typed values mapped to the closest entry of a reference list.

A BK-tree over the reference entries under Levenshtein distance answers "every entry within so many
edits"; the triangle inequality prunes the branches that can hold none. The list is cut into shards of bounded
size; the tree of a shard is built once and broadcast, all distinct values ask it where they are, and the
shards' winners are merged.

Null and empty values are left out; a value with no entry within the tolerance comes out unmatched.
Among entries at the same distance the first in code-point order wins.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.articles import edit_distance, plausible, split_reference, tolerance
from lexmill.operators.orphans import statute_spellings
from lexmill.session import stage

#: Entries one tree holds; a longer list is cut into shards of about this size.
SHARD_ENTRIES = 50_000


class BKTree:
    """Nodes are (entry, {distance: number of the child}); every distance between two entries is a true metric."""

    def __init__(self, entries, distance: Callable[[str, str], int] | None = None):
        self.distance = distance or levenshtein
        self.nodes: list[tuple[str, dict[int, int]]] = []
        for entry in entries:
            self.add(entry)

    def add(self, entry: str) -> None:
        at = 0
        while self.nodes:
            held, children = self.nodes[at]
            d = self.distance(entry, held)
            if not d:
                return
            if d not in children:
                children[d] = len(self.nodes)
                break
            at = children[d]
        self.nodes.append((entry, {}))

    def within(self, value: str, most: int) -> list[tuple[int, str]]:
        """(distance, entry) of every entry at most so far away, nearest first."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            entry, children = self.nodes[todo.pop()]
            d = self.distance(value, entry)
            if d <= most:
                found.append((d, entry))
            todo += [child for at, child in children.items() if d - most <= at <= d + most]
        return sorted(found)


def levenshtein(a: str, b: str) -> int:
    return edit_distance(a, b, max(len(a), len(b)))


def nearest_entries(values: DataFrame, entries: DataFrame, reach: Callable[[str], int] = tolerance, accept: Callable[[str, str, int], bool] = plausible, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(value, entry, distance) of the nearest accepted entry of each distinct value; entry and distance are null if there is none.

    values: one column `value`; entries: one column `entry`. `reach` gives the largest number of edits
    for a value, `accept` has the last word on (value, entry, distance).
    """
    spark = values.sparkSession
    values = values.where("value is not null and value <> ''").select("value").distinct()
    entries = entries.where("entry is not null and entry <> ''").select("entry").distinct()
    shards = max(1, -(-entries.count() // shard_entries))
    placed = entries.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int"))
    if shards > 1:
        values, placed = stage(values, "values"), stage(placed, "entries")

    def asked(shard: int) -> DataFrame:
        tree = spark.sparkContext.broadcast(BKTree(sorted(r[0] for r in placed.where(F.col("shard") == shard).select("entry").collect())))

        def search(batches):
            import pandas as pd

            for batch in batches:
                # an entry's own tolerance may be larger than the value's, by the difference in length
                hits = [next(((d, e) for d, e in tree.value.within(v, reach(v) + 1) if accept(v, e, d)), (None, None)) for v in batch["value"]]
                yield pd.DataFrame({"value": batch["value"], "entry": [h[1] for h in hits], "distance": pd.array([h[0] for h in hits], "Int32")})

        return values.mapInPandas(search, "value string, entry string, distance int")

    if shards == 1:
        return asked(0)
    won = stage(asked(0), "winners")
    for shard in range(1, shards):
        won = won.unionByName(stage(asked(shard), "winners"))
    winner = F.min(F.when(F.col("entry").isNotNull(), F.struct("distance", "entry")))
    return won.groupBy("value").agg(winner.alias("w")).select("value", "w.entry", "w.distance")


def reference_parts(raw: DataFrame) -> DataFrame:
    """(raw_value, name, number) of distinct non-empty raw values; name and number null without an article number."""

    def split(batches):
        import pandas as pd

        for batch in batches:
            parts = [split_reference(v) or (None, None) for v in batch["raw_value"]]
            yield pd.DataFrame({"raw_value": batch["raw_value"], "name": [p[0] for p in parts], "number": [p[1] for p in parts]})

    rows = raw.where("raw_value is not null and raw_value <> ''").select("raw_value").distinct()
    return rows.mapInPandas(split, "raw_value string, name string, number string")


def canonical_articles(raw: DataFrame, statutes: DataFrame) -> DataFrame:
    """(raw_value, chunk_id) of each distinct non-empty raw value; '' if it is unmatched.

    raw: a column raw_value. statutes: chunk_id, law_name, law_name_en, article_no. The names are mapped
    through the BK-tree; the number must be an article of that statute, deleted and late ones included.
    """
    spellings = stage(statute_spellings(statutes), "spellings")
    parts = stage(reference_parts(raw), "parts")
    nearest = nearest_entries(parts.select(F.col("name").alias("value")), spellings)
    meant = nearest.join(spellings, "entry").select(F.col("value").alias("name"), "law")
    number = F.regexp_extract("article_no", "([0-9]+(?:-[0-9]+)?)", 1)
    articles = statutes.groupBy(F.col("law_name").alias("law"), number.alias("number")).agg(F.min("chunk_id").alias("chunk_id"))
    # the few names and the articles of the list meet first, so that the raw values are joined once
    keyed = meant.join(articles, "law").select("name", "number", "chunk_id")
    return parts.join(keyed, ["name", "number"], "left").select("raw_value", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))


def typed_citations(analyses: DataFrame, results: DataFrame) -> DataFrame:
    return analyses.select(F.explode("cited_articles").alias("raw_value")).unionByName(results.select(F.explode("cited").alias("raw_value")))
