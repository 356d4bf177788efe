"""Problem 6: items that appear together, and how much more often than chance.

Heavy-light decomposition. Items in at least HEAVY_SHARE of the baskets are heavy; there are at most
(mean basket size / HEAVY_SHARE) of them. Pairs of heavy items are counted by popcounts of the AND of
their rows in dense bit matrices of the partition's baskets, MATRIX_ITEMS rows each; a heavy and a light item by
probing the heavy rows at the light item's list of baskets; pairs of light items by hash counting. The three parts
are summed, and scored by lift. Where only pairs of a least number of baskets are asked for, items in fewer are left
out beforehand, as no such pair can hold them.

A basket's light items are held in blocks of about BASKET_ITEMS; pairs across blocks are made where two blocks meet, so a
basket of any size is many tasks. Its heavy items go to each of its blocks.

Null baskets and null or empty items are left out; an item repeated in a basket counts once; an empty
table gives no pairs. Ties need no rule: pairs are ordered by code points and all are given.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.canon import canonical_articles
from lexmill.session import stage

HEAVY_SHARE = 1 / 500
#: Rows of one bit matrix; more heavy items take several, met pair by pair.
MATRIX_ITEMS = 1500
MATRIX_BASKETS = 1 << 16
BASKET_ITEMS = 256


def bit_rows(rows: list[np.ndarray], lo: int, hi: int) -> np.ndarray:
    """The bool matrix of the heavy items lo .. hi - 1 (rows) in these baskets (columns, in whole words)."""
    dense = np.zeros((hi - lo, -(-len(rows) // 64) * 64), bool)
    columns, items = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    here = (items >= lo) & (items < hi)
    dense[items[here] - lo, columns[here]] = True
    return dense


def popcounts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common baskets of every row of one matrix and every row of the other."""
    a, b = (np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (left, right))
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(len(a)):
        words = np.flatnonzero(a[i])  # words of the row without a bit can add nothing
        if len(words):
            out[i] = np.bitwise_count(b[:, words] & a[i, words]).sum(axis=1, dtype=np.int64)
    return out


def pair_counts(items: DataFrame, least: Column | int = 1, heavy_share: float = HEAVY_SHARE, matrix_items: int = MATRIX_ITEMS, basket_items: int = BASKET_ITEMS) -> DataFrame:
    """(field, item_a, item_b, n_ab, n_a, n_b, n), item_a < item_b, of items (field, basket, item); n counts the field's baskets.

    Pairs in at least `least` baskets (a number, or a column of n) are complete; others may be left out.
    """
    spark = items.sparkSession
    items = stage(items.where("basket is not null and item is not null and item <> ''").select("field", "basket", "item").distinct(), "items")
    sizes = stage(items.groupBy("field").agg(F.countDistinct("basket").alias("n")), "sizes")
    counts = stage(items.groupBy("field", "item").agg(F.count(F.lit(1)).alias("c")).join(sizes, "field").where(F.col("c") >= F.lit(least)), "counts")
    heavy = counts.where(F.col("c") >= F.col("n") * heavy_share).select("field", "item").orderBy("field", "item").toPandas()  # bounded, see above
    names = {f: list(part) for f, part in heavy.groupby("field")["item"]}
    marks = counts.select("field", "item", (F.col("c") >= F.col("n") * heavy_share).alias("heavy"))
    held = spark.sparkContext.broadcast({f: {item: i for i, item in enumerate(own)} for f, own in names.items()})
    marked = items.join(marks, ["field", "item"])
    large = stage(marked.groupBy("field", "basket").agg(F.count_if(~F.col("heavy")).alias("m")).where(F.col("m") > basket_items).select("field", "basket", F.ceil(F.col("m") / basket_items).cast("int").alias("blocks")), "large")
    placed = marked.join(large, ["field", "basket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("block", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    of = lambda heavy: F.array_sort(F.collect_list(F.when(F.col("heavy") == heavy, F.col("item"))))
    baskets = placed.groupBy("field", "basket", "block", "blocks").agg(of(True).alias("h"), of(False).alias("l"))
    baskets = stage(baskets.where("size(h) + size(l) > 1 or blocks > 1"), "baskets")
    schema = "field string, item_a string, item_b string, n_ab bigint"

    def dense(batches):
        import pyarrow as pa

        mixed: dict[tuple[str, int], np.ndarray] = {}
        waiting: dict[str, list] = {f: [] for f in names}
        spans = {f: [(lo, min(lo + matrix_items, len(own))) for lo in range(0, len(own), matrix_items)] for f, own in names.items()}
        total = {f: np.zeros((len(own), len(own)), np.int64) for f, own in names.items() if len(own) <= matrix_items}

        def rows_of(f, firsts, seconds, numbers):
            pairs = [sorted(p) for p in zip(firsts, seconds)]
            columns = [pa.array([f] * len(pairs), pa.string()), *(pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)), pa.array(numbers, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["field", "item_a", "item_b", "n_ab"])

        def matrix_rows(f, counted, x=0, y=0):
            i, j = np.nonzero(counted)
            return rows_of(f, [names[f][x + a] for a in i], [names[f][y + b] for b in j], counted[i, j])

        def flush(f):
            rows, first = [w[0] for w in waiting[f]], [w[0] if w[2] else w[0][:0] for w in waiting[f]]
            lists: dict[str, list[int]] = {}
            for b, (_, light, _) in enumerate(waiting[f]):
                for item in light:
                    lists.setdefault(item, []).append(b)
            for s, (lo, hi) in enumerate(spans[f]):
                matrix = bit_rows(first, lo, hi)
                for lo2, hi2 in spans[f][s:]:
                    counted = popcounts(matrix, matrix if lo2 == lo else bit_rows(first, lo2, hi2))
                    counted = np.triu(counted, 1) if lo2 == lo else counted
                    if f in total:
                        total[f] += counted
                    else:
                        yield matrix_rows(f, counted, lo, lo2)
                matrix = bit_rows(rows, lo, hi) if lists else matrix
                found = [(item, matrix[:, at].sum(axis=1)) for item, at in lists.items()]
                firsts = [(item, names[f][lo + i], int(hits[i])) for item, hits in found for i in np.flatnonzero(hits)]
                if firsts:
                    yield rows_of(f, *zip(*firsts))
            waiting[f] = []

        for batch in batches:
            for f, h, light, block in zip(*(batch.column(c).to_pylist() for c in ("field", "h", "l", "block"))):
                waiting[f].append((np.fromiter((held.value[f][i] for i in h), np.int64, len(h)), light, block == 0))
                if len(waiting[f]) >= MATRIX_BASKETS:
                    yield from flush(f)
        for f in names:
            if waiting[f]:
                yield from flush(f)
            if f in total:
                yield matrix_rows(f, total[f])

    by_matrix = baskets.where("size(h) > 0").select("field", "h", "l", "block").mapInArrow(dense, schema)
    firsts = baskets.where("size(l) > 1").select("field", "l", F.posexplode("l").alias("p", "item_a"))
    inside = firsts.select("field", "item_a", F.explode(F.slice("l", F.col("p") + 2, F.size("l"))).alias("item_b"))
    cells = baskets.where("blocks > 1 and size(l) > 0").select("field", "basket", "block", "l", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other <> block")
    side = lambda low, name: cells.where("block < other" if low else "block > other").select("field", "basket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.col("l").alias(name))
    met = side(True, "la").join(side(False, "lb"), ["field", "basket", "lo", "hi"]).select("field", "lb", F.explode("la").alias("x")).select("field", "x", F.explode("lb").alias("y"))
    across = met.select("field", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    by_hash = inside.unionByName(across).groupBy("field", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))
    pairs = by_matrix.unionByName(by_hash).groupBy("field", "item_a", "item_b").agg(F.sum("n_ab").alias("n_ab"))
    with_n = pairs.join(sizes, "field").where(F.col("n_ab") >= F.lit(least))
    count_of = lambda s: counts.select("field", F.col("item").alias(f"item_{s}"), F.col("c").alias(f"n_{s}"))
    return with_n.join(count_of("a"), ["field", "item_a"]).join(count_of("b"), ["field", "item_b"]).select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def lifted(items: DataFrame, least: int = 4, per_mille: int = 1, lift: int = 4) -> DataFrame:
    """Pairs in at least `least` baskets and `per_mille` of them, at least `lift` times as often as chance would give."""
    support = F.greatest(F.lit(least), F.ceil(F.col("n") * per_mille / 1000))
    return pair_counts(items, support).where(f"n_ab >= {least} and 1000 * n_ab >= {per_mille} * n and n_ab * n >= {lift} * n_a * n_b")


def corroborated_items(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.lit("cross_corroborated").alias("field"), F.col("analysis_id").alias("basket"), F.explode("cross_corroborated").alias("item"))


def article_items(analyses: DataFrame, evidence: DataFrame, statutes: DataFrame) -> DataFrame:
    """(field, basket, item): the articles of each analysis in both fields; unmatched citations are left out."""
    cited = stage(analyses.select(F.col("analysis_id").alias("basket"), F.explode("cited_articles").alias("raw_value")).where("raw_value is not null and raw_value <> ''").distinct(), "cited")
    meant = canonical_articles(cited.select("raw_value"), statutes).where("chunk_id <> ''")
    of_cited = cited.join(meant, "raw_value").select(F.lit("cited_articles").alias("field"), "basket", F.col("chunk_id").alias("item"))
    known = statutes.select(F.col("chunk_id").alias("item")).distinct()
    return of_cited.unionByName(corroborated_items(evidence).join(known, "item", "left_semi").select("field", "basket", "item"))
