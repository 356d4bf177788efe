"""References to records that do not exist.

A Bloom filter of the parent keys, sharded by the key's hash and broadcast while its size allows (`keyfilter`),
proves definite orphans; only references that pass it are verified by an exact join. Every reference that is missing,
deleted or later than the record comes out with its reason, and can be counted per table and period.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.articles import StatuteNames, spellings_of, split_reference
from lexmill.operators.keyfilter import HELD_BYTES, SHARD_BYTES, key_filter
from lexmill.session import stage

#: Characters of statutes' names that travel to the tasks; a longer list is mapped by a search over its shards.
NAME_CHARS = 32 << 20


def orphan_references(references: DataFrame, parents: DataFrame, at: str = "at", shard_bytes: int = SHARD_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """References (any columns, with `key` and the record's time `at`) and the reason why their parent doesn't count.

    parents: `key`, `since` (first time it is there), `until` (time it is deleted, or null); a key may
    come in several rows: it is there since the earliest `since`, and deleted only if every row is.
    reason: `missing`, `later` (since > at) or `deleted` (until <= at). Null keys are no references.
    A null `at`, `since` or `until` proves neither `later` nor `deleted`.
    """
    references, parents = references.where("key is not null"), parents.where("key is not null")
    one = stage(parents.groupBy("key").agg(F.min("since").alias("_since"), F.when(F.count("until") == F.count(F.lit(1)), F.max("until")).alias("_until")), "parents")
    held = key_filter(one.select(F.xxhash64("key")), shard_bytes, held_bytes, ready=True)  # `one` is staged with one row a key
    marked = stage(held.mark(references, F.xxhash64("key"), "_may"), "references")
    absent, rest = marked.where("not _may").drop("_may").withColumn("reason", F.lit("missing")), marked.where("_may").drop("_may")
    # a parent that very many records refer to is a hot key of this join: its side is one row, the other is split (adaptive skew join) or, if the parents are few, they are broadcast
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("_since") > F.col(at), "later").when(F.col("_until") <= F.col(at), "deleted")
    checked = rest.join(one.withColumn("_there", F.lit(True)), "key", "left").withColumn("reason", reason).where("reason is not null").drop("_there", "_since", "_until")
    return checked.unionByName(absent)


def orphan_counts(orphans: DataFrame, *keys: str) -> DataFrame:
    """Number of orphan references and of records with one, by the keys and reason."""
    return orphans.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records"))


def split_references(rows: DataFrame, raw: str) -> DataFrame:
    """The rows with the `name` and `number` their raw reference gives (null without a number)."""
    import pandas as pd

    @F.pandas_udf("name string, number string")
    def split(values: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        parts = [seen[v] if v in seen else seen.setdefault(v, split_reference(v) or (None, None)) for v in values]
        return pd.DataFrame(parts, columns=["name", "number"], dtype=object)

    return rows.withColumn("_parts", split(raw)).select("*", "_parts.name", "_parts.number").drop("_parts")


def statute_spellings(statutes: DataFrame) -> DataFrame:
    """(entry, law): every squashed spelling of the statutes' names, own names before short and English ones."""
    laws = statutes.select("law_name", "law_name_en").where("law_name is not null").distinct()

    def spell(batches):
        import pandas as pd

        for batch in batches:
            rows = [(e, law, rank) for a, b in zip(batch.law_name, batch.law_name_en) for e, law, rank in spellings_of(a, b)]
            yield pd.DataFrame(rows, columns=["entry", "law", "rank"])

    return laws.mapInPandas(spell, "entry string, law string, rank int").groupBy("entry").agg(F.min(F.struct("rank", "law")).alias("b")).select("entry", F.col("b.law").alias("law"))


def statutes_named(names: DataFrame, spellings: DataFrame, chars: int = NAME_CHARS) -> DataFrame:
    """(name, law) of each distinct non-empty name that means a statute. The spellings are held in blocks of at most `chars` characters, each asked once by all names."""
    asked = names.toDF("name").where("name is not null and name <> ''").distinct()
    size = spellings.agg(F.sum(F.length("entry") + F.length("law"))).first()[0] or 0
    blocks = max(1, -(-size // chars))
    placed = spellings.withColumn("_b", F.pmod(F.xxhash64("entry"), F.lit(blocks)))
    if blocks > 1:
        asked, placed = stage(asked, "names"), stage(placed, "spellings")
    found = []
    for block in range(blocks):
        entries = {r[0]: r[1] for r in placed.where(F.col("_b") == block).select("entry", "law").collect()}  # bounded by `chars`, but for chance
        held = names.sparkSession.sparkContext.broadcast(entries)

        def search(batches, held=held):
            import pandas as pd

            known = StatuteNames(held.value)
            for batch in batches:
                hits = [(n, *hit) for n in batch.name if (hit := known.nearest(n))]
                yield pd.DataFrame(hits, columns=["name", "distance", "entry", "law"])

        rows = asked.mapInPandas(search, "name string, distance int, entry string, law string")
        found.append(rows if blocks == 1 else stage(rows, "named"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("name").agg(F.min(F.struct("distance", "entry", "law")).alias("b")).select("name", "b.law")


def statute_parents(statutes: DataFrame) -> DataFrame:
    number = F.regexp_extract("article_no", "([0-9]+(?:-[0-9]+)?)", 1)
    return statutes.select(F.concat_ws("|", "law_name", number).alias("key"), F.col("loaded_at").alias("since"), F.col("deleted_at").alias("until"))


#: Fixed value: the shape of a judgement chunk's key.
CHUNK_KEY = r"^[^,_]+,[^,_]+,[^,_]+,[^,_]+__.+_[0-9]+$"


def legal_orphans(analyses: DataFrame, queries: DataFrame, statutes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src_table, month_key, record_id, raw_ref, reason) of all references in both tables, each once per record and value.

    Null and empty arrays and entries are no references; a record without created_at has month `unknown`.
    """

    def flat(rows, src, key, refs):
        return rows.select(F.lit(src).alias("src_table"), F.col(key).cast("string").alias("record_id"), F.col("created_at").alias("at"), F.explode(refs).alias("raw_ref")).where("raw_ref is not null and raw_ref <> ''").distinct()

    both = flat(analyses, "clause_analyses", "analysis_id", "cited_articles").unionByName(flat(queries, "gold_queries", "id", "relevant_ids"))
    chunk = (F.col("src_table") == "gold_queries") & F.col("raw_ref").rlike(CHUNK_KEY)
    keyed = both.withColumn("_chunk", chunk)
    split = stage(split_references(keyed.where("not _chunk"), "raw_ref").where("number is not null and name <> ''"), "split")
    laws = stage(statutes_named(split.select("name"), statute_spellings(statutes)), "laws")
    articles = split.join(laws, "name").withColumn("key", F.concat_ws("|", "law", "number")).drop("name", "number", "law")
    references = articles.unionByName(keyed.where("_chunk").withColumn("key", F.concat(F.lit("chunk|"), "raw_ref"))).drop("_chunk")
    held = chunks.select(F.concat(F.lit("chunk|"), "chunk_id").alias("key"), F.col("ingested_at").alias("since")).groupBy("key").agg(F.min("since").alias("since"))
    parents = statute_parents(statutes).unionByName(held.withColumn("until", F.lit(None).cast(statutes.schema["deleted_at"].dataType)))
    found = orphan_references(references, parents)
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return found.select("src_table", month.alias("month_key"), "record_id", "raw_ref", "reason").distinct()
