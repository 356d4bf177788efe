"""Structured Streaming: ordered clause events, keyed upsert, late data, resumable batches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of parquet events as a stream; zone-less timestamps become timestamps so that watermarks apply."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    for field in rows.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return rows


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`: one partial aggregation, no sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


BUCKETS = 64


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Bucket -> its versions, oldest first, from the names of a table's folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_v=*/_bucket=*")
    found: dict[int, list[int]] = {}
    for status in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ():
        held = status.getPath()
        found.setdefault(int(held.getName().removeprefix("_bucket=")), []).append(int(held.getParent().getName().removeprefix("_v=")))
    return {bucket: sorted(v) for bucket, v in found.items()}


def _read(spark: SparkSession, target: str, schema, newest_of: dict[int, int]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{target}/_v={v}/_bucket={b}" for b, v in sorted(newest_of.items())))


def upsert(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = BUCKETS):
    """Keeps in `target` the last row of each key: a micro-batch rewrites the buckets its keys lie in and no other.

    The batch number names the version of its buckets and only older ones are read, so a batch that is replayed
    after a failure gives the same table. Versions that two newer ones have replaced are removed.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        held = {b: [v for v in vs if v < number] for b, vs in _versions(spark, target).items() if b in touched}
        before = {b: vs[-1] for b, vs in held.items() if vs}
        if before:
            batch = batch.unionByName(_read(spark, target, schema, before))
        latest = latest_by_key(batch, keys, order).withColumn("_bucket", bucket)
        latest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/_v={number}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b, vs in held.items():
            for v in vs[:-1]:
                path = jvm.org.apache.hadoop.fs.Path(f"{target}/_v={v}/_bucket={b}")
                path.getFileSystem(conf).delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table as the last micro-batch left it."""
    known = {b: vs[-1] for b, vs in _versions(spark, target).items()}
    return _read(spark, target, schema, known) if known else spark.createDataFrame([], schema)


def ordered_stream(stream: DataFrame, document: str, index: str, target: str, checkpoint: str):
    """Writes each micro-batch's rows as events, a document's `clause` events in order and then its `done` event with their number.

    A document's rows come in one micro-batch; a task writes its documents one after the other. Columns: document, position, event, payload.
    """

    def emit(batch: DataFrame, number: int) -> None:
        rows = batch.select(document, F.col(index).cast("bigint").alias("position"), F.lit("clause").alias("event"), F.to_json(F.struct(*batch.columns)).alias("payload"))
        done = batch.groupBy(document).agg((F.coalesce(F.max(index), F.lit(-1)) + 1).cast("bigint").alias("position"), F.lit("done").alias("event"), F.to_json(F.struct(F.count(F.lit(1)).alias("count"))).alias("payload"))
        rows.unionByName(done).repartition(document).sortWithinPartitions(document, "position", F.desc("event")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def budgeted(todo: DataFrame, finished: str, keys: list[str], budget: int, work) -> int:
    """Works on at most `budget` rows whose key isn't in the table at `finished` yet, appends the results there and gives their number.

    work: rows -> rows with the keys. A run that is stopped leaves no row of it; the next call goes on after what is finished.
    """
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(finished).select(*keys)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = todo.select(*keys).limit(0)
    before = done.count()
    work(resume(todo, done, keys, budget)).write.mode("append").parquet(finished)
    return spark.read.parquet(finished).count() - before


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key in tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def ordered_events(batch: DataFrame, index: str) -> DataFrame:
    """`clause` rows in order and one `done` row with their number last; columns event, position, payload."""
    rows = batch.select(F.lit("clause").alias("event"), F.col(index).cast("bigint").alias("position"), F.to_json(F.struct(*batch.columns)).alias("payload"))
    done = batch.agg(F.lit("done").alias("event"), (F.coalesce(F.max(index), F.lit(-1)) + 1).cast("bigint").alias("position"), F.to_json(F.struct(F.count(F.lit(1)).alias("count"))).alias("payload"))
    return rows.unionByName(done).orderBy("position", F.col("event").desc())


def resume(todo: DataFrame, finished: DataFrame, keys: list[str], budget: int | None = None) -> DataFrame:
    """Rows whose key isn't finished; with a budget the first so many by key."""
    rest = todo.join(finished.select(*keys).distinct(), keys, "left_anti")
    return rest.orderBy(*keys).limit(budget) if budget else rest

