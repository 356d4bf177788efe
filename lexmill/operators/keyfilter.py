"""Bloom filters of a table's keys, sharded by the key's hash.

Every shard has at most SHARD_BYTES and is built where its keys are brought together (8 bytes a key), so no task
merges the filters of others. While all shards together stay under HELD_BYTES they are broadcast and
rows are tested where they are; beyond, rows are routed to the shard of their key, which streams by ahead of them. A
filter never denies a key it holds; how often it admits one it doesn't hold is measured on its bits.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import stage

SHARD_BYTES = 8 << 20
HELD_BYTES = 64 << 20
BITS_PER_KEY = 10
HASHES = 7
#: Rows of one shard that one task tests where rows are routed; a shard with more is copied to several tasks.
ROUTED_ROWS = 4_000_000


def _places(h: np.ndarray, bits: int):
    """The HASHES bit numbers of every 64-bit hash, one array after the other."""
    x = h.view(np.uint64) if h.dtype == np.int64 else h
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (low + np.uint64(i) * high) % np.uint64(bits)


def filter_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The packed bits of a filter of the hashes."""
    field = np.zeros(bits, bool)
    for at in _places(h, bits):
        field[at] = True
    return np.packbits(field)


def admits(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of the hashes."""
    out = np.ones(len(h), bool)
    for at in _places(h, len(packed) * 8):
        out &= (packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(h, shards)


@dataclass
class KeyFilter:
    """shards: number of shards; table: (shard, bits) rows; held: the shards' bits if they may be broadcast, else None."""

    shards: int
    table: DataFrame
    held: list[np.ndarray] | None
    n_bytes: int

    def rate(self) -> float:
        """Measured share of foreign keys that are admitted, from the bits that are set."""
        rows = self.table.select("ones", F.octet_length("bits").alias("n")).toPandas()  # two numbers a shard
        return float((((rows.ones / (rows.n * 8)) ** HASHES).mean()) if len(rows) else 0.0)

    def test(self, h: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may be a key's; for held filters."""
        return test_held(self.held, h)

    def mark(self, rows: DataFrame, hashed, name: str) -> DataFrame:
        """The rows with a boolean column: whether the filter may hold the hash `hashed` (a bigint column without nulls)."""
        return self._mark_held(rows, hashed, name) if self.held is not None else self._mark_routed(rows, hashed, name)

    def _mark_held(self, rows, hashed, name):
        import pandas as pd

        held = rows.sparkSession.sparkContext.broadcast(self.held)

        @F.pandas_udf("boolean")
        def may(h: pd.Series) -> pd.Series:
            return pd.Series(test_held(held.value, h.to_numpy(np.int64)))

        return rows.withColumn(name, may(hashed))

    def _mark_routed(self, rows, hashed, name):
        """Rows go to the task of their shard; the shard's bits come first there."""
        shards, columns = self.shards, rows.columns
        placed = rows.withColumn("_kf_hash", hashed).withColumn("_kf_shard", F.pmod("_kf_hash", F.lit(shards)).cast("int"))
        copies = placed.groupBy("_kf_shard").agg(F.ceil(F.count(F.lit(1)) / ROUTED_ROWS).cast("int").alias("_kf_copies"))
        placed = placed.join(copies, "_kf_shard").withColumn("_kf_copy", F.pmod(F.xxhash64(*columns), F.col("_kf_copies")).cast("int")).drop("_kf_copies")
        bits = self.table.select(F.col("shard").alias("_kf_shard"), F.col("bits").alias("_kf_bits")).join(copies, "_kf_shard").withColumn("_kf_copy", F.explode(F.sequence(F.lit(0), F.col("_kf_copies") - 1))).drop("_kf_copies")
        both = placed.withColumn("_kf_bits", F.lit(None).cast("binary")).unionByName(bits, allowMissingColumns=True)
        parts = max(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        routed = both.repartition(parts, "_kf_shard", "_kf_copy").sortWithinPartitions("_kf_shard", "_kf_copy", F.isnull("_kf_bits"))
        out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` boolean"

        def test(batches):
            import pyarrow as pa

            now, packed = None, None
            for batch in batches:
                shard, h, sent = batch.column("_kf_shard").to_numpy(), batch.column("_kf_hash").fill_null(0).to_numpy(), batch.column("_kf_bits")
                may, keep = np.zeros(len(shard), bool), np.ones(len(shard), bool)
                edges = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)) if len(shard) else []
                for lo, hi in zip(edges, [*edges[1:], len(shard)]):
                    if shard[lo] != now:
                        now, packed = shard[lo], None
                    while lo < hi and sent[lo].is_valid:
                        packed, keep[lo] = np.frombuffer(sent[lo].as_py(), np.uint8), False
                        lo += 1
                    # copies of a shard in one task: their bits are the same
                    for i in range(lo, hi):
                        if sent[i].is_valid:
                            keep[i] = False
                    if packed is not None and lo < hi:
                        may[lo:hi] = admits(packed, h[lo:hi])
                kept = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(kept) for c in columns), pa.array(may[keep])], [*columns, name])

        return routed.mapInArrow(test, out)


def test_held(held: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    if len(held) == 1:
        return admits(held[0], h)
    out, shard = np.zeros(len(h), bool), shard_of(h, len(held))
    for s in np.unique(shard):
        at = shard == s
        out[at] = admits(held[s], h[at])
    return out


def key_filter(hashes: DataFrame, shard_bytes: int = SHARD_BYTES, held_bytes: int = HELD_BYTES, ready: bool = False) -> KeyFilter:
    """The filter of a one-column table of 64-bit hashes (bigint); nulls are left out. ready: the table is staged, with distinct hashes."""
    rows = hashes.toDF("h").where("h is not null")
    if not ready:
        rows = stage(rows.distinct(), "keys")
    n = rows.count()
    per_shard = shard_bytes * 8 // BITS_PER_KEY
    shards = max(1, -(-n // per_shard))
    # shards of even size, each with the bits its number of keys needs and at most a quarter more
    bits = min(max(64, -(-n * BITS_PER_KEY // shards) * 5 // 4), shard_bytes * 8)
    bits = -(-bits // 8) * 8

    def build(batches):
        import pyarrow as pa

        parts: dict[int, list] = {}
        for batch in batches:
            h = batch.column(0).to_numpy()
            shard = shard_of(h, shards)
            for s in np.unique(shard):
                parts.setdefault(int(s), []).append(h[shard == s])
        for s, held in parts.items():
            packed = filter_bits(np.concatenate(held), bits)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed.tobytes()], pa.binary()), pa.array([int(np.bitwise_count(packed).sum())], pa.int64())], ["shard", "bits", "ones"])

    built = rows.repartition(shards, F.pmod("h", F.lit(shards))).mapInArrow(build, "shard int, bits binary, ones bigint")
    table = stage(built, "filter")
    size = shards * bits // 8
    held = None
    if size <= held_bytes:
        held = [np.zeros(bits // 8, np.uint8)] * shards
        for r in table.select("shard", "bits").toLocalIterator():
            held[r["shard"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        if any(len(x) != bits // 8 for x in held):
            raise AssertionError("a shard of the filter hasn't the size asked for")
    return KeyFilter(shards, table, held, size)
