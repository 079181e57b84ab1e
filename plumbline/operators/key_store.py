"""The keys of clean tables, written once, bucketed by key, so that a batch of new rows meets them without moving them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.detection import key_text
from plumbline.operators.profile_store import TableProfile

#: Keys behind one bucket on average.
BUCKET_KEYS = 1 << 20


@dataclass(frozen=True)
class KeyStore:
    """A table (attr, k): each different key of each column `attr`, dealt into buckets by both and sorted within."""

    spark: SparkSession
    table: str
    attrs: frozenset[str]

    @staticmethod
    def name(table: str, column: str) -> str:
        return f"{table}.{column}"

    def holds(self, table: str, column: str) -> bool:
        return self.name(table, column) in self.attrs

    def marked(self, keys: DataFrame, mark: str) -> DataFrame:
        """`keys` (attr, k, ...) with a flag that tells whether the store holds the key. Only `keys` are dealt out: the store is read
        bucket by bucket."""
        held = self.spark.table(self.table).select(F.col("attr").alias("__attr"), F.col("k").alias("__k"))
        # a merge join keeps the buckets; a hint, since a small batch would otherwise pull the store to itself
        joined = keys.hint("merge").join(held, (F.col("attr") == F.col("__attr")) & (F.col("k") == F.col("__k")), "left")
        return joined.withColumn(mark, F.col("__k").isNotNull()).drop("__attr", "__k")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def wanted_keys(profiles: dict[str, TableProfile]) -> set[tuple[str, str]]:
    """Columns whose clean keys a batch is checked against: keys, and what foreign keys point at."""
    own = {(t, c) for t, p in profiles.items() for c, known in p.columns.items() if known.potential_primary_key}
    return own | {(link.parent_table, link.parent_column) for p in profiles.values() for link in p.foreign_keys.values()}


def write_key_store(clean: dict[str, DataFrame], profiles: dict[str, TableProfile], table: str | None = None) -> KeyStore:
    """Store the clean keys of all tables in the warehouse; done once per profile.

    `table` is a new table of the session's catalog. Missing keys are left out; a key that many rows repeat is stored once.
    """
    spark = next(iter(clean.values())).sparkSession
    places = sorted((t, c) for t, c in wanted_keys(profiles) if t in clean and c in clean[t].columns)
    frames = []
    for t in sorted({t for t, _ in places}):
        cells = F.array(*[F.struct(F.lit(KeyStore.name(t, c)).alias("attr"), key_text(clean[t], c).alias("k"))
                          for owner, c in places if owner == t])
        frames.append(clean[t].select(F.inline(cells)))
    keys = spark.createDataFrame([], "attr string, k string")
    for frame in frames:
        keys = keys.unionByName(frame)
    keys = keys.filter("k IS NOT NULL").distinct()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(df.count() for df in clean.values()) // BUCKET_KEYS))
    table = table or f"keys_{uuid.uuid4().hex}"
    # one file per bucket
    keys.repartition(n, "attr", "k").write.format("parquet").bucketBy(n, "attr", "k").sortBy("attr", "k").saveAsTable(table)
    return KeyStore(spark, table, frozenset(KeyStore.name(t, c) for t, c in places))
