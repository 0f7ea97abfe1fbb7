"""Incremental identity assignment: new records join the identities already stored.

The stored table holds (block, name_key, identity). Each micro-batch is matched to it on block and name; records
without a match found an identity of their own, by the smallest id of their name in the block. Batches are applied
with ``foreachBatch``; a batch that is run again after a failure overwrites its own output, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["block", "name_key"]
STORED = "block string, name_key string, identity string"


def assigned(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``batch`` (id, block, name_key) with its identity, and whether that is new."""
    held = batch.join(stored.select(*KEYS, "identity"), KEYS, "left")
    fresh = batch.groupBy(*KEYS).agg(F.concat_ws("-", F.lit("N"), F.min("id").cast("string")).alias("_new"))
    joined = held.join(fresh, KEYS)
    return joined.select("id", *KEYS, F.coalesce("identity", "_new").alias("identity"), F.col("identity").isNull().alias("is_new"))


def start(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of (id, block, name_key); identities go to ``path``/store, assignments to ``path``/assigned."""
    spark = records.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        store = read_store(spark, path, before=number)
        found = assigned(batch.dropDuplicates(["id"]), store).persist()
        new = found.where("is_new").select(*KEYS, "identity").distinct()
        new.write.mode("overwrite").parquet(f"{path}/store/batch={number}")
        found.drop("is_new").write.mode("overwrite").parquet(f"{path}/assigned/batch={number}")
        found.unpersist()

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Identities stored by the batches before a number, or by all."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/store")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STORED)
    held = spark.read.schema(f"{STORED}, batch int").option("basePath", f"{path}/store").parquet(f"{path}/store")
    return (held if before is None else held.where(F.col("batch") < before)).select(*KEYS, "identity")
