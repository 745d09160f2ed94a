"""A last-write-wins store of artifacts that takes in a batch at the cost of the batch.

The store is a folder of hash buckets, each with a base and the deltas since. A batch only adds deltas. A bucket whose
deltas have outgrown its base is folded into a new base, so every row is rewritten about once each time its bucket doubles.
Rows are decided by their `seq` when read: taking a batch in twice, a fold that was broken off, or a new checkpoint over a
filled store leave rows that lose or are equal, and change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aerolattice.operators.lineage import latest

BUCKETS = 16


def _exists(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Data files (path, bytes) right under a folder; none if it does not exist."""
    if not _exists(spark, folder):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath(), f.getLen()) for f in system.listStatus(place) if f.isFile()]
    return [(path.toString(), size) for path, size in found if not path.getName().startswith(("_", "."))]


def _delete(spark: SparkSession, files: list[str]) -> None:
    for name in files:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)


def _write(rows: DataFrame, folder: str, buckets: int) -> None:
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("run_id", "artifact"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def take_in(batch: DataFrame, store: str, buckets: int = BUCKETS) -> None:
    """Add the last writes of a batch, then fold the buckets whose deltas weigh more than their base.

    `buckets` belongs to the store and must not change over its life. The batch must have the columns of the store.
    """
    spark = batch.sparkSession
    _write(latest(batch).select(*batch.columns), f"{store}/delta", buckets)
    for bucket in range(buckets):
        base, delta = (_files(spark, f"{store}/{part}/bucket={bucket}") for part in ("base", "delta"))
        if sum(size for _, size in delta) > sum(size for _, size in base):
            old = [path for path, _ in base + delta]
            _write(latest(spark.read.schema(batch.schema).parquet(*old)).select(*batch.columns), f"{store}/base", buckets)
            _delete(spark, old)


def stored(spark: SparkSession, store: str, schema) -> DataFrame:
    """One row per run and artifact, the last write; no row for a store that does not exist yet."""
    there = [f"{store}/{part}" for part in ("base", "delta") if _exists(spark, f"{store}/{part}")]
    empty = spark.createDataFrame([], schema)
    rows = spark.read.schema(empty.schema).parquet(*[f"{part}/*" for part in there]) if there else empty
    return latest(rows).select(*empty.columns)


def store_stream(publishes: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep `store` up with a stream of publishes; work per batch goes with the batch."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            take_in(batch, store, buckets)

    return publishes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
