"""New reads only: those above the highest number stored whose names are not stored yet; as a batch or from files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def increment(incoming: DataFrame, stored: DataFrame, column: str = "read_id") -> DataFrame:
    """Rows of ``incoming`` beyond the stored maximum (all if nothing is stored), by name not stored yet; a repeated name is taken once."""
    mark = stored.agg(F.max(column).alias("mark"))  # one row
    beyond = incoming.join(F.broadcast(mark)).where(F.col("mark").isNull() | (F.col(column) > F.col("mark"))).drop("mark")
    return beyond.join(stored.select("readname"), "readname", "left_anti").dropDuplicates(["readname"]).select(incoming.columns)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Take what is new in a folder of Parquet files into ``target`` (Parquet), then stop; the query to wait for.

    Every batch is checked against what the target holds; a batch that is repeated after a failure adds nothing.
    """
    def take(batch: DataFrame, _: int) -> None:
        try:
            stored = batch.sparkSession.read.schema(schema).parquet(target)
            known = stored.select("readname")
        except Exception as fault:  # the target doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(fault):
                raise
            known = batch.select("readname").limit(0)
        batch.dropDuplicates(["readname"]).join(known, "readname", "left_anti").write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
