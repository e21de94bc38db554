"""The queue as a stream: producers' folders of action rows come in, and each micro-batch is applied to the store.

A batch is committed by the store's manifest swap, which records the folders taken in, and then deletes them; a batch that is run again
after a crash finds them recorded or gone and changes nothing, so each action takes effect once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satchel.plans.store import SCHEMAS, Owner


def start(spark: SparkSession, folder: str, checkpoint: str, source: str = "left", once: bool = True):
    """Drain the store whenever producers have written. once: stop after what is there."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Owner(spark, folder, source).drain()

    stream = spark.readStream.schema(SCHEMAS["queue"]).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").parquet(f"{folder.rstrip('/')}/inbox")
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
