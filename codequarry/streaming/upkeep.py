"""Index upkeep as Structured Streaming: change events keep a ledger, lookups keep hit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.ledger import ledger_state
from codequarry.store import VersionedTable


def follow_ledger(events: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Folds a stream of ledger rows into a versioned table, micro-batch by micro-batch, and ends when the source is read.

    A batch is merged with the state and the newest row of each path is kept, so late
    older rows change nothing and a batch that runs twice gives the same state.
    """

    def merge(batch: DataFrame, _: int) -> None:
        old = table.read_or_none()
        merged = batch if old is None else old.unionByName(batch)
        table.write(ledger_state(merged))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_hits(lookups: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Lookups per key and window of event time; lookups later than the watermark are left out. Works on streams and tables."""
    rows = lookups.withWatermark("ts", late) if lookups.isStreaming else lookups
    return rows.groupBy(F.window("ts", window), "query_hash").agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "query_hash", "hits")


def stream_folder(spark: SparkSession, path: str, schema: object, files_per_batch: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
