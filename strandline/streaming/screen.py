"""Screening of outbound documents as they arrive: an extension, since everything else here is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.matching import METHODS


def screen(reference: DataFrame, outbound: DataFrame, sink: str, checkpoint: str, method: str = "bm25", threshold: float = 0.0, delay: str = "10 minutes", time_col: str = "ts", **trigger) -> StreamingQuery:
    """Append to `sink` the outbound documents whose best match reaches the threshold.

    outbound: a stream with doc_id, family_id, text and an event time.  A document that arrives again within `delay`
    is dropped by the watermark's state.  Each micro-batch runs the batch method against the registered documents;
    its rows carry the batch's number, and a batch that runs again after a failure overwrites its own folder.
    """
    match = METHODS[method]

    def one(batch: DataFrame, number: int) -> None:
        found = match(reference, batch.select("doc_id", "family_id", "text"))
        found.where(F.col("pred_doc_id").isNotNull() & (F.col("confidence") >= threshold)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    once = outbound.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["doc_id"])
    return once.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def volume(outbound: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", time_col: str = "ts", by: str = "family_id") -> DataFrame:
    """Documents per window and family, late ones within `delay` included."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return outbound.withWatermark(time_col, delay).groupBy(window, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
