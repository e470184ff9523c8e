"""Checks of documents as they arrive. A check needs one document at a time, so each micro-batch is checked by the batch plan."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prosegrain.config import Config
from prosegrain.operators import report
from prosegrain.operators.scopes import scopes
from prosegrain.plans.check import documents, findings_of


def check_stream(docs: DataFrame, config: Config, out: str, checkpoint: str) -> StreamingQuery:
    """Write the findings of a stream of docs (file, kind, raw) as Parquet under out, one folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so findings are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        texts = documents(batch)
        scoped = scopes(texts).persist(StorageLevel.DISK_ONLY)  # made once for all rules
        try:
            found = report.unsuppressed(findings_of(scoped, config), report.suppressions(texts, config.ignore_marker))
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            scoped.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
