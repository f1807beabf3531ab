"""Documents as they arrive: the extraction is independent for each document, so a micro-batch is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def extract_stream(docs: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True, release: Callable[[], None] | None = None) -> StreamingQuery:
    """Append extract(batch) of each micro-batch of docs to Parquet below path, in a folder for each batch; a repeated batch overwrites its own. release: called after each, to drop what extract cached (KeySentences.release)."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if release is not None:
            release()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
