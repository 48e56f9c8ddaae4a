"""Where streams end: idempotent batch tables, per-row senders, plain starts."""
from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(df: DataFrame, fmt: str, checkpoint: str, options: Mapping[str, str] | None = None,
          trigger: Mapping[str, object] | None = None, output_mode: str = "append",
          name: str | None = None) -> StreamingQuery:
    """Start a query into a streaming sink (kafka, parquet, memory, console ...)."""
    writer = (df.writeStream.format(fmt).outputMode(output_mode)
              .option("checkpointLocation", checkpoint).options(**(options or {}))
              .trigger(**(trigger or {"availableNow": True})))
    return (writer.queryName(name) if name else writer).start()


def batch_table(folder: str, shape: Callable[[DataFrame], DataFrame] | None = None,
                fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function writing each micro-batch to its own subfolder of its query's.

    A batch that is run again after a failure overwrites its own folder: no row twice. A query
    with a new checkpoint has a new id, so it leaves what earlier ones wrote.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = shape(batch) if shape else batch
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        out.write.mode("overwrite").format(fmt).save(f"{folder}/query_id={query}/batch_id={batch_id}")

    return write


class RowSender:
    """A ``foreach`` writer: opens a client per partition, sends each row, flushes at the end.

    Rows are shaped by column expressions beforehand (``key``, ``value``); the writer only
    sends. ``make_client`` runs on the executor and returns an object with ``send(key, value)``
    and ``close()``.
    """

    def __init__(self, make_client: Callable[[], object]):
        self._make_client = make_client
        self._client = None

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self._client = self._make_client()
        return True

    def process(self, row) -> None:
        self._client.send(row["key"], row["value"])

    def close(self, error) -> None:
        if self._client is not None:
            self._client.close()
