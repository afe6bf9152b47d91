"""New corpus vectors are added to a stored index, run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import write_vectors


def extend_index(vectors: DataFrame, centroids: DataFrame, path: str, checkpoint: str, run: str) -> StreamingQuery:
    """Assign the new vectors to the existing centres and add them; ends with the input.

    Every micro-batch of a ``run`` (one checkpoint location) owns a folder of the index, so
    one that is repeated after a failure replaces its first attempt. The statistics of a
    micro-batch lie beside it and are merged by readers; nothing stored is read again.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        write_vectors(batch, centroids, path, f"{run}-{batch_id}")

    return (
        vectors.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
