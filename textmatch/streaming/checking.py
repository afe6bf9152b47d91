"""Documents arriving on a stream are checked against the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.encoding import Model
from ..operators.matching import match_percent, vectors_per_document
from ..options import DEFAULTS, Options
from ..plans.checking import check_documents
from ..plans.indexing import similarity
from ..sources.readers import Index


def _batch_path(path: str, batch_id: int) -> str:
    # A batch that is run again after a failure overwrites its own folder.
    return f"{path}/batch_id={batch_id}"


def check_stream(
    docs: DataFrame,
    index: Index,
    vocab: DataFrame,
    make_model: Callable[[], Model],
    path: str,
    checkpoint: str,
    options: Options = DEFAULTS,
    nprobe: int | None = None,
) -> StreamingQuery:
    """Write a verdict for each document of a stream; ends when the input is used up.

    The best-k ranking is not allowed on a stream, so each micro-batch runs as a batch job.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        verdicts = check_documents(batch, index, vocab, make_model, options, nprobe)
        verdicts.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return (
        docs.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    vectors: DataFrame, index: Index, path: str, checkpoint: str, options: Options = DEFAULTS, k: int | None = None
) -> StreamingQuery:
    """Score query vectors of a stream; :func:`read_scores` gives the percentages.

    Each micro-batch stores hits per document and file and vectors per document, so a
    document may span any number of them.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        hits = similarity(batch, index, options, k=k).select("doc_id", "file_id", "hits")
        hits.write.mode("overwrite").parquet(_batch_path(f"{path}/hits", batch_id))
        vectors_per_document(batch).write.mode("overwrite").parquet(_batch_path(f"{path}/vectors", batch_id))

    return (
        vectors.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_scores(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Percentages over all micro-batches so far (doc_id, file_id, hits, percent)."""
    hits = spark.read.parquet(f"{path}/hits").groupBy("doc_id", "file_id").agg(F.sum("hits").alias("hits"))
    vectors = spark.read.parquet(f"{path}/vectors").groupBy("doc_id").agg(F.sum("n_query").alias("n_query"))
    return match_percent(hits, vectors, k)
