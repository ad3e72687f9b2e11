"""Background ingestion (S2): poll a folder, ingest each new file once.

A file stream with ``foreachBatch``: the checkpoint records which files were
already ingested (skip-already-ingested), the trigger is the polling interval.
Each micro-batch appends its own rows to the store and compacts it now and then; chunk and document ids are
content-derived, so a replayed batch rewrites the same rows. The commit's version is
the sequence, so a stream that starts over with a new checkpoint still wins over older
rows. Rejected chunks are kept with each commit (``read_rejects``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from guardrag.config import ChunkingOptions, IngestionOptions
from guardrag.operators.store import compact_store
from guardrag.plans.ingest import ingest_to_store
from guardrag.session import scratch_scope
from guardrag.sources.files import read_documents, stream_documents
from guardrag.streaming.once import without_copies


def start_ingest_stream(spark: SparkSession, store_root: str, checkpoint: str,
                        opts: IngestionOptions = IngestionOptions(), chunking: ChunkingOptions = ChunkingOptions(),
                        available_now: bool = False, docs: DataFrame | None = None, skip_copies: str | None = None, compact_every: int | None = None,
                        **ingest_kwargs) -> StreamingQuery:
    """``docs``: a stream of (title, content) rows to ingest instead of the folder's files. ``skip_copies``: how long (event time, column
    ``modified_at``) a content counts as ingested, so that a renamed copy adds no chunk; None goes by file name alone. ``compact_every``: compact the store after so many versions."""
    docs = stream_documents(spark, opts.source_path, opts.file_extensions) if docs is None else docs
    docs = docs if skip_copies is None else without_copies(docs, skip_copies)

    def batch(df: DataFrame, batch_id: int) -> None:
        with scratch_scope(df.sparkSession):
            version, _ = ingest_to_store(df, store_root, content_col="content", title_col="title", chunking=chunking, **ingest_kwargs)
            if compact_every and version % compact_every == 0:
                compact_store(df.sparkSession, store_root)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=f"{opts.polling_interval_seconds} seconds")
    return writer.start()


def ingest_folder(spark: SparkSession, store_root: str, ingest_seq: int | None = None, opts: IngestionOptions = IngestionOptions(),
                  chunking: ChunkingOptions = ChunkingOptions(), **ingest_kwargs) -> int:
    """Skip-already-ingested off: re-read the whole folder as one batch. Returns the committed version."""
    docs = read_documents(spark, opts.source_path, opts.file_extensions)
    version, _ = ingest_to_store(docs, store_root, ingest_seq, content_col="content", title_col="title",
                                 chunking=chunking, **ingest_kwargs)
    return version


def start_chunk_stream(stream: DataFrame, transform, sink: str, checkpoint: str) -> StreamingQuery:
    """Generic idempotent micro-batch sink: ``transform(batch_df)`` written to
    ``sink/batch_id=N`` with overwrite, so a retried batch replaces its own output."""

    def batch(df: DataFrame, batch_id: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
