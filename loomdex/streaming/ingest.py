"""Incremental ingestion: every micro-batch of texts becomes one segment and one manifest generation.

An addition: batch builds do the same by hand. The sink is at least once unless the
checkpoint and the index are on one file system; a batch that was already published is
recognised by its number and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import publish_table_segment
from ..plans.snapshot import IndexSnapshot
from ..sources.storage import IndexStorage


def stream_segments(texts: DataFrame, storage: IndexStorage, snapshot: IndexSnapshot, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Start a query over a streaming DataFrame with (key, text); each batch publishes a segment.

    An empty batch publishes nothing. Documents are numbered anew in every segment.
    """
    done = f"{checkpoint.rstrip('/')}/loomdex-batches"
    storage.files.make_dirs(done)

    def publish(batch: DataFrame, number: int) -> None:
        marker = f"{done}/{number}"
        if storage.files.exists(marker) or batch.isEmpty():
            return
        metadata = publish_table_segment(storage, snapshot, batch, text, key)
        storage.files.write(marker, str(metadata.segment_id).encode())

    return texts.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).start()
