"""Micro-batches become segments."""

from loomdex.plans.snapshot import IndexSnapshot
from loomdex.sources.storage import IndexStorage
from loomdex.streaming.ingest import stream_segments


def test_each_batch_is_a_segment(spark, tmp_path):
    source, storage = str(tmp_path / "in"), IndexStorage(spark, str(tmp_path / "index"))
    snapshot = IndexSnapshot(storage)

    def add(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(source)
        query = stream_segments(stream, storage, snapshot, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()

    add([(7, "rust is fast"), (3, "Rust, rust!"), (9, None)])
    run()
    add([(1, "rust")])
    run()
    run()
    assert [tuple(r) for r in snapshot.query_term("rust").collect()] == [(1, 0, 1), (1, 1, 1), (2, 0, 1)]
    assert snapshot.manifest.total_document_count == 3
