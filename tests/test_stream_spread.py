"""A micro-batch of one file is matched on all cores."""

from sigweave.streaming import captures as streams
from sigweave.streaming.runtime import read_stream, work_dir


def test_batches_of_one_file_are_dealt_out(spark, monkeypatch):
    seen = []

    def counted(batch, *_):
        seen.append(batch.rdd.getNumPartitions())
        return batch

    monkeypatch.setattr(streams, "detect", counted)
    folder, out = work_dir(spark, "one-file"), work_dir(spark, "spread-out")
    rows = spark.range(50).selectExpr("id AS capture_id")
    rows.coalesce(1).write.parquet(folder)
    streams.match_stream(read_stream(spark, folder, rows.schema), None, out, work_dir(spark, "state"))
    assert min(seen) >= spark.sparkContext.defaultParallelism
    assert sorted(r["capture_id"] for r in spark.read.parquet(out).collect()) == list(range(50))
