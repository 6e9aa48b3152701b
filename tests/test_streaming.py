"""The streams give what the batch forms give on the same log."""

import pytest

from chronoframe.sources.fixtures import Fixtures

pytest.importorskip("google.protobuf")


def _drain(df, folder):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_rates_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from chronoframe.operators.telemetry import rates
    from chronoframe.streaming.replay import sample_stream

    rows = Fixtures(spark, "/root/testdata/sf0.001").counter_samples().select("range_id", "replica_id", "at_us", "reads")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    _drain(sample_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = rates(rows, ["range_id", "replica_id"], ["reads"]).select("range_id", "replica_id", "at_us", "reads_rate")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
