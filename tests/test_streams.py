"""Streams over several files, a batch for each: state crosses batches, and a stream may be started again."""

import pytest

from tidemark.streaming import events


@pytest.fixture
def split(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("tidemark.stream.filesPerBatch", "1")
    yield str(tmp_path)
    spark.conf.unset("tidemark.stream.filesPerBatch")


@pytest.mark.parametrize("name", sorted(events.FRAMES))
def test_batches(name, spark, split, duck, same):
    frame, sql = events.FRAMES[name]
    same(frame(spark, split), duck, sql)


def test_merged_state_starts_again(spark, split, duck, same, tmp_path):
    sql = events.FRAMES["stream_merge_state"][1]
    for _ in range(2):
        same(events.merged_state(spark, split, f"{tmp_path}/state"), duck, sql)
