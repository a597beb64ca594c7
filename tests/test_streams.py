from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from mnemospark.streaming import events as E

SCHEMA = "user_id long, event_type string, ts timestamp"
T0 = datetime(2024, 1, 1)


def at(user, seconds):
    return (user, "snap", T0 + timedelta(seconds=seconds))


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def rows_of(spark, folder):
    return sorted((r.user_id, (r.ts - T0).total_seconds()) for r in spark.read.schema(SCHEMA).parquet(folder).collect())


@pytest.fixture
def stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [at(9, 0)])
    return folder, lambda: E.kept_snapshots(E.event_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1), ["user_id"], "60 seconds", "10 minutes")


def test_events_within_the_gap_are_dropped_over_batches_and_restarts(spark, tmp_path, stream):
    folder, query = stream
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, folder, [at(1, 0), at(1, 30), at(1, 60), at(1, 61), at(2, 5), at(2, 5)])
    E.run_to_end(query(), out, state)
    assert rows_of(spark, out) == [(1, 0), (1, 60), (2, 5), (9, 0)]
    put(spark, folder, [at(1, 100), at(1, 125), at(2, 64), at(2, 65)])
    E.run_to_end(query(), out, state)
    assert rows_of(spark, out) == [(1, 0), (1, 60), (1, 125), (2, 5), (2, 65), (9, 0)]


def test_late_events_are_dropped_and_old_state_is_cleared(spark, tmp_path, stream):
    folder, query = stream
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, folder, [at(1, 0)])
    E.run_to_end(query(), out, state)
    put(spark, folder, [at(2, 10_000)])  # moves the watermark to 9,400
    E.run_to_end(query(), out, state)
    put(spark, folder, [at(1, 500), at(1, 9_500), at(1, 9_520), at(3, 9_000)])
    E.run_to_end(query(), out, state)
    assert rows_of(spark, out) == [(1, 0), (1, 9_500), (2, 10_000), (9, 0)]


def test_a_stream_that_was_killed_goes_on_where_it_was(spark, tmp_path, stream):
    folder, query = stream
    out, state, broken = str(tmp_path / "out"), str(tmp_path / "state"), []
    for k in range(4):
        put(spark, folder, [at(1, 40 * k), at(2, 40 * k + 1)])

    def sink(fail):
        def write(batch, number):
            if fail and number == 2:
                broken.append(number)
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that comes again replaces itself

        return write

    run = lambda fail: query().writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink(fail)).start().awaitTermination()
    with pytest.raises(StreamingQueryException):
        run(True)
    assert broken
    run(False)
    got = sorted((r.user_id, (r.ts - T0).total_seconds()) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0), (1, 80), (2, 1), (2, 81), (9, 0)]
