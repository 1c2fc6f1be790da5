"""Rows that streams drop as too late are all in the account, however few batches the query itself remembers."""

from changeguard.streaming import monitors
from changeguard.streaming.late import late_rows, late_rows_to
from tests.test_streams import at, feed  # noqa: F401


def test_account_outlasts_the_progress_of_a_query(spark, feed, tmp_path):  # noqa: F811
    batches = [[(10 * n, at(1000 * n))] + [(10 * n + k, at(0)) for k in range(1, 1 + n % 4)] for n in range(1, 9)]
    stream = monitors.dedup_stream(feed(batches, "id long, ts timestamp"), "ts", ["id"], "1 second")
    account = str(tmp_path / "late")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with late_rows_to(spark, account) as listener:
            query = stream.writeStream.format("noop").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    got = {r.batch_id: r.dropped for r in late_rows(spark, account).collect()}
    # Batch n drops what the watermark of batch n - 1 had passed, which is that of the rows of batch n - 2.
    assert got == {n - 1: n % 4 for n in range(3, 9) if n % 4}
    assert monitors.dropped_rows(query) < sum(got.values())
    listener.log.commit([{"query_id": str(query.id), "query_name": "late", "batch_id": 2, "operator": 0, "operator_name": "dedupeWithinWatermark", "dropped": 3}])
    assert late_rows(spark, account).filter("batch_id = 2").first().dropped == 3  # a batch that ran twice
    assert late_rows(spark, account).count() == len(got)
    assert late_rows(spark, str(tmp_path / "none")).count() == 0
