"""Timers, late events and sinks of the streaming jobs, in several batches."""

import datetime
import time


from haggleframe.streaming import sightings, sinks

HOUR = 3_600_000
START = datetime.datetime(2024, 5, 1)


def stream_of(spark, path, batches):
    """One file, so one batch, for each list of (signature, hours, price)."""
    for rows in batches:
        data = [(k, START + datetime.timedelta(hours=h), p) for k, h, p in rows]
        spark.createDataFrame(data, "signature long, at timestamp, price_cents long").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema("signature long, at timestamp, price_cents long").option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, path, write=None):
    q = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write or sinks.batch_table(f"{path}/out")).start()
    q.awaitTermination()
    return q


def hours(rows):
    zero = int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    return sorted((r.signature, (r.at_ms - zero) / HOUR) for r in rows)


BATCHES = [[(1, 0, 5), (1, 0.5, 5), (2, 0, 9)], [(3, 10, 1)], [(1, 1, 7), (4, 9.5, 1), (3, 9.9, 2)], [(5, 60, 1)], [(1, 61, 5)]]


def test_suppression_state_leaves(spark, tmp_path):
    q = run(spark, sightings.suppressed(stream_of(spark, str(tmp_path / "in"), BATCHES), 6 * HOUR), str(tmp_path))
    got = hours(sinks.read_batches(spark, f"{tmp_path}/out", "signature long, at_ms long").collect())
    # signature 1 at one o'clock comes when the watermark is at nine: late, dropped; 4 is behind 3 but not behind the watermark
    assert got == [(1, 0), (1, 61), (2, 0), (3, 10), (4, 9.5), (5, 60)]
    left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(left) >= 3 and left[-1] == 2, left  # of what is sixty hours back nothing is left


def test_price_changes_across_batches(spark, tmp_path):
    batches = [[(1, 0, 5), (1, 0.2, 5), (1, 0.1, 6)], [(1, 0.5, 5), (2, 0.5, 1)], [(1, 0.6, 8), (1, 0.4, 3)], [(3, 200, 1)], [(1, 200.5, 8)]]
    run(spark, sightings.price_changes(stream_of(spark, str(tmp_path / "in"), batches), remembered_ms=24 * HOUR), str(tmp_path))
    rows = sinks.read_batches(spark, f"{tmp_path}/out", "signature long, at_ms long, price_cents long").collect()
    assert [(s, h) for s, h in hours(rows) if s == 1] == [(1, 0), (1, 0.1), (1, 0.2), (1, 0.6), (1, 200.5)], "the same price after 24 hours is a first sight again"
    assert sorted(r.price_cents for r in rows if r.signature == 1) == [5, 5, 6, 8, 8]


def test_replayed_batch_writes_nothing_twice(spark, tmp_path):
    write = sinks.batch_table(str(tmp_path / "t"))
    a, b = (spark.createDataFrame([(i,)], "x long") for i in (1, 2))
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert sorted((r.x, r.batch) for r in sinks.read_batches(spark, str(tmp_path / "t"), "x long").collect()) == [(1, 0), (2, 1)]


def test_alerts_are_throttled_and_repeatable(spark, tmp_path):
    schema = "k string, at long, what string"
    path = str(tmp_path / "alerts")
    write = sinks.alerts(path, "k", "at", schema, 100)
    batches = [[("a", 5, "x"), ("a", 6, "y"), ("b", 7, "x"), (None, 1, "null")], [("a", 50, "soon"), ("c", 51, "x")], [("a", 105, "again"), ("b", 106, "soon")], []]
    for i, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), i)
    want = [("a", 5, "x"), ("a", 105, "again"), ("b", 7, "x"), ("c", 51, "x")]
    read = lambda: sorted((r.k, r.at, r.what) for r in sinks.read_batches(spark, path, schema).collect())
    assert read() == want
    write(spark.createDataFrame(batches[1], schema), 1)
    write(spark.createDataFrame(batches[2], schema), 2)
    assert read() == want


def test_diagnostics(spark, tmp_path):
    d = sinks.Diagnostics(spark, str(tmp_path / "d"))
    d.put([("lane", 1, "busy"), ("other", 7, "")], at_ms=10)
    d.put([("lane", 0, "idle")], at_ms=20)
    assert {r.name: (r.value, r.text) for r in d.latest().collect()} == {"lane": (0, "idle"), "other": (7, "")}


def test_listener_reports(spark, tmp_path):
    listener = sinks.ProgressListener(sinks.Diagnostics(spark, str(tmp_path / "d")), "watched")
    spark.streams.addListener(listener)
    try:
        stream = sightings.suppressed(stream_of(spark, str(tmp_path / "in"), BATCHES), 6 * HOUR)
        stream.writeStream.queryName("watched").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).foreachBatch(lambda df, i: df.count()).start().awaitTermination()
        listener.flush()
    finally:
        spark.streams.removeListener(listener)
    got = {r.name: r.value for r in listener.diagnostics.latest().collect()}
    assert got == {"watched:rows": 9, "watched:batches": 5, "watched:state": 2}
