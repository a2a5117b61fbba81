"""The stream's closed days against the batch answer."""

import datetime as dt

from catchwater.streaming.live import live_alerts


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(p, 1, start + dt.timedelta(hours=h), float((h * 7 + p) % 13)) for p in (1, 2) for h in range(0, 24 * 5, 3)]
    readings = spark.createDataFrame(rows, "point_id long, area_id long, ts timestamp, mm double")
    readings.repartition(3).write.parquet(str(tmp_path / "in"))
    counts = spark.createDataFrame([(1, 1, 92, 40)], "area_id long, sink_id int, cn int, n long")
    ponds = spark.createDataFrame([(1, 1, 900.0)], "area_id long, sink_id int, volume_m3 double")
    stream = spark.readStream.schema(readings.schema).parquet(str(tmp_path / "in"))
    q = live_alerts(stream, counts, ponds).writeStream.format("memory").queryName("live_days").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("live_days").collect()}
    days = live_alerts(readings, counts, ponds).collect()
    last = max(r[2] for r in rows) - dt.timedelta(hours=1)  # the watermark
    closed = {tuple(r) for r in days if r.day + dt.timedelta(days=1) <= last}
    assert len(days) == 5 and len(closed) == 4 and got == closed


def test_late_readings_are_dropped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "point_id long, area_id long, ts timestamp, mm double"
    say = lambda rows: spark.createDataFrame([(1, 1, start + dt.timedelta(hours=h), mm) for h, mm in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = spark.createDataFrame([(1, 1, 92, 40)], "area_id long, sink_id int, cn int, n long")
    ponds = spark.createDataFrame([(1, 1, 900.0)], "area_id long, sink_id int, volume_m3 double")
    (tmp_path / "in").mkdir()
    for rows in ([(1, 5.0), (30, 7.0)], [(2, 100.0), (31, 1.0)], [(24 * 5, 0.0)], [(24 * 6, 0.0)]):  # hour 2 comes when hour 30 has closed its day
        say(rows)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = live_alerts(stream, counts, ponds).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {r.day: r.rain_mm for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[start] == 5.0 and got[start + dt.timedelta(days=1)] == 8.0
