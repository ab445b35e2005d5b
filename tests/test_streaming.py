"""A stream that is replayed gives what the batch gives."""

import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import telemetry
from lodestrata.plans import adapters as A
from lodestrata.streaming import activity, channel, session


def replay(spark, df, name, mode, path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    calls, batch = activity.call_stream(spark, str(tmp_path / "in")), A.event_calls(spark, sf)
    got = {tuple(r) for r in replay(spark, activity.running_average(calls), "s_avg", "complete", tmp_path / "c1").collect()}
    assert got == {tuple(r) for r in telemetry.tool_breakdown(batch).collect()}
    got = {(r.minute, r.n_calls) for r in replay(spark, activity.per_minute(calls), "s_min", "complete", tmp_path / "c2").collect()}
    assert got == {(r.minute, r.n_calls) for r in telemetry.activity_per_minute(batch).select(F.col("minute").cast("timestamp").alias("minute"), "n_calls").collect()}
    gaps = replay(spark, activity.idle_gaps(calls), "s_gap", "append", tmp_path / "c3")
    # Gaps between calls, and those that the watermark has passed after the last call of a tool.
    between = {(r.tool_name, r.ts) for r in telemetry.idle_gaps(batch, key="tool_name").join(batch.select("ord", F.col("ts").cast("timestamp").alias("ts")), "ord").collect()}
    ends = batch.groupBy("tool_name").agg(F.max("ts").cast("timestamp").alias("ts")).collect()
    passed = max(r.ts for r in ends).timestamp() - 60
    last = {(r.tool_name, r.ts) for r in ends if r.ts.timestamp() + 45 <= passed}
    got = [(r.tool_name, r.ts) for r in gaps.collect()]
    assert set(got) == between | last and len(got) == len(set(got))


def test_a_gap_is_told_without_another_call(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, "a", 0), (2, "b", 10), (3, "b", 30), (4, "b", 400)]
    made = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), 1, t, 1.0, "") for i, t, s in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    made["ts"] = made["ts"].astype("datetime64[us]")
    made.to_parquet(tmp_path / "in" / "e.parquet")
    gaps = replay(spark, activity.idle_gaps(activity.call_stream(spark, str(tmp_path / "in"))), "s_told", "append", tmp_path / "c")
    assert sorted((r.tool_name, r.ts.second) for r in gaps.collect()) == [("a", 0), ("b", 30)]


def test_activity_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("W|COMPLETED|grep|12ms\nW|INDEXED|x\nW|ERROR|grep|bad\n")
    rows = replay(spark, activity.activity_stream(spark, str(tmp_path / "in")), "s_act", "append", tmp_path / "c")
    assert sorted((r.type, r.details) for r in rows.collect()) == [("COMPLETED", "12ms"), ("ERROR", "bad")]
    assert isinstance(rows.toPandas(), pd.DataFrame)


def test_lines_of_a_channel_once_each_after_a_restart(spark, tmp_path):
    log, checkpoint = tmp_path / "log", tmp_path / "c"

    def run():
        rows = channel.activity_channel(spark, str(log), range="23")  # many ranges, lines across them
        running = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(checkpoint)).start()
        running.processAllAvailable()
        running.stop()

    run()  # no file
    messages = [f"W|COMPLETED|tool{i % 3}|{i}ms" if i % 4 else f"W|ERROR|tool{i % 3}|é {'x' * i}" for i in range(60)]
    log.write_text("".join(m + "\n" for m in messages[:40]) + messages[40][:7])  # the last line is not complete
    run()
    with log.open("a") as f:
        f.write(messages[40][7:] + "\r\n" + "no message\n\n" + "".join(m + "\n" for m in messages[41:]))
    run()
    run()  # nothing new
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()
    batch = telemetry.parse_activity(spark.createDataFrame([(m,) for m in messages], "value string")).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r) for r in batch] and len({r.ord for r in got}) == 60
    reader = channel.LineReader(str(log), 50)
    parts = reader.partitions({"bytes": 0}, reader.latestOffset())
    assert len(parts) > 10 and [x for p in parts for x in reader.read(p)] == [x for p in parts for x in reader.read(p)]  # a batch again, the same lines
    log.write_text("short\n")
    with pytest.raises(ValueError):
        reader.partitions({"bytes": 100}, reader.latestOffset())


def test_sessions_with_resets_in_mid_stream(spark, tmp_path):
    import random

    rng = random.Random(2)
    calls = [(rng.choice("AB"), i, "RESET" if i in (37, 38, 71) else "COMPLETED", f"t{rng.randrange(3)}", float(rng.randrange(50))) for i in range(120)]
    calls += [("C", 200, "COMPLETED", "t0", 5.0), ("C", 201, "RESET", "", None)]
    columns = "session string, ord long, type string, tool_name string, duration_ms double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = session.session_statistics(stream, entries=10, forget_ms=None)
    told = []

    def keep(rows, batch):
        told.append([tuple(r) for r in rows.collect()])

    def run():
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)

    for k in range(0, len(calls), 41):
        spark.createDataFrame(calls[k : k + 41], columns).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run()  # a restart each time
    last = {}
    for batch in told:
        last |= {s: [r for r in batch if r[0] == s] for s in {r[0] for r in batch}}
    for name in "ABC":
        mine = [c for c in calls if c[0] == name]
        begin = max((i for i, c in enumerate(mine) if c[2] == "RESET"), default=-1) + 1
        mine = mine[begin:]
        entries = [c[1] for c in mine][-10:]
        want = [(name, t, len(ms), sum(ms) / len(ms), entries) for t in sorted({c[3] for c in mine}) for ms in [[c[4] for c in mine if c[3] == t]]] or [(name, None, 0, None, [])]
        got = [(s, t if isinstance(t, str) else None, n, None if not n else a, list(e)) for s, t, n, a, e in last[name]]
        assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and all(a[3] == b[3] or abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert all(len(r[4]) <= 10 for batch in told for r in batch)  # state is bounded


def test_silent_sessions_are_forgotten(spark, tmp_path):
    columns = "session string, ord long, type string, tool_name string, duration_ms double"
    (tmp_path / "in").mkdir()
    put = lambda i: spark.createDataFrame([("A", i, "COMPLETED", "t", 1.0)], columns).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    told = []
    out = session.session_statistics(spark.readStream.schema(columns).json(str(tmp_path / "in")), forget_ms=2_000)
    running = out.writeStream.outputMode("update").foreachBatch(lambda rows, _: told.extend((r.n_calls, r.entries) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for i in (1, 2):
            put(i)
            end = time.time() + 60
            while len(told) < i and time.time() < end:
                time.sleep(0.5)
            time.sleep(4)
    finally:
        running.stop()
    assert told == [(1, [1]), (1, [2])]
