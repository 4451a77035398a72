"""Streams over several files, in several batches, also after a lost commit."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlight import schemas
from wardlight.operators import alerts as A
from wardlight.operators import metrics as M
from wardlight.operators import requests, triage
from wardlight.plans.fixtures import fixture
from wardlight.sources import readers
from wardlight.sources.sinks import read_batches, read_incidents
from wardlight.streaming import intake, signals

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def files(df, path, order, n):
    """The rows as n parquet files, in time order."""
    ranked = df.withColumn("_n", F.ntile(n).over(Window.orderBy(order)))
    for i in range(1, n + 1):
        ranked.filter(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def forget_last_commit(marks):
    """As if the driver was lost after the last batch's work and before its commit."""
    last = max(int(p.name) for p in (marks / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (marks / "commits" / name).unlink(missing_ok=True)


def test_ingest_stores_each_request_once(spark, tmp_path):
    raw, stored, marks = tmp_path / "raw", tmp_path / "stored", tmp_path / "marks"
    raw.mkdir()
    rng = random.Random(1)
    for i in range(5):
        lines = [f'{{"service_request_id":"{rng.randrange(40)}","service_name":"n"}}' for _ in range(30)]
        (raw / f"{i}.json").write_text("\n".join(lines + ['{"service_name":"no id"}']))
    seen = {r[0] for r in readers.read_requests(spark, str(raw)).select("service_request_id").collect()} - {None}

    def run():
        source = spark.readStream.schema(schemas.RAW_REQUEST).option("maxFilesPerTrigger", 1).json(str(raw))
        intake.stream_ingest(source, str(stored), str(marks)).awaitTermination()
        return sorted(r["incident_id"] for r in read_batches(spark, str(stored), schemas.REQUEST).collect())

    assert run() == sorted(seen)
    forget_last_commit(marks)
    assert run() == sorted(seen)
    (raw / "new.json").write_text('{"service_request_id":"999"}\n{"service_request_id":"1"}')
    assert run() == sorted(seen | {"999"})


def test_triage_stream_equals_batch(spark, tmp_path):
    raw, marks, history, bad = (tmp_path / n for n in ("raw", "marks", "history", "bad"))
    joined = requests.normalize_request(fixture(spark, SF_DIR, "requests")).join(
        fixture(spark, SF_DIR, "answers"), "incident_id")
    files(joined, raw, "incident_id", 4)

    def run():
        intake.stream_triage(stream(spark, raw, joined.schema), None, str(history), str(marks),
                             as_of="2024-01-01", rejects=str(bad)).awaitTermination()
        return rows(read_incidents(spark, str(history)))

    want = rows(triage.triage(joined, as_of="2024-01-01"))
    assert run() == want
    forget_last_commit(marks)
    assert run() == want
    refused = spark.read.parquet(str(bad)).count()
    assert refused + len(want) == joined.count() and refused > 0


def test_an_answer_that_comes_later_is_used(spark, tmp_path):
    """Answers come a batch after their requests; a repeated batch changes nothing."""
    schema = "incident_id string, description string, address string, image_url string"
    answer = '{"severity": "LOW", "confidence": 0.9, "reasoning": "r"}'
    raw, replies, marks = (tmp_path / n for n in ("raw", "replies", "marks"))

    def request(name):
        spark.createDataFrame([(name, "lamp out", "", None)], schema).write.mode("append").parquet(str(raw))

    def reply(name):
        spark.createDataFrame([(name, answer)], "incident_id string, response string").write.mode("append").parquet(str(replies))

    def run():
        intake.stream_triage(
            stream(spark, raw, spark.createDataFrame([], schema).schema), lambda: spark.read.parquet(str(replies)),
            str(tmp_path / "history"), str(marks), as_of="2024-01-01", pending=str(tmp_path / "pending")).awaitTermination()
        return sorted(r["incident_id"] for r in read_incidents(spark, str(tmp_path / "history")).collect())

    request("a"), request("b"), reply("b")
    assert run() == ["b"]
    reply("a"), request("c")
    assert run() == ["a", "b"]
    forget_last_commit(marks)
    assert run() == ["a", "b"]
    reply("c"), request("d")
    assert run() == ["a", "b", "c"]


def test_rates_from_a_stream_equal_batch(spark, tmp_path):
    calls = fixture(spark, SF_DIR, "calls")
    files(calls, tmp_path / "calls", "ts", 4)
    signals.stream_slices(
        stream(spark, tmp_path / "calls", calls.schema), ["instance"], 3600, {"events": F.count(F.lit(1))},
        str(tmp_path / "slices"), str(tmp_path / "marks")).awaitTermination()
    schema = M.slices(calls, ["instance"], 3600, events=F.count(F.lit(1))).schema
    got = signals.read_slices(spark, str(tmp_path / "slices"), ["instance"], schema)
    want = M.slices(calls, ["instance"], 3600, events=F.count(F.lit(1)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("n_files", [1, 6])
def test_alerts_from_a_stream_equal_batch(spark, tmp_path, n_files):
    calls = fixture(spark, SF_DIR, "calls")
    files(calls, tmp_path / "calls", "ts", n_files)
    root, marks = tmp_path / "alerts", tmp_path / "marks"
    sums = {"total": F.count(F.lit(1)), "bad": F.count_if(F.col("status") >= 500)}

    def run():
        signals.stream_alerts(
            stream(spark, tmp_path / "calls", calls.schema), ["instance"], sums,
            lambda r: F.try_divide(r["bad"], r["total"]) > 0.2, str(root), str(marks),
            step=3600, window="6 hours", hold="2h").awaitTermination()
        return rows(signals.read_alerts(spark, str(root), [calls.schema["instance"]]))

    got = run()
    final = read_batches(spark, f"{root}/slices", M.slices(calls, ["instance"], 3600, **sums).schema).drop("batch_id")
    summed = M.rolling(final, ["instance"], 3600, "6 hours", ["total", "bad"])
    judged = A.judged(summed, F.try_divide(F.col("bad"), F.col("total")), lambda v: v > 0.2)
    want = rows(A.sustained(judged, "2h", ["instance"], 3600).drop("value"))
    assert got == want and len(want) > 5
    forget_last_commit(marks)
    assert run() == want


def test_metric_stream_is_readable(spark, tmp_path):
    df = spark.createDataFrame([(None, "n", {"a": "b"}, 1.0)], schemas.METRIC)
    df.write.parquet(str(tmp_path / "m"))
    assert readers.read_metrics(spark, str(tmp_path / "m")).first()["labels"] == {"a": "b"}
    assert readers.read_metrics(spark, str(tmp_path / "m"), stream=True).isStreaming


def gauge_rows(spark, seed=2, n=900):
    """Samples of three series that go up and down, pause, and stop."""
    rng = random.Random(seed)
    found = []
    for s in ("a", "b", "c"):
        t, v = 0, 0.7
        for _ in range(n // 3):
            t += rng.choice([5, 15, 15, 30, 400 if s == "b" else 20])
            v = min(1.0, max(0.0, v + rng.choice([-0.1, 0.1, 0.0])))
            found.append((s, t, round(v, 3)))
            if s == "c" and t > 2000:
                break
    return spark.createDataFrame(found, "series string, s long, value double").select(
        "series", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("ts"), "value")


@pytest.mark.parametrize("n_files", [1, 7])
def test_gauge_alerts_from_a_stream_equal_batch(spark, tmp_path, n_files):
    samples = gauge_rows(spark)
    files(samples, tmp_path / "samples", "ts", n_files)
    root, marks = tmp_path / "alerts", tmp_path / "marks"

    def run():
        signals.stream_gauge_alerts(
            stream(spark, tmp_path / "samples", samples.schema), ["series"], lambda v: v < 0.6, str(root), str(marks),
            step=15, lookback="2 minutes", hold="1m", delay="1 minute").awaitTermination()
        return rows(signals.read_alerts(spark, str(root), [samples.schema["series"]]))

    got = run()
    final = read_batches(spark, f"{root}/slices", M.slices(samples, ["series"], 15, value=F.max("value")).schema).drop("batch_id")
    # what has left the stream is what the batch form sees
    whole = M.slices(samples, ["series"], 15, value=F.max_by("value", F.struct("ts", "value")))
    assert rows(final) == rows(whole.join(final.agg(F.max("tick").alias("_e")), F.col("tick") <= F.col("_e")).drop("_e"))
    ticks = M.dense(final, ["series"], 15, "2 minutes")
    want = rows(A.sustained(A.judged(ticks, F.col("value"), lambda v: v < 0.6), "1m", ["series"], 15).drop("value"))
    assert got == want and len(want) > 5
    forget_last_commit(marks)
    assert run() == want


def test_state_holds_a_window_and_no_more(spark, tmp_path):
    calls = fixture(spark, SF_DIR, "calls")
    files(calls, tmp_path / "calls", "ts", 5)
    root = tmp_path / "alerts"
    signals.stream_alerts(
        stream(spark, tmp_path / "calls", calls.schema), ["instance"], {"total": F.count(F.lit(1))}, lambda r: r["total"] > 3,
        str(root), str(tmp_path / "marks"), step=3600, window="6 hours", hold="2h").awaitTermination()
    kept = spark.read.parquet(f"{root}/state")
    assert kept.agg(F.max(F.size("recent"))).first()[0] <= 6 and kept.count() > 0


@pytest.mark.parametrize("n_files", [1, 8])
def test_increase_from_a_stream_equals_batch(spark, tmp_path, n_files):
    """Counters that start over within a slice, between slices and between batches; some samples come out of order."""
    rng = random.Random(9)
    found = []
    for s in ("a", "b"):
        v = 0
        for t in range(0, 6000, 5):
            v = 0 if rng.random() < 0.02 else v + rng.randrange(4)
            if rng.random() < 0.9:
                found.append((s, t, float(v)))
    samples = spark.createDataFrame(found, "series string, s long, value double").select(
        "series", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("ts"), "value", "s")
    # neighbours change files, at most as late as the watermark allows
    shuffled = samples.withColumn("_at", F.col("s") + F.hash("s", "series") % 60)
    files(shuffled, tmp_path / "samples", "_at", n_files)
    path, marks = tmp_path / "grown", tmp_path / "marks"

    def run():
        source = stream(spark, tmp_path / "samples", shuffled.schema)
        signals.stream_increase(source, ["series"], str(path), str(marks), step=15, delay="5 minutes").awaitTermination()
        return signals.read_increase(spark, str(path), [samples.schema["series"]], "2 minutes", 15)

    got = run()
    last = read_batches(spark, f"{path}/slices", M.counter_slices(samples, ["series"], 15).schema).agg(F.max("tick")).first()[0]
    grown = M.counter_slices(samples, ["series"], 15).filter(F.col("tick") <= last)
    want = rows(M.rolling(grown, ["series"], 15, "2 minutes", ["growth"]).withColumnRenamed("growth", "increase"))
    assert rows(got) == want and len(want) > 600
    forget_last_commit(marks)
    assert rows(run()) == want
