"""Streaming jobs over the given tables; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.operators import alerts as A
from wardlight.operators import metrics as M
from wardlight.operators import requests, reviews
from wardlight.plans import metric_plans as MP
from wardlight.plans import triage_plans as TP
from wardlight.plans.base import AS_OF, Data, Plan
from wardlight.plans.fixtures import streaming_fixture
from wardlight import schemas
from wardlight.session import work_folder
from wardlight.sources.sinks import compact_history, read_batches, read_incidents, write_batch
from wardlight.streaming import intake, signals


def _stream(d: Data, name: str):
    return streaming_fixture(d.spark, d.sf_dir, name)


def _ingested(d: Data):
    stored, marks = work_folder(d.spark, "requests"), work_folder(d.spark, "marks")
    intake.stream_ingest(_stream(d, "requests"), stored, marks).awaitTermination()
    return read_batches(d.spark, stored, schemas.REQUEST).drop("batch_id")


def _triaged(d: Data):
    history, marks = work_folder(d.spark, "history"), work_folder(d.spark, "marks")
    shaped = requests.normalize_request(_stream(d, "requests"))
    intake.stream_triage(shaped, d.answers, history, marks, as_of=AS_OF).awaitTermination()
    return TP._as_text(read_incidents(d.spark, history), "zip_code").select(*TP._TRIAGE_COLUMNS)


def _answered(d: Data):
    """What became of every request whose answer comes on a stream of its own: its severity, or why it is a reject."""
    history, rejects, marks = (work_folder(d.spark, n) for n in ("history", "rejects", "marks"))
    intake.stream_answers(
        _stream(d, "asked"), _stream(d, "replies"), history, marks, rejects, wait="1 hour", delay=signals.DELAY, as_of=AS_OF
    ).awaitTermination()
    refused = d.spark.read.schema("incident_id string, parse_status string").parquet(rejects)
    return read_incidents(d.spark, history).select("incident_id", F.col("severity").alias("outcome")).unionByName(
        refused.select("incident_id", F.col("parse_status").alias("outcome")))


# a request without answer is given up once the slower of both streams is an hour and ten minutes beyond it
_ANSWERED = f"""WITH {TP._PARSED},
told AS (SELECT a.incident_id, a.description FROM fx_asked a JOIN fx_replies r ON r.incident_id = a.incident_id
  AND r.answered_at BETWEEN a.asked_at - INTERVAL 1 HOUR AND a.asked_at + INTERVAL 1 HOUR),
mark AS (SELECT least((SELECT max(asked_at) FROM fx_asked), (SELECT max(answered_at) FROM fx_replies)) - INTERVAL 70 MINUTE AS at)
SELECT t.incident_id, CASE WHEN {TP._HIT} THEN 'CRITICAL' ELSE ai_severity END AS outcome FROM told t JOIN read r ON r.incident_id = t.incident_id
UNION ALL SELECT t.incident_id, parse_status FROM told t JOIN judged j ON j.incident_id = t.incident_id WHERE parse_status <> 'ok'
UNION ALL SELECT a.incident_id, 'unanswered' FROM fx_asked a, mark
  WHERE a.asked_at <= mark.at AND a.incident_id NOT IN (SELECT incident_id FROM told)"""


def _reviewed(d: Data):
    folds, marks = work_folder(d.spark, "folds"), work_folder(d.spark, "marks")
    intake.stream_reviews(_stream(d, "reviews"), folds, marks).awaitTermination()
    return reviews.apply_fold(d.incidents, intake.read_reviews(d.spark, folds)).select(
        "incident_id", "severity", "human_reviewed", "needs_review", "reviewer_notes", "reviewed_by", "reviewed_at")


def _snapshot(d: Data):
    """A history of three batches, of which two are folded into a committed snapshot before the third comes."""
    history = work_folder(d.spark, "history")
    rows = TP._history(d).select(*schemas.INCIDENT.fieldNames(), "batch_id")
    for n in (0, 1, 2):
        write_batch(rows.filter(F.col("batch_id") == n).drop("batch_id"), history, n)
        if n:
            compact_history(d.spark, history, through=n - 1)
    return read_incidents(d.spark, history).select("incident_id", "severity", "created_at", "human_reviewed")


_SLICE = T.StructType([
    T.StructField("instance", T.LongType()), T.StructField("tick", T.LongType()),
    T.StructField("events", T.LongType()),
])


def _rates(d: Data):
    path, marks = work_folder(d.spark, "slices"), work_folder(d.spark, "marks")
    signals.stream_slices(
        _stream(d, "calls"), ["instance"], MP.HOUR, {"events": F.count(F.lit(1))}, path, marks
    ).awaitTermination()
    counted = signals.read_slices(d.spark, path, ["instance"], _SLICE)
    rolled = M.rolling(counted, ["instance"], MP.HOUR, MP._SIX, ["events"])
    return rolled.withColumn("rate", F.round(F.col("events") / F.lit(float(MP._SIX)), 6))


def _running_entropy(d: Data):
    path, marks = work_folder(d.spark, "totals"), work_folder(d.spark, "marks")
    signals.stream_totals(_stream(d, "incidents"), M.severity_distribution, path, marks).awaitTermination()
    totals = signals.read_totals(d.spark, path, ["severity"], T.StructType([
        T.StructField("severity", T.StringType()), T.StructField("incidents", T.LongType())]))
    return MP._rounded(M.entropy_of(totals), "entropy")


def _running_histogram(d: Data):
    path, marks = work_folder(d.spark, "totals"), work_folder(d.spark, "marks")
    signals.stream_totals(_stream(d, "calls"), M.latency_histogram, path, marks).awaitTermination()
    return signals.read_totals(d.spark, path, ["le"], T.StructType([
        T.StructField("le", T.StringType()), T.StructField("cumulative", T.LongType())]))


def _running_confidence(d: Data):
    path, marks = work_folder(d.spark, "latest"), work_folder(d.spark, "marks")
    signals.stream_totals(_stream(d, "calls"), M.latest_rows, path, marks).awaitTermination()
    return M.latest_confidence(read_batches(d.spark, path, T.StructType([
        T.StructField("severity", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("confidence", T.DoubleType())])))


def _alerted(d: Data) -> tuple[str, list[T.StructField]]:
    """Run the error-share alert over the calls; its folder and series fields."""
    root, marks = work_folder(d.spark, "alerts"), work_folder(d.spark, "marks")
    calls = _stream(d, "calls")
    sums = {"total": F.count(F.lit(1)), "bad": F.count_if(F.col("status") >= 500)}
    signals.stream_alerts(
        calls, ["instance"], sums, lambda r: F.try_divide(r["bad"], r["total"]) > 0.2, root, marks,
        step=MP.HOUR, window=MP._SIX, hold="2h",
    ).awaitTermination()
    return root, [calls.schema["instance"]]


def _alerts(d: Data):
    return signals.read_alerts(d.spark, *_alerted(d))


# a slice counts once the watermark, ten minutes behind the last event, has passed it
_PASSED = f"WHERE ({MP.tick_sql()}) * 1000000 <= (SELECT max(epoch_us(ts)) - 600000001 FROM fx_calls)"
_FINAL_ALERTS = f"""WITH {MP.shares_sql('instance', _PASSED)},
{MP.runs_sql('shares', 'share', 'value > 0.2::DOUBLE', MP._HOLD)}
SELECT k AS instance, {MP.span_sql(MP._HOLD)} FROM runs"""


_HELD = {"step": MP.HOUR, "hold": "2h"}


def _gauge_alerts(samples, by: list[str], limit, col: str = "value"):
    """Run an alert over the last values of a stream; by ``by`` the series."""
    spark = samples.sparkSession
    root, marks = work_folder(spark, "alerts"), work_folder(spark, "marks")
    signals.stream_gauge_alerts(samples, by, limit, root, marks, col=col, lookback="1 day", **_HELD).awaitTermination()
    return signals.read_alerts(spark, root, [samples.schema[n] for n in by])


def _low_confidence(d: Data):
    calls = _stream(d, "calls").withColumn("label", F.col("severity"))
    return _gauge_alerts(calls, ["instance", "label"], lambda v: v < 0.8, "confidence")


def _high_memory(d: Data):
    return _gauge_alerts(A.samples_of(_stream(d, "metrics"), A.MEMORY_BYTES), ["series"], lambda v: v > 430_000_000)


def _increases(d: Data):
    path, marks = work_folder(d.spark, "grown"), work_folder(d.spark, "marks")
    samples = A.samples_of(_stream(d, "metrics"), A.RESTARTS)
    signals.stream_increase(samples, ["series"], path, marks, step=MP.HOUR).awaitTermination()
    rows = signals.read_increase(d.spark, path, [samples.schema["series"]], MP._SIX, MP.HOUR)
    return MP._rounded(rows, "increase")


def _passed(name: str) -> str:
    """The rows of a table whose slice the watermark has passed, as a table ``done``."""
    return f"done AS (SELECT * FROM {name} WHERE ({MP.tick_sql()}) * 1000000 <= (SELECT max(epoch_us(ts)) - 600000001 FROM {name}))"


_FINAL_CONFIDENCE = f"""WITH {_passed('fx_calls')}, {MP.gauge_sql('done', "instance || '/' || severity", 'confidence', MP.HOUR, 24 * MP.HOUR)},
{MP.runs_sql('rolled', 'v', 'value < 0.8::DOUBLE', MP._HOLD)}
SELECT CAST(split_part(k, '/', 1) AS BIGINT) AS instance, split_part(k, '/', 2) AS label, {MP.span_sql(MP._HOLD)} FROM runs"""
_FINAL_MEMORY = f"""WITH {MP._named('process_resident_memory_bytes')}, {_passed('samples')},
{MP.gauge_sql('done', 'series', 'value', MP.HOUR, 24 * MP.HOUR)},
{MP.runs_sql('rolled', 'v', 'value > 430000000', MP._HOLD)} SELECT k AS series, {MP.span_sql(MP._HOLD)} FROM runs"""
_FINAL_INCREASE = f"""WITH {MP._named('kube_pod_container_status_restarts_total')}, {_passed('samples')},
{MP.counter_sql('done', 'series')}, {MP.rolling_sql('grown', 'series', ['growth'], MP.HOUR, MP._SIX)}
SELECT k AS series, tick, growth AS increase FROM rolled"""


def _sql(name: str) -> str:
    plans = {p.name: p.sql for p in (*MP.PLANS, *TP.PLANS)}
    return plans[name]


PLANS = [
    Plan("stream_ingest", _ingested, _sql("normalize_request")),
    Plan("stream_triage", _triaged, _sql("triage")),
    Plan("stream_answers", _answered, _ANSWERED),
    Plan("stream_reviews", _reviewed, _sql("apply_reviews")),
    Plan("read_incidents", _snapshot, _sql("fold_history")),
    Plan("stream_rate", _rates, _sql("event_rate")),
    Plan("stream_severity_entropy", _running_entropy, _sql("severity_entropy")),
    Plan("stream_latency_histogram", _running_histogram, _sql("latency_histogram")),
    Plan("stream_latest_confidence", _running_confidence, _sql("latest_confidence")),
    Plan("stream_alerts", _alerts, _FINAL_ALERTS),
    Plan("stream_low_confidence_alerts", _low_confidence, _FINAL_CONFIDENCE),
    Plan("stream_high_memory_alerts", _high_memory, _FINAL_MEMORY),
    Plan("stream_increase", _increases, _FINAL_INCREASE),
]
