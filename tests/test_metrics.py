"""Rates, quantiles, alert lifecycle and messages on hand-made rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlight.operators import alerts as A
from wardlight.operators import metrics as M

T0 = datetime(2024, 1, 1)
EPOCH = datetime(1970, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def tick(moment, step):
    return math.ceil((moment - EPOCH) / timedelta(seconds=step)) * step


def calls(spark, rows):
    """(second, instance, duration, status, confidence, severity)."""
    return spark.createDataFrame(
        [(at(s), i, d, 100, 20, st, c, sev) for s, i, d, st, c, sev in rows],
        "ts timestamp_ntz, instance long, duration_s double, prompt_tokens long, completion_tokens long, "
        "status int, confidence double, severity string")


def samples(spark, rows, name, label):
    return spark.createDataFrame(
        [(at(s), name, {label: who}, float(v)) for s, who, v in rows],
        "ts timestamp_ntz, name string, labels map<string,string>, value double")


def test_entropy(spark):
    rows = spark.createDataFrame([("LOW",)] * 3 + [("HIGH",)] + [("UNKNOWN",)] * 9 + [(None,)], "ai_severity string")
    got = M.severity_entropy(rows).first()
    assert got["incidents"] == 4
    assert got["entropy"] == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    assert tuple(M.severity_entropy(rows.filter("ai_severity = 'UNKNOWN'")).first()) == (0, None)


def quantile_by_hand(values, bounds, q):
    cum = [sum(v <= b for v in values) for b in bounds] + [len(values)]
    if not values:
        return None
    rank = q * len(values)
    i = next(n for n, c in enumerate(cum) if c >= rank)
    if i == len(bounds):
        return bounds[-1]
    low, under = (bounds[i - 1], cum[i - 1]) if i else (0.0, 0)
    return low + (bounds[i] - low) * (rank - under) / (cum[i] - under)


@pytest.mark.parametrize("values", [[0.001], [0.3] * 5 + [4.0], [99.0], [0.02, 0.03, 7.0, 9.9, 11.0], list(range(20))])
def test_quantile_forms_agree(spark, values):
    df = calls(spark, [(i, 0, float(v), 200, 0.9, "LOW") for i, v in enumerate(values)])
    want = quantile_by_hand([float(v) for v in values], M.BOUNDS, 0.95)
    assert M.latency_quantile(df).first()["quantile"] == pytest.approx(want)
    assert M.histogram_quantile(M.latency_histogram(df)).first()["quantile"] == pytest.approx(want)


def test_quantile_of_nothing(spark):
    df = calls(spark, [])
    assert M.latency_quantile(df).first()["quantile"] is None
    assert M.histogram_quantile(M.latency_histogram(df)).first()["quantile"] is None


def test_increase_with_resets_equals_a_walk_over_the_samples(spark):
    rng = random.Random(2)
    rows, value = [], {"a": 0, "b": 0}
    for s in range(0, 1200, 4):
        for who in "ab":
            value[who] = 0 if rng.random() < 0.03 else value[who] + rng.randrange(4)
            rows.append((s + rng.random(), who, value[who]))
    df = samples(spark, rows, "n", "pod")
    got = {(r["pod"], r["tick"]): r["increase"] for r in
           M.increase(A.samples_of(df, "n", "pod"), "2 minutes", 15, ["pod"]).collect()}
    for who in "ab":
        mine = sorted((at(s), v) for s, w, v in rows if w == who)
        grown = {}
        for (_, before), (moment, now) in zip(mine, mine[1:]):
            t = tick(moment, 15)
            grown[t] = grown.get(t, 0) + (now - before if now >= before else now)
        ticks = range(tick(mine[0][0], 15), tick(mine[-1][0], 15) + 15, 15)
        for t in ticks:
            assert got.pop((who, t)) == sum(v for k, v in grown.items() if t - 120 < k <= t)
    assert not got


def test_a_gauge_goes_stale(spark):
    df = samples(spark, [(0, "a", 1), (3, "a", 2), (600, "a", 3)], "g", "instance")
    got = {r["tick"]: r["value"] for r in M.gauge_ticks(A.samples_of(df, "g", "instance"), ["instance"], 15, "1 minute").collect()}
    start = tick(T0, 15)
    assert got == {start: 1.0, **{start + s: 2.0 for s in (15, 30, 45, 60)}, start + 600: 3.0}


def test_runs_must_be_unbroken_and_long_enough(spark):
    rng = random.Random(4)
    rows = []
    for who in ("a", "b", "c"):
        rows += [(who, t * 15, float(t), rng.random() < 0.8) for t in range(200) if rng.random() < 0.97]
    df = spark.createDataFrame(rows, "who string, tick long, value double, firing boolean")
    got = sorted((r["who"], r["since"], r["fires_at"], r["resolved_at"]) for r in A.sustained(df, "1m", ["who"], 15).collect())
    want = []
    for who in "abc":
        mine = {t: f for w, t, _, f in rows if w == who}
        start = None
        for t in range(0, 200 * 15 + 15, 15):
            if mine.get(t) and start is None:
                start = t
            elif not mine.get(t) and start is not None:
                end = t - 15
                if end - start >= 60:
                    gone = None if end == max(t for _, t, _, _ in rows) else EPOCH + timedelta(seconds=t)
                    want.append((who, EPOCH + timedelta(seconds=start), EPOCH + timedelta(seconds=start + 60), gone))
                start = None
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and want


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_every_rule_fires_at_its_own_thresholds(spark):
    span = range(0, 1200, 15)
    bad = calls(spark, [(s + 1, 1, 6.0, 500 if s % 45 == 0 else 200, 0.6, "LOW") for s in span])
    good = calls(spark, [(s + 1, 1, 0.2, 200, 0.9, "LOW") for s in span])
    for rule in (A.alert_HighLLMLatency, A.alert_LowClassificationConfidence, A.alert_HighErrorRate,
                 A.alert_SLOBreach, A.alert_LLMHighErrorRate):
        row = one(rule(bad))
        spec = A.RULES[row["alertname"]]
        assert rule.__name__ == "alert_" + spec.name and row["severity"] == spec.severity
        assert rule(good).count() == 0, rule
    assert "7.375" in one(A.alert_HighLLMLatency(bad))["description"]
    assert one(A.alert_LowClassificationConfidence(bad))["description"].endswith("Current confidence: 0.6.")
    many = calls(spark, [(s / 20, 1, 0.1, 200, 0.9, "LOW") for s in range(16000)])
    assert one(A.alert_HighTokenUsage(many))["alertname"] == "HighTokenUsage"
    assert A.alert_HighTokenUsage(good).count() == 0
    assert one(A.alert_HighTokenUsage(good, count_tokens=True, threshold=5))["value"] > 5

    cpu = samples(spark, [(s, "i", s * 0.9) for s in span], A.CPU_SECONDS, "instance")
    assert one(A.alert_HighCPUUsage(cpu))["instance"] == "i"
    idle = samples(spark, [(s, "i", s * 0.5) for s in span], A.CPU_SECONDS, "instance")
    assert A.alert_HighCPUUsage(idle).count() == 0
    memory = samples(spark, [(s, "i", 500_000_001) for s in span], A.MEMORY_BYTES, "instance")
    assert one(A.alert_HighMemoryUsage(memory))["description"] == "Memory usage above 500MB on i."
    assert A.alert_HighMemoryUsage(samples(spark, [(s, "i", 5e8) for s in span], A.MEMORY_BYTES, "instance")).count() == 0
    restarts = samples(spark, [(s, "p", s // 100) for s in span], A.RESTARTS, "pod")
    assert one(A.alert_PodCrashLooping(restarts))["description"].startswith("Pod p has restarted")


def test_groups_tell_firing_and_recent_alerts(spark):
    rows = [("A", "critical", 0, 300, "i1"), ("A", "critical", 100, None, "i2"), ("B", "warning", 50, 60, "i1"), ("Watchdog", "none", 0, None, "w")]
    df = spark.createDataFrame(
        [(n, s, at(a), at(a), None if b is None else at(b), i, "s", "d") for n, s, a, b, i in rows],
        "alertname string, severity string, since timestamp_ntz, fires_at timestamp_ntz, resolved_at timestamp_ntz, "
        "instance string, summary string, description string")
    instants = F.array(*[F.lit(at(s)) for s in (0, 60, 200, 320, 900)])
    got = sorted((r["alertname"], int((r["evaluated_at"] - T0).total_seconds()), r["firing"], r["resolved"], r["receiver"], r["text"].count("*Alert:*"))
                 for r in A.alert_groups(df, instants, "1m").collect())
    assert got == [
        ("A", 0, 1, 0, "slack-critical", 1), ("A", 200, 2, 0, "slack-critical", 2), ("A", 320, 1, 1, "slack-critical", 2),
        ("A", 60, 1, 0, "slack-critical", 1), ("A", 900, 1, 0, "slack-critical", 1), ("B", 60, 0, 1, "slack-alerts", 1),
    ] or got == sorted([
        ("A", 0, 1, 0, "slack-critical", 1), ("A", 60, 1, 0, "slack-critical", 1), ("A", 200, 2, 0, "slack-critical", 2),
        ("A", 320, 1, 1, "slack-critical", 2), ("A", 900, 1, 0, "slack-critical", 1), ("B", 60, 0, 1, "slack-alerts", 1)])


def test_steady_counters_of_two_containers_do_not_fire(spark):
    rows = [(at(s), A.RESTARTS, {"pod": "p", "namespace": "n", "container": c}, v) for s in range(0, 1800, 15) for c, v in (("a", 0.0), ("b", 5.0))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, name string, labels map<string,string>, value double")
    assert A.alert_PodCrashLooping(df).count() == 0
    assert {r["series"] for r in A.samples_of(df, A.RESTARTS).collect()} == {"container=a,namespace=n,pod=p", "container=b,namespace=n,pod=p"}
    busy = df.withColumn("value", F.when(F.col("labels")["container"] == "b", F.unix_timestamp("ts") % 100000 / 60).otherwise(F.col("value")))
    row = one(A.alert_PodCrashLooping(busy))
    assert (row["namespace"], row["pod"], row["container"]) == ("n", "p", "b")
    assert "*Namespace:* n\n" in A.alert_text(A.alert_PodCrashLooping(busy)).first()["text"]


def test_a_series_that_stops_resolves_after_its_window(spark):
    """Instance 1 fails for a quarter of an hour and disappears; instance 2 runs on."""
    calls = [(at(s), "1", 500) for s in range(0, 900, 15)] + [(at(s), "2", 200) for s in range(0, 6000, 15)]
    df = spark.createDataFrame(calls, "ts timestamp_ntz, instance string, status int")
    alerts = A.alert_LLMHighErrorRate(df).collect()
    assert [a["instance"] for a in alerts] == ["1"]
    assert int((alerts[0]["resolved_at"] - T0).total_seconds()) == 885 + 300
    still = A.alert_LLMHighErrorRate(df.filter("instance = '1'")).first()
    assert still["resolved_at"] is None


def test_silence_is_a_traffic_drop(spark):
    calls = [(at(3600 * h + 60 * k), 1.0, 10, 5) for h in range(40) if h != 30 for k in range(20 + h % 3)]
    df = spark.createDataFrame(calls, "ts timestamp_ntz, duration_s double, prompt_tokens long, completion_tokens long")
    rows = M.signal_anomalies(df).orderBy("bucket_start").collect()
    assert len(rows) == 40 and [i for i, r in enumerate(rows) if r["traffic_drop"]] == [30]
    assert rows[30]["latency_z"] is None


def test_alert_lines(spark):
    df = spark.createDataFrame([("A", "warning", "s", "d", None, "p", "ns")],
                               "alertname string, severity string, summary string, description string, "
                               "instance string, pod string, namespace string")
    assert A.alert_text(df, "DEFAULT").first()["text"] == (
        "*Alert:* A\n*Severity:* warning\n*Summary:* s\n*Description:* d\n*Pod:* p\n*Namespace:* ns")
    assert A.alert_text(df).first()["text"] == (
        "*Alert:* A\n*Namespace:* ns\n*Severity:* warning\n*Summary:* s\n*Description:* d\n*Pod:* `p`")


def test_payload_quotes_and_lists(spark):
    reports = spark.createDataFrame(
        [("i", "High", 'say "x"', "1.1.1.1", ["it's", 'a "b"', "c\\d"]), ("j", "Low", "t", "s", [])],
        "incident_id string, severity string, anomaly_type string, source_ip string, recommended_actions array<string>")
    feedback = spark.createDataFrame([("k", "Critical", None), ("l", "Medium", "m")],
                                     "incident_id string, human_severity string, comment string")
    rows = {r["incident_id"]: r for r in A.filter_reportable(reports, feedback).collect()}
    assert set(rows) == {"i", "k"}
    assert rows["i"]["action"] == str(["it's", 'a "b"', "c\\d"])
    assert rows["k"]["action"] == "Feedback provided: " and rows["k"]["source_ip"] == "N/A (Feedback)"
    import json

    payload = json.loads(A.alert_payload(A.filter_reportable(reports)).first()["payload"])
    assert payload["blocks"][0]["text"] == {"type": "plain_text", "text": "🚨 HIGH Incident Detected", "emoji": True}
    assert payload["blocks"][1]["fields"][0]["text"] == '*Type:*\nsay "x"'


def many_alerts(spark, rows):
    return spark.createDataFrame(
        [(n, s, at(a), at(a), None if b is None else at(b), i, "s", "d") for n, s, a, b, i in rows],
        "alertname string, severity string, since timestamp_ntz, fires_at timestamp_ntz, resolved_at timestamp_ntz, "
        "instance string, summary string, description string")


def test_every_change_of_a_group_is_a_row(spark):
    rows = [("A", "critical", 0, 300, "i1"), ("A", "critical", 100, None, "i2"), ("A", "critical", 300, 90_000, "i3"),
            ("A", "critical", 200_000, 200_000, "i4"), ("B", "warning", 50, 60, "i1"), ("Watchdog", "none", 0, None, "w")]
    got = [(r["alertname"], int((r["at"] - T0).total_seconds()), r["fired"], r["resolved"], r["firing"], r["receiver"])
           for r in A.group_changes(many_alerts(spark, rows)).orderBy("alertname", "at").collect()]
    assert got == [
        ("A", 0, 1, 0, 1, "slack-critical"), ("A", 100, 1, 0, 2, "slack-critical"), ("A", 300, 1, 1, 2, "slack-critical"),
        ("A", 90_000, 0, 1, 1, "slack-critical"), ("A", 200_000, 1, 1, 1, "slack-critical"),
        ("B", 50, 1, 0, 1, "slack-alerts"), ("B", 60, 0, 1, 0, "slack-alerts")]
    lines = A.group_lines(many_alerts(spark, rows))
    told = sorted((r["alertname"], r["status"], r["text"].split("`")[1]) for r in A.told_at(lines, at(320), "1m").collect())
    assert told == [("A", "firing", "i2"), ("A", "firing", "i3"), ("A", "resolved", "i1")]
    assert A.group_changes(many_alerts(spark, rows).limit(0)).count() == 0


def test_a_group_of_many_alerts(spark):
    """One rule fires on 100,000 series, at many moments over some weeks; nothing is gathered."""
    i = F.col("id")
    start = F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i % 5000 * 400).cast("decimal(18,6)"))
    alerts = spark.range(100_000).select(
        F.lit("A").alias("alertname"), F.lit("critical").alias("severity"), start.alias("since"), start.alias("fires_at"),
        F.when(i % 3 != 0, start + F.make_dt_interval(F.lit(0), F.lit(1))).alias("resolved_at"),
        i.cast("string").alias("instance"), F.lit("s").alias("summary"), F.lit("d").alias("description"))
    changes = A.group_changes(alerts)
    last = changes.orderBy(F.col("at").desc()).first()
    assert last["firing"] == alerts.filter("resolved_at IS NULL").count()
    assert changes.agg(F.sum("fired")).first()[0] == 100_000 and A.group_lines(alerts).count() == 100_000
    text = changes._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "_day" in text.split("Window", 1)[1]
