"""Upsert, history, feedback, reviews."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardlight import schemas
from wardlight.operators import requests, reviews, store, views
from wardlight.sources import sinks

T0 = datetime(2024, 1, 1)


def incidents(spark, rows):
    """Rows of dicts as incidents; what is not given is null."""
    names = schemas.INCIDENT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.INCIDENT)


def test_upsert_keeps_what_a_conflict_must_not_touch(spark):
    current = incidents(spark, [
        dict(incident_id="a", severity="LOW", created_at=T0, human_reviewed=True, reviewer_notes="n", data_source="X"),
        dict(incident_id="b", severity="HIGH", created_at=T0),
    ])
    updates = incidents(spark, [
        dict(incident_id="a", severity=None, created_at=T0 + timedelta(days=1), human_reviewed=False, confidence=0.5),
        dict(incident_id="c", severity="MEDIUM"),
    ])
    later = T0 + timedelta(days=9)
    got = {r["incident_id"]: r for r in store.upsert_incidents(current, updates, as_of=later).collect()}
    assert got["a"]["severity"] is None and got["a"]["confidence"] == 0.5
    assert got["a"]["created_at"] == T0 and got["a"]["human_reviewed"] and got["a"]["reviewer_notes"] == "n"
    assert got["a"]["data_source"] == "X"
    assert got["b"]["severity"] == "HIGH"
    assert got["c"]["created_at"] == later and got["c"]["human_reviewed"] is False
    assert got["c"]["data_source"] == "SF_311_API"


def test_last_of_repeated_updates_wins(spark):
    updates = incidents(spark, [
        dict(incident_id="a", severity=s, created_at=T0 + timedelta(hours=h)) for s, h in (("LOW", 1), ("HIGH", 3), ("MEDIUM", 2))
    ])
    none = incidents(spark, [])
    assert store.upsert_incidents(none, updates, order=["created_at"]).first()["severity"] == "HIGH"


def test_history_is_a_chain_of_upserts(spark, tmp_path):
    rng = random.Random(5)
    batches = [
        [dict(incident_id=k, severity=rng.choice("LMHC"), created_at=T0 + timedelta(days=n), data_source=f"s{n}")
         for k in rng.sample("abcdefgh", 5)]
        for n in range(4)
    ]
    path, current = str(tmp_path / "history"), incidents(spark, [])
    assert sinks.read_incidents(spark, path).count() == 0
    for n, rows in enumerate(batches):
        sinks.write_batch(incidents(spark, rows), path, n)
        sinks.write_batch(incidents(spark, rows), path, n)  # a retry replaces the batch
        current = store.upsert_incidents(current, incidents(spark, rows))
    pick = ("incident_id", "severity", "created_at", "data_source")
    want = sorted(tuple(r) for r in current.select(*pick).collect())
    assert sorted(tuple(r) for r in sinks.read_incidents(spark, path).select(*pick).collect()) == want
    short = str(tmp_path / "short")
    sinks.compact_history(spark, path, short)
    assert sorted(tuple(r) for r in sinks.read_incidents(spark, short).select(*pick).collect()) == want


def test_incident_layout_prunes(spark, tmp_path):
    rows = incidents(spark, [
        dict(incident_id=str(i), data_source="S", created_at=T0 + timedelta(days=i % 3)) for i in range(30)])
    sinks.write_incidents(rows, str(tmp_path / "i"))
    back = spark.read.parquet(str(tmp_path / "i"))
    one_day = back.filter(F.col("created_on") == "2024-01-02")
    assert one_day.count() == 10 and len(one_day.inputFiles()) < len(back.inputFiles()) + 1
    assert "PartitionFilters: [isnotnull(created_on" in one_day._jdf.queryExecution().toString()


def test_feedback_is_appended(spark, tmp_path):
    rows = spark.createDataFrame([("a", "High", None), ("b", "Low", "c")], "incident_id string, human_severity string, comment string")
    path = str(tmp_path / "feedback")
    for _ in range(2):
        sinks.append_feedback(rows, path, T0)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.filter("comment = ''").count() == 2
    reports = spark.createDataFrame([("a", "High")], "incident_id string, severity string")
    got = {r["incident_id"]: (r["original_severity"], r["agrees"]) for r in store.feedback_vs_report(rows, reports).collect()}
    assert got == {"a": ("High", True), "b": (None, None)}


def fold_by_hand(incident, actions):
    row = dict(incident)
    for a in sorted(actions, key=lambda a: (a["action_ts"], a["seq"])):
        if a["action"] == "approve":
            row.update(human_reviewed=True, needs_review=False)
        elif a["action"] == "reject":
            row.update(needs_review=True)
        else:
            note = a["reviewer_notes"] or reviews.DEFAULT_NOTE
            entry = f"[{a['action_ts']:%Y-%m-%d %H:%M:%S}] HUMAN_OVERRIDE to {a['new_severity']} by {a['actor']} (Note: {note})\n"
            row.update(severity=a["new_severity"], human_reviewed=True, needs_review=False, reviewer_notes=note,
                       transformation_log=(row["transformation_log"] or "") + entry)
    return row


def random_actions(seed=3, n=200):
    rng = random.Random(seed)
    names = schemas.REVIEW_ACTION.fieldNames()
    rows = [dict(
        incident_id=rng.choice("aaaabcde"), seq=i, action=rng.choice(["approve", "reject", "reclassify"]),
        new_severity=rng.choice([None, "LOW", "HIGH"]), reviewer_notes=rng.choice([None, "why"]), actor=rng.choice("xy"),
        action_ts=T0 + timedelta(seconds=rng.randrange(40)),
    ) for i in range(n)]
    return rows, [tuple(r[c] for c in names) for r in rows]


def test_reviews_equal_a_step_by_step_fold(spark):
    rows, tuples = random_actions()
    base = [dict(incident_id=k, severity="MEDIUM", human_reviewed=False, needs_review=k == "b",
                 transformation_log=None if k == "c" else "old\n", reviewer_notes=None) for k in "abcdef"]
    got = {r["incident_id"]: r for r in reviews.apply_reviews(
        incidents(spark, base), spark.createDataFrame(tuples, schemas.REVIEW_ACTION)).collect()}
    for incident in base:
        want = fold_by_hand(incident, [a for a in rows if a["incident_id"] == incident["incident_id"]])
        for name, value in want.items():
            if name == "transformation_log":  # new entries are rows, the stored text stays
                value = incident[name]
            assert got[incident["incident_id"]][name] == value, (incident["incident_id"], name)


def test_the_trail_of_a_busy_incident_is_whole(spark):
    """One incident owns most actions; its entries are rows like any other's, in the order of the fold."""
    rows, tuples = random_actions(n=600)
    actions = spark.createDataFrame(tuples, schemas.REVIEW_ACTION)
    old = "[2023-05-02 09:00:00] Initial Severity classified as LOW by AI Agent (confidence: 0.50)\n"
    base = incidents(spark, [dict(incident_id=k, transformation_log=old) for k in "ab"])
    got = reviews.audit_trail(base, actions).filter("incident_id = 'a'").orderBy("part", "entry_ts", "position").collect()
    by_hand = fold_by_hand(dict(transformation_log=old), [a for a in rows if a["incident_id"] == "a"])
    assert "".join(f"[{r['entry_ts']:%Y-%m-%d %H:%M:%S}] {r['entry']}\n" for r in got) == by_hand["transformation_log"]
    assert len(got) > 80 and [r["kind"] for r in got[:2]] == ["initial", "human"]


def test_audit_text_with_and_without_newlines(spark):
    one = "[2023-05-02 09:00:00] Initial Severity classified as MEDIUM by AI Agent (confidence: 0.50)"
    two = "[2023-05-02 09:00:00] Policy Override to CRITICAL (Note: Safety Keyword Override)"
    three = "[2023-05-02 10:30:00] HUMAN_OVERRIDE to MEDIUM by admin (Note: only steam\nsee [1])"
    rows = spark.createDataFrame(
        [("a", one + two + "\n" + three + "\n"), ("b", one + "\n" + two + "\n"), ("c", None), ("d", "")],
        "incident_id string, transformation_log string")
    got = [(r["incident_id"], r["position"], r["kind"], r["entry"]) for r in
           reviews.split_audit_log(rows).orderBy("incident_id", "position").collect()]
    assert [g[:3] for g in got] == [
        ("a", 0, "initial"), ("a", 1, "policy"), ("a", 2, "human"), ("b", 0, "initial"), ("b", 1, "policy")]
    assert got[2][3] == three[22:]


def test_keys_of_any_kind_are_skipped(spark):
    big = 2**53 + 1
    new = spark.createDataFrame([(big,), (None,), (3,)], "k long")
    stored = spark.createDataFrame([(big,), (None,)], "k long")
    assert sorted(r[0] or 0 for r in requests.skip_seen(new, stored, "k").collect()) == [0, 3]
    for kind, value in (("decimal(38,2)", "12345678901234567890.12"), ("date", "2024-02-29"), ("timestamp_ntz", "2024-02-29 01:02:03.000004")):
        one = spark.createDataFrame([(value,), (None,)], "k string").selectExpr(f"CAST(k AS {kind}) AS k")
        assert [r[0] for r in requests.skip_seen(one, one.filter("k IS NOT NULL"), "k").collect()] == [None]


def test_skip_seen_and_lookup(spark):
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "incident_id string")
    stored = incidents(spark, [dict(incident_id=k, severity="LOW") for k in ("b", "x")])
    assert sorted(r[0] for r in requests.skip_seen(new, stored).collect()) == ["a", "c"]
    got = {r["requested_id"]: r for r in views.get_incident(stored, new).collect()}
    assert got["b"]["status"] == "processed" and got["b"]["severity"] == "LOW"
    assert got["a"]["status"] == "Not processed" and got["a"]["incident_id"] is None


def test_feedback_meets_the_report_in_force(spark):
    """Several reports and much feedback for one incident, in any order of rows."""
    rng = random.Random(8)
    reports = [(rng.choice("aaab"), rng.choice(["LOW", "HIGH", None]), T0 + timedelta(hours=rng.randrange(200))) for _ in range(60)]
    given = [(rng.choice("aaabc"), n, rng.choice(["LOW", "HIGH"]), T0 + timedelta(hours=rng.randrange(200))) for n in range(150)]
    given += [("a", 900, "LOW", None), (None, 901, "LOW", T0)]
    feedback = spark.createDataFrame(given, "incident_id string, n int, human_severity string, reviewed_at timestamp_ntz")
    table = spark.createDataFrame([*reports, ("a", "LOW", None), (None, "LOW", T0)], "incident_id string, severity string, reported_at timestamp_ntz")
    got = {r["n"]: (r["original_severity"], r["agrees"]) for r in store.feedback_in_force(feedback, table).collect()}
    for key, n, label, when in given:
        known = [(at, s is not None, s or "") for k, s, at in reports if k == key and when is not None and at <= when]
        want = (max(known)[2] or None) if known else None
        assert got[n] == (want, None if want is None else want == label), n
    assert len(got) == len(given) and store.feedback_in_force(feedback, table.limit(0)).filter("original_severity IS NOT NULL").count() == 0
