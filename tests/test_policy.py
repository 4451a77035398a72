"""The rules over all combinations of keyword, label and confidence."""

import itertools
from datetime import datetime, timedelta

from wardlight.functions import policy as P
from wardlight.operators import policy

NOW = datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = "case string, description string, severity string, confidence double"
KEYWORD, SLA, LOW = "Safety Keyword Override", "SLA Assignment", "Low Confidence Override"

LABELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL", "UNKNOWN", "critical", None]
CONFIDENCES = [None, 0.0, 0.7999, 0.8, 0.8001, 1.0]
TEXTS = [None, "", "nothing to see"] + [
    form for word in P.KEYWORDS for form in (word, word.upper(), f"x{word}x", f"{word[:-1]} {word[-1]}")
]
HOURS = {"CRITICAL": 2, "HIGH": 4, "MEDIUM": 24}


def expected(text, label, confidence):
    """The rules in plain words: keyword, then deadline by the final label, then the floor."""
    label = "LOW" if label is None else label
    hit = label != "CRITICAL" and any(word in (text or "").lower() for word in P.KEYWORDS)
    label = "CRITICAL" if hit else label
    unsure = confidence is not None and confidence < 0.8
    policies = [KEYWORD] * hit + [SLA] + [LOW] * unsure
    return label, hit or unsure, NOW + timedelta(hours=HOURS.get(label, 72)), policies


def test_every_combination(spark):
    cases = list(itertools.product(TEXTS, LABELS, CONFIDENCES))
    rows = spark.createDataFrame([(str(i), *case) for i, case in enumerate(cases)], SCHEMA)
    got = {int(r["case"]): r for r in policy.enforce_policies(rows, as_of=NOW).collect()}
    assert len(got) == len(cases)
    for i, case in enumerate(cases):
        row = got[i]
        assert (row["severity"], row["needs_review"], row["deadline"], row["applied_policies"]) == expected(*case), case


def test_default_deadline_lies_ahead(spark):
    rows = spark.createDataFrame([("a", "Hydrant leaks", "MEDIUM", 0.9)], SCHEMA)
    row = policy.enforce_policies(rows).selectExpr("deadline > localtimestamp() AS ahead").first()
    assert row["ahead"]


def test_applying_twice_lists_no_policy_twice(spark):
    rows = spark.createDataFrame([("a", "gas in the cellar", "LOW", 0.5)], SCHEMA)
    first = policy.enforce_policies(rows, as_of=NOW)
    again = policy.enforce_policies(first, as_of=NOW).first()
    assert again["applied_policies"] == first.first()["applied_policies"] == [KEYWORD, SLA, LOW]


def test_own_keywords_and_threshold(spark):
    rows = spark.createDataFrame([("a", "sinkhole near the fire station", "LOW", 0.85)], SCHEMA)
    row = policy.enforce_policies(rows, keywords=["sinkhole"], threshold=0.9, as_of=NOW).first()
    assert row["applied_policies"] == [KEYWORD, SLA, LOW]
    assert policy.enforce_policies(rows, keywords=[], as_of=NOW).first()["severity"] == "LOW"


def test_escalation_by_model_or_final_label(spark):
    rows = spark.createDataFrame(
        [("a", "MEDIUM", "CRITICAL"), ("b", None, "LOW"), ("c", "HIGH", "HIGH")],
        "incident_id string, ai_severity string, severity string")
    by_model = {r["incident_id"]: r for r in policy.decide_escalation(rows).collect()}
    final = {r["incident_id"]: r for r in policy.decide_escalation(rows, on="governed").collect()}
    assert by_model["a"]["action"] == "Back log" and final["a"]["action"] == "Escalate immediately"
    assert by_model["b"]["triage_severity"] == "UNKNOWN" and not by_model["b"]["needs_escalation"]
    assert by_model["c"]["needs_escalation"]


def test_review_hint_includes_the_limit(spark):
    rows = spark.createDataFrame([("LOW", 0.8), ("LOW", 0.81), ("HIGH", 0.99)], "ai_severity string, confidence double")
    assert [r["review_hint"] for r in policy.triage_review_hint(rows).collect()] == [True, False, True]
