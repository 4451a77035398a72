"""Deterministic rules over a model's label, as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that force the highest severity, anywhere in the text.
KEYWORDS = ("fire", "gas", "smoke", "explosion", "collapsed", "flood", "earthquake", "emergency")

# Hours until the deadline by final severity; anything else gets DEFAULT_HOURS.
SLA_HOURS = {"CRITICAL": 2, "HIGH": 4, "MEDIUM": 24}
DEFAULT_HOURS = 72

# Names of the rules in the applied list.
SAFETY = "Safety Keyword Override"
SLA = "SLA Assignment"
CONFIDENCE = "Low Confidence Override"

# Severities that escalate, and the two outcomes.
ESCALATING = ("HIGH", "CRITICAL")
ESCALATE = "Escalate immediately"
BACKLOG = "Back log"

CONFIDENCE_FLOOR = 0.8


def mentions_any(lowered: Column, words: Sequence[str] = KEYWORDS) -> Column:
    """Whether lower-case text holds any of the words, also inside longer words."""
    hits = [F.contains(lowered, F.lit(word)) for word in words]
    return F.coalesce(reduce(Column.__or__, hits, F.lit(False)), F.lit(False))


def low_confidence(confidence: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) < F.lit(float(floor))


def deadline(severity: Column, start: Column) -> Column:
    hours = F.lit(DEFAULT_HOURS)
    for name, value in SLA_HOURS.items():
        hours = F.when(severity == name, F.lit(value)).otherwise(hours)
    return start + F.make_dt_interval(F.lit(0), hours)


def wants_review(severity: Column, confidence: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    return F.coalesce(severity.isin(*ESCALATING), F.lit(False)) | (confidence <= F.lit(float(floor)))


def escalates(severity: Column) -> Column:
    return F.coalesce(severity.isin(*ESCALATING), F.lit(False))
