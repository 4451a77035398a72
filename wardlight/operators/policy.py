"""Safety, deadline and confidence rules, escalation and the audit text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import policy as P
from wardlight.functions import times

# Wording of the audit lines.
AUDIT_INITIAL = "Initial Severity classified as "
AUDIT_AGENT = " by AI Agent (confidence: "
AUDIT_POLICY = "Policy Override to "
AUDIT_NOTE = " (Note: "


def _add_policy(df: DataFrame, name: str, applies: Column) -> DataFrame:
    """Append a policy name where it applies; a name is never listed twice."""
    one = F.array(F.lit(name))
    none = F.array().cast("array<string>")
    if "applied_policies" not in df.columns:
        return df.withColumn("applied_policies", F.when(applies, one).otherwise(none))
    sofar = F.coalesce("applied_policies", none)
    new = applies & ~F.array_contains(sofar, name)
    return df.withColumn("applied_policies", F.concat(sofar, F.when(new, one).otherwise(none)))


def _review_flag(df: DataFrame) -> Column:
    return F.coalesce("needs_review", F.lit(False)) if "needs_review" in df.columns else F.lit(False)


def safety_override(df: DataFrame, keywords: Sequence[str] = P.KEYWORDS) -> DataFrame:
    """A danger word in the text makes the case CRITICAL and asks for review."""
    # lower-cased once as a column: inside the chain of ORs it would be done per word
    lowered = df.withColumn("_lowered", F.lower("description"))
    hit = P.mentions_any(F.col("_lowered"), keywords) & ~F.col("severity").eqNullSafe(F.lit("CRITICAL"))
    marked = lowered.withColumn("_hit", hit)
    return (
        _add_policy(marked, P.SAFETY, F.col("_hit"))
        .withColumns({
            "needs_review": _review_flag(df) | F.col("_hit"),
            "severity": F.when(F.col("_hit"), F.lit("CRITICAL")).otherwise(F.col("severity")),
        })
        .drop("_hit", "_lowered")
    )


def assign_sla(df: DataFrame, as_of=None) -> DataFrame:
    """Deadline from the final severity, counted from ``as_of`` (default: now)."""
    due = P.deadline(F.col("severity"), times.moment(as_of))
    return _add_policy(df.withColumn("deadline", due), P.SLA, F.lit(True))


def confidence_guardrail(df: DataFrame, threshold: float = P.CONFIDENCE_FLOOR) -> DataFrame:
    """Confidence below the threshold asks for review; severity stays."""
    low = P.low_confidence(F.col("confidence"), threshold)
    return _add_policy(df, P.CONFIDENCE, low).withColumn("needs_review", _review_flag(df) | low)


def enforce_policies(
    df: DataFrame,
    keywords: Sequence[str] = P.KEYWORDS,
    threshold: float = P.CONFIDENCE_FLOOR,
    as_of=None,
    missing_severity: str | None = "LOW",
) -> DataFrame:
    """Safety, then deadline, then confidence.

    Reads description, severity and confidence. A null severity counts as
    absent and becomes ``missing_severity``; pass None to keep it null.
    """
    if missing_severity is not None:
        df = df.withColumn("severity", F.coalesce("severity", F.lit(missing_severity)))
    return (
        df.transform(safety_override, keywords)
        .transform(assign_sla, as_of)
        .transform(confidence_guardrail, threshold)
    )


def triage_review_hint(df: DataFrame, label: str = "ai_severity") -> DataFrame:
    """The model-side hint; it is logged and is not the stored review flag."""
    return df.withColumn("review_hint", P.wants_review(F.col(label), F.col("confidence")))


def decide_escalation(df: DataFrame, on: str = "ai") -> DataFrame:
    """Escalation by the model's own label, or with on='governed' by the final one."""
    label = {"ai": "ai_severity", "governed": "severity"}[on]
    severity = F.coalesce(F.col(label), F.lit("UNKNOWN"))
    urgent = P.escalates(severity)
    return df.select(
        "incident_id",
        severity.alias("triage_severity"),
        urgent.alias("needs_escalation"),
        F.when(urgent, P.ESCALATE).otherwise(P.BACKLOG).alias("action"),
    )


def transformation_log(df: DataFrame, as_of=None) -> DataFrame:
    """First audit lines: the model's label and, if it was changed, the rule."""
    when = times.stamp(times.moment(as_of))

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("None"))

    def line(*parts: Column) -> Column:
        return F.concat(F.lit("["), when, F.lit("] "), *parts, F.lit(")\n"))

    first = line(
        F.lit(AUDIT_INITIAL), shown(F.col("ai_severity")),
        F.lit(AUDIT_AGENT), F.format_string("%.2f", F.col("confidence")),
    )
    second = line(
        F.lit(AUDIT_POLICY), shown(F.col("severity")),
        F.lit(AUDIT_NOTE), F.array_join("applied_policies", ","),
    )
    changed = ~F.col("ai_severity").eqNullSafe(F.col("severity"))
    return df.withColumn(
        "transformation_log", F.concat(first, F.when(changed, second).otherwise(F.lit("")))
    )
