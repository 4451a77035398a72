"""Listing, filtering and looking up incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions import text as X
from wardlight.functions import times

_LISTED = (
    "incident_id", "description", "severity", "confidence", "image_url",
    "created_at", "human_reviewed", "needs_review", "ai_reasoning",
)


def latest_incidents(df: DataFrame, n: int = 100) -> DataFrame:
    return df.orderBy(F.col("created_at").desc_nulls_first(), F.col("incident_id")).limit(n)


def list_projection(df: DataFrame) -> DataFrame:
    return df.select(*_LISTED).withColumn("created_at", times.iso(F.col("created_at")))


def dashboard_title(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "title": X.title(F.col("description")),
        "reasoning": F.coalesce(X.blank_to_null(F.col("ai_reasoning")), F.lit("No reasoning provided.")),
    })


def dashboard_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("needs_review")).alias("needs_review"),
    )


def filter_critical(df: DataFrame) -> DataFrame:
    return df.filter(F.col("severity") == "CRITICAL")


def filter_needs_review(df: DataFrame) -> DataFrame:
    return df.filter(F.col("needs_review"))


def reviewed_only(df: DataFrame, version: str | None = None) -> DataFrame:
    reviewed = df.filter(F.col("human_reviewed"))
    return reviewed if version is None else reviewed.filter(F.col("prompt_version") == version)


def get_incident(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Details per requested id; an unknown id gives nulls and 'Not processed'.

    Ids that the planner knows to be few are broadcast against the incident
    scan, so the table is not shuffled; the outer join then only sees the rows
    that were found.
    """
    asked = ids.select(F.col("incident_id").alias("requested_id")).distinct()
    found = df.select(
        "incident_id", "description", "severity", "needs_review", "policies_applied",
        "created_at", "deadline",
    ).join(asked, F.col("incident_id") == F.col("requested_id"), "left_semi")
    status = F.when(F.col("incident_id").isNull(), "Not processed").otherwise("processed")
    return asked.join(found, F.col("requested_id") == F.col("incident_id"), "left").withColumn(
        "status", status
    )


def accuracy_tier(stats: DataFrame, good: float = 90, fair: float = 75) -> DataFrame:
    score = F.col("accuracy_percentage")
    tier = F.when(score >= good, "green").when(score >= fair, "amber").otherwise("red")
    return stats.withColumn("tier", tier)
