"""How good the model's labels are: accuracy, drift, bias between zip codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators.views import reviewed_only

# Status texts.
DRIFT, STABLE = "🚨 DRIFT ALERT", "✅ STABLE"
BIAS, NO_BIAS = "🚨 BIAS ALERT", "✅ NO SIGNIFICANT BIAS"
WAITING = "⏳ Awaiting Human Review Data"


def _agrees() -> Column:
    return F.col("severity") == F.col("ai_severity")


def _percent(part: Column, whole: Column) -> Column:
    """part * 100 / whole, rounded to two digits in decimal, as a double."""
    exact = (part * F.lit(100)).cast("decimal(20,0)") / whole.cast("decimal(20,0)")
    return F.round(exact, 2).cast("double")


def performance_stats(df: DataFrame) -> DataFrame:
    """Per prompt version: reviewed incidents, agreements, accuracy."""
    counted = reviewed_only(df).groupBy("prompt_version").agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.count_if(_agrees()).alias("matched_count"),
    )
    return counted.withColumn(
        "accuracy_percentage", _percent(F.col("matched_count"), F.col("total_incidents"))
    ).orderBy(F.col("prompt_version").desc_nulls_first())


def _edge(rows: DataFrame, n: int, oldest: bool, salts: int) -> DataFrame:
    """The n oldest (or newest) rows per version.

    There are few versions, so one of them may own most of the table. Every
    scan task first keeps n rows per version; these are ranked within
    (version, salt) by many tasks and only n rows per salt reach the last
    rank. The salt is the scan task's number, so that salting does not make a
    task keep more rows; the result does not depend on it.
    """
    time = F.col("created_at")
    order = [time.asc_nulls_last() if oldest else time.desc_nulls_first(), F.col("incident_id").asc()]
    inner = Window.partitionBy("prompt_version", "_salt").orderBy(*order)
    outer = Window.partitionBy("prompt_version").orderBy(*order)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    return (
        rows.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(outer)).filter(F.col("_rank") <= n)
    )


def drift_check(df: DataFrame, n: int = 50, limit: float = 0.10, salts: int = 64) -> DataFrame:
    """Accuracy of the n oldest against the n newest reviewed incidents.

    Both shares divide by n even when a version has fewer rows; the sample
    sizes are part of the result.
    """
    rows = reviewed_only(df).select(
        "prompt_version", "created_at", "incident_id", F.coalesce(_agrees(), F.lit(False)).alias("_hit")
    )
    old = _edge(rows, n, True, salts).withColumn("_old", F.lit(True))
    new = _edge(rows, n, False, salts).withColumn("_old", F.lit(False))
    counts = old.unionByName(new).groupBy("prompt_version").agg(
        F.count_if(F.col("_old")).alias("baseline_rows"),
        F.count_if(~F.col("_old")).alias("current_rows"),
        F.count_if(F.col("_old") & F.col("_hit")).alias("baseline_matches"),
        F.count_if(~F.col("_old") & F.col("_hit")).alias("current_matches"),
    )
    size = F.lit(float(n))
    before, after = F.col("baseline_matches") / size, F.col("current_matches") / size
    drifted = (before > 0) & ((before - after) > F.lit(float(limit)))
    return counts.select(
        F.col("prompt_version").alias("version"),
        "baseline_rows",
        "current_rows",
        F.round(before, 2).alias("baseline_accuracy"),
        F.round(after, 2).alias("current_accuracy"),
        drifted.alias("drift_detected"),
        F.when(drifted, DRIFT).otherwise(STABLE).alias("status"),
    )


def bias_by_zip(df: DataFrame, min_rows: int = 2, integer_division: bool = False) -> DataFrame:
    """Reviewed incidents and accuracy per zip code.

    ``integer_division`` gives the truncating variant, where a zip code is
    either 0 or 100 percent accurate.
    """
    counted = reviewed_only(df).groupBy("zip_code").agg(
        F.count(F.lit(1)).alias("total_incidents"), F.count_if(_agrees()).alias("_hits")
    ).filter(F.col("total_incidents") >= min_rows)
    if integer_division:
        accuracy = F.when(F.col("_hits") == F.col("total_incidents"), 100.0).otherwise(0.0)
    else:
        accuracy = F.col("_hits") * F.lit(100.0) / F.col("total_incidents")
    return counted.withColumn("accuracy", accuracy).drop("_hits")


def bias_check(
    df: DataFrame, limit: float = 20, min_rows: int = 2, integer_division: bool = False
) -> DataFrame:
    """Gap between the most and least accurate zip code; always one row."""
    gap = F.max("accuracy") - F.min("accuracy")
    summary = bias_by_zip(df, min_rows, integer_division).agg(
        F.count(F.lit(1)).alias("neighborhoods"), gap.alias("_gap")
    )
    biased = F.coalesce(F.col("_gap") > F.lit(float(limit)), F.lit(False))
    return summary.select(
        "neighborhoods",
        F.coalesce(F.round("_gap", 2), F.lit(0.0)).alias("bias_gap_percentage"),
        biased.alias("bias_detected"),
        F.when(F.col("neighborhoods") == 0, WAITING).when(biased, BIAS).otherwise(NO_BIAS).alias("status"),
    )
