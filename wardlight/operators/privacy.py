"""Personal data in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.functions import text as X


def redact_pii(df: DataFrame, col: str = "description") -> DataFrame:
    return df.withColumn(col, X.redact(F.col(col)))


def pii_audit(df: DataFrame, col: str = "description") -> DataFrame:
    """One row: texts seen, texts still holding a phone number, tokens present.

    A clean store has ``leaking`` = 0.
    """
    def tokens(token: str):
        # counting by length difference keeps this a single pass without regex
        shorter = F.length(F.col(col)) - F.length(F.replace(F.col(col), F.lit(token), F.lit("")))
        return F.coalesce(F.sum((shorter / F.lit(len(token))).cast("long")), F.lit(0)).cast("long")

    leaking = F.rlike(F.col(col), F.lit(X.UNICODE + X.AUDIT_PHONE_PATTERN))
    return df.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(leaking).alias("leaking"),
        tokens(X.EMAIL_TOKEN).alias("email_tokens"),
        tokens(X.PHONE_TOKEN).alias("phone_tokens"),
    )
