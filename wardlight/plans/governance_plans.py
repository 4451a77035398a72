"""Governance queries: accuracy, drift, bias."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import governance as G
from wardlight.operators import views
from wardlight.plans.base import Data, Plan

_STATS = """stats AS (SELECT prompt_version, count(*) AS total_incidents, count(*) FILTER (severity = ai_severity) AS matched_count,
  CAST(round(CAST(count(*) FILTER (severity = ai_severity) * 100.0 AS DECIMAL(20, 1)) / count(*), 2) AS DOUBLE) AS accuracy_percentage
  FROM fx_incidents WHERE human_reviewed GROUP BY prompt_version)"""

_DRIFT = """WITH ranked AS (SELECT prompt_version, severity = ai_severity AS hit,
  row_number() OVER (PARTITION BY prompt_version ORDER BY created_at ASC NULLS LAST, incident_id) AS ra,
  row_number() OVER (PARTITION BY prompt_version ORDER BY created_at DESC NULLS FIRST, incident_id) AS rd
  FROM fx_incidents WHERE human_reviewed),
counts AS (SELECT prompt_version AS version, count(*) FILTER (ra <= 50) AS baseline_rows, count(*) FILTER (rd <= 50) AS current_rows,
  count(*) FILTER (ra <= 50 AND hit) AS b, count(*) FILTER (rd <= 50 AND hit) AS c FROM ranked GROUP BY prompt_version),
shares AS (SELECT *, b / 50::DOUBLE AS base, c / 50::DOUBLE AS cur FROM counts)
SELECT version, baseline_rows, current_rows, round(base, 2) AS baseline_accuracy, round(cur, 2) AS current_accuracy,
  base > 0 AND base - cur > 0.10::DOUBLE AS drift_detected,
  CASE WHEN base > 0 AND base - cur > 0.10::DOUBLE THEN '🚨 DRIFT ALERT' ELSE '✅ STABLE' END AS status FROM shares"""


def _zips(accuracy: str) -> str:
    return f"""zips AS (SELECT zip_code, count(*) AS total_incidents, {accuracy} AS accuracy
  FROM fx_incidents WHERE human_reviewed GROUP BY zip_code HAVING count(*) > 1)"""


_EXACT = "count(*) FILTER (severity = ai_severity) * 100.0::DOUBLE / count(*)"
_WHOLE = "CAST((count(*) FILTER (severity = ai_severity) // count(*)) * 100 AS DOUBLE)"
_BIAS = """SELECT count(*) AS neighborhoods, coalesce(round(max(accuracy) - min(accuracy), 2), 0) AS bias_gap_percentage,
  coalesce(max(accuracy) - min(accuracy) > 20, false) AS bias_detected,
  CASE WHEN count(*) = 0 THEN '⏳ Awaiting Human Review Data' WHEN max(accuracy) - min(accuracy) > 20 THEN '🚨 BIAS ALERT'
    ELSE '✅ NO SIGNIFICANT BIAS' END AS status FROM zips"""


def _by_zip(d: Data, **options):
    rows = G.bias_by_zip(d.incidents, **options)
    return rows.select(F.col("zip_code").cast("string").alias("zip_code"), "total_incidents",
                       F.round("accuracy", 2).alias("accuracy"))


_BY_ZIP = "SELECT CAST(zip_code AS STRING) AS zip_code, total_incidents, round(accuracy, 2) AS accuracy FROM zips"

PLANS = [
    Plan("performance_stats", lambda d: G.performance_stats(d.incidents), f"WITH {_STATS} SELECT * FROM stats"),
    Plan("accuracy_tier", lambda d: views.accuracy_tier(G.performance_stats(d.incidents)),
         f"""WITH {_STATS} SELECT *, CASE WHEN accuracy_percentage >= 90 THEN 'green' WHEN accuracy_percentage >= 75 THEN 'amber'
  ELSE 'red' END AS tier FROM stats"""),
    Plan("drift_check", lambda d: G.drift_check(d.incidents), _DRIFT),
    Plan("bias_by_zip", _by_zip, f"WITH {_zips(_EXACT)} {_BY_ZIP}"),
    Plan("bias_by_zip_truncating", lambda d: _by_zip(d, integer_division=True), f"WITH {_zips(_WHOLE)} {_BY_ZIP}"),
    Plan("bias_check", lambda d: G.bias_check(d.incidents), f"WITH {_zips(_EXACT)} {_BIAS}"),
]
