"""Web-server log lines: parsing, ranking, evidence; traces of service logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import text as X
from wardlight.operators.common import evaluated

# Fixed value: the shape of a log line.
LINE_PATTERN = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(?:\[client\s+([^\]]+)\]\s+)?(.*)$"

# Points per level; any other level gets OTHER_SCORE.
LEVEL_SCORES = {
    "emerg": 100, "alert": 100, "crit": 100, "error": 80,
    "warn": 50, "notice": 10, "info": 1, "debug": 1,
}
OTHER_SCORE = 1

_FLAGS = "(?Ud)"  # Unicode classes; a dot stops only at a line feed
_SEP = "\x1f"


def clean_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """Drop bytes that are not valid UTF-8 and leave valid lines alone."""
    raw = F.col(col)
    mended = F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    return df.withColumn(col, F.when(F.is_valid_utf8(raw), raw).otherwise(mended))


def _marked(line: Column) -> Column:
    """The line with a separator before each of its four groups, if it has the shape."""
    groups = _SEP + _SEP.join(f"${i}" for i in range(1, 5))
    return F.regexp_replace(line, _FLAGS + LINE_PATTERN, groups)


def _fields(line: Column, marked: Column) -> Column:
    """The four groups as an array, null when the line has another shape.

    One regex pass has marked the groups. A line that holds the separator
    itself takes the slower way, one extraction per group.
    """
    pattern = _FLAGS + LINE_PATTERN
    quick = F.when(F.startswith(marked, F.lit(_SEP)), F.slice(F.split(marked, _SEP), 2, 4))
    slow = F.when(
        F.rlike(line, F.lit(pattern)), F.array(*[F.regexp_extract(line, pattern, i) for i in range(1, 5)])
    )
    return F.when(F.contains(line, F.lit(_SEP)), slow).otherwise(quick)


def parse_log_line(lines: DataFrame, col: str = "line") -> DataFrame:
    """log_ts, level, client_ip, message; lines of another shape are dropped."""
    stripped = evaluated(lines, _line=X.strip(F.col(col)))
    marked = evaluated(stripped, _marked=_marked(F.col("_line")))
    parsed = evaluated(marked, _f=_fields(F.col("_line"), F.col("_marked"))).filter(F.col("_f").isNotNull())
    part = F.col("_f")
    return parsed.select(
        *[c for c in lines.columns if c != col],
        part[0].alias("log_ts"),
        F.lower(part[1]).alias("level"),
        F.coalesce(X.blank_to_null(part[2]), F.lit("unknown")).alias("client_ip"),
        X.strip(part[3]).alias("message"),
    )


def level_score(logs: DataFrame, scores: dict[str, int] | None = None) -> DataFrame:
    by_score: dict[int, list[str]] = {}
    for name, points in (LEVEL_SCORES if scores is None else scores).items():
        by_score.setdefault(points, []).append(name)
    score = F.lit(OTHER_SCORE)
    for points, names in by_score.items():
        score = F.when(F.col("level").isin(*names), F.lit(points)).otherwise(score)
    return logs.withColumn("severity_score", score)


def log_anomalies(logs: DataFrame) -> DataFrame:
    """Per (client_ip, message): count, highest score, and their product."""
    scored = logs if "severity_score" in logs.columns else level_score(logs)
    return scored.groupBy("client_ip", "message").agg(
        F.count(F.lit(1)).alias("count"), F.max("severity_score").alias("severity_score")
    ).withColumn("priority", F.col("count") * F.col("severity_score"))


def _ranked(logs: DataFrame, n: int) -> DataFrame:
    order = [F.col("priority").desc(), F.col("client_ip"), F.col("message")]
    return log_anomalies(logs).orderBy(*order).limit(n)


def top_anomalies(logs: DataFrame, n: int = 3) -> DataFrame:
    return _ranked(logs, n).select("client_ip", "message", "count")


def diagnostic_evidence(lines: DataFrame, n: int = 3, col: str = "line") -> DataFrame:
    """From raw lines to one row of evidence: a JSON list of the top anomalies.

    Only the n ranked rows are gathered.
    """
    top = lines.transform(clean_lines, col).transform(parse_log_line, col).transform(_ranked, n)
    rows = F.array_sort(F.collect_list(F.struct(
        (-F.col("priority")).alias("rank"), "client_ip", "message", "count"
    )))
    items = F.transform(rows, lambda r: F.struct(
        r["client_ip"].alias("client_ip"), r["message"].alias("message"), r["count"].alias("count")
    ))
    return top.agg(F.to_json(items).alias("evidence"))


def trace_incident(logs: DataFrame) -> DataFrame:
    """Log rows of all services in incident and time order.

    A range-partitioned sort on (incident, time): an incident with a very
    large share of the rows is spread over several partitions.
    """
    return logs.filter(F.col("incident_id").isNotNull()).orderBy(
        "incident_id", "timestamp", "logger", "message"
    )


def trace_summary(logs: DataFrame) -> DataFrame:
    """Per incident: span, number of services, rows, errors and last message."""
    at = F.struct("timestamp", "logger", "message")
    return logs.filter(F.col("incident_id").isNotNull()).groupBy("incident_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count_distinct("logger").alias("services"),
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.max_by("message", at).alias("last_message"),
    )
