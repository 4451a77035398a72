"""Complaint, answer, review, log and metric tables derived from the given tables.

Each fixture is one SELECT in SQL that Spark and DuckDB read alike; ``@name``
stands for a given table. Every fixture covers its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SERVICE = """CASE o_orderkey % 12 WHEN 0 THEN 'Gas leak' WHEN 1 THEN 'Street flood'
    WHEN 2 THEN 'Firefly nest' WHEN 3 THEN 'Graffiti' WHEN 4 THEN 'Pothole' WHEN 5 THEN 'SMOKE'
    WHEN 6 THEN 'Noise' ELSE 'Broken streetlight' END"""
_DETAILS = """CASE WHEN o_orderkey % 7 = 0
      THEN 'Call 415-555-' || SUBSTRING(CAST(10000 + o_orderkey % 10000 AS STRING), 2, 4) ELSE '' END
    || CASE WHEN o_orderkey % 11 = 0 THEN ' mail u' || CAST(o_custkey AS STRING) || CHR(64) || 'mail.example.com' ELSE '' END"""
_ADDRESS = """CAST(o_custkey AS STRING) || ' Main St, Springfield'
    || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE ', ' || CAST(94100 + o_custkey % 25 AS STRING) END"""
_LABEL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
    WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END"""
_VERSION = "CASE o_orderstatus WHEN 'F' THEN 'v1.0.0' WHEN 'O' THEN 'v1.1.0' ELSE 'v1.2.0' END"
_STAMP = "SUBSTRING(CAST(o_orderdate AS STRING), 1, 10) || ' 08:30:00'"

_RESPONSE = f"""CASE WHEN o_orderkey % 97 = 0 THEN 'not json' WHEN o_orderkey % 89 = 0 THEN '{{"severity": "LOW"}} trailing'
  WHEN o_orderkey % 83 = 0 THEN '{{"severity": "LOW", "confidence": 0.9}}]' WHEN o_orderkey % 79 = 0 THEN '{{"severity": "LOW"}}, "more": 1'
  ELSE '{{' || CASE WHEN o_orderkey % 31 = 0 THEN '"note": 1' ELSE '"severity": "' || {_LABEL} || '"' END
     || CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN ', "confidence": null'
             WHEN o_orderkey % 41 = 0 THEN ', "confidence": "high"'
             ELSE ', "confidence": 0.' || SUBSTRING(CAST(100 + (o_orderkey * 37) % 100 AS STRING), 2, 2) END
     || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', "reasoning": "because"' END || '}}' END"""
_ASKED_AT = "o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND"

FIXTURES = {
    # raw service requests; some lack details, address or media
    "requests": f"""SELECT CAST(o_orderkey AS STRING) AS service_request_id,
  {_SERVICE} AS service_name, o_orderpriority AS service_subtype,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {_DETAILS} END AS service_details,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {_ADDRESS} END AS address,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
    WHEN 2 THEN '{{"url":"http://img.example.com/' || CAST(o_orderkey AS STRING) || '.jpg"}}'
    ELSE 'http://img.example.com/' || CAST(o_orderkey AS STRING) || '.png' END AS media_url
FROM @orders""",
    # the same kind of requests as JSON texts
    "request_lines": f"""SELECT CASE WHEN o_orderkey % 101 = 0 THEN '{{"service_request_id": '
  WHEN o_orderkey % 103 = 0 THEN '{{"service_request_id": "1"}}]' ELSE
  '{{"service_request_id":"' || CAST(o_orderkey AS STRING) || '","service_name":"' || {_SERVICE}
  || '","service_subtype":"' || o_orderpriority || '"'
  || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE ',"address":"' || {_ADDRESS} || '"' END
  || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',"media_url":"http://img.example.com/a.png"'
     ELSE ',"media_url":{{"url":"http://img.example.com/' || CAST(o_orderkey AS STRING) || '.jpg"}}' END
  || '}}' END AS line
FROM @orders""",
    # shaped requests, some without a required field
    "inputs": f"""SELECT CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS incident_id,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
    ELSE 'service_name: ' || {_SERVICE} || ' service_details: ' || {_DETAILS} END AS description,
  {_ADDRESS} AS address
FROM @orders""",
    # stored incidents
    "incidents": f"""SELECT CAST(o_orderkey AS STRING) AS incident_id,
  'service_name: ' || {_SERVICE} || ' service_subtype: ' || o_orderpriority
    || CASE WHEN o_orderkey % 6 = 0 THEN ' | ' ELSE ' ' END || 'service_details: ' || {_DETAILS} AS description,
  {_ADDRESS} AS address,
  {_LABEL} AS ai_severity,
  CASE WHEN (o_orderkey * 31) % 100 < 2 * (o_custkey % 20)
       + CASE WHEN o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '2001-06-01 00:00:00' THEN 30 ELSE 0 END
    THEN 'MEDIUM' ELSE {_LABEL} END AS severity,
  CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS confidence,
  o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND AS created_at,
  CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 'http://img.example.com/' || CAST(o_orderkey AS STRING) END AS image_url,
  o_totalprice > 150000 AS human_reviewed,
  (o_orderkey * 37) % 101 < 80 AS needs_review,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'because' END AS ai_reasoning,
  {_VERSION} AS prompt_version,
  o_orderdate + INTERVAL '3' DAY AS deadline,
  CASE WHEN (o_orderkey * 37) % 101 < 80 THEN 'SLA Assignment,Low Confidence Override' ELSE 'SLA Assignment' END
    AS policies_applied,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(94100 + o_custkey % 25 AS INT) END AS zip_code,
  'SF_311_API' AS data_source,
  CAST(NULL AS STRING) AS reviewer_notes,
  '[' || {_STAMP} || '] Initial Severity classified as ' || {_LABEL} || ' by AI Agent (confidence: 0.50)'
    || CASE WHEN o_orderkey % 2 = 0 THEN '[' || {_STAMP} || '] Policy Override to CRITICAL (Note: Safety Keyword Override,SLA Assignment)'
       ELSE '' END || CHR(10)
    || CASE WHEN o_orderpriority = '3-MEDIUM' THEN '[' || {_STAMP} || '] HUMAN_OVERRIDE to LOW by admin (Note: steam, not gas)' || CHR(10)
       ELSE '' END AS transformation_log
FROM @orders""",
    # one model answer per incident: good, without keys, with nulls, not JSON
    "answers": f"""SELECT CAST(o_orderkey AS STRING) AS incident_id,
  {_RESPONSE} AS response
FROM @orders""",
    # the same requests shaped and with the time they came at, and answers that come before, after or far too late
    "asked": f"""SELECT CAST(o_orderkey AS STRING) AS incident_id,
  'service_name: ' || {_SERVICE} || ' service_details: ' || {_DETAILS} AS description, {_ADDRESS} AS address,
  CAST(NULL AS STRING) AS image_url, {_ASKED_AT} AS asked_at
FROM @orders""",
    "replies": f"""SELECT CAST(o_orderkey AS STRING) AS incident_id,
  {_RESPONSE} AS response,
  {_ASKED_AT} + CASE o_orderkey % 6 WHEN 0 THEN INTERVAL '30' DAY WHEN 1 THEN INTERVAL '-10' MINUTE ELSE INTERVAL '20' MINUTE END AS answered_at
FROM @orders""",
    # review actions, up to three per incident
    "reviews": """SELECT CAST(o_orderkey AS STRING) AS incident_id, CAST(1 AS BIGINT) AS seq,
  CASE o_orderkey % 9 WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'approve' ELSE 'reclassify' END AS action,
  CASE WHEN o_orderkey % 9 IN (1, 2, 3) THEN NULL ELSE 'LOW' END AS new_severity,
  CASE WHEN o_orderkey % 2 = 0 THEN 'steam, not gas' ELSE NULL END AS reviewer_notes,
  'admin' AS actor, o_orderdate + INTERVAL '2' DAY AS action_ts
FROM @orders
UNION ALL
SELECT CAST(o_orderkey AS STRING), CAST(2 AS BIGINT), 'reclassify', 'CRITICAL', NULL, 'lead', o_orderdate + INTERVAL '3' DAY
FROM @orders WHERE o_orderpriority = '1-URGENT'
UNION ALL
SELECT CAST(o_orderkey AS STRING), CAST(3 AS BIGINT), 'reject', NULL, NULL, 'lead', o_orderdate + INTERVAL '3' DAY
FROM @orders WHERE o_orderstatus = 'P'""",
    # root-cause reports and the feedback on them
    "reports": """SELECT CAST(o_orderkey AS STRING) AS incident_id,
  CASE WHEN o_orderkey % 53 = 0 THEN '{"severity":"High","anomaly_type":"partial"}' WHEN o_orderkey % 59 = 0 THEN 'oops' ELSE
  CASE WHEN o_orderkey % 61 = 0 THEN '{"severity":"High"}] ' ELSE '' END || '{"severity":"' || CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
     WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END
  || '","anomaly_type":"timeout","source_ip":"10.0.0.' || CAST(o_custkey % 200 AS STRING)
  || '","root_cause":"disk","evidence":["a","b' || CAST(o_orderkey % 3 AS STRING)
  || '"],"confidence":"High","recommended_actions":["restart","page ' || o_orderstatus || '"]}' END AS report
FROM @orders""",
    "feedback": """SELECT CAST(o_orderkey AS STRING) AS incident_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS human_severity,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'seen by ' || o_orderstatus END AS comment
FROM @orders""",
    # reports in the course of time, a second one for every other incident, and feedback before, between, after and at once with them
    "timed_reports": f"""SELECT CAST(o_orderkey AS STRING) AS incident_id, {_LABEL} AS severity, o_orderdate + INTERVAL '1' DAY AS reported_at FROM @orders
UNION ALL
SELECT CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 'LOW' ELSE NULL END, o_orderdate + INTERVAL '3' DAY FROM @orders WHERE o_orderkey % 2 = 0
UNION ALL
SELECT CAST(o_orderkey AS STRING), 'CRITICAL', o_orderdate + INTERVAL '27' HOUR FROM @orders WHERE o_orderkey % 5 = 0""",
    "timed_feedback": """SELECT CAST(o_orderkey AS STRING) AS incident_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS human_severity,
  o_orderdate + (o_orderkey % 5) * INTERVAL '1' DAY AS reviewed_at FROM @orders""",
    # web-server log lines: padded, mixed case levels, without client, other shapes
    "log_lines": """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'garbage line'
  ELSE CASE WHEN event_id % 9 = 0 THEN '  ' ELSE '' END || '[' || CAST(ts AS STRING) || '] ['
   || CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'notice'
      WHEN 'click' THEN 'Crit' ELSE 'core:info' END || '] '
   || CASE WHEN user_id % 5 = 0 THEN '' ELSE '[client 10.0.0.' || CAST(user_id % 200 AS STRING) || '] ' END
   || event_type || ' failure code ' || CAST(event_id % 4 AS STRING) || CASE WHEN event_id % 8 = 0 THEN ' ' ELSE '' END END AS line
FROM @events""",
    # structured service logs as JSON lines
    "service_log_lines": """SELECT CASE WHEN event_id % 61 = 0 THEN 'Traceback (most recent call last):'
  WHEN event_id % 67 = 0 THEN '{"message": "closed too early"}]' ELSE
  '{"timestamp": "' || REPLACE(CAST(ts AS STRING), ' ', 'T') || 'Z", "level": "'
  || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END || '", "logger": "'
  || CASE WHEN event_id % 2 = 0 THEN 'triage_agent' ELSE 'escalation_agent' END || '", "message": "'
  || event_type || ' step", "module": "server", "func_name": "run", "trace_id": "t' || CAST(event_id AS STRING) || '"'
  || CASE WHEN event_id % 10 = 0 THEN '' ELSE ', "incident_id": "INC-' || CAST(user_id AS STRING) || '"' END
  || '}' END AS line
FROM @events""",
    # model calls / requests
    "calls": """SELECT event_id, ts, user_id % 3 AS instance, value / 25 AS duration_s,
  100 + event_id % 400 AS prompt_tokens, 20 + event_id % 80 AS completion_tokens,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_type = 'error' THEN event_id % 3 ELSE 0 END AS retries,
  CAST(event_id % 101 AS DOUBLE) / 100 AS confidence,
  CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
FROM @events""",
    # metric samples with their labels as columns, empty where a series has none: counters that start
    # over every day beside ones that stand still under the same pod or instance, further made-up series that end early, a gauge
    "metrics": """SELECT ts, 'process_cpu_seconds_total' AS name, 'city' AS namespace, CAST(user_id % 3 AS STRING) AS instance, '' AS pod,
  '' AS container, CASE WHEN event_id % 4 = 0 THEN 'idle' ELSE 'triage' END AS job,
  CASE WHEN event_id % 4 = 0 THEN CAST(7 AS DOUBLE)
    ELSE CAST(EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60 AS DOUBLE) END AS value
FROM @events
UNION ALL
SELECT ts, 'process_cpu_seconds_total', 'city', 'gone', '', '', 'triage',
  CAST(EXTRACT(HOUR FROM ts) * 3600 + EXTRACT(MINUTE FROM ts) * 60 AS DOUBLE) FROM @events WHERE user_id % 3 = 2 AND EXTRACT(DAY FROM ts) <= 20
UNION ALL
SELECT ts, 'kube_pod_container_status_restarts_total', 'city', '', 'pod-' || CAST(user_id % 4 AS STRING),
  CASE WHEN event_id % 4 = 0 THEN 'sidecar' ELSE 'app' END, '',
  CASE WHEN event_id % 4 = 0 THEN CAST(5 AS DOUBLE)
    ELSE FLOOR(CAST(EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS DOUBLE) / 90) END
FROM @events
UNION ALL
SELECT ts, 'kube_pod_container_status_restarts_total', 'city', '', 'pod-gone', 'app', '',
  FLOOR(CAST(EXTRACT(HOUR FROM ts) * 60 + EXTRACT(MINUTE FROM ts) AS DOUBLE) / 90) FROM @events WHERE user_id % 4 = 3 AND EXTRACT(DAY FROM ts) <= 20
UNION ALL
SELECT ts, 'process_resident_memory_bytes', 'city', CAST(user_id % 3 AS STRING), '', '', 'triage', 400000000 + ROUND(value * 1000000)
FROM @events""",
}


def spark_sql_text(name: str, sf_dir: str) -> str:
    return re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m.group(1)}.parquet`", FIXTURES[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_sql_text(name, sf_dir))


def with_fixtures(sql: str) -> str:
    """The SQL with every fixture it mentions as ``fx_<name>`` put in front as a CTE."""
    used = [n for n in FIXTURES if re.search(rf"\bfx_{n}\b", sql)]
    ctes = ",\n".join(f"fx_{n} AS (\n{FIXTURES[n].replace('@', '')}\n)" for n in used)
    if not used:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def streaming_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture over a file stream of its source table."""
    source = re.search(r"@(\w+)", FIXTURES[name]).group(1)
    schema = table(spark, sf_dir, source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{source}.parquet").parquet(sf_dir)
    view = f"wardlight_stream_{source}"
    stream.createOrReplaceTempView(view)
    return spark.sql(FIXTURES[name].replace(f"@{source}", view))
