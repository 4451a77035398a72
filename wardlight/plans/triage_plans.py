"""Requests, text functions, policy, triage, store and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import alerts as A
from wardlight.operators import answers, policy, privacy, requests, reviews, store, views
from wardlight.operators import triage as TR
from wardlight.plans.base import AS_OF, Data, Plan
from wardlight.sources import readers

_EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
_PHONE = r"\b\d{10}\b|\b\d{3}[-.]?\d{3}[-.]?\d{4}\b|\b\d{3}[-.]?\d{4}\b"


def _redacted(col: str) -> str:
    return (
        f"regexp_replace(regexp_replace({col}, '{_EMAIL}', '[REDACTED_EMAIL]', 'g'),"
        f" '{_PHONE}', '[REDACTED_PHONE]', 'g')"
    )


_DESCRIBED = """'service_name: ' || coalesce(service_name, '') || ' service_subtype: ' || coalesce(service_subtype, '')
  || ' service_details: ' || coalesce(service_details, '')"""
_MEDIA = """nullif(CASE WHEN media_url LIKE '{%' THEN json_extract_string(media_url, '$.url') ELSE media_url END, '')"""
_HIT = "regexp_matches(lower(description), 'fire|gas|smoke|explosion|collapsed|flood|earthquake|emergency')"
_FINAL = f"CASE WHEN {_HIT} THEN 'CRITICAL' ELSE severity END"


def _due(severity: str, start: str) -> str:
    return (
        f"{start} + CASE {severity} WHEN 'CRITICAL' THEN INTERVAL 2 HOUR WHEN 'HIGH' THEN INTERVAL 4 HOUR"
        " WHEN 'MEDIUM' THEN INTERVAL 24 HOUR ELSE INTERVAL 3 DAY END"
    )


def _labelled(d: Data):
    """Incidents with the model's label in the column the rules read."""
    return d.incidents.select(
        "incident_id", "description", F.col("ai_severity").alias("severity"), "confidence"
    )


_LABELLED = "labelled AS (SELECT incident_id, description, ai_severity AS severity, confidence FROM fx_incidents)"


def _joined_policies(df):
    return df.withColumn("applied_policies", F.array_join("applied_policies", ","))


def _enforced(d: Data):
    return _joined_policies(policy.enforce_policies(_labelled(d), as_of=AS_OF)).drop("description")


_ENFORCED = f"""ruled AS (SELECT incident_id, severity AS ai, confidence, {_HIT} AND severity <> 'CRITICAL' AS hit, {_FINAL} AS final
  FROM labelled)"""

# ---- reading and parsing answers, in SQL ----
_OBJECT = "(json_valid(response) AND response LIKE '{%')"
_PARSED = f"""parsed AS (SELECT incident_id, response, {_OBJECT} AS is_object,
    CASE WHEN {_OBJECT} THEN json_extract(response, '$.severity') END AS s,
    CASE WHEN {_OBJECT} THEN json_extract(response, '$.confidence') END AS c,
    CASE WHEN {_OBJECT} THEN json_extract(response, '$.reasoning') END AS r
  FROM fx_answers),
judged AS (SELECT *, CASE WHEN NOT is_object THEN 'malformed'
    WHEN c IS NOT NULL AND json_type(c) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'bad_confidence' ELSE 'ok' END AS parse_status
  FROM parsed),
read AS (SELECT incident_id, CASE WHEN s IS NULL THEN 'UNKNOWN' ELSE s ->> '$' END AS ai_severity,
    CASE WHEN c IS NULL THEN 0.0 ELSE CAST(c AS DOUBLE) END AS confidence,
    CASE WHEN r IS NULL THEN 'No explanation provided' ELSE r ->> '$' END AS ai_reasoning
  FROM judged WHERE parse_status = 'ok')"""


def _requests(d: Data):
    return requests.normalize_request(d.requests)


_REQUESTS = f"""shaped AS (SELECT service_request_id AS incident_id, {_DESCRIBED} AS description,
  coalesce(address, '') AS address, {_MEDIA} AS image_url FROM fx_requests)"""


def _triaged(d: Data):
    return TR.triage(_requests(d), d.answers, as_of=AS_OF)


_TRIAGE_COLUMNS = (
    "incident_id", "description", "severity", "ai_severity", "confidence", "created_at", "image_url",
    "human_reviewed", "needs_review", "ai_reasoning", "prompt_version", "deadline", "policies_applied",
    "address", "zip_code", "data_source", "transformation_log",
)
_TRIAGED = f"""{_REQUESTS},
{_PARSED},
clean AS (SELECT incident_id, {_redacted('description')} AS description, address, image_url,
    ai_severity, confidence, ai_reasoning FROM shaped JOIN read USING (incident_id)),
hits AS (SELECT *, {_HIT} AND ai_severity <> 'CRITICAL' AS hit, CASE WHEN {_HIT} THEN 'CRITICAL' ELSE ai_severity END AS severity
  FROM clean),
triaged AS (SELECT incident_id, description, severity, ai_severity, confidence, TIMESTAMP '{AS_OF}' AS created_at, image_url,
    false AS human_reviewed, hit OR confidence < 0.8::DOUBLE AS needs_review, ai_reasoning, 'v1.1.0' AS prompt_version,
    {_due('severity', f"TIMESTAMP '{AS_OF}'")} AS deadline,
    concat_ws(',', CASE WHEN hit THEN 'Safety Keyword Override' END, 'SLA Assignment',
      CASE WHEN confidence < 0.8::DOUBLE THEN 'Low Confidence Override' END) AS policies_applied,
    trim(split_part(address, ',', 1)) AS address,
    CAST(nullif(regexp_extract(address, '(\\d{{5}})$', 1), '') AS INT) AS zip_code, 'SF_311_API' AS data_source
  FROM hits),
logged AS (SELECT *, '[{AS_OF}] Initial Severity classified as ' || ai_severity || ' by AI Agent (confidence: '
    || printf('%.2f', confidence) || ')' || chr(10) || CASE WHEN ai_severity <> severity
      THEN '[{AS_OF}] Policy Override to ' || severity || ' (Note: ' || policies_applied || ')' || chr(10) ELSE '' END
    AS transformation_log FROM triaged)"""


def _as_text(df, name: str):
    """Nullable whole numbers and booleans leave as text, so both engines print them alike."""
    return df.withColumn(name, F.col(name).cast("string"))


def _current(d: Data):
    return d.incidents.filter(F.col("prompt_version") != "v1.1.0")


def _updates(d: Data):
    """New model results for two of the three versions, one row per key."""
    return d.incidents.filter(F.col("prompt_version") != "v1.0.0").select(
        "incident_id", "description", "ai_severity", F.lit("HIGH").alias("severity"),
        F.lit(0.9).alias("confidence"), "image_url", F.lit(False).alias("needs_review"), "ai_reasoning",
        F.lit("v2").alias("prompt_version"), "deadline", "policies_applied", "address", "zip_code",
        "transformation_log", "created_at",
    )


_UPSERT_OUT = "incident_id, severity, confidence, created_at, human_reviewed, needs_review, prompt_version, data_source"
_UPSERT_SQL = f"""WITH cur AS (SELECT * FROM fx_incidents WHERE prompt_version <> 'v1.1.0'),
upd AS (SELECT * FROM fx_incidents WHERE prompt_version <> 'v1.0.0'),
merged AS (SELECT coalesce(c.incident_id, u.incident_id) AS incident_id,
    CASE WHEN u.incident_id IS NOT NULL THEN 'HIGH' ELSE c.severity END AS severity,
    CASE WHEN u.incident_id IS NOT NULL THEN 0.9::DOUBLE ELSE c.confidence END AS confidence,
    coalesce(c.created_at, u.created_at) AS created_at,
    CASE WHEN c.incident_id IS NOT NULL THEN c.human_reviewed ELSE false END AS human_reviewed,
    CASE WHEN u.incident_id IS NOT NULL THEN false ELSE c.needs_review END AS needs_review,
    CASE WHEN u.incident_id IS NOT NULL THEN 'v2' ELSE c.prompt_version END AS prompt_version,
    'SF_311_API' AS data_source
  FROM cur c FULL OUTER JOIN upd u ON c.incident_id = u.incident_id)
SELECT {_UPSERT_OUT} FROM merged"""


def _history(d: Data):
    """Three batches of triaged rows for the same keys: an append-only history."""
    rows = d.incidents.withColumns({
        "reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp_ntz"),
    })
    first = rows.withColumn("batch_id", F.lit(0))
    second = rows.filter(F.col("prompt_version") == "v1.2.0").withColumns({
        "batch_id": F.lit(1), "severity": F.lit("LOW"), "created_at": F.col("deadline"),
    })
    third = rows.filter(F.col("severity") == "HIGH").withColumns({
        "batch_id": F.lit(2), "severity": F.lit("MEDIUM"), "human_reviewed": F.lit(False),
    })
    return first.unionByName(second).unionByName(third)


_REVIEWED_SQL = """WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY action_ts DESC, seq DESC) AS back
  FROM fx_reviews),
over AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY action_ts DESC, seq DESC) AS oback
  FROM fx_reviews WHERE action = 'reclassify'),
closing AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY action_ts DESC, seq DESC) AS cback
  FROM fx_reviews WHERE action <> 'reject')
SELECT i.incident_id, CASE WHEN o.incident_id IS NOT NULL THEN o.new_severity ELSE i.severity END AS severity,
  i.human_reviewed OR c.incident_id IS NOT NULL AS human_reviewed,
  CASE WHEN l.incident_id IS NULL THEN i.needs_review ELSE l.action = 'reject' END AS needs_review,
  CASE WHEN o.incident_id IS NOT NULL THEN coalesce(o.reviewer_notes, 'Manual human reclassification') END AS reviewer_notes,
  c.actor AS reviewed_by, c.action_ts AS reviewed_at
FROM fx_incidents i LEFT JOIN ordered l ON l.incident_id = i.incident_id AND l.back = 1
LEFT JOIN over o ON o.incident_id = i.incident_id AND o.oback = 1
LEFT JOIN closing c ON c.incident_id = i.incident_id AND c.cback = 1"""


def _ids(d: Data):
    """Ids people ask for: some stored, some not."""
    return d.answers.select(
        F.when(F.col("response") == "not json", F.concat(F.lit("X"), "incident_id"))
        .otherwise(F.col("incident_id")).alias("incident_id")
    )


def _split_rows(d: Data):
    return reviews.split_audit_log(d.incidents)


_SPLIT_SQL = r"""WITH pieces AS (SELECT incident_id, unnest(string_split(regexp_replace(transformation_log,
    '\n?(\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] )', chr(30) || '\1', 'g'), chr(30))[2:]) AS piece,
    generate_subscripts(string_split(regexp_replace(transformation_log,
    '\n?(\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] )', chr(30) || '\1', 'g'), chr(30))[2:], 1) AS n FROM fx_incidents),
bodies AS (SELECT incident_id, CAST(n - 1 AS INT) AS position, CAST(substring(piece, 2, 19) AS TIMESTAMP) AS entry_ts,
    rtrim(substring(piece, 23), chr(10)) AS entry FROM pieces),
split AS (SELECT *, CASE WHEN entry LIKE 'Initial%' THEN 'initial' WHEN entry LIKE 'Policy%' THEN 'policy' ELSE 'human' END AS kind FROM bodies)"""

_LISTED = """incident_id, description, severity, confidence, image_url,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, human_reviewed, needs_review, ai_reasoning"""
_LATEST = "latest AS (SELECT * FROM fx_incidents ORDER BY created_at DESC NULLS FIRST, incident_id LIMIT 100)"

_REPORT = """parsed AS (SELECT incident_id, report::JSON AS j FROM fx_reports WHERE json_valid(report)),
reports AS (SELECT incident_id, j ->> 'severity' AS severity, j ->> 'anomaly_type' AS anomaly_type, j ->> 'source_ip' AS source_ip,
    j ->> 'root_cause' AS root_cause, j ->> 'confidence' AS confidence,
    j ->> '$.evidence[0]' || '|' || (j ->> '$.evidence[1]') AS evidence,
    j ->> '$.recommended_actions[0]' AS a0, j ->> '$.recommended_actions[1]' AS a1
  FROM parsed WHERE j ->> 'root_cause' IS NOT NULL)"""


def _reports(d: Data):
    return answers.report_from_json(d.reports)[0]


_REPORTABLE = f"""{_REPORT},
reportable AS (SELECT incident_id, severity, anomaly_type, source_ip, '[''' || a0 || ''', ''' || a1 || ''']' AS action FROM reports
    WHERE severity IN ('High', 'Critical')
  UNION ALL SELECT incident_id, human_severity, 'Human Override/Correction', 'N/A (Feedback)',
    'Feedback provided: ' || coalesce(comment, '') FROM fx_feedback WHERE human_severity IN ('High', 'Critical'))"""


PLANS = [
    # ---- sources ----
    Plan("read_requests",
         lambda d: requests.in_order(readers.parse_requests(d.request_lines)),
         """SELECT line ->> 'service_request_id' AS service_request_id, line ->> 'service_name' AS service_name,
  line ->> 'service_subtype' AS service_subtype, line ->> 'service_details' AS service_details,
  line ->> 'address' AS address, line ->> 'media_url' AS media_url
FROM fx_request_lines WHERE json_valid(line) ORDER BY service_request_id DESC"""),
    Plan("parse_requests", lambda d: readers.parse_requests(d.request_lines),
         """SELECT line ->> 'service_request_id' AS service_request_id, line ->> 'service_name' AS service_name,
  line ->> 'service_subtype' AS service_subtype, line ->> 'service_details' AS service_details,
  line ->> 'address' AS address, line ->> 'media_url' AS media_url FROM fx_request_lines WHERE json_valid(line)"""),
    Plan("read_runbooks", lambda d: readers.as_runbooks(d.table("documents")),
         "SELECT doc_id, text FROM documents WHERE length(trim(text, ' \t\n\r')) > 0"),
    # ---- request shaping ----
    Plan("build_description",
         lambda d: requests.build_description(d.requests).select("service_request_id", "description"),
         f"SELECT service_request_id, {_DESCRIBED} AS description FROM fx_requests"),
    Plan("resolve_media_url",
         lambda d: requests.resolve_media_url(d.requests).select("service_request_id", "image_url"),
         f"SELECT service_request_id, {_MEDIA} AS image_url FROM fx_requests"),
    Plan("normalize_request", _requests, f"WITH {_REQUESTS} SELECT * FROM shaped"),
    Plan("validate_requests", lambda d: requests.validate_requests(d.inputs)[0],
         "SELECT * FROM fx_inputs WHERE incident_id IS NOT NULL AND description IS NOT NULL"),
    Plan("validate_requests_rejects", lambda d: requests.validate_requests(d.inputs)[1],
         """SELECT *, concat_ws(',', CASE WHEN description IS NULL THEN 'description' END,
  CASE WHEN incident_id IS NULL THEN 'incident_id' END) AS missing
FROM fx_inputs WHERE incident_id IS NULL OR description IS NULL"""),
    Plan("redact_pii", lambda d: privacy.redact_pii(d.table("documents").select("doc_id", "text"), "text"),
         f"SELECT doc_id, {_redacted('text')} AS text FROM documents"),
    Plan("redact_pii_incidents",
         lambda d: privacy.redact_pii(d.incidents.select("incident_id", "description")),
         f"SELECT incident_id, {_redacted('description')} AS description FROM fx_incidents"),
    Plan("pii_audit", lambda d: privacy.pii_audit(d.table("documents"), "text"),
         r"""SELECT count(*) AS texts, count(*) FILTER (regexp_matches(text, '\b\d{3}[-.]?\d{4}\b')) AS leaking,
  CAST(coalesce(sum(len(string_split(text, '[REDACTED_EMAIL]')) - 1), 0) AS BIGINT) AS email_tokens,
  CAST(coalesce(sum(len(string_split(text, '[REDACTED_PHONE]')) - 1), 0) AS BIGINT) AS phone_tokens FROM documents"""),
    Plan("pii_audit_redacted",
         lambda d: privacy.pii_audit(privacy.redact_pii(d.table("documents"), "text"), "text"),
         rf"""WITH r AS (SELECT {_redacted('text')} AS text FROM documents)
SELECT count(*) AS texts, count(*) FILTER (regexp_matches(text, '\b\d{{3}}[-.]?\d{{4}}\b')) AS leaking,
  CAST(coalesce(sum(len(string_split(text, '[REDACTED_EMAIL]')) - 1), 0) AS BIGINT) AS email_tokens,
  CAST(coalesce(sum(len(string_split(text, '[REDACTED_PHONE]')) - 1), 0) AS BIGINT) AS phone_tokens FROM r"""),
    Plan("extract_zip", lambda d: _as_text(TR.extract_zip(d.requests), "zip_code").select("service_request_id", "zip_code"),
         r"""SELECT service_request_id, nullif(regexp_extract(address, '(\d{5})$', 1), '') AS zip_code FROM fx_requests"""),
    Plan("street_of_address",
         lambda d: TR.street_of_address(d.requests).select("service_request_id", "street"),
         "SELECT service_request_id, trim(split_part(coalesce(address, ''), ',', 1)) AS street FROM fx_requests"),
    # ---- prompts and answers ----
    Plan("render_prompt",
         lambda d: answers.render_prompt(d.incidents, version=None)[0].select("incident_id", "prompt_version", "prompt"),
         """SELECT incident_id, prompt_version, 'You are a 311 incident classifier. Classify this complaint:' || chr(10) || 'Description: '
  || description || chr(10) || 'Classify as: LOW, MEDIUM, HIGH, or CRITICAL' || chr(10)
  || 'Return ONLY JSON: {"severity": "...", "confidence": 0.0-1.0'
  || CASE prompt_version WHEN 'v1.1.0' THEN ', "reasoning": "(Short explanation)"' ELSE '' END || '}' AS prompt
FROM fx_incidents WHERE prompt_version IN ('v1.0.0', 'v1.1.0')"""),
    Plan("render_prompt_rejects",
         lambda d: answers.render_prompt(d.incidents, version=None)[1].select("incident_id", "prompt_version"),
         "SELECT incident_id, prompt_version FROM fx_incidents WHERE prompt_version NOT IN ('v1.0.0', 'v1.1.0')"),
    Plan("parse_llm_response", lambda d: answers.parse_llm_response(d.answers)[0].drop("response"),
         f"WITH {_PARSED} SELECT * FROM read"),
    Plan("parse_llm_response_rejects", lambda d: answers.parse_llm_response(d.answers)[1],
         f"WITH {_PARSED} SELECT incident_id, response, parse_status FROM judged WHERE parse_status <> 'ok'"),
    Plan("llm_cost",
         lambda d: answers.llm_cost(d.calls).select("event_id", F.round("cost_usd", 9).alias("cost_usd")),
         """SELECT event_id, round(prompt_tokens * 0.000005::DOUBLE + completion_tokens * 0.000015::DOUBLE, 9) AS cost_usd
FROM fx_calls"""),
    Plan("report_from_json",
         lambda d: _reports(d).drop("recommended_actions").withColumn("evidence", F.array_join("evidence", "|")),
         f"""WITH {_REPORT} SELECT incident_id, severity, anomaly_type, source_ip, root_cause, evidence, confidence FROM reports"""),
    Plan("report_from_json_rejects", lambda d: answers.report_from_json(d.reports)[1],
         """SELECT incident_id, report FROM fx_reports
WHERE NOT json_valid(report) OR json_extract_string(CASE WHEN json_valid(report) THEN report ELSE '{}' END, '$.root_cause') IS NULL"""),
    # ---- listing ----
    Plan("latest_incidents", lambda d: views.latest_incidents(d.incidents).select("incident_id", "created_at"),
         f"WITH {_LATEST} SELECT incident_id, created_at FROM latest"),
    Plan("list_projection", lambda d: views.list_projection(views.latest_incidents(d.incidents)),
         f"WITH {_LATEST} SELECT {_LISTED} FROM latest"),
    Plan("dashboard_title",
         lambda d: views.dashboard_title(d.incidents).select("incident_id", "title", "reasoning"),
         """SELECT incident_id, split_part(description, '|', 1) AS title,
  coalesce(nullif(ai_reasoning, ''), 'No reasoning provided.') AS reasoning FROM fx_incidents"""),
    Plan("dashboard_counts", lambda d: views.dashboard_counts(views.latest_incidents(d.incidents)),
         f"""WITH {_LATEST} SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (needs_review) AS needs_review FROM latest"""),
    Plan("filter_critical", lambda d: views.filter_critical(d.incidents).select("incident_id", "severity"),
         "SELECT incident_id, severity FROM fx_incidents WHERE severity = 'CRITICAL'"),
    Plan("filter_needs_review",
         lambda d: views.filter_needs_review(d.incidents).select("incident_id", "needs_review"),
         "SELECT incident_id, needs_review FROM fx_incidents WHERE needs_review"),
    Plan("reviewed_only",
         lambda d: views.reviewed_only(d.incidents, "v1.1.0").select("incident_id", "severity", "ai_severity"),
         """SELECT incident_id, severity, ai_severity FROM fx_incidents
WHERE human_reviewed AND prompt_version = 'v1.1.0'"""),
    Plan("get_incident", lambda d: _as_text(views.get_incident(d.incidents, _ids(d)), "needs_review"),
         """WITH asked AS (SELECT CASE WHEN response = 'not json' THEN 'X' || incident_id ELSE incident_id END AS requested_id FROM fx_answers)
SELECT a.requested_id, i.incident_id, i.description, i.severity, CAST(i.needs_review AS STRING) AS needs_review, i.policies_applied, i.created_at, i.deadline,
  CASE WHEN i.incident_id IS NULL THEN 'Not processed' ELSE 'processed' END AS status
FROM asked a LEFT JOIN fx_incidents i ON i.incident_id = a.requested_id"""),
    # ---- policy ----
    Plan("safety_override",
         lambda d: _joined_policies(policy.safety_override(_labelled(d))).select(
             "incident_id", "severity", "needs_review", "applied_policies"),
         f"""WITH {_LABELLED}, {_ENFORCED} SELECT incident_id, final AS severity, hit AS needs_review,
  CASE WHEN hit THEN 'Safety Keyword Override' ELSE '' END AS applied_policies FROM ruled"""),
    Plan("assign_sla",
         lambda d: policy.assign_sla(d.incidents, as_of=F.col("created_at")).select("incident_id", "deadline"),
         f"SELECT incident_id, {_due('severity', 'created_at')} AS deadline FROM fx_incidents"),
    Plan("confidence_guardrail",
         lambda d: _joined_policies(policy.confidence_guardrail(_labelled(d))).select(
             "incident_id", "needs_review", "applied_policies"),
         f"""WITH {_LABELLED} SELECT incident_id, confidence < 0.8::DOUBLE AS needs_review,
  CASE WHEN confidence < 0.8::DOUBLE THEN 'Low Confidence Override' ELSE '' END AS applied_policies FROM labelled"""),
    Plan("enforce_policies", _enforced,
         f"""WITH {_LABELLED}, {_ENFORCED} SELECT incident_id, final AS severity, confidence,
  hit OR confidence < 0.8::DOUBLE AS needs_review, {_due('final', f"TIMESTAMP '{AS_OF}'")} AS deadline,
  concat_ws(',', CASE WHEN hit THEN 'Safety Keyword Override' END, 'SLA Assignment',
    CASE WHEN confidence < 0.8::DOUBLE THEN 'Low Confidence Override' END) AS applied_policies FROM ruled"""),
    Plan("triage_review_hint",
         lambda d: policy.triage_review_hint(d.incidents).select("incident_id", "review_hint"),
         """SELECT incident_id, ai_severity IN ('CRITICAL', 'HIGH') OR confidence <= 0.8::DOUBLE AS review_hint
FROM fx_incidents"""),
    Plan("decide_escalation", lambda d: policy.decide_escalation(d.incidents),
         """SELECT incident_id, ai_severity AS triage_severity, ai_severity IN ('HIGH', 'CRITICAL') AS needs_escalation,
  CASE WHEN ai_severity IN ('HIGH', 'CRITICAL') THEN 'Escalate immediately' ELSE 'Back log' END AS action FROM fx_incidents"""),
    Plan("decide_escalation_governed", lambda d: policy.decide_escalation(d.incidents, on="governed"),
         """SELECT incident_id, severity AS triage_severity, severity IN ('HIGH', 'CRITICAL') AS needs_escalation,
  CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'Escalate immediately' ELSE 'Back log' END AS action FROM fx_incidents"""),
    Plan("transformation_log", lambda d: _triaged(d).select("incident_id", "transformation_log"),
         f"WITH {_TRIAGED} SELECT incident_id, transformation_log FROM logged"),
    Plan("triage", lambda d: _as_text(_triaged(d), "zip_code").select(*_TRIAGE_COLUMNS),
         f"""WITH {_TRIAGED} SELECT {', '.join(c for c in _TRIAGE_COLUMNS if c != 'zip_code')},
  CAST(zip_code AS STRING) AS zip_code FROM logged"""),
    Plan("triage_pending",
         lambda d: TR.pending(_requests(d), d.answers.filter(F.col("response") != "not json")).select("incident_id"),
         """SELECT service_request_id AS incident_id FROM fx_requests WHERE service_request_id NOT IN
  (SELECT incident_id FROM fx_answers WHERE response <> 'not json')"""),
    # ---- store and review ----
    Plan("skip_seen", lambda d: requests.skip_seen(_requests(d), _current(d)).select("incident_id"),
         """SELECT service_request_id AS incident_id FROM fx_requests WHERE service_request_id NOT IN
  (SELECT incident_id FROM fx_incidents WHERE prompt_version <> 'v1.1.0')"""),
    Plan("upsert_incidents",
         lambda d: store.upsert_incidents(_current(d), _updates(d), as_of=AS_OF).select(*_UPSERT_OUT.split(", ")),
         _UPSERT_SQL),
    Plan("fold_history",
         lambda d: store.fold_history(_history(d), ["batch_id"]).select(
             "incident_id", "severity", "created_at", "human_reviewed"),
         """SELECT incident_id, CASE WHEN severity = 'HIGH' THEN 'MEDIUM' WHEN prompt_version = 'v1.2.0' THEN 'LOW'
  ELSE severity END AS severity, created_at, human_reviewed FROM fx_incidents"""),
    Plan("append_feedback", lambda d: store.stamp_feedback(d.feedback, AS_OF),
         f"""SELECT incident_id, CAST(NULL AS STRING) AS original_severity, human_severity, coalesce(comment, '') AS comment,
  TIMESTAMP '{AS_OF}' AS reviewed_at FROM fx_feedback"""),
    Plan("feedback_vs_report", lambda d: _as_text(store.feedback_vs_report(d.feedback, _reports(d)), "agrees"),
         f"""WITH {_REPORT} SELECT f.incident_id, r.severity AS original_severity, f.human_severity,
  CAST(r.severity = f.human_severity AS STRING) AS agrees FROM fx_feedback f LEFT JOIN reports r ON r.incident_id = f.incident_id"""),
    Plan("feedback_in_force", lambda d: _as_text(store.feedback_in_force(d.timed_feedback, d.timed_reports), "agrees"),
         """SELECT f.incident_id, f.human_severity, f.reviewed_at, r.severity AS original_severity,
  CAST(r.severity = f.human_severity AS STRING) AS agrees
FROM fx_timed_feedback f ASOF LEFT JOIN fx_timed_reports r ON f.incident_id = r.incident_id AND f.reviewed_at >= r.reported_at"""),
    Plan("apply_reviews",
         lambda d: reviews.apply_reviews(d.incidents, d.reviews).select(
             "incident_id", "severity", "human_reviewed", "needs_review", "reviewer_notes", "reviewed_by",
             "reviewed_at"),
         _REVIEWED_SQL),
    Plan("audit_trail", lambda d: reviews.audit_trail(d.incidents, d.reviews),
         f"""{_SPLIT_SQL}
SELECT incident_id, 0 AS part, CAST(position AS BIGINT) AS position, entry_ts, kind, entry FROM split
UNION ALL SELECT incident_id, 1, seq, date_trunc('second', action_ts), 'human', 'HUMAN_OVERRIDE to ' || new_severity
  || ' by ' || actor || ' (Note: ' || coalesce(reviewer_notes, 'Manual human reclassification') || ')'
FROM fx_reviews WHERE action = 'reclassify'"""),
    Plan("review_entries", lambda d: reviews.review_entries(d.reviews),
         """SELECT incident_id, action_ts, seq, '[' || strftime(action_ts, '%Y-%m-%d %H:%M:%S') || '] HUMAN_OVERRIDE to ' || new_severity
  || ' by ' || actor || ' (Note: ' || coalesce(reviewer_notes, 'Manual human reclassification') || ')' || chr(10) AS entry
FROM fx_reviews WHERE action = 'reclassify'"""),
    Plan("split_audit_log", _split_rows, f"{_SPLIT_SQL} SELECT * FROM split"),
    # ---- reports that alert ----
    Plan("filter_reportable", lambda d: A.filter_reportable(_reports(d), d.feedback),
         f"WITH {_REPORTABLE} SELECT * FROM reportable"),
    Plan("alert_payload", lambda d: A.alert_payload(A.filter_reportable(_reports(d), d.feedback)),
         f"""WITH {_REPORTABLE} SELECT incident_id, severity, '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"🚨 '
  || upper(severity) || ' Incident Detected","emoji":true}}}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Type:*\\n'
  || anomaly_type || '"}},{{"type":"mrkdwn","text":"*Source IP:*\\n`' || source_ip
  || '`"}}]}},{{"type":"section","text":{{"type":"mrkdwn","text":"*Recommended Action:*\\n' || action || '"}}}}]}}' AS payload
FROM reportable"""),
]
