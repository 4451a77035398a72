"""Explicit schemas of the tables and feeds the operators work on."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# media_url arrives either as a string or as an object; a STRING field keeps the
# object's JSON text.
RAW_REQUEST = _struct(
    service_request_id=_S,
    service_name=_S,
    service_subtype=_S,
    service_details=_S,
    address=_S,
    media_url=_S,
)

REQUEST = _struct(incident_id=_S, description=_S, address=_S, image_url=_S)

INCIDENT = _struct(
    incident_id=_S,
    description=_S,
    severity=_S,
    ai_severity=_S,
    confidence=T.DoubleType(),
    created_at=T.TimestampNTZType(),
    image_url=_S,
    human_reviewed=T.BooleanType(),
    needs_review=T.BooleanType(),
    reviewed_by=_S,
    reviewed_at=T.TimestampNTZType(),
    reviewer_notes=_S,
    ai_reasoning=_S,
    prompt_version=_S,
    deadline=T.TimestampNTZType(),
    policies_applied=_S,
    address=_S,
    zip_code=T.IntegerType(),
    data_source=_S,
    transformation_log=_S,
)

# Columns an upsert overwrites; every other incident column survives a conflict.
UPSERT_COLUMNS = (
    "description",
    "ai_severity",
    "severity",
    "confidence",
    "image_url",
    "needs_review",
    "ai_reasoning",
    "prompt_version",
    "deadline",
    "policies_applied",
    "address",
    "zip_code",
    "transformation_log",
)

FEEDBACK = _struct(
    incident_id=_S,
    original_severity=_S,
    human_severity=_S,
    comment=_S,
    reviewed_at=T.TimestampNTZType(),
)

REPORT = _struct(
    severity=_S,
    anomaly_type=_S,
    source_ip=_S,
    root_cause=_S,
    evidence=T.ArrayType(_S),
    confidence=_S,
    recommended_actions=T.ArrayType(_S),
)

SERVICE_LOG = _struct(
    timestamp=_S,
    level=_S,
    logger=_S,
    message=_S,
    module=_S,
    func_name=_S,
    trace_id=_S,
    incident_id=_S,
    exception=_S,
)

METRIC = _struct(
    ts=T.TimestampNTZType(),
    name=_S,
    labels=T.MapType(_S, _S),
    value=T.DoubleType(),
)

REVIEW_ACTION = _struct(
    incident_id=_S,
    seq=T.LongType(),
    action=_S,
    new_severity=_S,
    reviewer_notes=_S,
    actor=_S,
    action_ts=T.TimestampNTZType(),
)
