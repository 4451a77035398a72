"""From a valid request and a model answer to a governed incident row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import schemas
from wardlight.functions import text as X
from wardlight.functions import times
from wardlight.operators import answers, policy, privacy

DATA_SOURCE = "SF_311_API"


def extract_zip(df: DataFrame, col: str = "address") -> DataFrame:
    return df.withColumn("zip_code", X.zip_of(F.col(col)))


def street_of_address(df: DataFrame, col: str = "address") -> DataFrame:
    return df.withColumn("street", X.street_of(F.col(col)))


def pending(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests that no answer has come for; they are triaged once it has."""
    return requests.join(responses.select("incident_id"), "incident_id", "left_anti")


def triage(
    requests: DataFrame,
    responses: DataFrame | None = None,
    as_of=None,
    version: str = answers.CURRENT_PROMPT,
) -> DataFrame:
    """Governed incident rows, ready for the upsert.

    ``responses`` holds (incident_id, response); without it the requests carry
    the response column themselves and the whole job is one scan and one
    projection. Answers that cannot be read are left out here, see
    ``answers.parse_llm_response`` for the rejects; requests without an answer
    are in ``pending``.
    """
    joined = requests
    if responses is not None:
        joined = requests.join(responses.select("incident_id", "response"), "incident_id")
    clean = joined.transform(privacy.redact_pii)
    ok, _ = answers.parse_llm_response(clean)
    ruled = (
        ok.withColumn("severity", F.col("ai_severity"))
        .transform(policy.enforce_policies, as_of=as_of, missing_severity=None)
        .transform(policy.transformation_log, as_of)
        .transform(extract_zip)
        .withColumn("address", X.street_of(F.col("address")))
    )
    known = {
        "created_at": times.moment(as_of),
        "human_reviewed": F.lit(False),
        "prompt_version": F.lit(version),
        "policies_applied": F.array_join("applied_policies", ","),
        "data_source": F.lit(DATA_SOURCE),
    }
    return ruled.select(*[
        known.get(f.name, F.col(f.name) if f.name in ruled.columns else F.lit(None))
        .cast(f.dataType).alias(f.name)
        for f in schemas.INCIDENT.fields
    ])
