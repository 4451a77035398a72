"""Prompts and model answers: the model itself stays outside, as a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import schemas
from wardlight.functions import text as X
from wardlight.operators.common import evaluated

# Prompt texts by version and the version in use.
PROMPTS = {
    "v1.0.0": (
        "You are a 311 incident classifier. Classify this complaint:\n"
        "Description: {description}\n"
        "Classify as: LOW, MEDIUM, HIGH, or CRITICAL\n"
        'Return ONLY JSON: {"severity": "...", "confidence": 0.0-1.0}'
    ),
    "v1.1.0": (
        "You are a 311 incident classifier. Classify this complaint:\n"
        "Description: {description}\n"
        "Classify as: LOW, MEDIUM, HIGH, or CRITICAL\n"
        'Return ONLY JSON: {"severity": "...", "confidence": 0.0-1.0, "reasoning": "(Short explanation)"}'
    ),
}
CURRENT_PROMPT = "v1.1.0"

# What a missing key of an answer stands for.
NO_SEVERITY = "UNKNOWN"
NO_CONFIDENCE = 0.0
NO_REASONING = "No explanation provided"

# USD per token.
INPUT_PRICE = 0.000005
OUTPUT_PRICE = 0.000015


def render_prompt(
    df: DataFrame, registry: Mapping[str, str] = PROMPTS, version: str | None = CURRENT_PROMPT
) -> tuple[DataFrame, DataFrame]:
    """(rendered, rejects): the version's template filled with the description.

    ``version=None`` takes the row's own ``prompt_version``; a row whose version
    is not in the registry has no prompt and is a reject. The registry is a
    handful of constants, so it is an expression, not a join.
    """
    if version is not None:
        df = df.withColumn("prompt_version", F.lit(version))
    template = F.lit(None).cast("string")
    for name, body in registry.items():
        template = F.when(F.col("prompt_version") == name, F.lit(body)).otherwise(template)
    filled = F.replace(template, F.lit("{description}"), F.col("description"))
    known = F.coalesce(F.col("prompt_version").isin(*registry), F.lit(False))
    return df.withColumn("prompt", filled).filter(known), df.filter(~known)


_ANSWER = "struct<severity:string,confidence:double,reasoning:string>"


def with_parsed_answer(df: DataFrame, col: str = "response") -> DataFrame:
    """Add ai_severity, confidence, ai_reasoning and parse_status.

    A missing key takes its default; an explicit null confidence, one that is
    not a number, or text that is not one JSON object is an error. The keys of
    an answer are only looked at when a field came out empty.
    """
    parsed = evaluated(df, _objects=X.json_objects(F.col(col), _ANSWER)).withColumn(
        "_answer", F.when(X.single(F.col("_objects")), F.get("_objects", F.lit(0)))
    )
    answer = F.col("_answer")
    full = answer["severity"].isNotNull() & answer["confidence"].isNotNull() & answer["reasoning"].isNotNull()
    keyed = evaluated(parsed, _keys=F.when(answer.isNotNull() & ~full, F.json_object_keys(col)))
    keys = F.col("_keys")

    def field(name: str, default):
        absent = answer.isNotNull() & answer[name].isNull() & ~X.has_key(keys, name)
        return F.when(absent, F.lit(default)).otherwise(answer[name])

    no_number = (answer["confidence"].isNull() & X.has_key(keys, "confidence")) | F.isnan(answer["confidence"])
    status = F.when(answer.isNull(), "malformed").when(no_number, "bad_confidence").otherwise("ok")
    return keyed.select(
        *df.columns,
        field("severity", NO_SEVERITY).alias("ai_severity"),
        field("confidence", NO_CONFIDENCE).alias("confidence"),
        field("reasoning", NO_REASONING).alias("ai_reasoning"),
        status.alias("parse_status"),
    )


def parse_llm_response(df: DataFrame, col: str = "response") -> tuple[DataFrame, DataFrame]:
    """(ok, rejects): rejects keep the raw answer and say what was wrong."""
    parsed = with_parsed_answer(df, col)
    ok = parsed.filter(F.col("parse_status") == "ok").drop("parse_status")
    rejects = parsed.filter(F.col("parse_status") != "ok").drop(
        "ai_severity", "confidence", "ai_reasoning"
    )
    return ok, rejects


def llm_cost(
    df: DataFrame, in_price: float = INPUT_PRICE, out_price: float = OUTPUT_PRICE
) -> DataFrame:
    cost = F.col("prompt_tokens") * F.lit(in_price) + F.col("completion_tokens") * F.lit(out_price)
    return df.withColumn("cost_usd", cost)


def report_from_json(df: DataFrame, col: str = "report") -> tuple[DataFrame, DataFrame]:
    """(reports, rejects): a report needs all seven fields."""
    parsed = evaluated(df, _objects=X.json_objects(F.col(col), schemas.REPORT)).withColumn(
        "_r", F.when(X.single(F.col("_objects")), F.get("_objects", F.lit(0)))
    )
    complete = F.lit(True)
    for name in schemas.REPORT.fieldNames():
        complete = complete & F.col("_r")[name].isNotNull()
    others = [c for c in df.columns if c != col]
    return parsed.filter(complete).select(*others, "_r.*"), parsed.filter(~complete).select(*df.columns)
