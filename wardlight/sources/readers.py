"""Sources. Every reader states its schema, so nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import schemas
from wardlight.functions import text as X
from wardlight.operators.common import evaluated
from wardlight.operators.logs import clean_lines


def _reader(spark: SparkSession, stream: bool, schema=None):
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema) if schema is not None else reader


def read_requests(spark: SparkSession, path: str, stream: bool = False, extra: str = "") -> DataFrame:
    """Raw requests from JSON lines; ``extra`` is DDL for further columns."""
    schema = schemas.RAW_REQUEST
    if extra:
        schema = spark.createDataFrame([], schema=extra).schema
        schema = type(schema)(schemas.RAW_REQUEST.fields + schema.fields)
    return _reader(spark, stream, schema).json(path)


def parse_requests(lines: DataFrame, col: str = "line") -> DataFrame:
    """Raw requests from a column of JSON texts, e.g. a message queue's value."""
    others = [c for c in lines.columns if c != col]
    parsed = evaluated(lines, _objects=X.json_objects(F.col(col), schemas.RAW_REQUEST))
    return parsed.select(*others, F.inline(F.when(X.single(F.col("_objects")), F.col("_objects"))))


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Web-server log lines; undecodable bytes are dropped."""
    return clean_lines(_reader(spark, stream).text(path).withColumnRenamed("value", "line"))


def parse_json_logs(lines: DataFrame, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) from a column of JSON log lines."""
    others = [c for c in lines.columns if c != col]
    parsed = evaluated(lines, _objects=X.json_objects(F.col(col), schemas.SERVICE_LOG))
    objects = F.col("_objects")
    records = parsed.select(*others, F.inline(F.when(X.single(objects), objects)))
    at = F.rtrim("timestamp", F.lit("Z")).try_cast("timestamp_ntz")
    return records.withColumn("timestamp", at), parsed.filter(~X.single(objects)).select(*lines.columns)


def read_json_logs(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of structured service logs, one JSON object per line."""
    return parse_json_logs(_reader(spark, stream).text(path).withColumnRenamed("value", "line"))


def read_metrics(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Metric samples from parquet: ts, name, labels, value."""
    return _reader(spark, stream, schemas.METRIC).parquet(path)


def read_runbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every runbook below a folder as (doc_id, text), one row per file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return as_runbooks(files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))


def as_runbooks(docs: DataFrame) -> DataFrame:
    """Documents that hold text, as runbooks."""
    return docs.select("doc_id", "text").filter(F.length(X.strip(F.col("text"))) > 0)
