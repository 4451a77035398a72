"""Sinks that survive a retry: a batch always writes the same place whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight import schemas
from wardlight.operators.store import fold_history, stamp_feedback, upsert_few, upsert_incidents
from wardlight.sources import snapshots


def append_feedback(feedback: DataFrame, path: str, as_of=None, batch_id: int | None = None) -> None:
    """Append feedback; a caller that may try again names its batch, which then is stored once."""
    stamped = stamp_feedback(feedback, as_of)
    if batch_id is None:
        stamped.write.mode("append").parquet(path)
    else:
        write_batch(stamped, path, batch_id)


def write_batch(df: DataFrame, path: str, batch_id: int, by: str | None = None) -> None:
    """Write one batch to its own folder; writing it again replaces it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written so far, with their batch_id; empty before the first."""
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not folder_exists(spark, path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


_ORDER = ("batch_id", "created_at", "description", "transformation_log")


def read_incidents(spark: SparkSession, history: str, order: tuple[str, ...] = _ORDER) -> DataFrame:
    """Current incidents from a folder of triaged batches.

    The committed snapshot holds the batches up to some point folded; those
    after it are folded here and put on top. A later batch wins; the further
    columns only settle a key that a batch holds twice. A reader works on the
    snapshot that held when this was called, whatever is committed meanwhile.
    """
    now = snapshots.latest(spark, history)
    later = fold_history(snapshots.later_rows(spark, history, now, schemas.INCIDENT), list(order))
    if not now.folders:
        return later
    return upsert_few(snapshots.folded_rows(spark, now, schemas.INCIDENT), later, fill=False).select(*schemas.INCIDENT.fieldNames())


def compact_history(
    spark: SparkSession, history: str, target: str | None = None, buckets: int = snapshots.BUCKETS, through: int | None = None
) -> snapshots.Snapshot | None:
    """Fold the history's batches into its snapshot and commit that; nothing that is read is overwritten.

    Streams may go on writing batches and readers reading. The last batch is
    left in the log, since its stream may write it again, unless ``through``
    names it. Only the buckets of keys in the folded batches are rewritten;
    ``snapshots.vacuum`` deletes what is no longer needed. With a ``target``
    folder nothing is committed: it gets a copy of the incidents as one batch.
    """
    if target is not None:
        write_batch(read_incidents(spark, history), target, -1)
        return None
    return snapshots.compact(
        spark, history, schemas.INCIDENT, "incident_id", lambda rows: fold_history(rows, list(_ORDER)),
        lambda old, new: upsert_incidents(old, new, fill=False).select(*schemas.INCIDENT.fieldNames()), buckets, through)


def write_incidents(incidents: DataFrame, path: str) -> None:
    """Incidents laid out by source and day, so time filters prune files.

    The rebalance hint gathers each (source, day) and lets adaptive execution
    split the big ones and join the small ones into files of a good size.
    """
    dated = incidents.withColumn("created_on", F.to_date("created_at"))
    dated.hint("rebalance", "data_source", "created_on").write.mode("errorifexists").partitionBy(
        "data_source", "created_on").parquet(path)
