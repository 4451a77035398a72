"""Streams of requests: new ones only, and triage into the incident history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardlight import schemas
from wardlight.functions import times
from wardlight.operators import answers, privacy, requests, reviews, triage
from wardlight.sources import snapshots
from wardlight.sources.sinks import folder_exists, read_batches, write_batch
from wardlight.streaming.base import each_batch


KEYS = T.StructType([schemas.REQUEST["incident_id"]])


def _indexed(spark: SparkSession, stored: str, keys: str, batch_id: int, buckets: int) -> snapshots.Snapshot:
    """The key index as it is committed; a store that is older than its index is entered first."""
    if not folder_exists(spark, keys) and folder_exists(spark, stored):
        older = read_batches(spark, stored, schemas.REQUEST).filter(F.col("batch_id") < batch_id).select("incident_id").distinct()
        return snapshots.begin(spark, keys, older, "incident_id", batch_id - 1, buckets)
    return snapshots.latest(spark, keys, buckets)


def seen_keys(spark: SparkSession, keys: str, batch_id: int, touched: list[int], index: snapshots.Snapshot) -> DataFrame:
    """Keys of the given buckets that batches before this one have stored; no other bucket is read."""
    later = snapshots.later_rows(spark, keys, index, KEYS, before=batch_id, only=touched).select("incident_id")
    return snapshots.folded_rows(spark, index, KEYS, touched).union(later)


def compact_keys(spark: SparkSession, keys: str, buckets: int = snapshots.BUCKETS) -> snapshots.Snapshot:
    """Fold the key batches into the committed index, a file or few for each bucket with new keys."""
    return snapshots.compact(
        spark, keys, KEYS, "incident_id", lambda rows: rows.select("incident_id").distinct(),
        lambda old, new: old.union(new), buckets)


def stream_ingest(
    raw: DataFrame, stored: str, checkpoint: str, trigger: dict | None = None, keys: str | None = None,
    buckets: int = snapshots.BUCKETS, compact_every: int = 50,
) -> StreamingQuery:
    """Append the requests whose id was never stored, each once.

    Repeats inside a batch are dropped by key. Those of earlier batches are
    found in an index of the stored keys in buckets (folder ``keys``): a batch
    reads the buckets that its own ids fall into and none of the stored rows.
    The index is compacted every so many batches. There is no growing stream
    state, and a request that arrives late is kept however late it is. Requests
    without an id or description are left out, as ``validate_requests`` does. A
    batch that runs again looks only at earlier ones and writes the same rows.
    """
    spark = raw.sparkSession
    keys = keys or f"{stored.rstrip('/')}/_keys"
    shaped = requests.normalize_request(raw).select(*schemas.REQUEST.fieldNames())

    def handle(batch: DataFrame, batch_id: int) -> None:
        valid, _ = requests.validate_requests(batch)
        once = valid.groupBy("incident_id").agg(
            F.min(F.struct("description", "address", "image_url")).alias("_r")
        ).select("incident_id", "_r.*")
        index = _indexed(spark, stored, keys, batch_id, buckets)
        bucket = snapshots.bucket_of(F.col("incident_id"), index.buckets)
        once.persist()  # read for its buckets, for the join and for the write
        touched = [r[0] for r in once.select(bucket).distinct().collect()]
        write_batch(requests.skip_seen(once, seen_keys(spark, keys, batch_id, touched, index)), stored, batch_id)
        once.unpersist()
        new = spark.read.schema(KEYS).parquet(f"{stored}/batch_id={batch_id}")
        write_batch(new.withColumn("bucket", bucket).repartition("bucket"), keys, batch_id, by="bucket")
        if batch_id and batch_id % compact_every == 0:
            compact_keys(spark, keys, buckets)

    return each_batch(shaped, handle, checkpoint, trigger=trigger)


def stream_triage(
    shaped: DataFrame,
    responses: DataFrame | Callable[[], DataFrame] | None,
    history: str,
    checkpoint: str,
    as_of=None,
    rejects: str | None = None,
    pending: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Triage every micro-batch into an append-only history.

    ``responses`` holds (incident_id, response), or is a function that reads
    them anew for every batch; without it the requests carry the response.
    Requests that are not answered yet go to the ``pending`` folder (below the
    history unless another is named) and are tried again with the next batch
    that brings requests, so an answer may come later and none is lost;
    ``stream_answers`` takes answers as a stream of their own.
    ``sinks.read_incidents`` folds the history to current incidents with the
    meaning of an upsert; ``sinks.compact_history`` shortens it. Unreadable
    answers go to ``rejects`` when a folder is given.
    """
    spark = shaped.sparkSession
    if responses is not None and pending is None:
        pending = f"{history.rstrip('/')}/_pending"

    def waiting(batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch and what the one before has left over."""
        if pending is None or not folder_exists(spark, f"{pending}/batch_id={batch_id - 1}"):
            return batch
        left = spark.read.schema(batch.schema).parquet(f"{pending}/batch_id={batch_id - 1}")
        return batch.unionByName(left)

    def handle(batch: DataFrame, batch_id: int) -> None:
        joined = batch
        if responses is not None:
            known = responses() if callable(responses) else responses
            asked = waiting(batch, batch_id)
            if pending is not None:
                write_batch(triage.pending(asked, known), pending, batch_id)
            joined = asked.join(known.select("incident_id", "response"), "incident_id")
        joined.persist()  # read for the history and for the rejects
        write_batch(triage.triage(joined, as_of=as_of), history, batch_id)
        if rejects is not None:
            bad = answers.parse_llm_response(privacy.redact_pii(joined))[1]
            write_batch(bad.select("incident_id", "response", "parse_status"), rejects, batch_id)
        joined.unpersist()

    return each_batch(shaped, handle, checkpoint, trigger=trigger)


UNANSWERED = "unanswered"


def _timed(stream: DataFrame, at: str, clock: DataFrame | None, delay: str) -> DataFrame:
    """A stream with a join key and its event time as watermark, and rows of a clock that only move it on.

    No key is null, and those of the clock and of rows without an id equal none
    of the other side; the clock's are made from its times, since the optimizer
    would drop rows whose keys are constants that cannot match before they
    reach the watermark.
    """
    rows = stream.withColumn(at, F.coalesce(times.local(F.col(at)).cast("timestamp"), F.current_timestamp())).withColumn(
        "_key", F.coalesce(F.concat(F.lit("id:"), "incident_id"), F.lit(f"none:{at}")))
    if clock is not None:
        moment = times.local(F.col("ts")).cast("timestamp")
        ticks = clock.select(moment.alias(at), F.concat(F.lit(f"clock:{at}:"), F.col("ts").cast("string")).alias("_key"))
        rows = rows.unionByName(ticks, allowMissingColumns=True)
    return rows.withWatermark(at, delay)


def stream_answers(
    shaped: DataFrame,
    replies: DataFrame,
    history: str,
    checkpoint: str,
    rejects: str,
    wait: str = "1 hour",
    delay: str = "10 minutes",
    clock: DataFrame | None = None,
    as_of=None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Triage requests whose answers arrive on a stream of their own, before them or after.

    ``shaped`` has an event time ``asked_at``, ``replies`` is (incident_id,
    response, answered_at). An answer belongs to a request if their times are at
    most ``wait`` apart. Both sides wait for each other in the state of an outer
    join, which the watermarks bound: a request is given up, and goes to
    ``rejects`` as unanswered, once both streams are ``wait`` and ``delay``
    beyond its time. A side on which nothing arrives would hold the other's
    watermark back; a ``clock``, a stream of rows with a time ``ts`` such as the
    rate source, moves both on, so that requests are given up although no
    further request or answer comes. Until then they stay in the checkpointed
    state. A row without a time counts from when it is read, a request without
    an id is given up like any other, and rows that come later than ``delay``
    are dropped, as in any join by event time. Several answers to one request
    are several triaged rows, and ``sinks.read_incidents`` keeps the last.
    """
    asked = _timed(shaped.withColumn("_real", F.lit(True)), "asked_at", clock, delay)
    told = _timed(replies.select("incident_id", "response", "answered_at"), "answered_at", clock, delay).select(
        F.col("_key").alias("_answered"), "response", "answered_at")
    span = F.expr(f"INTERVAL '{times.seconds_of(wait)}' SECOND")
    near = (F.col("answered_at") >= F.col("asked_at") - span) & (F.col("answered_at") <= F.col("asked_at") + span)
    joined = asked.join(told, (F.col("_key") == F.col("_answered")) & near, "left_outer")

    def handle(rows: DataFrame, batch_id: int) -> None:
        batch = rows.filter(F.col("_real")).persist()  # read for the history and for the rejects
        answered = batch.filter(F.col("_answered").isNotNull())
        write_batch(triage.triage(answered.drop("_answered", "_key", "_real"), as_of=as_of), history, batch_id)
        bad = answers.parse_llm_response(privacy.redact_pii(answered))[1].select("incident_id", "asked_at", "response", "parse_status")
        given_up = batch.filter(F.col("_answered").isNull()).select(
            "incident_id", "asked_at", "response", F.lit(UNANSWERED).alias("parse_status"))
        write_batch(bad.unionByName(given_up), rejects, batch_id)
        batch.unpersist()

    return each_batch(joined, handle, checkpoint, trigger=trigger)


FOLD = T.StructType([
    T.StructField("incident_id", T.StringType()),
    *[T.StructField(name, T.StructType([
        T.StructField("ts", T.TimestampNTZType()), T.StructField("seq", T.LongType()), *values,
    ])) for name, values in (
        ("last", [T.StructField("needs", T.BooleanType())]),
        ("override", [T.StructField("severity", T.StringType()), T.StructField("note", T.StringType())]),
        ("closed", [T.StructField("actor", T.StringType())]),
    )],
])


def stream_reviews(actions: DataFrame, folds: str, checkpoint: str, compact_every: int = 50, trigger: dict | None = None) -> StreamingQuery:
    """Fold review actions as they arrive, one row per incident and micro-batch.

    The parts merge in any order (``reviews.merge_folds``), so an action that
    arrives late still takes its place by its own time; no watermark is needed
    and none is dropped. ``read_reviews`` merges what the batches left, and the
    parts are folded into a committed snapshot every so many batches.
    """
    spark = actions.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(reviews.review_fold(batch).select(*[F.col(f.name).cast(f.dataType) for f in FOLD]), folds, batch_id)
        if batch_id and batch_id % compact_every == 0:
            compact_reviews(spark, folds)

    return each_batch(actions, handle, checkpoint, trigger=trigger)


def compact_reviews(spark: SparkSession, folds: str, buckets: int = snapshots.BUCKETS) -> snapshots.Snapshot:
    """Fold the written parts into the committed snapshot; only buckets of incidents with new actions are rewritten."""
    return snapshots.compact(
        spark, folds, FOLD, "incident_id", reviews.merge_folds, lambda old, new: reviews.merge_folds(old.unionByName(new)), buckets)


def read_reviews(spark: SparkSession, folds: str) -> DataFrame:
    """One fold per incident over all that has arrived, for ``reviews.apply_fold``."""
    now = snapshots.latest(spark, folds)
    later = snapshots.later_rows(spark, folds, now, FOLD).drop("batch_id")
    return reviews.merge_folds(snapshots.folded_rows(spark, now, FOLD).unionByName(later))
