"""The incident table as data: upsert, fold of an append-only history, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import schemas
from wardlight.functions import times
from wardlight.operators.triage import DATA_SOURCE


def last_per_key(df: DataFrame, order: list[str], key: str = "incident_id") -> DataFrame:
    """The last row of each key.

    An aggregate, not a window: partitions combine before the shuffle, so a
    key that holds a large share of the rows sends one row per partition.
    """
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(newest.alias("_last")).select(key, "_last.*")


def _or_default(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def _sides(current: DataFrame, updates: DataFrame, key: str, as_of, fill: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides of an upsert as (key, old) and (key, new), the rows in the incident schema."""
    inserts = {} if not fill else {
        "created_at": _or_default(updates, "created_at", times.moment(as_of)),
        "human_reviewed": _or_default(updates, "human_reviewed", F.lit(False)),
        "data_source": _or_default(updates, "data_source", F.lit(DATA_SOURCE)),
    }

    def incoming(field) -> Column:
        value = inserts.get(field.name)
        if value is None:
            value = F.col(field.name) if field.name in updates.columns else F.lit(None)
        return value.cast(field.dataType)

    fields = schemas.INCIDENT.fields
    old = current.select(key, F.struct(*[
        (F.col(f.name) if f.name in current.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]).alias("old"))
    return old, updates.select(key, F.struct(*[incoming(f).alias(f.name) for f in fields]).alias("new"))


def _upserted(joined: DataFrame, key: str) -> DataFrame:
    """Rows of (key, old, new), either of which may be null, as incidents."""
    def merged(name: str) -> Column:
        winner, other = ("new", "old") if name in schemas.UPSERT_COLUMNS else ("old", "new")
        return F.when(F.col(winner).isNotNull(), F.col(winner)[name]).otherwise(F.col(other)[name])

    fields = [f.name for f in schemas.INCIDENT.fields if f.name != key]
    return joined.select(F.col(key), *[merged(name).alias(name) for name in fields])


def upsert_incidents(
    current: DataFrame,
    updates: DataFrame,
    key: str = "incident_id",
    order: list[str] | None = None,
    as_of=None,
    fill: bool = True,
) -> DataFrame:
    """Insert new keys; on a known key overwrite only the upsert columns.

    With ``order`` the updates may repeat a key and the last one wins; without
    it they must hold each key once. Inserted rows get the defaults of a new
    incident where they are null, unless ``fill`` is off, as for rows that have
    been stored before. Both sides are shuffled by key, which is
    right for updates of the store's order of size; ``upsert_few`` is for a batch.
    """
    if order:
        updates = last_per_key(updates, order, key)
    old, new = _sides(current, updates, key, as_of, fill)
    return _upserted(old.join(new, key, "full_outer"), key)


def upsert_few(
    current: DataFrame, updates: DataFrame, key: str = "incident_id", order: list[str] | None = None, as_of=None, fill: bool = True
) -> DataFrame:
    """The same rows as ``upsert_incidents``, for updates that are few beside the store.

    The updates meet the store in a left join, and again in a semi join on the
    key alone that tells which of them are new. Where the planner broadcasts
    them the store is not shuffled; it is read twice, the second time its key.
    """
    if order:
        updates = last_per_key(updates, order, key)
    old, new = _sides(current, updates, key, as_of, fill)
    known = old.select(key).join(new.select(key), key, "left_semi")
    inserts = new.join(known, key, "left_anti").select(key, F.lit(None).cast(old.schema["old"].dataType).alias("old"), "new")
    return _upserted(old.join(new, key, "left").unionByName(inserts), key)


def fold_history(history: DataFrame, order: list[str], key: str = "incident_id") -> DataFrame:
    """Current incidents from an append-only history of triaged rows.

    The upsert columns come from the last row of a key and everything else
    from its first, which is what a chain of upserts would have left. One
    shuffle, combined per partition first.
    """
    kept = [f.name for f in schemas.INCIDENT.fields if f.name not in (key, *schemas.UPSERT_COLUMNS)]
    at = F.struct(*order)
    folded = history.groupBy(key).agg(
        F.max_by(F.struct(*schemas.UPSERT_COLUMNS), at).alias("_last"),
        F.min_by(F.struct(*kept), at).alias("_first"),
    )
    return folded.select(key, "_last.*", "_first.*").select(*schemas.INCIDENT.fieldNames())


def stamp_feedback(feedback: DataFrame, as_of=None) -> DataFrame:
    """Feedback rows as they are stored: empty original severity, review time."""
    return feedback.select(
        "incident_id",
        F.lit(None).cast("string").alias("original_severity"),
        "human_severity",
        F.coalesce("comment", F.lit("")).alias("comment"),
        times.moment(as_of).alias("reviewed_at"),
    )


def feedback_vs_report(feedback: DataFrame, reports: DataFrame) -> DataFrame:
    """Fill original_severity from the report and say whether the human agreed.

    ``reports`` holds one row per incident_id. A left join: adaptive execution
    splits a hot incident on the feedback side. Where an incident has several
    reports in the course of time, see ``feedback_in_force``.
    """
    labels = reports.select("incident_id", F.col("severity").alias("_label"))
    return feedback.drop("original_severity").join(labels, "incident_id", "left").select(
        "incident_id",
        F.col("_label").alias("original_severity"),
        "human_severity",
        (F.col("_label") == F.col("human_severity")).alias("agrees"),
    )


def feedback_in_force(feedback: DataFrame, reports: DataFrame) -> DataFrame:
    """Feedback against the report that was in force when it was given.

    ``feedback`` has ``reviewed_at``, ``reports`` is (incident_id, severity,
    reported_at) with any number of rows for an incident. The report in force is
    the last one up to that time; of several at one time, the greatest severity
    as text. Feedback given before any report has no original severity. All
    feedback rows stay, those without an id or a time without a report.

    Both kinds of rows meet as one sequence per incident and day, which carries
    the last report on; the reports of earlier days come from one row per
    incident and day. So an incident with very many rows is spread over its days.
    """
    own = [c for c in feedback.columns if c != "original_severity"]
    marks = reports.filter(F.col("reported_at").isNotNull() & F.col("incident_id").isNotNull()).select(
        "incident_id", F.col("reported_at").alias("_at"), F.struct(F.col("severity").alias("label")).alias("_report"))
    asked = feedback.select(*own, F.col("reviewed_at").alias("_at"), F.lit(None).cast(marks.schema["_report"].dataType).alias("_report"))
    rows = asked.withColumn("_asked", F.lit(1)).unionByName(marks.withColumn("_asked", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumn("_day", F.to_date("_at"))
    days = rows.groupBy("incident_id", "_day").agg(
        F.max_by("_report", F.when(F.col("_report").isNotNull(), F.struct("_at", "_report"))).alias("_last"))
    earlier = Window.partitionBy("incident_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("incident_id", "_day", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("incident_id", "_day").orderBy("_at", "_asked", "_report").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("_now", F.last("_report", ignorenulls=True).over(inside)).join(before, ["incident_id", "_day"], "left")
    label = F.coalesce("_now", "_before")["label"]
    return told.filter(F.col("_asked") == 1).select(
        *own, label.alias("original_severity"), (label == F.col("human_severity")).alias("agrees"))
