"""Human review: fold of actions onto incidents, and the audit trail as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import times

# Fixed value: the note of a reclassification that gives none.
DEFAULT_NOTE = "Manual human reclassification"

# Words that tell the kinds of audit entries apart.
ENTRY_KINDS = {
    "initial": "Initial Severity classified as",
    "policy": "Policy Override to",
    "human": "HUMAN_OVERRIDE to",
}

ENTRY_START = r"\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] "


def _entry() -> Column:
    """The audit line of a reclassification."""
    return F.concat(
        F.lit("["), times.stamp(F.col("action_ts")), F.lit("] HUMAN_OVERRIDE to "),
        F.coalesce("new_severity", F.lit("None")), F.lit(" by "), F.col("actor"),
        F.lit(" (Note: "), F.coalesce("reviewer_notes", F.lit(DEFAULT_NOTE)), F.lit(")\n"),
    )


def review_entries(actions: DataFrame) -> DataFrame:
    """One audit entry per reclassification: the trail in append-only form."""
    return actions.filter(F.col("action") == "reclassify").select(
        "incident_id", "action_ts", "seq", _entry().alias("entry")
    )


def review_fold(actions: DataFrame) -> DataFrame:
    """What the review actions of each incident come to, as a part that further parts can be merged with.

    Every value carries the (time, seq) of its action, so parts may be merged in
    any order, whatever the order in which actions arrived: ``last`` decides the
    review flag, ``override`` severity and notes, ``closed`` the reviewer.
    """
    known = actions.filter(F.col("action").isin("approve", "reject", "reclassify"))
    closes = F.col("action").isin("approve", "reclassify")
    note = F.coalesce("reviewer_notes", F.lit(DEFAULT_NOTE))
    order = F.struct("action_ts", "seq")
    at = (F.col("action_ts").alias("ts"), F.col("seq").alias("seq"))
    return known.groupBy("incident_id").agg(
        F.max_by(F.struct(*at, (~closes).alias("needs")), order).alias("last"),
        F.max_by(
            F.struct(*at, F.col("new_severity").alias("severity"), note.alias("note")), F.when(F.col("action") == "reclassify", order)
        ).alias("override"),
        F.max_by(F.struct(*at, F.col("actor").alias("actor")), F.when(closes, order)).alias("closed"),
    )


def merge_folds(parts: DataFrame) -> DataFrame:
    """Parts of ``review_fold``, of several batches, as one row per incident."""
    def latest(name: str) -> Column:
        order = F.when(F.col(name).isNotNull(), F.struct(F.col(name)["ts"], F.col(name)["seq"]))
        return F.max_by(name, order).alias(name)

    return parts.groupBy("incident_id").agg(*map(latest, ("last", "override", "closed")))


def apply_fold(incidents: DataFrame, fold: DataFrame) -> DataFrame:
    """Incidents after the actions that ``fold`` holds, one row per incident."""
    parts = fold.select("incident_id", *[F.col(c).alias(f"_{c}") for c in ("last", "override", "closed")])
    joined = incidents.join(parts, "incident_id", "left")
    last, override, closed = F.col("_last"), F.col("_override"), F.col("_closed")

    def old(name: str, kind: str):
        return F.col(name) if name in incidents.columns else F.lit(None).cast(kind)

    changed = {
        "severity": F.when(override.isNotNull(), override["severity"]).otherwise(F.col("severity")),
        "human_reviewed": F.coalesce(old("human_reviewed", "boolean"), F.lit(False)) | closed.isNotNull(),
        "needs_review": F.coalesce(last["needs"], old("needs_review", "boolean")),
        "reviewer_notes": F.coalesce(override["note"], old("reviewer_notes", "string")),
        "reviewed_by": F.coalesce(closed["actor"], old("reviewed_by", "string")),
        "reviewed_at": F.coalesce(closed["ts"], old("reviewed_at", "timestamp_ntz")),
    }
    kept = [c for c in incidents.columns if c not in changed]
    return joined.select(*kept, *[c.alias(name) for name, c in changed.items()])


def apply_reviews(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Incidents after approve / reject / reclassify actions in (time, seq) order.

    The fold is written as aggregates that combine before the shuffle: the
    review flag follows the last action, severity and notes the last
    reclassification. The audit text is not touched; the trail is rows, see
    ``audit_trail``. ``streaming.intake.stream_reviews`` is the form for
    actions that arrive on a stream.
    """
    return apply_fold(incidents, review_fold(actions))


def audit_trail(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """All audit entries as rows: those in the stored text, then those of review actions.

    (part, position) orders the entries of an incident: part 0 is the stored
    text in its own order, part 1 the actions by ``entry_ts``, then by their
    sequence number. There is no gathering, so an incident may have any number.
    """
    stored = split_audit_log(incidents).select(
        "incident_id", F.lit(0).alias("part"), F.col("position").cast("long").alias("position"), "entry_ts", "kind", "entry")
    text = F.regexp_replace(F.substr(F.col("entry"), F.lit(23)), r"\n\z", "")
    added = review_entries(actions).select(
        "incident_id", F.lit(1).alias("part"), F.col("seq").cast("long").alias("position"),
        F.date_trunc("second", "action_ts").cast("timestamp_ntz").alias("entry_ts"), F.lit("human").alias("kind"), text.alias("entry"))
    return stored.unionByName(added)


def split_audit_log(df: DataFrame, col: str = "transformation_log") -> DataFrame:
    """One row per audit entry, whether or not entries end with a newline."""
    pieces = F.filter(F.split(F.col(col), rf"\n?(?={ENTRY_START})"), lambda p: p != "")
    rows = df.select("incident_id", F.posexplode(pieces).alias("position", "_piece"))
    body = F.regexp_replace(F.substr(F.col("_piece"), F.lit(23)), r"\n\z", "")
    kind = F.lit("other")
    for name, words in ENTRY_KINDS.items():
        kind = F.when(F.startswith(body, F.lit(words)), F.lit(name)).otherwise(kind)
    return rows.select(
        "incident_id",
        "position",
        F.substring("_piece", 2, 19).try_cast("timestamp_ntz").alias("entry_ts"),
        kind.alias("kind"),
        body.alias("entry"),
    )
