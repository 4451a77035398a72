"""Raw service requests: paging, shaping, validation, skipping what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import text as X


def in_order(df: DataFrame, key: str = "service_request_id") -> DataFrame:
    """All requests, every page one after the other: descending key order, by ranges of the key."""
    return df.orderBy(F.col(key).desc_nulls_first())


def page(df: DataFrame, limit: int = 10, below=None, key: str = "service_request_id") -> DataFrame:
    """The page of keys below the last one seen (None: the first page), in descending order.

    Each task keeps ``limit`` rows however deep the page is; a null key comes first.
    """
    rest = df if below is None else df.filter(F.col(key) < F.lit(below))
    return in_order(rest, key).limit(limit)


def build_description(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "description",
        X.describe(F.col("service_name"), F.col("service_subtype"), F.col("service_details")),
    )


def resolve_media_url(df: DataFrame) -> DataFrame:
    return df.withColumn("image_url", X.media_link(F.col("media_url")))


def normalize_request(df: DataFrame) -> DataFrame:
    """Raw request -> incident_id, description, address, image_url (plus event columns)."""
    extra = [c for c in df.columns if c not in (
        "service_request_id", "service_name", "service_subtype", "service_details", "address",
        "media_url",
    )]
    shaped = df.transform(build_description).transform(resolve_media_url)
    return shaped.select(
        F.col("service_request_id").cast("string").alias("incident_id"),
        "description",
        F.coalesce("address", F.lit("")).alias("address"),
        "image_url",
        *extra,
    )


def request_is_valid() -> Column:
    return F.col("incident_id").isNotNull() & F.col("description").isNotNull()


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects); a reject names the required fields it lacks."""
    missing = F.concat_ws(
        ",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("description", "incident_id")]
    )
    return df.filter(request_is_valid()), df.filter(~request_is_valid()).withColumn("missing", missing)


def skip_seen(new: DataFrame, stored: DataFrame, key: str = "incident_id") -> DataFrame:
    """Requests whose key is not stored yet.

    The stored table is first reduced to the keys that also occur in ``new``.
    Where the planner knows ``new`` to be small it broadcasts it for that, and
    the stored table is only scanned; two big sides meet in a shuffle join.
    What is left is at most as big as ``new``. Nothing runs before the result
    is asked for.
    """
    seen = stored.select(key).join(new.select(key), key, "left_semi").distinct()
    return new.join(seen, key, "left_anti")
