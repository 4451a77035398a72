"""Metrics of the model service: counts, cost, latency, rates on a time grid.

Samples are reduced to one row per (series, grid second) with a combining
aggregate before any window runs, so what a window sorts is bounded by the time
span of a series and not by how many samples it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions import times
from wardlight.operators.answers import INPUT_PRICE, OUTPUT_PRICE

# Upper bounds of latency buckets in seconds; +Inf follows.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

# The labels that enter the entropy.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# A gauge counts as gone when it has no sample for this long.
LOOKBACK = "5 minutes"


# ---- counts and cost ----

def severity_distribution(df: DataFrame, col: str = "ai_severity") -> DataFrame:
    return df.groupBy(F.col(col).alias("severity")).agg(F.count(F.lit(1)).alias("incidents"))


def severity_entropy(df: DataFrame, col: str = "ai_severity") -> DataFrame:
    """Entropy in nats over the four known labels; null without any such row."""
    return entropy_of(severity_distribution(df.filter(F.col(col).isin(*SEVERITIES)), col))


def entropy_of(counts: DataFrame) -> DataFrame:
    """Entropy from (severity, incidents) rows, such as a stream's running totals.

    With n per label and N in total, -sum(n/N ln(n/N)) = ln N - sum(n ln n)/N,
    which needs one pass over at most four counts.
    """
    n = F.col("incidents")
    known = counts.filter(F.col("severity").isin(*SEVERITIES) & (n > 0))
    sums = known.agg(F.sum(n).alias("_n"), F.sum(n * F.ln(n)).alias("_nln"))
    return sums.select(
        F.coalesce("_n", F.lit(0)).alias("incidents"),
        (F.ln("_n") - F.col("_nln") / F.col("_n")).alias("entropy"),
    )


def _usage(calls: DataFrame) -> list[Column]:
    retries = F.col("retries") if "retries" in calls.columns else F.lit(0)
    return [
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.coalesce(F.sum(retries), F.lit(0)).cast("long").alias("retries"),
    ]


def _cost(in_price: float, out_price: float) -> Column:
    # from the token sums: whole numbers add up the same in any order
    return F.col("input_tokens") * F.lit(in_price) + F.col("output_tokens") * F.lit(out_price)


def token_cost_totals(
    calls: DataFrame, by: Sequence[str] = (), in_price: float = INPUT_PRICE, out_price: float = OUTPUT_PRICE
) -> DataFrame:
    return calls.groupBy(*by).agg(*_usage(calls)).withColumn("cost_usd", _cost(in_price, out_price))


def cost_rollup(
    calls: DataFrame, by: Sequence[str] = (), in_price: float = INPUT_PRICE, out_price: float = OUTPUT_PRICE
) -> DataFrame:
    """Cost per request, per second of the observed span, and projected per day."""
    at = times.micros(F.col("ts"))
    span = (F.max(at) - F.min(at)) / F.lit(1_000_000.0)
    sums = calls.groupBy(*by).agg(*_usage(calls), span.alias("seconds"))
    per_second = F.try_divide("cost_usd", "seconds")
    return sums.withColumn("cost_usd", _cost(in_price, out_price)).select(
        *by,
        "calls",
        "cost_usd",
        F.try_divide(F.col("cost_usd"), F.col("calls")).alias("cost_per_request"),
        per_second.alias("cost_per_second"),
        (per_second * F.lit(86400.0)).alias("cost_per_day"),
    )


def request_counts(calls: DataFrame, by: str = "instance") -> DataFrame:
    """Requests received and, for the ones that did not fail, rows stored."""
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") < 500).alias("db_connections"),
    )


def latest_rows(calls: DataFrame, by: Sequence[str] = ("severity",)) -> DataFrame:
    """Time and confidence of the last call per label; equal times go to the larger value."""
    return calls.groupBy(*by).agg(F.max(F.struct("ts", "confidence")).alias("_last")).select(*by, "_last.*")


def latest_confidence(calls: DataFrame, by: Sequence[str] = ("severity",)) -> DataFrame:
    """The last confidence per label, also from the ``latest_rows`` of several batches."""
    return latest_rows(calls, by).drop("ts")


def _bucket(bucket: str) -> Column:
    return F.window(F.col("ts"), bucket)["start"]


def severity_over_time(df: DataFrame, bucket: str = "1 hour", col: str = "severity") -> DataFrame:
    return df.groupBy(_bucket(bucket).alias("bucket_start"), F.col(col).alias("severity")).agg(
        F.count(F.lit(1)).alias("incidents")
    )


def availability(calls: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Share of requests that did not end in a 5xx status, per bucket."""
    good = F.count_if(F.col("status") < 500)
    return calls.groupBy(_bucket(bucket).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("requests"), (good / F.count(F.lit(1))).alias("availability")
    )


def usage_over_time(
    calls: DataFrame, bucket: str = "1 hour", by: Sequence[str] = (), in_price: float = INPUT_PRICE, out_price: float = OUTPUT_PRICE
) -> DataFrame:
    """Tokens, calls, errors, retries and cost per bucket."""
    sums = calls.groupBy(_bucket(bucket).alias("bucket_start"), *by).agg(*_usage(calls))
    return sums.withColumn("cost_usd", _cost(in_price, out_price))


def latency_over_time(
    calls: DataFrame, bucket: str = "1 hour", by: Sequence[str] = ("kind",), q: float = 0.95, bounds: Sequence[float] = BOUNDS
) -> DataFrame:
    """A quantile of the durations per bucket and kind of call, from bucket counts."""
    return latency_quantile(calls, q, [_bucket(bucket).alias("bucket_start"), *by], bounds)


def entropy_over_time(df: DataFrame, bucket: str = "1 hour", col: str = "severity") -> DataFrame:
    """Entropy of the known labels per bucket; a bucket without any has no row."""
    n = F.col("incidents")
    counts = severity_over_time(df, bucket, col).filter(F.col("severity").isin(*SEVERITIES))
    sums = counts.groupBy("bucket_start").agg(F.sum(n).alias("incidents"), F.sum(n * F.ln(n)).alias("_nln"))
    return sums.select("bucket_start", "incidents", (F.ln("incidents") - F.col("_nln") / F.col("incidents")).alias("entropy"))


# ---- histograms and quantiles ----

def _counts_up_to(col: str, bounds: Sequence[float]) -> list[Column]:
    return [F.count_if(F.col(col) <= F.lit(float(b))) for b in bounds] + [
        F.count_if(F.col(col).isNotNull())
    ]


def bucket_counts(
    df: DataFrame, by: Sequence, bounds: Sequence[float] = BOUNDS, col: str = "duration_s"
) -> DataFrame:
    """Cumulative counts per bound, one column each: b0, b1, ..., the last is +Inf.

    One hash aggregate over plain long buffers; rows are never multiplied.
    """
    aggs = [c.alias(f"b{i}") for i, c in enumerate(_counts_up_to(col, bounds))]
    return df.groupBy(*by).agg(*aggs)


def latency_histogram(
    df: DataFrame, bounds: Sequence[float] = BOUNDS, col: str = "duration_s", by: Sequence[str] = ()
) -> DataFrame:
    """Rows (by, le, cumulative); the bounds are exploded after the aggregate."""
    labels = [f"{b:g}" for b in bounds] + ["+Inf"]
    wide = bucket_counts(df, by, bounds, col)
    rows = F.array(*[
        F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, le in enumerate(labels)
    ])
    return wide.select(*by, F.inline(rows))


def quantile_of(counts: Column, bounds: Sequence[float], q: float) -> Column:
    """Quantile by linear interpolation inside cumulative buckets.

    ``counts`` has one entry per bound plus +Inf. A rank in the +Inf bucket
    gives the highest bound; no observations give null.
    """
    tops = F.array(*[F.lit(float(b)) for b in bounds])
    last = len(bounds)
    total = F.get(counts, F.lit(last))
    rank = F.lit(float(q)) * total
    at = F.array_position(F.transform(counts, lambda c: c >= rank), True).cast("int") - 1
    low = F.when(at == 0, F.lit(0.0)).otherwise(F.get(tops, at - 1))
    under = F.when(at == 0, F.lit(0)).otherwise(F.get(counts, at - 1))
    inside = low + (F.get(tops, at) - low) * F.try_divide(rank - under, F.get(counts, at) - under)
    return F.when(total > 0, F.when(at == last, F.lit(float(bounds[-1]))).otherwise(inside))


def latency_quantile(
    df: DataFrame, q: float = 0.95, by: Sequence = (), bounds: Sequence[float] = BOUNDS,
    col: str = "duration_s",
) -> DataFrame:
    wide = bucket_counts(df, by, bounds, col)
    counts = F.array(*[F.col(f"b{i}") for i in range(len(bounds) + 1)])
    keep = [c for c in wide.columns if c not in {f"b{i}" for i in range(len(bounds) + 1)}]
    return wide.select(
        *keep, F.col(f"b{len(bounds)}").alias("observations"), quantile_of(counts, bounds, q).alias("quantile")
    )


def histogram_quantile(buckets: DataFrame, q: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Quantile from long bucket rows (by, le, cumulative), le as text with +Inf.

    A group has one row per bound, so ranking it with a window stays small.
    """
    key = list(by) or [F.lit(1)]
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    w = Window.partitionBy(*key).orderBy("_le")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = buckets.withColumn("_le", le).withColumns({
        "_rank": F.lit(float(q)) * F.max("cumulative").over(everything),
        "_low": F.coalesce(F.lag("_le").over(w), F.lit(0.0)),
        "_under": F.coalesce(F.lag("cumulative").over(w), F.lit(0)),
        "_top": F.max(F.when(F.col("_le") < float("inf"), F.col("_le"))).over(everything),
    })
    hit = (F.col("cumulative") >= F.col("_rank")) & (F.col("_under") < F.col("_rank"))
    share = F.try_divide(F.col("_rank") - F.col("_under"), F.col("cumulative") - F.col("_under"))
    value = F.when(F.col("_le") == float("inf"), F.col("_top")).otherwise(
        F.col("_low") + (F.col("_le") - F.col("_low")) * share
    )
    return ranked.groupBy(*by).agg(F.min_by(value, F.when(hit, F.col("_le"))).alias("quantile"))


# ---- rates on the grid ----

def slices(df: DataFrame, by: Sequence[str], step: str | int, **sums: Column) -> DataFrame:
    """One row per (series, tick) with the given aggregates."""
    return df.groupBy(*by, times.tick_of(F.col("ts"), step).alias("tick")).agg(
        *[c.alias(name) for name, c in sums.items()]
    )


def series_order(by: Sequence[str]) -> Window:
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy("tick")


def last_tick(rows: DataFrame) -> Column:
    """The last tick of all series: up to there rules are evaluated."""
    return rows.agg(F.max("tick")).scalar()


def end_of(samples: DataFrame, step: str | int) -> Column:
    """The last tick of all raw rows: the end of an evaluation over them, from one narrow scan."""
    return samples.agg(times.tick_of(F.max("ts"), step)).scalar()


def dense(
    rows: DataFrame, by: Sequence[str], step: str | int, reach: str | int, end: Column | None = None
) -> DataFrame:
    """Repeat each row of a series at the grid seconds up to the next row, the last one up to ``end``.

    ``reach`` limits how far, so a series that pauses or stops leaves a gap and
    a rare sample does not become a long run of rows. ``end`` is the end of the
    evaluation, by default the last tick of all series. ``is_sample`` marks the
    rows that were there.
    """
    width = times.seconds_of(step)
    furthest = F.col("tick") + F.lit(max(times.seconds_of(reach) - width, 0))
    end = last_tick(rows) if end is None else end
    until = F.coalesce(F.lead("tick").over(series_order(by)) - F.lit(width), F.greatest(end, F.col("tick")))
    others = [c for c in rows.columns if c != "tick"]
    return rows.withColumn("_to", F.least(until, furthest)).select(
        *others, F.col("tick").alias("_from"),
        F.explode(F.sequence(F.col("tick"), F.col("_to"), F.lit(width).cast("long"))).alias("tick"),
    ).withColumn("is_sample", F.col("tick") == F.col("_from")).drop("_from")


def rolling(
    rows: DataFrame, by: Sequence[str], step: str | int, window: str | int, cols: Sequence[str],
    end: Column | None = None,
) -> DataFrame:
    """Sums over the window that ends at each grid second.

    A series has rows from its first tick on, except where its window is empty;
    after its last sample the window empties, up to the end of the evaluation.
    """
    back = times.seconds_of(window) - times.seconds_of(step)
    frame = series_order(by).rangeBetween(-back, 0)
    filled = dense(rows, by, step, window, end)
    return filled.select(*by, "tick", *[
        F.sum(F.when(F.col("is_sample"), F.col(c)).otherwise(F.lit(0))).over(frame).alias(c) for c in cols
    ])


def counter_slices(samples: DataFrame, by: Sequence[str], step: str | int) -> DataFrame:
    """Growth of a counter per (series, tick); after a reset the new value counts.

    Differences inside a tick are taken within (series, tick), so a series with
    very many samples is spread over its ticks; the step from one tick to the
    next only looks at each tick's first and last sample.
    """
    rows = samples.withColumn("tick", times.tick_of(F.col("ts"), step))
    inside = Window.partitionBy(*by, "tick").orderBy("ts", "value")
    before = F.lag("value").over(inside)

    def growth(now: Column, prior: Column) -> Column:
        return F.when(now >= prior, now - prior).when(now < prior, now).otherwise(F.lit(0.0))

    per_tick = rows.withColumn("_grown", growth(F.col("value"), before)).groupBy(*by, "tick").agg(
        F.sum("_grown").alias("_inner"),
        F.min_by("value", F.struct("ts", "value")).alias("_first"),
        F.max_by("value", F.struct("ts", "value")).alias("_last"),
    )
    across = growth(F.col("_first"), F.lag("_last").over(series_order(by)))
    return per_tick.select(*by, "tick", (F.col("_inner") + across).alias("growth"))


def increase(
    samples: DataFrame, window: str | int = "15 minutes", step: str | int = 15,
    by: Sequence[str] = ("name", "instance"),
) -> DataFrame:
    grown = counter_slices(samples, by, step)
    return rolling(grown, by, step, window, ["growth"], end_of(samples, step)).withColumnRenamed("growth", "increase")


def rate(
    samples: DataFrame, window: str | int = "5 minutes", step: str | int = 15,
    by: Sequence[str] = ("name", "instance"),
) -> DataFrame:
    """Growth per second of a counter over a sliding window."""
    seconds = float(times.seconds_of(window))
    return increase(samples, window, step, by).select(
        *by, "tick", (F.col("increase") / F.lit(seconds)).alias("rate")
    )


def event_rate(
    events: DataFrame, window: str | int = "5 minutes", step: str | int = 15, by: Sequence[str] = ("instance",)
) -> DataFrame:
    """Events per second over a sliding window, straight from the events."""
    counted = slices(events, by, step, events=F.count(F.lit(1)))
    seconds = float(times.seconds_of(window))
    return rolling(counted, by, step, window, ["events"], end_of(events, step)).withColumn(
        "rate", F.col("events") / F.lit(seconds)
    )


def gauge_ticks(
    samples: DataFrame, by: Sequence[str], step: str | int, lookback: str | int = LOOKBACK, col: str = "value",
    end: Column | None = None,
) -> DataFrame:
    """The last known value of a gauge at each grid second, until it goes stale."""
    end = end_of(samples, step) if end is None else end
    latest = slices(samples, by, step, value=F.max_by(F.col(col), F.struct("ts", col)))
    return dense(latest, by, step, lookback, end).select(*by, "tick", "value")


def signal_anomalies(calls: DataFrame, bucket: str = "1 hour", z: float = 3.0, trail: int = 24) -> DataFrame:
    """Traffic drops, token spikes and latency jumps against the trailing buckets."""
    per_bucket = calls.groupBy(_bucket(bucket).alias("bucket_start")).agg(
        F.count(F.lit(1)).cast("double").alias("traffic"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("double").alias("tokens"),
        (F.sum(F.round(F.col("duration_s") * 1_000_000).cast("long")) / F.count(F.lit(1)) / 1e6).alias("latency"),
    )
    # a bucket without a call has no traffic, which is the strongest drop; its latency is unknown
    span = per_bucket.agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"))
    grid = span.filter("lo IS NOT NULL").select(
        F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL '{times.seconds_of(bucket)}' SECOND"))).alias("bucket_start"))
    per_bucket = grid.join(per_bucket, "bucket_start", "left").withColumns({
        c: F.coalesce(c, F.lit(0.0)) for c in ("traffic", "tokens")})
    # one row per bucket: the single partition is bounded by the time span
    w = Window.partitionBy(F.lit(1)).orderBy("bucket_start").rowsBetween(-trail, -1)

    def score(name: str) -> Column:
        spread = F.stddev_samp(name).over(w)
        return F.when(spread > 0, (F.col(name) - F.avg(name).over(w)) / spread).alias(f"{name}_z")

    scored = per_bucket.select("bucket_start", *map(score, ("traffic", "tokens", "latency")))
    signs = {
        "traffic_drop": F.col("traffic_z") < -z,
        "token_spike": F.col("tokens_z") > z,
        "latency_anomaly": F.col("latency_z") > z,
    }
    flagged = scored.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in signs.items()])
    return flagged.withColumn("anomalous", reduce(Column.__or__, [F.col(n) for n in signs]))
