"""Streams of calls: grid slices, rates and alerts with carried state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardlight.functions import times
from wardlight.operators import alerts as A
from wardlight.operators import metrics as M
from wardlight.sources.sinks import read_batches, write_batch
from wardlight.streaming.base import each_batch

DELAY = "10 minutes"


def sliced(
    events: DataFrame, by: Sequence[str], step: str | int, sums: dict[str, Column], delay: str = DELAY
) -> DataFrame:
    """Streaming slices per (series, tick), the same as the batch ``metrics.slices``.

    A window covers [start, end) and a tick (T - step, T], so the event time
    of the window is a microsecond early. Windows keep the session time zone;
    the grid needs it to be a whole number of steps from UTC.
    """
    width = times.seconds_of(step)
    early = times.local(F.col("ts")).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    windowed = (
        events.withColumn("_at", early)
        .withWatermark("_at", delay)
        .groupBy(*by, F.window("_at", f"{width} seconds").alias("_w"))
        .agg(*[c.alias(n) for n, c in sums.items()])
    )
    tick = times.tick_of(F.col("_w")["end"].cast("timestamp_ntz"), step)
    return windowed.select(*by, tick.alias("tick"), *sums)


def stream_slices(
    events: DataFrame, by: Sequence[str], step: str | int, sums: dict[str, Column], path: str,
    checkpoint: str, delay: str = DELAY, trigger: dict | None = None,
) -> StreamingQuery:
    """Write every slice that changed in a micro-batch; ``read_slices`` takes the last."""
    rows = sliced(events, by, step, sums, delay)
    return each_batch(rows, lambda df, n: write_batch(df, path, n), checkpoint, "update", trigger)


def read_slices(spark: SparkSession, path: str, by: Sequence[str], schema: T.StructType) -> DataFrame:
    rows = read_batches(spark, path, schema)
    values = [f.name for f in schema.fields if f.name not in (*by, "tick")]
    latest = rows.groupBy(*by, "tick").agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return latest.select(*by, "tick", "_v.*")


def stream_totals(
    events: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the partial aggregate of every micro-batch.

    For counts, sums and last values no stream state and no watermark are needed: what the
    batches wrote adds up, and a late event counts like any other.
    """
    return each_batch(events, lambda df, n: write_batch(partial(df), path, n), checkpoint, trigger=trigger)


def read_totals(spark: SparkSession, path: str, by: Sequence[str], schema: T.StructType) -> DataFrame:
    """The sums over all batches of what ``stream_totals`` wrote."""
    sums = [f.name for f in schema.fields if f.name not in by]
    return read_batches(spark, path, schema).groupBy(*by).agg(
        *[F.sum(name).cast(schema[name].dataType).alias(name) for name in sums])


def _state_schema(series: list[T.StructField], values: list[T.StructField]) -> T.StructType:
    recent = T.ArrayType(T.StructType([T.StructField("tick", T.LongType()), *values]))
    return T.StructType([
        *series,
        T.StructField("last_tick", T.LongType()),
        T.StructField("since", T.LongType()),
        T.StructField("fired", T.BooleanType()),
        T.StructField("recent", recent),
    ])


def _event_schema(series: list[T.StructField]) -> T.StructType:
    return T.StructType([
        *series,
        T.StructField("since", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("at", T.LongType()),
    ])


def _carried_on(rows: DataFrame, by, step, window, cols, end) -> DataFrame:
    """A gauge at each grid second: its last value until it is as old as the window."""
    return M.dense(rows, by, step, window, end).select(*by, "tick", *cols)


def alert_step(
    fresh: DataFrame, state: DataFrame, by: Sequence[str], step: str | int, window: str | int, hold: str | int,
    firing: Callable[[DataFrame], Column], cols: Sequence[str], gauge: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, new state, runs) of one batch of final slices.

    The runs feed both others; the caller may keep them between the two writes.

    ``state`` has per series its last tick, the start of a run that was still
    going, whether that run has fired, and the slices of its trailing window;
    of a gauge, the last one. Those are put in front of the new slices, sums or
    values are taken on the dense grid, and the open run of a series takes part
    as a row at its last tick. A series' row is bounded by its window.
    """
    width, span, need = map(times.seconds_of, (step, window, hold))
    by = list(by)
    end = M.last_tick(fresh)
    # a series that has stopped is looked at as long as a run of it is open
    touched = fresh.select(*by).union(state.filter(F.col("since").isNotNull()).select(*by)).distinct()
    known = touched.join(state, by, "left")
    earlier = known.select(*by, F.inline("recent")).select(*by, "tick", *cols)
    now = earlier.unionByName(fresh.select(*by, "tick", *cols))
    rolled = (_carried_on if gauge else M.rolling)(now, by, step, window, cols, end)
    judged = rolled.withColumn("firing", F.coalesce(firing(rolled), F.lit(False)))
    slim = known.drop("recent")
    new = judged.join(slim, by).filter(
        F.col("last_tick").isNull() | (F.col("tick") > F.col("last_tick"))
    ).select(*by, "tick", "firing", F.lit(None).cast("long").alias("_since"), F.lit(False).alias("_fired"))
    carried = slim.filter(F.col("since").isNotNull()).select(
        *by, F.col("last_tick").alias("tick"), F.lit(True).alias("firing"),
        F.col("since").alias("_since"), F.col("fired").alias("_fired"),
    )
    order = M.series_order(by)
    runs = (
        new.unionByName(carried)
        .withColumn("_open", F.col("tick") >= end)
        .filter(F.col("firing"))
        .withColumn("_run", F.col("tick") - F.row_number().over(order) * F.lit(width))
        .groupBy(*by, "_run")
        .agg(
            F.min(F.coalesce("_since", "tick")).alias("since"),
            F.max("tick").alias("until"),
            F.bool_or("_open").alias("open"),
            F.bool_or("_fired").alias("before"),
        )
        .withColumn("fires", F.col("until") - F.col("since") >= need)
    )
    starts = runs.filter(F.col("fires") & ~F.col("before")).select(
        *by, "since", F.lit("firing").alias("kind"), (F.col("since") + F.lit(need)).alias("at"))
    ends = runs.filter(F.col("fires") & ~F.col("open")).select(
        *by, "since", F.lit("resolved").alias("kind"), (F.col("until") + F.lit(width)).alias("at"))
    going = runs.filter(F.col("open")).select(*by, "since", F.col("fires").alias("fired"))
    cell = F.struct("tick", *cols)
    if gauge:
        held = now.groupBy(*by).agg(F.array(F.max_by(cell, "tick")).alias("recent"))
    else:
        held = now.filter(F.col("tick") > end - F.lit(span)).groupBy(*by).agg(F.collect_list(cell).alias("recent"))
    moved = touched.withColumn("last_tick", end).join(going, by, "left").join(held, by, "left").select(
        *by, "last_tick", "since", F.coalesce("fired", F.lit(False)).alias("fired"), "recent")
    resting = state.join(touched, by, "left_anti").select(*by, "last_tick", "since", "fired", "recent")
    return starts.unionByName(ends), resting.unionByName(moved), runs


def stream_alerts(
    events: DataFrame, by: Sequence[str], sums: dict[str, Column],
    firing: Callable[[DataFrame], Column], root: str, checkpoint: str,
    step: str | int = 15, window: str | int = "5 minutes", hold: str | int = "2 minutes",
    delay: str = DELAY, trigger: dict | None = None, gauge: bool = False,
) -> StreamingQuery:
    """Alert on a sliding condition that must hold for a while.

    Slices leave the stream once the watermark has passed them and are never
    revised. Each batch writes its slices, its events and the state of every
    series below ``root`` and reads the state of the batch before; ``read_alerts``
    pairs the events. With ``gauge`` the aggregates are last values, which stay
    in force until ``window`` has passed, instead of sums over it.
    """
    spark = events.sparkSession
    rows = sliced(events, by, step, sums, delay)
    schema = rows.schema
    series = [schema[n] for n in by]
    kept = _state_schema(series, [schema[n] for n in sums])

    def handle(fresh: DataFrame, batch_id: int) -> None:
        write_batch(fresh, f"{root}/slices", batch_id)
        now = spark.read.schema(schema).parquet(f"{root}/slices/batch_id={batch_id}")
        state = read_batches(spark, f"{root}/state", kept).filter(F.col("batch_id") == batch_id - 1).drop("batch_id")
        if now.isEmpty():  # the end of the evaluation has not moved
            write_batch(spark.createDataFrame([], _event_schema(series)), f"{root}/events", batch_id)
            write_batch(state, f"{root}/state", batch_id)
            return
        told, moved, runs = alert_step(now, state, by, step, window, hold, firing, list(sums), gauge)
        runs.persist()
        write_batch(told, f"{root}/events", batch_id)
        write_batch(moved, f"{root}/state", batch_id)
        runs.unpersist()

    return each_batch(rows, handle, checkpoint, "append", trigger)


def stream_gauge_alerts(
    samples: DataFrame, by: Sequence[str], firing: Callable[[Column], Column], root: str, checkpoint: str,
    col: str = "value", step: str | int = 15, lookback: str | int = M.LOOKBACK, hold: str | int = "2 minutes",
    delay: str = DELAY, trigger: dict | None = None,
) -> StreamingQuery:
    """Alert on a gauge whose last known value breaks a limit for a while; a value expires after ``lookback``."""
    last = {"value": F.max_by(F.col(col), F.struct("ts", col))}
    return stream_alerts(
        samples, by, last, lambda r: firing(r["value"]), root, checkpoint, step, lookback, hold, delay, trigger, gauge=True)


# Fixed by the arithmetic: what a counter has grown by from one value to the next; after a reset the new value counts.
def _grown(now: Column, before: Column) -> Column:
    return F.when(now >= before, now - before).when(now < before, now).otherwise(F.lit(0.0))


def stream_increase(
    samples: DataFrame, by: Sequence[str], path: str, checkpoint: str, step: str | int = 15, delay: str = DELAY,
    col: str = "value", trigger: dict | None = None,
) -> StreamingQuery:
    """Growth of counters per (series, tick), the same as the batch ``metrics.counter_slices``.

    A slice leaves the stream once the watermark has passed it, with its first
    and last value and the growth between them; the growth since the slice
    before is taken against the last value of the series, which every batch
    carries on (folder ``state``). A reset counts from zero, within a slice,
    between slices and between batches alike. Samples that come later than
    ``delay`` are dropped. Batches write ``slices`` below ``path``;
    ``read_increase`` sums them over a window.
    """
    spark = samples.sparkSession
    by = list(by)
    # the samples of one series in one grid second, in time order
    inside = F.array_sort(F.collect_list(F.struct(F.col("ts").alias("ts"), F.col(col).cast("double").alias("value"))))
    rows = sliced(samples, by, step, {"_all": inside}, delay)
    series = [rows.schema[n] for n in by]
    kept = T.StructType([*series, T.StructField("last", T.DoubleType())])

    def handle(fresh: DataFrame, batch_id: int) -> None:
        cells = F.col("_all")
        steps = F.transform(F.sequence(F.lit(2), F.greatest(F.size(cells), F.lit(2))), lambda i: _grown(
            F.get(cells, i - 1)["value"], F.get(cells, i - 2)["value"]))
        parts = fresh.select(
            *by, "tick", F.aggregate(steps, F.lit(0.0), lambda x, y: x + y).alias("_inner"),
            F.get(cells, F.lit(0))["value"].alias("_first"), F.element_at(cells, -1)["value"].alias("_last")).persist()
        state = read_batches(spark, f"{path}/state", kept).filter(F.col("batch_id") == batch_id - 1).drop("batch_id")
        order = M.series_order(by)
        before = F.coalesce(F.lag("_last").over(order), F.col("last"))
        grown = parts.join(state, by, "left").select(*by, "tick", (F.col("_inner") + _grown(F.col("_first"), before)).alias("growth"))
        write_batch(grown, f"{path}/slices", batch_id)
        newest = parts.groupBy(*by).agg(F.max_by("_last", "tick").alias("last"))
        write_batch(state.join(newest, by, "left_anti").unionByName(newest), f"{path}/state", batch_id)
        parts.unpersist()

    return each_batch(rows, handle, checkpoint, "append", trigger)


def read_increase(
    spark: SparkSession, path: str, series: list[T.StructField], window: str | int = "15 minutes", step: str | int = 15
) -> DataFrame:
    """(series, tick, increase) over a sliding window, up to the last slice that has left the stream."""
    by = [f.name for f in series]
    schema = T.StructType([*series, T.StructField("tick", T.LongType()), T.StructField("growth", T.DoubleType())])
    grown = read_batches(spark, f"{path}/slices", schema).drop("batch_id")
    return M.rolling(grown, by, step, window, ["growth"]).withColumnRenamed("growth", "increase")


def read_alerts(spark: SparkSession, root: str, series: list[T.StructField]) -> DataFrame:
    """One row per fired run: since, fires_at and, once it ended, resolved_at."""
    told = read_batches(spark, f"{root}/events", _event_schema(series))
    by = [f.name for f in series]
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    return told.groupBy(*by, "since").agg(at("firing").alias("f"), at("resolved").alias("r")).select(
        *by,
        times.at_second(F.col("since")).alias("since"),
        times.at_second(F.col("f")).alias("fires_at"),
        times.at_second(F.col("r")).alias("resolved_at"),
    )

