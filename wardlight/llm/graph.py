"""Tables kept in shared storage and connected components of an edge table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import work_folder

# Share of the driver's heap limit from which free heap is given back, and the share of time that may take.
FULL, TIME = 0.5, 0.1


class Heap:
    """Free heap that the driver's JVM gives back to the system.

    An operator of many small queries leaves plans and broadcast tables behind;
    the heap grows to its limit before they go, and stays that large beside
    everything else that the driver holds. Collecting empties it earlier.
    """

    def __init__(self):
        self.next = 0.0

    def tidy(self, spark: SparkSession) -> None:
        """Collect if the heap has grown beyond a share of its limit, and not too often."""
        now = time.monotonic()
        if now < self.next:
            return
        runtime = spark._jvm.java.lang.Runtime.getRuntime()
        if runtime.totalMemory() > FULL * runtime.maxMemory():
            runtime.gc()
            self.next = time.monotonic() + (time.monotonic() - now) / TIME


HEAP = Heap()


class Shelf:
    """Tables written to the shared folder in the course of one operator.

    A written table cuts the lineage, survives lost executors and has a known
    size, so that the planner sees which join sides are small.
    """

    def __init__(self):
        self.folders: list[str] = []

    def settled(self, df: DataFrame) -> DataFrame:
        """The frame, computed now, written and read again."""
        folder = work_folder(df.sparkSession, "llm")
        df.write.parquet(folder)
        self.folders.append(folder)
        HEAP.tidy(df.sparkSession)
        return df.sparkSession.read.schema(df.schema).parquet(folder)

    def clear(self, spark) -> None:
        """Delete what has been written so far; frames on it can no longer be read."""
        for folder in self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []


def _shape(edges: DataFrame):
    """Number of edges and an order-free sum over them, to see when nothing changes."""
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def _step(edges: DataFrame, larger: bool, settled) -> DataFrame:
    """One star step: neighbours of u move to the smallest node that u knows.

    ``edges`` has u > v. The large step moves the larger neighbours of a node,
    the small step its smaller ones. Minima are combined before the shuffle and
    stored, so that a node with very many neighbours is a join side Spark can split.
    """
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = settled(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")))
        moved = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        lows = settled(edges.groupBy("u").agg(F.min("v").alias("low")))
        near = edges.join(lows, "u")
        moved = near.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            lows.select("u", F.col("low").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, keep: Shelf) -> DataFrame:
    """(id, component) for every node that has an edge; a component is its smallest id.

    ``edges`` has two columns a, b; the result is written to ``keep``. Large and small star steps alternate until
    every node hangs on its smallest one; the number of rounds grows with the
    logarithm of a component's diameter.
    """
    shelf = Shelf()
    settled = shelf.settled
    now = settled(edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        shape = _shape(now)
        if shape == before or not shape[0]:
            break
        before = shape
        now = settled(_step(settled(_step(now, True, settled)), False, settled))
    heads = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    done = keep.settled(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads))
    shelf.clear(edges.sparkSession)
    return done
