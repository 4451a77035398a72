"""Keyed rows as a log of batches and a committed snapshot in buckets.

Below one folder lie the batches that a job has written (``batch_id=N``), the
snapshots that compaction has folded them into (``_snapshots``), and manifests
(``_manifest``). A manifest names the last batch that is folded and the folder
of every bucket; the one of the highest version holds. It appears by a rename
that fails if the name is taken, so readers see the old state or the new one,
and of two compactions at the same time one gives way.

A key belongs to the bucket that its hash names. Folding a batch rewrites the
buckets that hold its keys and leaves the folders of all others as they are.
Nothing that a manifest names is ever overwritten; ``vacuum`` deletes what no
kept manifest needs. On a store whose rename is not atomic, let one job compact.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
# The last batch of a state that has folded none.
_NONE = -(1 << 62)
# Manifests that vacuum keeps, so that a reader that has just begun can finish.
KEPT = 2


@dataclass(frozen=True)
class Snapshot:
    """What a manifest says; version 0 is the state before the first one."""

    version: int = 0
    last_batch: int = _NONE
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, fs = _files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def _manifest(root: str, version: int) -> str:
    return f"{root}/_manifest/{version:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions of the manifests that are there, rising."""
    names = _names(spark, f"{root}/_manifest")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def load(spark: SparkSession, root: str, version: int) -> Snapshot:
    """The snapshot that a manifest names."""
    target, fs = _files(spark, _manifest(root, version))
    stream = fs.open(target)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(**said | {"folders": {int(k): v for k, v in said["folders"].items()}})


def latest(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Snapshot:
    """The committed snapshot; before the first one, an empty one of so many buckets."""
    found = versions(spark, root)
    return load(spark, root, found[-1]) if found else Snapshot(buckets=buckets)


def publish(spark: SparkSession, root: str, snapshot: Snapshot) -> bool:
    """Commit a manifest; False if another one of its version is there already."""
    draft, fs = _files(spark, f"{root}/_manifest/_{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(asdict(snapshot)).encode()))
    finally:
        stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(_manifest(root, snapshot.version)), gateway.new_array(kind, 0))
    except Py4JJavaError as refused:
        fs.delete(draft, False)
        if refused.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that are written whole, rising."""
    found = [int(n.split("=")[1]) for n in _names(spark, root) if n.startswith("batch_id=")]
    return sorted(n for n in found if "_SUCCESS" in _names(spark, f"{root}/batch_id={n}"))


def folded_rows(spark: SparkSession, snapshot: Snapshot, schema: T.StructType, only: Iterable[int] | None = None) -> DataFrame:
    """Rows of the snapshot, of all its buckets or of the given ones."""
    wanted = sorted(snapshot.folders if only is None else set(only) & set(snapshot.folders))
    folders = [snapshot.folders[b] for b in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def later_rows(
    spark: SparkSession, root: str, snapshot: Snapshot, schema: T.StructType, before: int | None = None, only: Iterable[int] | None = None
) -> DataFrame:
    """Rows of the batches that the snapshot does not hold, with their batch_id.

    ``before`` leaves out that batch and all after it. ``only`` reads the given
    buckets of batches that were written by bucket; both are partition filters.
    """
    parts = [T.StructField("batch_id", T.LongType())] + ([] if only is None else [T.StructField("bucket", T.IntegerType())])
    whole = T.StructType([*schema.fields, *parts])
    if not any(n.startswith("batch_id=") for n in _names(spark, root)):
        return spark.createDataFrame([], T.StructType([*schema.fields, parts[0]]))
    rows = spark.read.schema(whole).option("basePath", root).parquet(root).filter(F.col("batch_id") > snapshot.last_batch)
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    if only is not None:
        rows = rows.filter(F.col("bucket").isin(sorted(only))).drop("bucket")
    return rows


def compact(
    spark: SparkSession, root: str, schema: T.StructType, key: str,
    fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS, through: int | None = None,
) -> Snapshot:
    """Fold the batches after the snapshot into it; returns the snapshot that then holds.

    ``fold`` makes one row per key from rows with their batch_id, ``merge``
    joins the rows of old buckets with those. By default the last batch stays
    in the log, since a stream may have to write it again; ``through`` tells
    another one. Only buckets with new keys are read and written. Running it
    again, or beside another compaction, changes nothing that readers see.
    """
    now = latest(spark, root, buckets)
    done = batches(spark, root)
    end = (done[-2] if len(done) > 1 else _NONE) if through is None else max([n for n in done if n <= through], default=_NONE)
    if end <= now.last_batch:
        return now
    new = fold(later_rows(spark, root, now, schema, before=end + 1)).persist()
    try:
        touched = [r[0] for r in new.select(bucket_of(F.col(key), now.buckets)).distinct().collect()]
        merged = merge(folded_rows(spark, now, schema, touched), new)
        return _written(spark, root, now, merged, key, end, touched)
    finally:
        new.unpersist()


def _written(
    spark: SparkSession, root: str, now: Snapshot, rows: DataFrame, key: str, last_batch: int, touched: list[int]
) -> Snapshot:
    """Rows written as the buckets ``touched`` of the next version, and its manifest."""
    folder = f"{root}/_snapshots/{now.version + 1:012d}-{uuid.uuid4().hex}"
    # a bucket's rows go to files of a good size; a heavy bucket is split, light ones share a task
    rows.withColumn("bucket", bucket_of(F.col(key), now.buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
    folders = now.folders | {b: f"{folder}/bucket={b}" for b in touched}
    after = Snapshot(now.version + 1, last_batch, now.buckets, folders)
    if publish(spark, root, after):
        return after
    target, fs = _files(spark, folder)
    fs.delete(target, True)
    return latest(spark, root)


def begin(spark: SparkSession, root: str, rows: DataFrame, key: str, last_batch: int, buckets: int = BUCKETS) -> Snapshot:
    """A first snapshot from rows that hold each key once, as if batches up to ``last_batch`` were folded."""
    now = latest(spark, root, buckets)
    if now.version:
        return now
    touched = [r[0] for r in rows.select(bucket_of(F.col(key), buckets)).distinct().collect()]
    return _written(spark, root, now, rows, key, last_batch, touched)


def vacuum(spark: SparkSession, root: str, keep: int = KEPT) -> list[str]:
    """Delete what no kept manifest needs; returns the folders and files that went.

    The last ``keep`` manifests stay, with the buckets they name and the
    batches that the oldest of them has not folded.
    """
    found = versions(spark, root)
    if not found:
        return []
    kept = [load(spark, root, v) for v in found[-max(keep, 1):]]
    needed = {folder for s in kept for folder in s.folders.values()}
    holding = {folder.rsplit("/", 1)[0] for folder in needed}
    low, high = min(s.last_batch for s in kept), kept[-1].version
    gone = [_manifest(root, v) for v in found[:-max(keep, 1)]]
    for name in _names(spark, f"{root}/_snapshots"):
        folder = f"{root}/_snapshots/{name}"
        if folder not in holding:
            # a folder of a version still to come is being written
            gone += [folder] if int(name.split("-")[0]) <= high else []
        else:
            gone += [f"{folder}/{b}" for b in _names(spark, folder) if b.startswith("bucket=") and f"{folder}/{b}" not in needed]
    gone += [f"{root}/batch_id={n}" for n in batches(spark, root) if n <= low]
    for path in gone:
        target, fs = _files(spark, path)
        fs.delete(target, True)
    return gone
