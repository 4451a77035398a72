"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label are dealt into blocks, and every two blocks meet in one
task. There each unit vector u is rounded to whole steps, u ~ s * q with q from
-127 to 127, and r = |u - s * q| is kept. Since

    |u_a . u_b - s_a s_b (q_a . q_b)| <= r_a + r_b + r_a * r_b

a product of whole numbers tells which pairs cannot reach the threshold; only
the others are computed again in full precision. Equal vectors are one class
with a count, and a task returns sums and groups, never pairs: of each class
how many vectors it is linked with in this tile, and the smallest class that
links of the tile lead to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.graph import Shelf, components

THRESHOLD = 0.93
# Vectors of a block, and its bytes at eight a number.
BLOCK_ROWS = 8192
BLOCK_BYTES = 32 << 20
# Rows of a block whose products are held at once.
STRIP = 1024
# Pairs that are computed in full precision at once.
PAIRS = 1 << 16
# Numbers that a product of bytes may add up in single precision without rounding.
_EXACT_TERMS = 1024
# What rounding in the bound itself may amount to, far above its true size.
_SLACK = 1e-5


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; no entry may be infinite and no row zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: int8 codes, the step of each, and the length of what rounding leaves."""
    step = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / step[:, None])
    rest = units - codes * step[:, None]
    return codes.astype(np.int8), step, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of quantised rows whose cosine may reach the threshold."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    product = np.zeros((len(qa), len(qb)), np.float32)
    for begin in range(0, qa.shape[1], _EXACT_TERMS):
        # whole numbers below 2**24, so single precision adds them up exactly
        part = qa[:, begin:begin + _EXACT_TERMS].astype(np.float32) @ qb[:, begin:begin + _EXACT_TERMS].astype(np.float32).T
        product += part
    product *= sa[:, None].astype(np.float32)
    product *= sb[None, :].astype(np.float32)
    bound = np.multiply.outer((1 + ra).astype(np.float32), (1 + rb).astype(np.float32))
    product += bound
    return np.nonzero(product >= threshold + 1 - _SLACK)


def linked_pairs(units: np.ndarray, codes: tuple, threshold: float, rows: slice, others: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of two ranges of rows whose cosine in double precision reaches the threshold."""
    for begin in range(rows.start, rows.stop, STRIP):
        own = slice(begin, min(begin + STRIP, rows.stop))
        for start in range(others.start, others.stop, STRIP):
            far = slice(start, min(start + STRIP, others.stop))
            if rows == others and far.stop <= own.start:
                continue
            i, j = possible(tuple(x[own] for x in codes), tuple(x[far] for x in codes), threshold)
            i, j = i + own.start, j + far.start
            if rows == others:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), PAIRS):
                x, y = i[at:at + PAIRS], j[at:at + PAIRS]
                good = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
                yield x[good], y[good]


def joined_heads(heads: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Heads of groups after pairs have joined them; a head is the lowest row of its group."""
    while True:
        a, b = heads[i], heads[j]
        apart = a != b
        if not apart.any():
            return heads
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(heads, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = heads[heads]
            if np.array_equal(up, heads):
                break
            heads = up


def compare_tile(ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, side: np.ndarray, one: bool, threshold: float):
    """Ids of classes with links in a tile, the vectors they link with, and the lowest id that links lead to.

    ``side`` tells the block of each row; within a block nothing is compared
    unless the tile has but this ``one``.
    """
    order = np.lexsort((ids, side))
    ids, sizes, units = ids[order], sizes[order], unit_rows(vectors[order])
    codes = quantised(units)
    cut = len(ids) if one else int(np.searchsorted(side[order], side.max()))
    rows, others = slice(0, cut), slice(0, cut) if one else slice(cut, len(ids))
    links, heads = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in linked_pairs(units, codes, threshold, rows, others):
        np.add.at(links, i, sizes[j])
        np.add.at(links, j, sizes[i])
        heads = joined_heads(heads, i, j)
    lowest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(lowest, heads, ids)
    some = links > 0
    return ids[some], links[some], lowest[heads[some]]


def _identified(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, size, vector, k0, k1): the entries as bytes and their identity, null where nothing can be compared."""
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    source = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), kind) + np.dtype(kind).type(0)  # no -0.0
            able = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            raw: list[bytes | None] = [None] * len(batch)
            keys = np.zeros((len(batch), 2), np.int64)
            for row in able:
                raw[row] = flat[ends[row] - sizes[row]:ends[row]].tobytes()
                keys[row] = np.frombuffer(hashlib.blake2b(raw[row], digest_size=16).digest(), np.int64)
            none = np.array([x is None for x in raw], bool)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()),
                pa.array(keys[:, 0], mask=none), pa.array(keys[:, 1], mask=none),
            ], ["vec_id", "label", "size", "vector", "k0", "k1"])

    able = F.forall(source, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))) & F.exists(source, lambda c: c != 0)
    types = vectors.schema
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(able & F.col(label_col).isNotNull(), source).alias("vector"))
    return rows.mapInArrow(run, T.StructType([
        T.StructField("vec_id", types[id_col].dataType), T.StructField("label", types[label_col].dataType), T.StructField("size", T.IntegerType()),
        T.StructField("vector", T.BinaryType()), T.StructField("k0", T.LongType()), T.StructField("k1", T.LongType())]))


def _tiles(classes: DataFrame, threshold: float, width: int, block_rows: int) -> DataFrame:
    """(id, links, head) from every tile, of the classes that have links in it.

    A label's classes are dealt into as many blocks as its size asks for; a hot
    label is many tiles.
    """
    kind = "<f4" if width == 4 else "<f8"
    per_block = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))))
    labels = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / F.first(per_block)).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    placed = classes.join(labels, ["label", "size"]).select(
        "label", "size", "id", "members", "vector", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tiles = placed.select(
        "label", "size", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "members", "vector")

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, side = (table.column(c).to_numpy() for c in ("id", "members", "own"))
        low, high, width = (table.column(c)[0].as_py() for c in ("low", "high", "size"))
        rows = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, width).astype(np.float64)
        if low != high and side.min() == side.max():
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = compare_tile(ids, sizes, rows, side, low == high, threshold)
        return pa.table(dict(zip(("id", "links", "head"), map(pa.array, found))))

    # a tile is much work in few bytes, so tiles are not put together by their bytes
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(tasks, "label", "size", "low", "high").groupBy("label", "size", "low", "high").applyInArrow(
        run, "id long, links long, head long")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two rows are linked if their labels are equal and not null, their vectors
    as long, and their cosine in double precision is at least the threshold. A
    vector that is null, empty or all zero, or holds a null, an infinity or a
    NaN, is linked with nothing, as is any row without label. Repeated rows are
    vectors of their own, linked with each other; rows that share an id but not
    a vector are linked only if their vectors are. component_id is the smallest
    id that links reach, a null id is none; kept tells whether that is the
    row's own id, and rows with a null id or no other id in reach are kept. An
    empty table gives an empty result; other columns are not read.

    Every pair of different vectors of a label is compared, so the work grows
    with the square of a label's distinct vectors; copies cost nothing.
    """
    passing, result = Shelf(), Shelf()
    rows = passing.settled(_identified(vectors, id_col, vector_col, label_col))
    width = 4 if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else 8
    known = rows.filter("k0 IS NOT NULL")
    # the written table fixes the numbers that classes get
    classes = passing.settled(known.groupBy("label", "size", "vector", "k0", "k1").agg(
        F.count("*").alias("members"), F.min("vec_id").alias("lowest")).withColumn("id", F.monotonically_increasing_id()))
    slim = result.settled(classes.select("label", "size", "k0", "k1", "members", "lowest", "id"))
    members = result.settled(rows.select("vec_id", "label", "size", "k0", "k1"))
    found = passing.settled(_tiles(classes, threshold, width, block_rows))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = passing.settled(found.filter("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    groups = components(edges, passing)
    reach = slim.select("id", "lowest").join(groups, "id").groupBy("component").agg(F.min("lowest").alias("reached"))
    told = result.settled(
        slim.join(links, "id", "left").join(groups, "id", "left").join(reach, "component", "left").select(
            "label", "size", "k0", "k1", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("reached", "lowest").alias("reached")))
    passing.clear(vectors.sparkSession)
    return members.join(told, ["label", "size", "k0", "k1"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("reached", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
