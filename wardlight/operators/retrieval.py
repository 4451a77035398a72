"""Runbook chunks and exact nearest-neighbour retrieval."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import text as X
from wardlight.operators.common import evaluated

# The search functions travel to the executors as code, so that the package
# does not have to be installed there.
register_pickle_by_value(sys.modules[__name__])

# Chunk size and overlap in characters, texts per context.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
CONTEXT_TEXTS = 2

# Where texts are cut, in the order of preference; the empty one is between any two characters.
SEPARATORS = ("\n\n", "\n", " ", "")

# Query vectors that may travel to every task; more go through blocks.
INLINE_QUERIES = 2048
INLINE_BYTES = 64 * 1024 * 1024
CHUNK_BLOCK = 20_000
QUERY_BLOCK = 256


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, col: str = "text"
) -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last.

    The text is cut once into strides and every chunk is a stride plus the
    head of the next one, so the cost stays linear in the text; repeated
    substrings would walk a long text from its start for every chunk.
    """
    stride = size - overlap
    if not 0 <= overlap <= stride:
        raise ValueError("overlap must be between 0 and half the size")
    wanted = F.greatest(
        F.lit(1), F.ceil((F.length(col) - F.lit(overlap)) / F.lit(float(stride))).cast("int")
    )
    cut = (
        docs.filter(F.length(col) > 0)
        .withColumn("_n", wanted)
        .withColumn("_cells", F.regexp_extract_all(F.col(col), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)))
    )
    cells = F.col("_cells")

    def chunk(i):
        head = F.coalesce(F.get(cells, i + 1), F.lit(""))
        return F.concat(F.get(cells, i), F.substring(head, 1, overlap))

    pieces = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), chunk)
    return cut.select(
        *[c for c in docs.columns if c != col], F.posexplode(pieces).alias("chunk_no", "chunk")
    )


def _atoms(text: Column, separators: Sequence[str], size: int) -> Column:
    """The pieces that chunks are made of, in order, as (piece, wall).

    A text is cut before each separator; pieces that are still too long are cut
    at the next one. Those stand between two empty pieces with ``wall``, since
    pieces of one cut are not merged with those of another.
    """
    sep, rest = separators[0], separators[1:]
    if sep == "":
        cuts = F.filter(F.split(text, "", -1), lambda x: x != "")
        return F.transform(cuts, lambda x: F.struct(x.alias("piece"), F.lit(False).alias("wall")))
    parts = F.transform(F.split(text, re.escape(sep), -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(sep), x)))

    def inner(x: Column) -> Column:
        whole = F.array(F.struct(x.alias("piece"), F.lit(False).alias("wall")))
        wall = F.array(F.struct(F.lit("").alias("piece"), F.lit(True).alias("wall")))
        long = F.concat(wall, _atoms(x, rest, size) if rest else whole, wall)
        return F.when(F.length(x) < size, whole).otherwise(long)

    return F.flatten(F.transform(F.filter(parts, lambda x: x != ""), inner))


def _merged_spans(atoms: Column, size: int, overlap: int) -> Column:
    """Chunks as (first, n) spans of pieces: greedy, each carrying on the tail of the one before.

    The state holds the open chunk's first piece and the lengths of its pieces,
    at most ``size`` of them.
    """
    sized = F.transform(atoms, lambda a, i: F.struct(F.length(a["piece"]).alias("len"), a["wall"].alias("wall"), i.alias("i")))
    start = F.struct(
        F.array().cast("array<struct<first:int,n:int>>").alias("out"), F.lit(0).alias("first"),
        F.array().cast("array<int>").alias("lens"), F.lit(0).alias("total"))

    def closed(s: Column) -> Column:
        span = F.array(F.struct(s["first"].alias("first"), F.size(s["lens"]).alias("n")))
        return F.when(F.size(s["lens"]) > 0, F.concat(s["out"], span)).otherwise(s["out"])

    def state(out, first, lens, total) -> Column:
        return F.struct(out.alias("out"), first.alias("first"), lens.alias("lens"), total.alias("total"))

    def step(s: Column, a: Column) -> Column:
        def drop(left: Column, x: Column) -> Column:
            go = (left["total"] > overlap) | ((left["total"] + a["len"] > size) & (left["total"] > 0))
            return F.struct((left["total"] - F.when(go, x).otherwise(0)).alias("total"), (left["k"] + go.cast("int")).alias("k"))

        kept = F.aggregate(s["lens"], F.struct(s["total"].alias("total"), F.lit(0).alias("k")), drop)
        tail = F.concat(F.slice(s["lens"], kept["k"] + 1, F.size(s["lens"])), F.array(a["len"]))
        return (
            F.when(a["wall"], state(closed(s), a["i"] + 1, F.array().cast("array<int>"), F.lit(0)))
            .when(s["total"] + a["len"] > size, state(closed(s), s["first"] + kept["k"], tail, kept["total"] + a["len"]))
            .otherwise(state(s["out"], s["first"], F.concat(s["lens"], F.array(a["len"])), s["total"] + a["len"]))
        )

    return F.aggregate(sized, start, step, closed)


def split_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS, col: str = "text"
) -> DataFrame:
    """Chunks of at most ``size`` characters that end at paragraphs, lines, words, or else anywhere.

    A text is cut before the first of the separators, pieces that are not
    shorter than ``size`` before the next one, and so on. Neighbouring pieces of
    one cut are put together while they fit; a new chunk begins with the last
    pieces of the one before, up to ``overlap`` characters as far as they leave
    room for the next piece. White space around a chunk goes, and empty chunks
    do. Null and empty texts have none. Without an empty separator a piece may
    stay longer than ``size``. Any overlap below the size will do. The texts
    are cut once and chunks joined from pieces, so the cost grows with the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    cut = evaluated(docs.filter(F.length(col) > 0), _atoms=_atoms(F.col(col), list(separators), size))
    spans = evaluated(cut, _spans=_merged_spans(F.col("_atoms"), size, overlap))
    pieces = F.transform("_atoms", lambda a: a["piece"])
    texts = evaluated(spans, _pieces=pieces).select("*", F.filter(
        F.transform("_spans", lambda p: X.strip(F.array_join(F.slice("_pieces", p["first"] + 1, p["n"]), ""))),
        lambda x: x != "").alias("_chunks"))
    return texts.select(*[c for c in docs.columns if c != col], F.posexplode("_chunks").alias("chunk_no", "chunk"))


def _nearest(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int):
    """Per query the k nearest rows: distance first, then the smaller id.

    A matrix product gives all squared distances up to rounding; only rows
    that could be among the k nearest are then measured exactly.
    """
    found = []
    norms = np.einsum("ij,ij->i", vectors, vectors)
    kth = min(k, len(ids)) - 1
    slack = 16 * vectors.shape[1] * np.finfo(np.float64).eps
    for start in range(0, len(queries), QUERY_BLOCK):
        block = queries[start:start + QUERY_BLOCK]
        sizes = np.einsum("ij,ij->i", block, block)
        rough = norms[:, None] - 2.0 * (vectors @ block.T) + sizes
        limits = np.partition(rough, kth, axis=0)[kth] + slack * (norms.max() + sizes)
        for query, near in zip(block, (rough <= limits).T):
            close = np.flatnonzero(near)
            gap = vectors[close] - query
            squared = np.einsum("ij,ij->i", gap, gap)
            best = np.lexsort((ids[close], squared))[:k]
            found.append((ids[close[best]], np.sqrt(squared[best])))
    return found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _frame(query_ids, found) -> pd.DataFrame:
    sizes = [len(ids) for ids, _ in found]
    return pd.DataFrame({
        "query_id": np.repeat(np.asarray(query_ids), sizes),
        "chunk_id": np.concatenate([ids for ids, _ in found]),
        "distance": np.concatenate([d for _, d in found]),
    })


def _scan(queries_inline: tuple[list, np.ndarray], chunks: DataFrame, k: int, schema) -> DataFrame:
    """One pass over the chunks; every task keeps k candidates per query."""
    shared = chunks.sparkSession.sparkContext.broadcast(queries_inline)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_vectors = shared.value
        best: list = [None] * len(query_ids)
        for batch in batches:
            if batch.empty:
                continue
            ids, vectors = batch["chunk_id"].to_numpy(), _matrix(batch["vector"])
            for i, found in enumerate(_nearest(ids, vectors, query_vectors, k)):
                if best[i] is not None:
                    both = np.concatenate([best[i][0], found[0]]), np.concatenate([best[i][1], found[1]])
                    keep = np.lexsort(both)[:k]
                    found = both[0][keep], both[1][keep]
                best[i] = found
        if best and best[0] is not None:
            yield _frame(query_ids, best)

    return chunks.mapInPandas(search, schema)


def _blocks(queries: DataFrame, chunks: DataFrame, k: int, schema, n_queries: int) -> DataFrame:
    """More queries than a task may hold: blocks of queries against blocks of chunks.

    Every pair of blocks is one bounded group that returns k rows per query.
    """
    query_blocks = max(1, -(-n_queries // INLINE_QUERIES))
    chunk_blocks = max(1, -(-chunks.count() // CHUNK_BLOCK))

    def other(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def own(key: str, n: int, name: str):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)

    left = queries.select("query_id", "vector", own("query_id", query_blocks, "_qb")).select(
        "*", other(chunk_blocks, "_cb"))
    right = chunks.select("chunk_id", "vector", own("chunk_id", chunk_blocks, "_cb")).select(
        "*", other(query_blocks, "_qb"))

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        ids, vectors = cs["chunk_id"].to_numpy(), _matrix(cs["vector"])
        return _frame(qs["query_id"], _nearest(ids, vectors, _matrix(qs["vector"]), k))

    return (
        left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(search, schema)
    )


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = CONTEXT_TEXTS) -> DataFrame:
    """The k chunks nearest to each query by Euclidean distance; ties go to the smaller id.

    ``queries`` is (query_id, vector), ``chunks`` is (chunk_id, vector). The
    size of the query side is looked at first: up to INLINE_QUERIES vectors
    and INLINE_BYTES go to every task and the chunks are scanned once without
    a shuffle; beyond that both sides meet block by block.
    """
    schema = _schema(queries, chunks)
    some = queries.select("query_id", "vector").limit(INLINE_QUERIES + 1).toPandas()
    size = sum(len(v) for v in some["vector"]) * 8
    if len(some) <= INLINE_QUERIES and size <= INLINE_BYTES:
        inline = (list(some["query_id"]), _matrix(some["vector"]) if len(some) else np.zeros((0, 0)))
        candidates = _scan(inline, chunks.select("chunk_id", "vector"), k, schema)
    else:
        candidates = _blocks(queries, chunks, k, schema, queries.count())
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve_context(
    queries: DataFrame, chunks: DataFrame, k: int = CONTEXT_TEXTS
) -> DataFrame:
    """The texts of the nearest chunks, nearest first, joined by newlines.

    ``chunks`` also has a ``chunk`` text. At most k texts per query are gathered.
    """
    near = vector_topk(queries, chunks, k)
    texts = near.join(chunks.select("chunk_id", "chunk"), "chunk_id")
    lines = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    return texts.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda r: r["chunk"]), "\n").alias("context")
    )
