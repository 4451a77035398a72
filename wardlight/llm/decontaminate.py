"""Benchmark decontamination by spaced-seed hashing.

A mask lays over consecutive words and hashes only some of them, so a
substituted word under a gap changes nothing. Hashes of benchmark items and of
documents are joined. A bit table of fixed size, made from the benchmark's
hashes, goes to the scan of the documents and keeps nearly everything that
cannot join from being written out. Stretches of a document around its hits are
then aligned with the item at the offset of each joined hit, and the best
stretch of the alignment decides, with substitutions allowed.

Short items have masks of their own without gaps: an item that is shorter than
a mask is hashed whole, and of one of up to LEAST_EQUAL words both halves are,
one of which a single substitution leaves as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import ALNUM, Powers, Words, constants, mixed, pieces, tidy, words_of
from wardlight.llm.graph import Shelf

# The masks, one character for each word, 1 where it is hashed.
MASKS = ("11101101", "11011011", "10111011")
# The bit table: 2**TABLE_BITS bits (4 MiB) at every size of the benchmark, and bits for each hash.
TABLE_BITS, PROBES = 25, 3
# Words kept on both sides of hits, and the gap up to which hits share a stretch.
AROUND = 64
# Least equal words of an overlap; of an item with no more words all but one, and all if it is shorter than a mask.
# A substitution costs as much as two equal words gain.
LEAST_EQUAL = 12
COST = 2
# Fewest words of an item for which a document is dropped.
SHORTEST = 4


SPAN = len(MASKS[0])


def needed(length: int, least: int = LEAST_EQUAL) -> int:
    """Equal words that an overlap with an item of so many words must have."""
    if length < SPAN:
        return length
    return length - 1 if length <= least else least


def solid_lengths(length: int, least: int = LEAST_EQUAL) -> list[int]:
    """The masks without gaps that an item of so many words is hashed with, by their length."""
    if length < SPAN:
        return [length] * (length > 0)
    return [length // 2] if length <= least else []


def _hashes_under(mask: str, salt: int, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + len(mask) <= last)
    total = np.zeros(len(at), np.uint64)
    for k, weight in enumerate(constants(len(mask), salt)):
        if mask[k] == "1":
            total += hashes[at + k] * weight
    return at, mixed(total)


def solid_hashes(length: int, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of so many words."""
    return _hashes_under("1" * length, 60 + length, hashes, first)


def seed_hashes(hashes: np.ndarray, first: np.ndarray, solid: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask: the places (word numbers) where it fits into a text, and its hashes there; then the same for solid ones."""
    spaced = [_hashes_under(mask, 20 + number, hashes, first) for number, mask in enumerate(MASKS)]
    return spaced + [solid_hashes(length, hashes, first) for length in solid]


def _item_seeds(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of one item and their places in it."""
    whole = np.array([0, len(hashes)])
    pairs = seed_hashes(hashes, whole)
    for length in solid_lengths(len(hashes), least):
        at, seeds = solid_hashes(length, hashes, whole)
        ends = np.unique([0, len(hashes) - length])
        pairs.append((at[ends], seeds[ends]))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([s for _, s in pairs])


def _probes(hashes: np.ndarray) -> list[np.ndarray]:
    """The bits of a hash: disjoint parts of it."""
    return [((hashes >> np.uint64(64 - TABLE_BITS - 13 * k)) & np.uint64((1 << TABLE_BITS) - 1)) for k in range(PROBES)]


def _is_set(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (table[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) > 0


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([p.view(np.int64) if p.dtype == np.uint64 else p for p in parts], pa.list_(kind))


def benchmark_words(items: DataFrame, least: int = LEAST_EQUAL) -> DataFrame:
    """(item_id, words, seeds, places) of items with words; seeds and places go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for begin, stop, data, rows in pieces(batch.column(1)):
                words = words_of(data, rows, ALNUM)
                hashes, first = words.hashes(powers), words.first
                n = stop - begin
                own = [hashes[first[i]:first[i + 1]] for i in range(n)]
                found = [_item_seeds(x, least) for x in own]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, n), _lists(own, pa.int64()),
                    _lists([seeds for _, seeds in found], pa.int64()), _lists([at for at, _ in found], pa.int64()),
                ], ["item_id", "words", "seeds", "places"])

    id_type = items.schema[items.columns[0]].dataType.simpleString()
    return items.mapInArrow(run, f"item_id {id_type}, words array<long>, seeds array<long>, places array<long>")


def bit_table(seeds: DataFrame) -> np.ndarray:
    """The table of all seeds (column ``seed``), put together by Spark; at most 2**TABLE_BITS bits reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unique(np.concatenate(_probes(own)))
            cells, at = np.unique(bits >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), at) if len(at) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int64)), pa.array(value.view(np.int64))], ["cell", "bits"])

    rows = seeds.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[rows["cell"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def _stretches(words: Words, hashes: np.ndarray, table: np.ndarray, solid: tuple[int, ...]):
    """(text, first word in the text, word hashes, seeds, their places in the stretch) around hits."""
    at_all, seed_all = [], []
    for at, seeds in seed_hashes(hashes, words.first, solid):
        for probe in range(PROBES):
            hit = _is_set(table, _probes(seeds)[probe])
            at, seeds = at[hit], seeds[hit]
        at_all.append(at)
        seed_all.append(seeds)
    at, seeds = np.concatenate(at_all), np.concatenate(seed_all)
    order = np.argsort(at, kind="stable")
    at, seeds = at[order], seeds[order]
    text = np.searchsorted(words.first, at, side="right") - 1
    cuts = np.flatnonzero((np.diff(at) > AROUND) | (np.diff(text) > 0)) + 1
    for part in np.split(np.arange(len(at)), cuts) if len(at) else ():
        i = text[part[0]]
        start = max(words.first[i], at[part[0]] - AROUND)
        stop = min(words.first[i + 1], at[part[-1]] + SPAN + AROUND)
        yield i, start - words.first[i], hashes[start:stop], seeds[part], at[part] - start


def document_stretches(docs: DataFrame, table, solid: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, start, key, words, seeds, places): stretches of documents around hits of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), table.value
        for batch in batches:
            for begin, stop, data, rows in pieces(batch.column(1)):
                words = words_of(data, rows, ALNUM)
                found = list(_stretches(words, words.hashes(powers), bits, solid))
                if not found:
                    continue
                keys = [int(mixed((w * constants(len(w), 9)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
                        for _, _, w, _, _ in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([begin + f[0] for f in found])),
                    pa.array([int(f[1]) for f in found], pa.int64()), pa.array(keys, pa.int64()),
                    *[_lists([f[k] for f in found], pa.int64()) for k in (2, 3, 4)],
                ], ["doc_id", "start", "key", "words", "seeds", "places"])

    id_type = docs.schema[docs.columns[0]].dataType.simpleString()
    return docs.mapInArrow(
        tidy(run), f"doc_id {id_type}, start long, key long, words array<long>, seeds array<long>, places array<long>")


def best_overlap(words: np.ndarray, item: np.ndarray, offset: int, cost: int = COST) -> tuple[int, int, int]:
    """(start, stop, equal words) of the best stretch of words aligned with item[0] at ``offset``."""
    low, high = max(0, offset), min(len(words), offset + len(item))
    if high <= low:
        return 0, 0, 0
    equal = words[low:high] == item[low - offset:high - offset]
    gain = np.r_[0, np.cumsum(np.where(equal, 1, -cost))]
    lowest = np.minimum.accumulate(gain)
    stop = int(np.argmax(gain - lowest))
    start = int(np.argmin(gain[:stop + 1]))
    return low + start, low + stop, int(equal[start:stop].sum())


def _verified(pairs: DataFrame, least: int) -> DataFrame:
    """The best overlap of each (stretch, item, offset) that has enough equal words.

    ``words`` are those of the stretch that lie over the item; an item that
    begins before the stretch has a negative offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, spans = [], []
            for i, (words, item, offset) in enumerate(zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)])):
                words, item = np.array(words), np.array(item)
                start, stop, equal = best_overlap(words, item, min(0, offset))
                if len(item) <= least:  # a short item is compared whole
                    under = item[max(0, -offset):][:len(words)]
                    start, stop, equal = 0, len(under), int((words[:len(under)] == under).sum())
                if equal >= needed(len(item), least):
                    keep.append(i)
                    spans.append((max(0, offset) + start, max(0, offset) + stop, equal))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at),
                 *[pa.array([s[k] for s in spans], pa.int64()) for k in range(3)]],
                ["key", "item_id", "low", "high", "equal"])

    kind = pairs.schema["item_id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"key long, item_id {kind}, low long, high long, equal long")


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, least_equal: int = LEAST_EQUAL, shortest: int = 1,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, n_equal): the longest overlap of each document and item.

    Words are runs of ASCII letters and digits and of all other characters, A-Z
    lower-cased. An overlap has at least ``least_equal`` equal words; an item of
    no more words overlaps as a whole with all its words but one equal, and
    exactly if it has fewer than 8. Items of fewer than ``shortest`` words, null
    and empty texts overlap with nothing. A very long text is scanned whole, in
    the memory of its own words. Of equally long overlaps the first is
    given. Repeated rows and rows that share an id count as one document, rows
    with a null id too; items with a null id are left out. Empty tables give an empty result. Other columns are
    not read.
    """
    spark, shelf = docs.sparkSession, Shelf()
    items = shelf.settled(benchmark_words(
        benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col), F.col(item_text_col).cast("binary")), least_equal
    ).filter(F.size("words") >= shortest))
    short = [r[0] for r in items.select(F.size("words").alias("n")).filter(F.col("n") <= least_equal).distinct().collect()]
    solid = tuple(sorted({n for length in short for n in solid_lengths(length, least_equal)}))
    seeds = items.select("item_id", F.size("words").alias("length"), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "item_id", "length", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    table = spark.sparkContext.broadcast(bit_table(seeds.select("seed")))
    found = shelf.settled(document_stretches(docs.select(F.col(id_col), F.col(text_col).cast("binary")), table, solid))
    one = found.dropDuplicates(["key"]).select("key", "words", "seeds", "places")
    hits = one.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "key", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    pairs = shelf.settled(hits.join(seeds, "seed").select(
        "key", "item_id", "length", (F.col("at") - F.col("place")).alias("offset")).distinct())
    # only what lies over the item goes on; a repetitive stretch may have very many offsets
    over = F.slice("words", (F.greatest(F.col("offset"), F.lit(0)) + 1).cast("int"),
                   (F.col("length") + F.least(F.col("offset"), F.lit(0))).cast("int"))
    aligned = pairs.join(one.select("key", "words"), "key").select("key", "item_id", "offset", over.alias("words")).join(
        items.select("item_id", F.col("words").alias("item")), "item_id")
    good = _verified(aligned.select("key", "item_id", "words", "item", "offset"), least_equal)
    spans = found.select("doc_id", "start", "key").join(good, "key").select(
        "doc_id", "item_id", "equal", (F.col("start") + F.col("low")).alias("first_word"),
        (F.col("start") + F.col("high") - 1).alias("last_word"))
    best = F.max_by(F.struct("first_word", "last_word", "equal"), F.struct("equal", -F.col("first_word")))
    return spans.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.first_word", "b.last_word", F.col("b.equal").alias("n_equal"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The documents without an overlap, whole rows; rows with a null id stay if none of them overlaps.

    Items of fewer than ``shortest`` words are no ground to drop a document:
    clean ones hold them as well.
    """
    shelf = Shelf()
    dirty = shelf.settled(find_overlaps(docs, benchmark, shortest=shortest).select(F.col("doc_id").alias("_dirty")).distinct())
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_dirty"]), "left_anti")
