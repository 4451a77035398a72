"""Near-duplicate groups by a chosen-path similarity join.

A document is the set of its word shingles. Rows with equal sets form a class
with one representative. Representatives are placed in nodes of several
independent trees: a root deals all members by their minwise token at its own
coordinate; a node below chooses a fixed number of coordinates, the same for
all its members, and each deals the members into child nodes. The number is so
large that a pair at the threshold meets in 1.5 children or more on average,
so its chance to meet in some small node does not fade with the depth; the
number of trees sets it.

Small nodes are compared exhaustively, large ones branch again. Only groups
are wanted, so nodes whose members are in one group already are finished: a
node of thousands of near copies ends as soon as links to few members have
joined it. Links are proposed by 64 minwise values and confirmed on full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import NOT_SPACE, Powers, constants, mixed, pieces, shingles, tidy, words_of
from wardlight.llm.graph import Shelf, components

COORDINATES = 64
# Independent trees at least; more where the threshold is low.
TREES = 12
# Chance that a pair at the threshold which no other text connects may have of meeting in no tree.
LOST = 1e-4
# Nodes up to this size are compared exhaustively.
SMALL_NODE = 32
# A proposal may have this many standard deviations fewer equal coordinates than the threshold asks.
SLACK = 4.5
# Mean share of equal tokens with a node's smallest member from which the node is compared rather than branched.
TIGHT = 0.3
# Levels of branching before new links are confirmed and finished nodes are dropped.
LEVELS = 3
# Shingles and members that one comparison task holds; heavier nodes meet block by block if they are tight, else branch on.
BLOCK_ITEMS = 1 << 22
BLOCK_ROWS = 4096
# Levels after which nodes that are still heavier are compared block by block, tight or not.
DEPTH = 24

_SKETCH = "doc_id long, k0 long, k1 long, n_shingles long, sketch array<long>, roots array<long>"


def branches(threshold: float) -> int:
    """How many coordinates every node below a root chooses; a fixed number, so that none chooses none."""
    return min(COORDINATES, math.ceil(1.5 / threshold))


def lost(trees: int, threshold: float, levels: int = 100) -> float:
    """Chance that a pair at the threshold, alone, meets in no node that lies so many levels below the roots."""
    total = 0.0
    for equal in range(COORDINATES + 1):
        share, gone = equal / COORDINATES, 0.0
        for _ in range(levels):
            gone = (1 - share + share * gone) ** branches(threshold)
        weight = math.comb(COORDINATES, equal) * threshold**equal * (1 - threshold) ** (COORDINATES - equal)
        total += weight * (1 - share + share * gone) ** trees
    return total


def enough_trees(threshold: float) -> int:
    """The fewest trees, at least TREES and at most COORDINATES, that lose few enough pairs at any depth."""
    return next((t for t in range(TREES, COORDINATES) if lost(t, threshold) <= LOST), COORDINATES)


def root_choices(trees: int, seed: int = 1) -> np.ndarray:
    """The coordinate of each tree's root; no two trees share one before all are taken."""
    return np.resize(np.random.default_rng(seed).permutation(COORDINATES), trees)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketched(docs: DataFrame, words: int, roots: np.ndarray) -> DataFrame:
    """Per row: the identity of its shingle set (null if empty), its size, minwise tokens of 16 bits, root nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, factors, salts = Powers(), constants(COORDINATES, 3), constants(len(roots), 5)
        for batch in batches:
            ids = batch.column(0)
            for begin, stop, data, rows in pieces(batch.column(1)):
                found = words_of(data, rows, NOT_SPACE)
                runs, first = shingles(found.hashes(powers), found.first, words)
                keys = np.zeros((stop - begin, 2), np.int64)
                sizes = np.zeros(stop - begin, np.int64)
                for i in np.flatnonzero(np.diff(first)):
                    own = np.unique(runs[first[i]:first[i + 1]])
                    sizes[i] = len(own)
                    keys[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                full = np.flatnonzero(sizes)
                lows = np.zeros((len(full), COORDINATES), np.uint64)
                for c in range(COORDINATES if len(full) else 0):
                    lows[:, c] = np.minimum.reduceat(runs * factors[c], first[full])
                lows = mixed(lows + np.arange(COORDINATES, dtype=np.uint64))
                nodes = mixed(lows[:, roots] ^ salts)
                sketch = _signed(np.ascontiguousarray((lows >> np.uint64(48)).astype(np.uint16)).view(np.uint64))
                sizes_of = np.zeros(stop - begin + 1, np.int32)

                def lists(values: np.ndarray) -> pa.Array:
                    sizes_of[1:] = np.cumsum(np.where(sizes > 0, values.shape[1], 0))
                    return pa.ListArray.from_arrays(
                        pa.array(sizes_of.copy()), pa.array(_signed(np.ascontiguousarray(values)).ravel()))

                empty = sizes == 0
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, stop - begin), pa.array(keys[:, 0], mask=empty),
                    pa.array(keys[:, 1], mask=empty), pa.array(sizes), lists(sketch), lists(nodes),
                ], ["doc_id", "k0", "k1", "n_shingles", "sketch", "roots"])

    return docs.mapInArrow(tidy(run), _SKETCH)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, items): the distinct shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for begin, stop, data, rows in pieces(batch.column(1)):
                found = words_of(data, rows, NOT_SPACE)
                runs, first = shingles(found.hashes(powers), found.first, words)
                items = [_signed(np.unique(runs[first[i]:first[i + 1]])) for i in range(stop - begin)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), pa.array(items, pa.list_(pa.int64()))],
                    ["id", "items"])

    return docs.mapInArrow(tidy(run), "id long, items array<long>")


def _equal_tokens(a: Column, b: Column) -> Column:
    """How many of the minwise tokens are equal; four of them share a number."""
    lanes = (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -1 << 48)

    def equal(i: int) -> list[Column]:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        return [(x.bitwiseAND(F.lit(lane)) == 0).cast("int") for lane in lanes]

    return reduce(lambda x, y: x + y, [c for i in range(COORDINATES // 4) for c in equal(i)])


def _sized(rows: DataFrame, settled) -> DataFrame:
    """Rows of nodes with at least two members, with the node's size and smallest member."""
    nodes = settled(rows.groupBy("node").agg(
        F.count("*").alias("size"), F.min("id").alias("leader")).filter("size > 1"))
    return rows.join(nodes, "node")


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows of the next level: one for each coordinate that the row's node chooses."""
    start, step = F.xxhash64("node", F.lit("start")), F.xxhash64("node", F.lit("step")).bitwiseOR(F.lit(1))

    def child(k: Column) -> Column:
        # an odd step meets no coordinate twice
        i = (start.bitwiseAND(F.lit(COORDINATES - 1)) + k * step.bitwiseAND(F.lit(COORDINATES - 1))).bitwiseAND(F.lit(COORDINATES - 1))
        cell = F.get("sketch", F.floor(i / 4).cast("int"))
        token = F.call_function("shiftrightunsigned", cell, (i % 4 * 16).cast("int")).bitwiseAND(F.lit(0xFFFF))
        return F.xxhash64(F.col("node"), i, token)

    children = F.array(*[child(F.lit(k)) for k in range(branches(threshold))])
    return rows.select("id", "sketch", F.explode(children).alias("node"))


def _proposals(rows: DataFrame, least: int, small: int | None, apart: bool) -> DataFrame:
    """(a, b, equal) from nodes: smallest member with all, and in small nodes all with all.

    ``apart``: only members that different groups hold (column ``component``).
    """
    lefts = rows if small is None else rows.filter((F.col("id") == F.col("leader")) | (F.col("size") <= small))
    extra = ["component"] if apart else []
    a = lefts.select("node", F.col("id").alias("a"), F.col("sketch").alias("sa"), *[F.col(c).alias("ca") for c in extra])
    b = rows.select("node", F.col("id").alias("b"), F.col("sketch").alias("sb"), *[F.col(c).alias("cb") for c in extra])
    on = (a["node"] == b["node"]) & (F.col("a") < F.col("b"))
    if apart:
        on &= F.col("ca") != F.col("cb")
    return a.join(b, on).select("a", "b", _equal_tokens(F.col("sa"), F.col("sb")).alias("equal")).filter(
        F.col("equal") >= least).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, in whole numbers."""
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib")).cast("long")
    return pairs.join(a, "a").join(b, "b").withColumn("both", both).filter(
        100 * F.col("both") >= percent * (F.size("ia") + F.size("ib") - F.col("both"))).select("a", "b")


def _tight(large: DataFrame, settled) -> DataFrame:
    """Nodes whose members resemble the smallest one: branching would part them slowly, so they are compared."""
    lead = large.filter("id = leader").select("node", F.col("sketch").alias("_lead"))
    alike = large.join(lead, "node").groupBy("node").agg(F.avg(_equal_tokens(F.col("sketch"), F.col("_lead"))).alias("mean"))
    return settled(alike.filter(F.col("mean") >= TIGHT * COORDINATES).select("node"))


def _unfinished(rows: DataFrame, groups: DataFrame | None, settled) -> DataFrame:
    """Rows with their group so far, of nodes whose members are in several groups."""
    if groups is None:
        held = rows.withColumn("component", F.col("id"))
    else:
        held = rows.join(groups.withColumnRenamed("component", "_c"), "id", "left").withColumn(
            "component", F.coalesce("_c", "id")).drop("_c")
    nodes = settled(held.groupBy("node").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("node"))
    return settled(held.join(nodes, "node", "left_semi"))


def linked_members(ids: np.ndarray, groups: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Exhaustive comparison of a bounded node: pairs that join its groups, one for each join.

    Members meet as bit rows over the shingles that at least two of them have.
    A member with too few such shingles cannot be linked. Members of one group
    are not compared.
    """
    sizes = np.array([len(x) for x in items])
    values, where = np.unique(np.concatenate(items), return_inverse=True)
    shared = np.bincount(where, minlength=len(values)) > 1
    owner = np.repeat(np.arange(len(ids)), sizes)
    keep = shared[where]
    both = np.bincount(owner[keep], minlength=len(ids))
    able = np.flatnonzero(100 * both >= percent * sizes)
    column = (np.cumsum(shared) - 1)[where[keep]]
    bits = np.zeros((len(ids), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[keep], column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    bits, sizes, ids, label = bits[able], sizes[able], ids[able], groups[able].copy()
    found = []
    for i in range(len(able) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        same = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in others[100 * same >= percent * (sizes[others] + sizes[i] - same)]:
            if label[j] != label[i]:
                found.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return found


def _blocks(full: DataFrame, whole: Column) -> DataFrame:
    """Per node: its largest group ``main``, the blocks that this group and the other members take, and ``whole``.

    A node that one task can hold has no blocks of its main group and one of all members.
    Otherwise two blocks fit in a task, and each side has one at least.
    """
    per = full.groupBy("node", "component").agg(
        F.count("*").alias("n"), F.sum(F.size("items")).alias("weight"), F.max(whole).alias("whole"))
    both = per.groupBy("node").agg(
        F.max_by(F.struct("component", "n", "weight"), F.struct("n", "component")).alias("m"),
        F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max("whole").alias("whole"))

    def share(n: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(2 * weight / BLOCK_ITEMS), F.ceil(2 * n / BLOCK_ROWS), F.lit(1).cast("long"))

    light = (F.col("n") <= BLOCK_ROWS) & (F.col("weight") <= BLOCK_ITEMS)
    return both.select(
        "node", "whole", light.alias("light"), F.col("m.component").alias("main"),
        F.when(light, 0).otherwise(share(F.col("m.n"), F.col("m.weight"))).cast("long").alias("mains"),
        F.when(light, 1).otherwise(share(F.col("n") - F.col("m.n"), F.col("weight") - F.col("m.weight"))).cast("long").alias("others"))


def _exhausted(held: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the groups of nodes, whose rows have the columns of _blocks.

    A node of several blocks is compared for each pair of blocks, but members
    of its largest group do not meet each other.
    """

    def run(table: pa.Table) -> pa.Table:
        column = table.column("items").combine_chunks()
        flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        at = at - at[0]
        items = [flat[at[i]:at[i + 1]] for i in range(len(at) - 1)]
        found = linked_members(
            table.column("id").to_numpy(), table.column("component").to_numpy(), items, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    lead = ~F.col("light") & (F.col("component") == F.col("main"))
    own = F.when(lead, F.pmod(F.xxhash64("id"), F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), F.col("others")))
    first = F.when(lead, F.col("mains")).otherwise(F.lit(0).cast("long"))
    other = F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1))
    placed = held.select("node", "id", "component", "items", own.alias("own"), other.alias("other"))
    return placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select(
        "node", "low", "high", "id", "component", "items").groupBy("node", "low", "high").applyInArrow(run, "a long, b long")


class _Join:
    """Confirmed links so far, the groups they make, and the sets read for them."""

    def __init__(self, texts: DataFrame, words: int, percent: int, shelf: Shelf):
        self.texts, self.words, self.percent, self.shelf = texts, words, percent, shelf
        self.tried = self.sets = self.groups = None

    def read(self, ids: DataFrame) -> None:
        """Make sure that the sets of these ids are at hand."""
        missing = self.shelf.settled(ids if self.sets is None else ids.join(self.sets, "id", "left_anti"))
        if not missing.isEmpty():
            wanted = self.texts.join(missing, self.texts["doc_id"] == missing["id"], "left_semi")
            new = self.shelf.settled(shingle_sets(wanted, self.words))
            self.sets = new if self.sets is None else self.sets.union(new)

    def link(self, good: DataFrame) -> None:
        """Join the groups of confirmed links."""
        if not good.isEmpty():
            links = good if self.groups is None else good.union(
                self.groups.filter("id > component").select(F.col("component").alias("a"), F.col("id").alias("b")))
            self.groups = components(links, self.shelf)

    def confirm(self, pairs: DataFrame) -> None:
        """Check pairs that have not been checked and join the groups of those that hold."""
        if self.tried is not None:
            pairs = self.shelf.settled(pairs.join(self.tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.read(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        self.link(self.shelf.settled(_confirmed(pairs, self.sets, self.percent)))

    def exhaust(self, rows: DataFrame, last: bool) -> DataFrame:
        """Compare unfinished nodes on full sets; returns the rows of nodes too heavy for one task that are not tight, unless ``last``.

        Column ``whole`` tells the rows of tight nodes.
        """
        held = _unfinished(rows, self.groups, self.shelf.settled)
        if held.isEmpty():
            return held
        self.read(held.select("id").distinct())
        full = held.join(self.sets, "id")
        nodes = self.shelf.settled(_blocks(full, F.col("whole")))
        fit = nodes if last else nodes.filter("light OR whole")
        self.link(self.shelf.settled(_exhausted(full.drop("whole").join(fit, "node"), self.percent)))
        return held.join(nodes.join(fit, "node", "left_anti"), "node", "left_semi").drop("component", "whole")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, trees: int | None = None,
    small_node: int = SMALL_NODE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row, under the given id name's values.

    Documents with 100 * intersection >= percent * union of their sets are
    linked; component_id is the smallest id that links reach, and the document
    with that id is kept. A text without words, or null, has an empty set, is
    linked with nothing and kept. Repeated rows are equal texts like any other;
    where one id has several texts, a link of any of them is a link of the id
    they share as smallest id of their classes. A null id cannot be linked: its
    component_id is null, or that of an equal text, and the row is kept. An
    empty table gives an empty result. Other columns of docs are not read.
    """
    threshold = percent / 100
    least = int(np.floor(COORDINATES * threshold - SLACK * np.sqrt(COORDINATES * threshold * (1 - threshold))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    result, passing, early = Shelf(), Shelf(), Shelf()
    settled = passing.settled
    sketches = early.settled(sketched(texts, words, root_choices(trees or enough_trees(threshold))))
    rows_of = result.settled(sketches.select("doc_id", "n_shingles", "k0", "k1"))
    known = sketches.filter("doc_id IS NOT NULL AND k0 IS NOT NULL")
    classes = result.settled(known.groupBy("k0", "k1").agg(F.min("doc_id").alias("id")))
    firsts = settled(known.select("doc_id", "k0", "k1", "sketch", "roots").join(
        classes, ["k0", "k1"]).filter("doc_id = id").dropDuplicates(["id", "k0", "k1"]).select("id", "sketch", "roots"))
    early.clear(docs.sparkSession)
    rows = early.settled(_sized(firsts.select("id", F.explode("roots").alias("node")), early.settled))
    rows = settled(rows.join(firsts.select("id", "sketch"), "id"))
    early.clear(docs.sparkSession)
    join = _Join(texts, words, percent, passing)
    # first one link for each member, the most promising one; then what is still apart
    stars = _proposals(rows, least, 0, False)
    join.confirm(settled(stars.groupBy("b").agg(
        F.max_by("a", F.struct("equal", -F.col("a"))).alias("a")).select("a", "b")))
    depth = 0
    while not rows.isEmpty():
        found = waiting = None
        for _ in range(LEVELS):
            depth += 1
            held = _unfinished(rows, join.groups, settled)
            new = settled(_proposals(held, least, small_node, True).select("a", "b"))
            found = new if found is None else found.union(new)
            large = held.filter(F.col("size") > small_node)
            tight = _tight(large, settled)
            alike = large.join(tight, "node", "left_semi").select("node", "id", "sketch")
            waiting = alike if waiting is None else waiting.union(alike)
            rows = settled(_sized(_children(large.join(tight, "node", "left_anti"), threshold), settled))
            if rows.isEmpty():
                break
        join.confirm(settled(found.distinct()))
        whole = waiting.withColumn("whole", F.lit(True)).union(rows.select("node", "id", "sketch", F.lit(False)))
        heavy = join.exhaust(settled(whole), depth >= DEPTH)
        rows = settled(_sized(_children(heavy, threshold), settled))
    groups = None if join.groups is None else result.settled(join.groups)
    passing.clear(docs.sparkSession)
    member = rows_of.join(classes, ["k0", "k1"], "left")
    if groups is not None:
        member = member.join(groups, "id", "left")
    else:
        member = member.withColumn("component", F.lit(None).cast("long"))
    return member.select(
        "doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one of each near-duplicate group left, whole rows.

    Of rows that share an id one stays. Rows with a null id stay.
    """
    kept = near_duplicates(docs, **settings).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(docs.columns).union(docs.filter("doc_id IS NULL"))
