"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Every token of a text has the byte offset where it ends. The ends of tokenizer
A and those of tokenizer B are two sorted lists, and where they have a number
in common, both tokenizers cut. The lists of many texts lie one after another
and are merged together: a binary search on each of many equally spaced
diagonals tells how many of the first d ends come from A, which divides the
merge into pieces of equal work that know nothing of each other, wherever a
long text begins or stops. The pieces advance side by side, one step of all of
them at a time, and emit the ends that both sides have; pairs of ends that fall
on the boundary of two pieces are stitched in, and a group of tokens is what
lies between two common ends, in one piece or over many.

Texts are tokenized by the tokenizers' own libraries, in stretches that both
cut in any case: before a blank that ends a run of white space and follows
anything but a blank. Stretches that come back are tokenized once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.bpe import byte_characters
from wardlight.llm.graph import Shelf

# Ends that one piece of a merge takes.
PIECE = 256
# Characters of documents that a task aligns together; a longer text is alone.
BATCH_CHARS = 2_000_000
# Bytes of stretches and their ids that a task remembers.
REMEMBERED_BYTES = 96 << 20
# What a remembered stretch takes beside its characters and ids.
_ENTRY_BYTES = 200
# Stretches that are tokenized in one go.
TOGETHER = 2000
# Pairs of ids whose counts are sent to all tasks; with more, the counts are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000

# A blank with something other than a blank before it and no white space after it.
_CUT = re.compile(r" (?<=[^ ] )(?=\S)")
# Fixed value: the blank in the pieces of tokenizer B.
_BLANK = "▁"


def split_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d ends of the merge come from ``a``, for each diagonal d; of equal ends, a's is first."""
    low = np.maximum(diagonals - len(b), 0)
    high = np.minimum(diagonals, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        earlier = a[middle] <= b[diagonals[open_] - middle - 1]
        low[open_[earlier]] = middle[earlier] + 1
        high[open_[~earlier]] = middle[~earlier]


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] == b[j], rising, of two strictly rising lists."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.append(np.arange(0, total, piece, dtype=np.int64), total)
    from_a = split_points(a, b, edges)
    from_b = edges - from_a
    partner = np.full(len(b), -1, np.int64)
    i, j, stop_a, stop_b = from_a[:-1].copy(), from_b[:-1].copy(), from_a[1:], from_b[1:]
    last = np.full(len(i), -1, np.int64)  # the end that a piece took from a most recently
    far_a, far_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    for _ in range(piece):
        left, right = i < stop_a, j < stop_b
        take_a = left & (~right | (far_a[i] <= far_b[j]))
        take_b = right & ~take_a
        shared = take_b & (last == far_b[j])
        partner[j[shared]] = i[shared] - 1
        last = np.where(take_a, far_a[i], last)
        i += take_a
        j += take_b
    # the last end of one piece and the first one of the next
    at = from_a[1:-1], from_b[1:-1]
    inner = (at[0] > 0) & (at[1] < len(b))
    i, j = at[0][inner], at[1][inner]
    same = a[i - 1] == b[j]
    partner[j[same]] = i[same] - 1
    found = np.flatnonzero(partner >= 0)
    return partner[found], found


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the stretches of text met lately."""

    def __init__(self, a_file: str, b_file: bytes, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_file), SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        spelled = {c: n for n, c in enumerate(byte_characters())}
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(names.values()))
        for name, n in names.items():
            known = all(c in spelled for c in name)
            self.a_bytes[n] = bytes([spelled[c] for c in name]) if known else name.encode()
        self.b_bytes = []
        for n in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(n)
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(n) else name.replace(_BLANK, " ").encode())
        if any(_BLANK in self.b.id_to_piece(n).lstrip(_BLANK) for n in range(len(self.b_bytes))):
            raise ValueError("a piece of tokenizer B has a blank after a letter, so texts cannot be cut before blanks")
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.spelling = Spelling(max(len(self.a_bytes), len(self.b_bytes)))
        # stretch: as 32-bit numbers how many ids of A there are, those, and the ids of B; nothing where they spell other bytes than the text
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered, self.held = remembered, 0

    def learn(self, stretches: set[str]) -> None:
        """Have all the stretches in the current generation; those not remembered are tokenized."""
        if self.held > self.remembered // 2:
            self.known, self.older, self.held = {}, self.known, 0
        new = stretches.difference(self.known)
        for own in new.intersection(self.older):
            self._keep(own, self.older[own])
            new.discard(own)
        # one beside another they are cut where they meet, unless white space begins or ends them
        plain = [x for x in new if not x[0].isspace() and x[-1] != " "]
        for begin in range(0, len(plain), TOGETHER):
            some = plain[begin:begin + TOGETHER]
            if self._tokenized(some):
                new.difference_update(some)
        for own in new:
            if not self._tokenized([own]):
                self._keep(own, b"")

    def _tokenized(self, some: list[str]) -> bool:
        """Tokenize stretches as one text and keep the ids of each; False if tokens do not spell the text or cross its cuts."""
        text = " ".join(some)
        raw = (" " + text).encode()
        ends = np.cumsum([1 + len(x.encode()) for x in some])
        counts, parts = [], []
        for ids, spelled, sizes in (
            (self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes, self.a_sizes),
            (self.b.encode(text), self.b_bytes, self.b_sizes),
        ):
            if b"".join([spelled[n] for n in ids]) != raw:
                return False
            flat = np.array(ids, "<i4")
            stops = np.cumsum(sizes[flat])
            at = np.searchsorted(stops, ends)
            if not np.array_equal(stops[at], ends):
                return False
            counts.append(np.diff(at, prepend=-1))
            whole, cuts = flat.tobytes(), [0, *(4 * (at + 1)).tolist()]
            parts.append([whole[s:e] for s, e in zip(cuts, cuts[1:])])
        heads = counts[0].astype("<i4").tobytes()
        for n, (own, a, b) in enumerate(zip(some, *parts)):
            self._keep(own, heads[4 * n:4 * n + 4] + a + b)
        return True

    def _keep(self, own: str, found: bytes) -> None:
        self.known[own] = found
        self.held += 2 * len(own) + len(found) + _ENTRY_BYTES

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts one after another: ids of A and of B, and how many of each every text has.

        A text that the tokens of either do not spell has none.
        """
        cut = [_CUT.split(x) if x else [] for x in texts]
        distinct = {own for parts in cut for own in parts}
        self.learn(distinct)
        place = {own: n for n, own in enumerate(distinct)}
        found = [self.known[own] for own in distinct]
        at = np.array([n for parts in cut for n in map(place.__getitem__, parts)], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(parts) for parts in cut])
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        bad = sizes == 0
        if bad.any():
            refused = np.zeros(len(texts), bool)
            refused[text[bad[at]]] = True
            at, text = at[~refused[text]], text[~refused[text]]
        flat = np.frombuffer(b"".join(found), "<i4")
        first = np.cumsum(sizes) - sizes
        n_a = np.zeros(len(sizes), np.int64)
        n_a[~bad] = flat[first[~bad]]
        out = []
        for start, n in ((first + 1, n_a), (first + 1 + n_a, sizes - 1 - n_a)):
            n = n[at]
            # the tokens of every stretch, stretch by stretch
            take = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((flat[take].astype(np.int64), np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)))
        return out[0][0], out[1][0], out[0][1], out[1][1]


@dataclass
class Aligned:
    """Groups of some texts: per text counts and spelling, and the pair of ids that ends every group."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    spelled: list[bytes]
    ends_a: np.ndarray
    ends_b: np.ndarray


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Spelling:
    """Ids as decimal words with the mark that follows them, padded to one width."""

    def __init__(self, n_ids: int):
        digits = np.arange(n_ids).astype(f"S{len(str(n_ids))}")
        self.sizes = np.char.str_len(digits) + 1
        self.width = int(self.sizes.max()) if n_ids else 1
        self.words = {mark: np.char.add(digits, mark.encode()).astype(f"S{self.width}") for mark in ",|;"}

    def marked(self, ids: np.ndarray, ends: np.ndarray, mark: str) -> np.ndarray:
        """Words of ids, commas behind them but for a mark behind those at ``ends``."""
        found = self.words[","][ids]
        found[ends] = self.words[mark][ids[ends]]
        return found


def spelled_groups(spelling: Spelling, a, b, n_a, n_b, i, j) -> list[bytes]:
    """Per text its groups in order: ids of A, a bar, ids of B; commas between ids, semicolons between groups."""
    in_a, in_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)  # tokens of each group
    line = np.empty(len(a) + len(b), f"S{spelling.width}")
    line[np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = spelling.marked(a, i, "|")
    line[np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b)] = spelling.marked(b, j, ";")
    whole = line.tobytes().replace(b"\0", b"")
    ends = [_offsets(spelling.sizes[ids])[_offsets(n)] for ids, n in ((a, n_a), (b, n_b))]
    edges = (ends[0] + ends[1]).tolist()
    return [whole[s:e - 1] if e > s else b"" for s, e in zip(edges, edges[1:])]


def align(tokenizers: Tokenizers, texts: list[str], piece: int = PIECE) -> Aligned:
    """Groups of tokens between common ends, for many texts at once."""
    a, b, n_a, n_b = tokenizers.ids(texts)
    # texts lie one after another, so ends rise over all of them
    i, j = common_ends(np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b]), piece)
    n_groups = np.diff(np.searchsorted(i, _offsets(n_a)))
    return Aligned(n_a, n_b, n_groups, spelled_groups(tokenizers.spelling, a, b, n_a, n_b, i, j), a[i], b[j])


def _batches(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with few enough characters; at least one row."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else []
    begin = 0
    while begin < len(column):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield begin, stop
        begin = stop


def aligned_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, piece: int = PIECE
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, ``groups`` (text, unless switched off), and the distinct
    pairs (a_ids, b_ids) that end a group with how often they do (times), for every row.

    A null or empty text has no tokens, nor has one that either tokenizer does
    not spell byte by byte. Repeated rows are aligned alike; other columns are
    not read; an empty table gives an empty result. Both files are read on the
    driver and their contents broadcast. A very long text is tokenized in its
    stretches and merged in pieces, in the memory of its own tokens.
    """
    with open(a_path, encoding="utf-8") as file:
        a_file = file.read()
    with open(b_path, "rb") as file:
        b_file = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((a_file, b_file))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string" + ", groups string" * groups
    schema += ", a_ids array<int>, b_ids array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(*shared.value)
        wide = max(len(tokenizers.a_bytes), len(tokenizers.b_bytes))
        for batch in batches:
            for begin, stop in _batches(batch.column(1), BATCH_CHARS):
                own = batch.slice(begin, stop - begin)
                found = align(tokenizers, [x or "" for x in own.column(1).to_pylist()], piece)
                row = np.repeat(np.arange(len(own)), found.n_groups)
                keys, times = np.unique((row * wide + found.ends_a) * wide + found.ends_b, return_counts=True)
                at = pa.array(np.searchsorted(keys, np.arange(len(own) + 1) * wide * wide), pa.int32())

                def lists(values: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(at, pa.array(values, pa.int32()))

                hashes = [hashlib.sha256(x).hexdigest() if x else "" for x in found.spelled]
                yield pa.RecordBatch.from_arrays([
                    own.column(0), pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups), pa.array(hashes, pa.string()),
                    *([pa.array([x.decode() for x in found.spelled], pa.string())] if groups else []),
                    lists(keys // wide % wide), lists(keys % wide), lists(times),
                ], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if groups else []), "a_ids", "b_ids", "times"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, links): how often each pair of ids ends together in all documents."""
    return _links(aligned).groupBy("a_id", "b_id").agg(F.sum("times").alias("links"))


def _links(aligned: DataFrame, *keep: str) -> DataFrame:
    rows = aligned.select(*keep, F.explode(F.arrays_zip("a_ids", "b_ids", "times")).alias("link"))
    return rows.select(*keep, F.col("link.a_ids").alias("a_id"), F.col("link.b_ids").alias("b_id"), F.col("link.times").cast("long").alias("times"))


def align_tokenizers(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, piece: int = PIECE
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, unless switched off,
    ``groups`` for every row; rows and texts as in aligned_documents.

    A link is a token of A and one of B that end together; its count is the
    number of links with the same two ids in all documents. ``n_best`` tells
    the links whose count is the highest among those of their id of B, ties
    included, ``count_sum`` adds up the counts of a document's links. Rows that
    share an id are told apart.
    """
    passing, result = Shelf(), Shelf()
    aligned = result.settled(aligned_documents(docs, a_path, b_path, id_col, text_col, groups, piece).withColumn(
        "row", F.monotonically_increasing_id()))
    counts = passing.settled(pair_counts(aligned))
    highest = counts.groupBy("b_id").agg(F.max("links").alias("highest"))
    told = result.settled(counts.join(highest, "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("highest")).alias("best")))
    passing.clear(docs.sparkSession)
    if told.count() <= BROADCAST_PAIRS:
        told = F.broadcast(told)
    sums = _links(aligned, "row").join(told, ["a_id", "b_id"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"), F.sum("times").alias("n_links"))
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")],
        "groups_sha256", *(["groups"] if groups else []))
