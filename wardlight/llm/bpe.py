"""Byte pair encoding of whole tables, by an index from pairs to their places.

The distinct words of many documents are encoded together. All their symbols
lie in one array with links to the neighbours; an index maps each pair of
adjacent symbols to all its places. The pair of the lowest rank among those
present is taken, merged at its places from left to right, and the lists of the
pairs that thereby appear are extended; places that have changed meanwhile are
noticed when they are taken. Words do not touch, so this gives each word the
merges that it would get alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import tidy

# Bytes of tokens and their ids that a task remembers; those that do not come back go first.
REMEMBERED_BYTES = 32 << 20
# What a remembered token takes beside its characters and ids.
_ENTRY_BYTES = 200
# Characters of documents that a task encodes together; a longer text is encoded alone.
BATCH_CHARS = 2_000_000

# White space as the vocabulary's normalizer sees it, and the characters that stand for bytes.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# What Python's own split takes for white space beyond that.
_NOT_BLANK = "\x1c\x1d\x1e\x1f"
_NO_RANK = 1 << 60
# Fixed value: the usual pattern of words. It looks at nothing beside a word and matches no blank.
USUAL_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: merges by rank, ids, special tokens and how words are found."""

    ids: dict[str, int]
    merges: np.ndarray  # per rank: left id, right id, merged id
    special: dict[str, int]
    pattern: str
    suffix: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A file of the kind that is supported; any other is refused."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        steps = [x["type"] for x in whole["normalizer"]["normalizers"]]
        cuts = whole["pre_tokenizer"]["pretokenizers"]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or not plain:
            raise ValueError(f"{path} is not a lower-casing byte-level BPE vocabulary with word ends")
        if whole["decoder"] is not None or whole["post_processor"] is not None:
            raise ValueError(f"{path} has a decoder or post-processor")
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"]]
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        return cls(ids, merges, special, cuts[0]["pattern"]["Regex"], suffix)


class PairIndex:
    """The symbols of some words, linked to their neighbours, and every pair's places by rank.

    Where a word ends, its links lead to a last place whose symbol is in no pair.
    """

    def __init__(self, rules: Merges, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        self.rules, self.symbols = rules, np.append(symbols, rules.none)
        self.after, self.before = np.arange(1, n + 2), np.arange(-1, n)
        self.after[ends - 1] = self.after[n] = n
        self.before[starts] = self.before[n] = n
        self.places: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        self.note(np.arange(n))

    def note(self, at: np.ndarray) -> int:
        """Enter the pairs that begin at these places; the lowest rank among them."""
        at, ranks = self.rules.ranked(at, self.symbols[at], self.symbols[self.after[at]])
        if not len(at):
            return _NO_RANK
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for start, stop in zip(cuts, cuts[1:]):
            rank = int(ranks[start])
            if rank in self.places:
                self.places[rank].append(at[start:stop])
            else:
                self.places[rank] = [at[start:stop]]
                heapq.heappush(self.queue, rank)
        return int(ranks[0])

    def merge(self, at: np.ndarray, rank: int) -> int:
        """Merge the pair of a rank where it still stands; the lowest rank that appears.

        No two of the places may share a symbol.
        """
        left, right, merged = self.rules.rows[rank]
        gone = self.after[at]
        good = (self.symbols[at] == left) & (self.symbols[gone] == right)
        at, gone = at[good], gone[good]
        next_ = self.after[gone]
        self.symbols[at], self.symbols[gone], self.after[at] = merged, -1, next_
        self.before[next_] = at
        return self.note(np.concatenate([at, self.before[at]]))

    def run(self) -> None:
        """Apply all ranks in ascending order.

        All places of a pair are merged at once, unless they could overlap
        (a symbol twice) or a merge could bring up a pair of a lower rank,
        which would then go first; such pairs go place by place.
        """
        while self.queue:
            rank = heapq.heappop(self.queue)
            parts = self.places.pop(rank)
            here = parts[0] if len(parts) == 1 else np.concatenate(parts)
            if self.rules.at_once[rank]:
                self.merge(here, rank)
                continue
            here = np.unique(here)
            for done in range(len(here)):
                if self.merge(here[done:done + 1], rank) < rank and done + 1 < len(here):
                    self.places.setdefault(rank, []).append(here[done + 1:])
                    if len(self.places[rank]) == 1:
                        heapq.heappush(self.queue, rank)
                    break


class Merges:
    """Ranks of pairs, looked up many at a time."""

    def __init__(self, merges: np.ndarray, n_ids: int):
        self.merges, self.none, self.width = merges, n_ids, n_ids + 1
        self.rows = merges.tolist()
        keys = merges[:, 0] * self.width + merges[:, 1]
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], 1 << 62)  # a last one that equals no key
        lowest = np.full(n_ids, _NO_RANK)  # the lowest rank that each symbol takes part in
        for side in (0, 1):
            np.minimum.at(lowest, merges[:, side], np.arange(len(merges)))
        self.at_once = (merges[:, 0] != merges[:, 1]) & (lowest[merges[:, 2]] > np.arange(len(merges)))

    def ranked(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose pair has a rank, and the ranks."""
        keys = left * self.width + right
        found = np.searchsorted(self.keys, keys)
        good = self.keys[found] == keys
        return at[good], self.order[found[good]]


class Encoder:
    """Encodes and decodes with one vocabulary and remembers tokens between white space that come back.

    Tokens of the current generation are held beside those of the one before;
    when the current one is full it takes the other's place, so a token that is
    not met again is forgotten after at most two.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED_BYTES):
        self.special, self.remembered = vocabulary.special, remembered
        ids = vocabulary.ids
        n_ids = 1 + max([*ids.values(), *vocabulary.special.values()])
        self.rules = Merges(vocabulary.merges, n_ids)
        self.usual = vocabulary.pattern == USUAL_PATTERN
        self.words = regex.compile(vocabulary.pattern.replace("\\s", SPACE) + ("| " if self.usual else ""))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or "(?!)")
        letters = byte_characters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + vocabulary.suffix] for c in letters], np.int64)
        self.names = [""] * n_ids
        for name, i in [*ids.items(), *vocabulary.special.items()]:
            self.names[i] = name
        # token: its ids as bytes
        self.raw: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def tokens(self, text: str) -> list[str]:
        """The stretches between white space, and special tokens by themselves.

        Special tokens are found before anything else, in their own spelling.
        """
        found: list[str] = []
        at = 0
        for mark in self.marks.finditer(text):
            found += self._split(text[at:mark.start()])
            found.append(mark.group())
            at = mark.end()
        return found + self._split(text[at:] if at else text)

    def _split(self, text: str) -> list[str]:
        if any(c in text for c in _NOT_BLANK):
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def cut(self, tokens: list[str]) -> list[str]:
        """The words of all tokens in order, a blank after those of each token.

        Tokens hold no blanks, so joined by them they are normalized and cut in
        one pass, unless the pattern could see a neighbour. Lower-casing goes
        character by character: a capital sigma has one lower case.
        """
        joined = " ".join([*tokens, ""])
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        joined = joined.lower()
        if self.usual:
            return self.words.findall(joined)
        return [w for token in joined.split(" ")[:-1] for w in (*self.words.findall(token), " ")]

    def learn(self, tokens: set[str]) -> None:
        """Have all the tokens in the current generation; those not remembered are encoded together."""
        if self.held > self.remembered // 2:
            self.raw, self.older, self.held = {}, self.raw, 0
        new = tokens.difference(self.raw)
        back = list(new.intersection(self.older))
        self._keep(back, [self.older[t] for t in back])
        marks = list(new.intersection(self.special).difference(back))
        self._keep(marks, [np.array([self.special[t]], "<u4").tobytes() for t in marks])
        rest = list(new.difference(back, marks))
        self._keep(rest, self._encoded(rest))

    def _keep(self, tokens: list[str], raw: list[bytes]) -> None:
        self.raw.update(zip(tokens, raw))
        self.held += sum(map(len, tokens)) + sum(map(len, raw)) + _ENTRY_BYTES * len(tokens)

    def _encoded(self, tokens: list[str]) -> list[bytes]:
        """The ids of each token: those of its words, each distinct word merged once."""
        if not tokens:
            return []
        numbers: dict[str, int] = {" ": 0}
        which = np.array([numbers.setdefault(w, len(numbers)) for w in self.cut(tokens)])
        ids, ends = self._merged(list(numbers)[1:])
        # the blank has no ids, so that it only ends its token
        ends = np.r_[0, ends]
        sizes = np.diff(ends, prepend=0)[which]
        to = np.cumsum(sizes)
        raw = ids[np.repeat(ends[which] - to, sizes) + np.arange(to[-1])].astype("<u4").tobytes()
        stops = (4 * to[which == 0]).tolist()
        return [raw[s:e] for s, e in zip([0, *stops], stops)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where those of each end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spelled = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in spelled])
        starts = np.r_[0, ends[:-1]]
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        index = PairIndex(self.rules, symbols, starts, ends)
        index.run()
        symbols = index.symbols[:-1]
        left = symbols >= 0
        return symbols[left], np.cumsum(left)[ends - 1]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str, int]]:
        """Of each text: its ids as little-endian 32-bit numbers, the decoded text, the number of ids."""
        tokens = [self.tokens(text) for text in texts]
        self.learn(set().union(*tokens))
        tokens.reverse()
        while tokens:
            raw = b"".join(map(self.raw.__getitem__, tokens.pop()))
            yield raw, self.decode(np.frombuffer(raw, "<u4").tolist()), len(raw) // 4

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces joined by blanks, as a vocabulary without decoder has it."""
        return " ".join(map(self.names.__getitem__, ids))


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless switched off, ``ids`` (binary,
    little-endian unsigned 32-bit) for every row.

    A null or empty text has no tokens. Special tokens written in a text become
    their ids, as in the tokenizers library. Repeated rows are encoded alike;
    an empty table gives an empty result; other columns are not read. The file
    is read on the driver and its contents are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1])
            ends = np.cumsum(sizes.astype(np.int64))
            begin = 0
            while begin < len(column):
                done = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + BATCH_CHARS, side="right")))
                texts = [x or "" for x in column.slice(begin, stop - begin).to_pylist()]
                counts, hashes, decoded, raw = [], [], [], []
                for own, text, n in encoder.encode(texts):
                    counts.append(n)
                    hashes.append(hashlib.sha256(own).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if ids:
                        raw.append(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, stop - begin), pa.array(counts, pa.int64()),
                    pa.array(hashes, pa.string()), pa.array(decoded, pa.string()),
                    *([pa.array(raw, pa.binary())] if ids else []),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])
                begin = stop

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)
