"""Language identification: averaged hashed subword embeddings and a linear softmax.

The features of a text are the character sequences (as bytes, with A-Z
lower-cased) of lengths 1 to 4 inside its words, with a mark at both word ends,
hashed to buckets. A text is the mean of its features' embeddings, followed by
a linear softmax, both trained by stochastic gradient descent in numpy. The
mean and the softmax's inputs are linear, so for prediction each bucket is
reduced to one number per language. A temperature fitted on texts that training
has not seen makes scores probabilities, and the lowest score that keeps the
wanted precision there is the limit below which a prediction is not accepted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import NOT_SPACE, mixed, pieces, words_of

BUCKETS = 1 << 16
DIMENSIONS = 16
LENGTHS = (1, 2, 3, 4)
# Bounds of the training sample, which the driver holds: texts per language, characters taken of each.
TEXTS = 400
CHARACTERS = 2000
# A training text is cut into snippets of about so many bytes, so that short texts are learnt too.
SNIPPET = 160
EPOCHS, RATE, BATCH = 4, 4.0, 32
PRECISION = 0.98

_LETTER = re.compile(rb"[A-Za-z]")


def features(data: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the buckets in text order, and per text the first of them (one more at the end).

    Words are laid out with a mark before and after each; a sequence that would
    pass a word's second mark is none.
    """
    found = words_of(data, rows, NOT_SPACE)
    if not len(found.start):
        return [(np.zeros(0, np.int64), np.zeros(len(rows), np.int64)) for _ in LENGTHS]
    sizes = found.end - found.start
    spans = sizes + 2
    first = np.cumsum(spans) - spans
    laid = np.full(int(spans.sum()), 0x20, np.uint64)
    shift = np.repeat(first + 1 - found.start, sizes)
    inside = NOT_SPACE[data]
    at = np.flatnonzero(inside) + shift
    letters = data[inside].astype(np.uint64)
    upper = (letters >= 65) & (letters <= 90)
    laid[at] = letters + upper.astype(np.uint64) * np.uint64(32)
    room = np.repeat(first + spans, spans) - np.arange(len(laid))  # places up to the word's end
    edges = np.r_[first, len(laid)][found.first]  # the first place of each text
    result = []
    running = np.zeros(len(laid), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        running <<= np.uint64(8)
        running[:len(laid) - n + 1] |= laid[n - 1:]
        if n in LENGTHS:
            whole = room >= n
            buckets = (mixed(running[whole] + np.uint64(n << 40)) >> np.uint64(48)).astype(np.int64)
            result.append((buckets, np.r_[0, np.cumsum(whole)][edges]))
    return result


def by_text(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all lengths together, text by text."""
    owner = np.concatenate([np.repeat(np.arange(len(first) - 1), np.diff(first)) for _, first in found])
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(found[0][1])))
    return np.concatenate([buckets for buckets, _ in found])[order], edges


@dataclass(frozen=True)
class Model:
    """One number per bucket and language, the languages, the temperature and the limit of acceptance."""

    table: np.ndarray
    bias: np.ndarray
    languages: tuple[str, ...]
    temperature: float
    limit: float

    def logits(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Mean over a text's features of the buckets' numbers; zero features give the bias."""
        total = np.zeros((len(rows) - 1, len(self.languages)))
        counts = np.zeros(len(rows) - 1, np.int64)
        for buckets, first in features(data, rows):
            own = np.diff(first)
            full = np.flatnonzero(own)
            if len(full):
                total[full] += np.add.reduceat(self.table[buckets], first[full], axis=0)
            counts += own
        return total / np.maximum(counts, 1)[:, None] + self.bias

    def scores(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, rows) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def snippets(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Texts cut between words into pieces of about SNIPPET bytes, and the text each comes from."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        words, size, part = text.encode().split(), 0, []
        for w in words:
            part.append(w)
            size += len(w) + 1
            if size >= SNIPPET:
                parts.append(b" ".join(part))
                owner.append(i)
                size, part = 0, []
        if part:
            parts.append(b" ".join(part))
            owner.append(i)
    return parts, np.array(owner, np.int64)


def _buffer(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=rows[1:])
    return np.frombuffer(b"".join(parts), np.uint8), rows


def fit(texts: list[str], languages: list[str], seed: int = 5) -> Model:
    """Train on a sample; a fifth of its texts is kept for temperature and limit."""
    names = sorted(set(languages))
    if not names:
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros(1), ("und",), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    label_of_text = np.array([names.index(x) for x in languages])
    parts, owner = snippets(texts)
    labels = label_of_text[owner]
    apart = rng.random(len(texts)) < 0.2
    test, train = np.flatnonzero(apart[owner]), np.flatnonzero(~apart[owner])
    buckets, first = by_text(features(*_buffer(parts)))
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(names)), np.float32)
    bias = np.zeros(len(names))
    steps = EPOCHS * max(1, -(-len(train) // BATCH))
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for start in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            rows = order[start:start + BATCH]
            rows = rows[first[rows + 1] > first[rows]]
            if not len(rows):
                continue
            sizes = first[rows + 1] - first[rows]
            cells = np.concatenate([buckets[first[r]:first[r + 1]] for r in rows])
            at = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(embedding[cells], at, axis=0) / sizes[:, None]
            slope = softmax(mean @ weights + bias)
            slope[np.arange(len(rows)), labels[rows]] -= 1
            slope /= len(rows)
            back = (slope @ weights.T / sizes[:, None]).astype(np.float32)
            weights -= rate * (mean.T @ slope).astype(np.float32)
            bias -= rate * slope.sum(axis=0)
            np.add.at(embedding, cells, -rate * np.repeat(back, sizes, axis=0))
    model = Model(embedding @ weights, bias, tuple(names), 1.0, 0.0)
    if not len(test):
        return model
    logits, truth = model.logits(*_buffer([parts[i] for i in test])), labels[test]
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    temperature = float(min(losses, key=losses.get))
    chances = softmax(logits / temperature)
    top, right = chances.max(axis=1), chances.argmax(axis=1) == truth
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    limit = float(top[order][good[-1]]) if len(good) else 1.0
    return Model(model.table, bias, tuple(names), temperature, limit)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the checksum of the id as text falls on the part that is not learnt from; a null id does."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """At most TEXTS texts of each language, CHARACTERS of each, taken evenly by a hash of the id."""
    known = docs.filter(~held_out(id_col, 4, 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(1.2 * TEXTS / r["count"]))])
    # one scan; the draw leaves little over the bound, to which each language is then cut
    drawn = known.filter(draw < shares[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, CHARACTERS).alias("text")).limit(2 * TEXTS * len(counts))
    taken: dict[str, list[str]] = {}
    for r in drawn.collect():
        taken.setdefault(r["lang"], []).append(r["text"])
    pairs = [(text, lang) for lang in sorted(taken) for text in sorted(taken[lang], key=lambda t: zlib.crc32(t.encode()))[:TEXTS]]
    return [t for t, _ in pairs], [x for _, x in pairs]


def identify_languages(
    docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for every row.

    Without a model one is fitted on a bounded sample (TEXTS, CHARACTERS) of
    the rows that are not held out and have a text and a language. A null text,
    or one without a letter, is ``und`` with a score of 0 and not accepted;
    where nothing can be learnt, every text is. A row with a null id counts as
    held out. Repeated rows give equal results, an empty table an empty one;
    columns other than these three are not read.
    """
    model = fit(*training_sample(docs, id_col, text_col, lang_col)) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, lang_pred string, score double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for begin, stop, data, rows in pieces(batch.column(1)):
                chances = model.scores(data, rows)
                whole = data.tobytes()
                lettered = [_lettered(whole[rows[i]:rows[i + 1]]) for i in range(stop - begin)]
                best = chances.argmax(axis=1)
                names += [model.languages[k] if ok else "und" for k, ok in zip(best, lettered)]
                scores += np.where(lettered, chances.max(axis=1), 0.0).tolist()
            accepted = [s >= model.limit and n != "und" for n, s in zip(names, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(accepted, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(
        F.col(id_col), F.col(text_col).cast("binary").alias("text"), held_out(id_col, 4, 2).alias("held_out")
    ).mapInArrow(run, schema)


def _lettered(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))
