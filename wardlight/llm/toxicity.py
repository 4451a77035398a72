"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its embedding, if the training sample knew it, beside the mean
of the hashed embeddings of its character triples. A network of gated recurrent
units reads each window of words in both directions, attention weighs its
states, and a linear layer scores the window. Windows overlap and cover the
whole text; a text scores as its highest window. Training runs in numpy on a
bounded sample of labelled rows: first every window of a text takes part by its
softmax weight, later only the highest one. Scores are made probabilities on
sample rows that training has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import ALNUM, Powers, Words, pieces, release_memory, tidy, words_of
from wardlight.llm.langid import held_out

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_SIZE, CHAR_SIZE, ATTENTION = 8, 8, 8, 8
CHAR_BUCKETS = 1 << 12
# A word has its own embedding if at least so many texts of the sample have it.
LEAST_TEXTS = 4
# Bounds of the training sample, which the driver holds: texts of each label, characters of a text.
TEXTS = 1000
CHARACTERS = 6000
# A small sample is gone through more often, until so many steps are made; the softmax weights hold for two thirds.
EPOCHS, STEPS, BATCH, RATE = 6, 200, 64, 0.01
# Windows that are scored together.
BLOCK = 1024


def character_triples(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the triples around each byte of the words, and each word's first one."""
    inside = ALNUM[words.data]
    low = np.where(inside, words.data, 0x20).astype(np.uint32)
    low += ((low >= 65) & (low <= 90)).astype(np.uint32) * 32
    before, after = np.full(len(low), 0x20, np.uint32), np.full(len(low), 0x20, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[words.start] = 0x20
    after[words.end - 1] = 0x20
    hashed = (before * np.uint32(0x9E3779B1) + low * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35))
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    sizes = words.end - words.start
    return (hashed[inside] >> np.uint32(20)).astype(np.int64), np.cumsum(sizes) - sizes


def windows_of(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, words in it, text) of every window; together they cover all words of a text.

    A text without words has one empty window.
    """
    n = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), n)
    step = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    size = np.clip(counts[text] - step * STRIDE, 0, WINDOW)
    return first[text] + step * STRIDE, size, text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name, the known words' hashes in order, and the scale of the final score."""

    p: dict[str, np.ndarray]
    known: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, known: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)

        def random(*shape: int, size: float) -> np.ndarray:
            return rng.normal(0, size, shape).astype(np.float32)

        h, x = HIDDEN, WORD_SIZE + CHAR_SIZE
        return cls({
            "word": random(len(known) + 1, WORD_SIZE, size=0.05), "char": random(CHAR_BUCKETS, CHAR_SIZE, size=0.1),
            "wx": random(x, 6 * h, size=x ** -0.5), "bx": np.zeros(6 * h, np.float32),
            "u0": random(h, 3 * h, size=h ** -0.5), "u1": random(h, 3 * h, size=h ** -0.5),
            "a": random(2 * h, ATTENTION, size=(2 * h) ** -0.5), "ab": np.zeros(ATTENTION, np.float32),
            "v": random(ATTENTION, size=0.3), "w": random(2 * h, size=0.3), "b": np.zeros(1, np.float32),
        }, known)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the word table; 0 for a word that the sample did not know."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def inputs(self, ids: np.ndarray, triples: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's vector, and its part in the gates of both directions; the last row is padding."""
        both = np.zeros((len(ids) + 1, WORD_SIZE + CHAR_SIZE), np.float32)
        if len(ids):
            sizes = np.diff(np.r_[first, len(triples)])
            both[:-1, :WORD_SIZE] = self.p["word"][ids]
            both[:-1, WORD_SIZE:] = np.add.reduceat(self.p["char"][triples], first, axis=0) / sizes[:, None]
        return both, both @ self.p["wx"] + self.p["bx"]

    def forward(self, x: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = False):
        """Window scores; ``at`` holds word places, a column for each window. With ``keep`` also all states."""
        p, h_size = self.p, HIDDEN
        n_windows = at.shape[1]
        states = np.zeros((WINDOW, n_windows, 2 * h_size), np.float32)
        mask = (np.arange(WINDOW)[:, None] < size).astype(np.float32)
        saved = []
        for side in (0, 1):
            u, h = p[f"u{side}"], np.zeros((n_windows, h_size), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                gates = x[at[t], 3 * h_size * side:3 * h_size * (side + 1)]
                hu = h @ u
                rz = sigmoid(gates[:, :2 * h_size] + hu[:, :2 * h_size])
                r, z = rz[:, :h_size], rz[:, h_size:]
                n = np.tanh(gates[:, 2 * h_size:] + r * hu[:, 2 * h_size:])
                if keep:
                    saved.append((side, t, h, r, z, n, hu[:, 2 * h_size:]))
                h = h + mask[t][:, None] * (1 - z) * (n - h)
                states[t, :, h_size * side:h_size * (side + 1)] = h
        s = np.tanh(states @ p["a"] + p["ab"])
        e = np.where(mask > 0, s @ p["v"], -1e9)
        weights = np.exp(e - e.max(axis=0))
        weights *= mask
        weights /= np.maximum(weights.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weights, states)
        score = pooled @ p["w"] + p["b"][0]
        return (score, (states, mask, saved, s, weights, pooled)) if keep else score

    def backward(self, at: np.ndarray, n_words: int, kept, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the recurrent and attention parameters, and of the words' gate inputs."""
        p, h_size = self.p, HIDDEN
        states, mask, saved, s, weights, pooled = kept
        g = {name: np.zeros_like(p[name]) for name in ("u0", "u1")}
        g["w"], g["b"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * p["w"]
        d_weights = np.einsum("tbh,bh->tb", states, d_pooled)
        d_e = weights * (d_weights - (weights * d_weights).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", d_e, s)
        d_s = d_e[:, :, None] * p["v"] * (1 - s * s)
        g["a"], g["ab"] = np.einsum("tbh,tba->ha", states, d_s), d_s.sum(axis=(0, 1))
        d_states = weights[:, :, None] * d_pooled + d_s @ p["a"].T
        d_x = np.zeros((n_words, 6 * h_size), np.float32)
        carried = {0: np.zeros_like(d_pooled[:, :h_size]), 1: np.zeros_like(d_pooled[:, :h_size])}
        for side, t, before, r, z, n, hn in reversed(saved):
            u = p[f"u{side}"]
            d_h = carried[side] + d_states[t, :, h_size * side:h_size * (side + 1)]
            own = d_h * mask[t][:, None]
            d_an = own * (1 - z) * (1 - n * n)
            d_az = own * (before - n) * z * (1 - z)
            d_ar = d_an * hn * r * (1 - r)
            d_hu = np.concatenate([d_ar, d_az, d_an * r], axis=1)
            g[f"u{side}"] += before.T @ d_hu
            carried[side] = d_h - own * (1 - z) + d_hu @ u.T
            np.add.at(d_x, (at[t], slice(3 * h_size * side, 3 * h_size * (side + 1))), np.concatenate([d_ar, d_az, d_an], axis=1))
        return g, d_x

    def texts(self, data: np.ndarray, rows: np.ndarray, powers: Powers) -> np.ndarray:
        """The highest window score of each text."""
        words = words_of(data, rows, ALNUM)
        triples, first = character_triples(words)
        _, x = self.inputs(self.word_ids(words.hashes(powers)), triples, first)
        start, size, text = windows_of(words.counts, words.first[:-1])
        scores = np.concatenate([
            self.forward(x, *placed(start[i:i + BLOCK], size[i:i + BLOCK], len(x) - 1))
            for i in range(0, len(start), BLOCK)])
        return np.maximum.reduceat(scores, np.searchsorted(text, np.arange(len(rows) - 1)))

    def chances(self, data: np.ndarray, rows: np.ndarray, powers: Powers) -> np.ndarray:
        return sigmoid(self.scale * self.texts(data, rows, powers).astype(np.float64) + self.shift)


def placed(start: np.ndarray, size: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """The word at each step of each window, the padding row where a window is shorter."""
    steps = np.arange(WINDOW)[:, None]
    return np.where(steps < size, start + steps, padding), size


def fit(texts: list[str], labels: list[int], shares: tuple[float, float], seed: int = 3) -> Network:
    """Train on a sample; ``shares`` are the labels' shares among all labelled rows, for the final scale."""
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    rows = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=rows[1:])
    words = words_of(np.frombuffer(b"".join(raw), np.uint8), rows, ALNUM)
    hashes = words.hashes(Powers())
    owner = np.repeat(np.arange(len(raw)), words.counts)
    pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)]), axis=1)[0]
    known, in_texts = np.unique(pairs, return_counts=True)
    net = Network.fresh(known[in_texts >= LEAST_TEXTS])
    if not texts or len(set(labels)) < 2:
        net.scale, net.shift = 0.0, -20.0 if not any(labels) else 20.0
        return net
    ids = net.word_ids(hashes)
    triples, first = character_triples(words)
    sizes = words.end - words.start
    y = np.array(labels, np.float32)
    start, size, text = windows_of(words.counts, words.first[:-1])
    window_of = np.searchsorted(text, np.arange(len(raw) + 1))
    apart = rng.random(len(raw)) < 0.2
    train = np.flatnonzero(~apart)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    done = 0
    epochs = max(EPOCHS, STEPS * BATCH // max(1, len(train)))
    for epoch in range(epochs):
        order = rng.permutation(train)
        for begin in range(0, len(order), BATCH):
            batch = order[begin:begin + BATCH]
            which = np.concatenate([np.arange(window_of[i], window_of[i + 1]) for i in batch])
            bag = np.repeat(np.arange(len(batch)), window_of[batch + 1] - window_of[batch])
            edge = np.searchsorted(bag, np.arange(len(batch)))
            # the words of the batch, laid side by side
            lengths = words.counts[batch]
            shift = np.cumsum(lengths) - lengths - words.first[batch]
            own = np.concatenate([np.arange(words.first[i], words.first[i + 1]) for i in batch])
            cells = np.repeat(first[own] - np.r_[0, np.cumsum(sizes[own])[:-1]], sizes[own]) + np.arange(sizes[own].sum())
            both, x = net.inputs(ids[own], triples[cells], np.r_[0, np.cumsum(sizes[own])[:-1]] if len(own) else np.zeros(0, np.int64))
            at, width = placed(start[which] + shift[bag], size[which], len(own))
            scores = net.forward(x, at, width)
            top = np.maximum.reduceat(scores, edge)
            if 3 * epoch < 2 * epochs:
                weight = np.exp(scores - top[bag])
                weight /= np.add.reduceat(weight, edge)[bag]
                top = np.add.reduceat(weight * scores, edge)
            else:
                weight = np.zeros(len(scores), np.float32)
                weight[np.lexsort((-scores, bag))[edge]] = 1
            used = weight > 1e-3
            slope = ((sigmoid(top) - y[batch])[bag] * weight / len(batch))[used].astype(np.float32)
            _, kept = net.forward(x, at[:, used], width[used], keep=True)
            g, d_x = net.backward(at[:, used], len(x), kept, slope)
            g["wx"], g["bx"] = both.T @ d_x, d_x.sum(axis=0)
            d_both = (d_x @ net.p["wx"].T)[:-1]
            g["word"], g["char"] = 1e-5 * net.p["word"], 1e-5 * net.p["char"]
            np.add.at(g["word"], ids[own], d_both[:, :WORD_SIZE])
            np.add.at(g["char"], triples[cells], np.repeat(d_both[:, WORD_SIZE:] / sizes[own][:, None], sizes[own], axis=0))
            done += 1
            for name, slope_ in g.items():
                m, v = moments[name]
                m += 0.1 * (slope_ - m)
                v += 0.01 * (slope_ * slope_ - v)
                rate = RATE * np.sqrt(1 - 0.99 ** done) / (1 - 0.9 ** done)
                net.p[name] -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
    _calibrate(net, raw, y, np.flatnonzero(apart), shares)
    return net


def _calibrate(net: Network, raw: list[bytes], y: np.ndarray, test: np.ndarray, shares: tuple[float, float]) -> None:
    """Place the middle of the score where errors on rows that training left out cost least.

    The labels count by their shares among all labelled rows. Of equally good
    places the middle of the widest stretch is taken.
    """
    if len(set(y[test])) < 2:
        return
    rows = np.zeros(len(test) + 1, np.int64)
    np.cumsum([len(raw[i]) for i in test], out=rows[1:])
    s = net.texts(np.frombuffer(b"".join([raw[i] for i in test]), np.uint8), rows, Powers()).astype(np.float64)
    order = np.argsort(s)
    s, toxic = s[order], y[test][order] == 1
    cost = np.where(toxic, shares[1] / toxic.sum(), -shares[0] / (~toxic).sum())
    # cost of a limit below the first, between neighbours, and above the last
    errors = shares[0] + np.r_[0.0, np.cumsum(cost)]
    edges = np.r_[s[0] - 1, s, s[-1] + 1]
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    net.shift = -float(edges[widest] + edges[widest + 1]) / 2


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """Texts, labels and the labels' shares: at most TEXTS of each label, none longer than CHARACTERS,
    taken evenly by a hash of the id, from rows that are not held out."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("_y")).filter(~held_out("_id", 5, 0))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_y") == 1, 2.0 * TEXTS / counts.get(1, 1)).otherwise(2.0 * TEXTS / counts.get(0, 1))
    # the drawn ids are a bounded table of two numbers a row, so they may be broadcast
    drawn = marked.filter(draw < share).limit(6 * TEXTS)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.length("_t") <= CHARACTERS)
    rows = known.join(F.broadcast(drawn), "_id").orderBy(draw).limit(4 * TEXTS).collect()
    texts, y = [], []
    for label in (0, 1):
        own = [r["_t"] for r in rows if r["_y"] == label][:TEXTS]
        texts += own
        y += [label] * len(own)
    return texts, y, (counts.get(0, 0) / total, counts.get(1, 0) / total)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Network:
    """A network for these labels; the driver gives the memory of the training back."""
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col))
    release_memory()
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame | None = None, model: Network | None = None,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Without a model one is fitted on a bounded sample (TEXTS, CHARACTERS) of
    labelled rows that are not held out; where that has only one label, or
    none, every score is near that label, or 0. A null or empty text is scored
    as one empty window. A row with a null id counts as held out. Repeated rows
    give equal results, an empty table an empty one; columns other than id and
    text are not read.
    """
    model = fitted(docs, labels, id_col, text_col, label_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, powers = shared.value, Powers()
        for batch in batches:
            scores = [net.chances(data, rows, powers) for _, _, data, rows in pieces(batch.column(1))]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select(
        F.col(id_col), F.col(text_col).cast("binary").alias("text"), held_out(id_col, 5, 0).alias("held_out")
    ).mapInArrow(tidy(run), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, whole rows; scored in place, without a join.

    Every row is judged by its own text, so rows that repeat or share an id need
    not go together, and null ids make no difference. A null or empty text is
    scored as one empty window, a very long one in all its windows. An empty
    table gives an empty result.
    """
    model = fitted(docs, labels, id_col, text_col, "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, powers = shared.value, Powers()
        for batch in batches:
            column = batch.column(place).cast(pa.binary())
            scores = [net.chances(data, rows, powers) for _, _, data, rows in pieces(column)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
