"""Two tokenizers against a plain alignment with the libraries on whole texts."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlight.llm import alignment
from wardlight.llm.bpe import byte_characters
from wardlight.llm.queries import QUERIES, vocabulary_path

FOLDER = "/root/testdata/sf0.001"
PATHS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a  b   c ", "a\n b\n\n  c\t d", "x　y   z", "don't I'LL 's", "日本語 नमस्ते 👍🏽 ﬁ", "<|endoftext|> <s> </s> <0x0A> <unk>",
       "▁a b", "a ▁", "a\0b \x85 \x1c c", "aaaa" * 60, "é" * 50, "\r\n\r\n", "a  b", "1234567890 3.14", "tab\tx  \ty", "​ a​ b"]


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def plain(both, texts):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum, groups; whole texts through the libraries."""
    a, b = both
    code = {c: n for n, c in enumerate(byte_characters())}
    found, counts = [], collections.Counter()
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bytes_a = [bytes(code[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in x]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(z) for z in bytes_a]).tolist(), np.cumsum([len(z) for z in bytes_b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            links.append((x[k - 1], y[m - 1]))
            i, j = k, m
        counts.update(links)
        found.append((x, y, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return [(len(x), len(y), len(g), len(z), sum(counts[p] == best[p[1]] for p in z), sum(counts[p] for p in z), ";".join(g)) for x, y, g, z in found]


def listed(rows):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def test_query_equals_plain(spark, both):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    wanted = plain(both, docs.text.tolist())
    got = listed(QUERIES["op12_cross_tokenizer_alignment"](spark, FOLDER).collect())
    assert got == {i: (*w[:6], digest(w[6])) for i, w in zip(docs.doc_id, wanted)}


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    letters = "abé ß日 \n\t'.,1▁　s" + "  " * 4
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return [*ODD, *mixed, None, " ".join(f"word{i} 日本 the" for i in range(40_000))]


@pytest.mark.parametrize("piece", [1, 7, 256])
def test_odd_texts(spark, both, odd_texts, piece):
    texts = odd_texts if piece > 1 else odd_texts[:-1]
    extra = {c: F.lit(1) for c in ("row", "a_id", "times", "links", "best", "n_a")}
    rows = [*enumerate(texts), (len(texts), texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)
    wanted = plain(both, [t for _, t in rows])
    got = alignment.align_tokenizers(docs, *PATHS, piece=piece).collect()
    assert listed(got) == {i: (*w[:6], digest(w[6])) for i, w in enumerate(wanted)}
    assert {r.doc_id: r.groups for r in got} == {i: w[6] for i, w in enumerate(wanted)}


def test_repeated_and_null_ids(spark, both):
    rows = [(1, "one two"), (1, "three"), (None, "one two"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_a, r.n_b, r.count_sum) for r in alignment.align_tokenizers(docs, *PATHS).collect())
    assert got == sorted((w[0], w[1], w[5]) for w in plain(both, [t for _, t in rows]))
    assert alignment.align_tokenizers(docs.limit(0), *PATHS).count() == 0


def test_join_instead_of_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(50)
    first = listed(alignment.align_tokenizers(docs, *PATHS).collect())
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert listed(alignment.align_tokenizers(docs, *PATHS).collect()) == first


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 64, 1000])
def test_merge_in_pieces(piece):
    rng = np.random.default_rng(piece)
    for _ in range(60):
        a, b = (np.flatnonzero(rng.random(rng.integers(1, 300)) < rng.random()) for _ in range(2))
        i, j = alignment.common_ends(a, b, piece)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_pieces_are_equal_work():
    a, b = np.arange(0, 3000, 3), np.arange(1000, 1100)
    edges = np.append(np.arange(0, 1100, 100), 1100)
    from_a = alignment.split_points(a, b, edges)
    merged = np.sort(np.concatenate([a, b]), kind="stable")
    assert all(len(merged[s:e]) == 100 for s, e in zip(edges, edges[1:]))
    for d, k in zip(edges, from_a):
        assert sorted([*a[:k], *b[:d - k]]) == merged[:d].tolist()
