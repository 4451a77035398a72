"""Chunks that end at paragraphs, lines or words, against a plain recursive version."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import retrieval as R


def plain_chunks(text, size, overlap, separators=R.SEPARATORS):
    """The rule as a recursive function over strings."""
    def joined(parts):
        chunks, held = [], []
        for part in parts:
            if sum(map(len, held)) + len(part) > size and held:
                chunks.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                    held = held[1:]
            held = [*held, part]
        return [*chunks, "".join(held)]

    def cut(text, separators):
        sep, rest = separators[0], separators[1:]
        pieces = list(text) if sep == "" else [p if n == 0 else sep + p for n, p in enumerate(text.split(sep))]
        chunks, fitting = [], []
        for piece in filter(None, pieces):
            if len(piece) < size:
                fitting.append(piece)
                continue
            chunks += joined(fitting) + (cut(piece, rest) if rest else [piece])
            fitting = []
        return chunks + joined(fitting)

    return [c.strip() for c in cut(text, list(separators)) if c.strip()]


def got(spark, texts, *args, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("other", F.lit(1))
    found = [[] for _ in texts]
    for r in R.split_documents(docs, *args, **more).orderBy("doc_id", "chunk_no").collect():
        assert r["chunk_no"] == len(found[r["doc_id"]]) and r["other"] == 1
        found[r["doc_id"]].append(r["chunk"])
    return found


def random_text(rng):
    marks = ["\n\n", "\n", " ", " ", " ", "\n\n\n", "  ", ". "]
    return "".join(rng.choice(["a", "word", "é日本", "x" * rng.randrange(1, 40)]) + rng.choice(marks) for _ in range(rng.randrange(1, 60)))


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 9), (25, 5), (25, 20), (100, 10), (1, 0), (2, 1)])
def test_equal_to_the_recursive_rule(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    texts = [random_text(rng) for _ in range(40)] + ["", "\n\n", "   ", "abc", "a" * 60, "\n\na\n\n\n\nb", " lead and trail "]
    assert got(spark, texts, size, overlap) == [plain_chunks(t, size, overlap) for t in texts]


def test_other_separators(spark):
    texts = ["one. two three. four five six. seven", "no mark here at all " * 5, "." * 30]
    assert got(spark, texts, 12, 4, separators=(".", " ")) == [plain_chunks(t, 12, 4, (".", " ")) for t in texts]


def test_chunks_respect_their_size(spark):
    rng = random.Random(1)
    texts = [" ".join(random_text(rng) for _ in range(200)), None]
    chunks = got(spark, texts)
    assert max(map(len, chunks[0])) <= 1000 and len(chunks[0]) > 20 and chunks[1] == []
    assert chunks[0] == plain_chunks(texts[0], 1000, 100)
    with pytest.raises(ValueError):
        R.split_documents(spark.createDataFrame([("a",)], "text string"), 10, 10)


def test_a_long_text_is_linear(spark):
    text = " ".join(f"word{i}" for i in range(60_000))
    assert got(spark, [text])[0] == plain_chunks(text, 1000, 100)
