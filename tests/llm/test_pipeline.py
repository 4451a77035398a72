"""Each stage on all that the one before kept, against a plain version."""

import hashlib
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import plain
import pytest
from tokenizers import Tokenizer

from wardlight.llm import graph, toxicity
from wardlight.llm.queries import vocabulary_path
from wardlight.llm.secret_scan import MASK

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows before, rows after) of every stage, written and read again."""
    folder, found = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        found.append((name, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}))
        docs = after
    return {name: (before, after) for name, before, after in found}


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert set(after) == {i for i in before if not scored[i]} and len(after) > 0.8 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    groups = plain.near_duplicates([(i, r["text"]) for i, r in before.items()], 5)
    assert set(after) == {i for i, (_, _, kept) in groups.items() if kept} and len(after) < len(before)


def test_documents_with_an_item_go(spark, stages):
    before, after = stages["decontamination"]
    spaced = lambda t: " ".join(["", *plain.ALNUM.findall(t.translate(plain.LOWER)), ""])
    items = [spaced(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holding = {i for i, r in before.items() if any(item in spaced(r["text"]) for item in items)}
    assert holding and set(after) == set(before) - holding


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    assert set(after) == set(before)
    for i, r in before.items():
        expected, at = [], 0
        for span in plain.secret_spans(r["text"]):
            start, end = map(int, span.split(":")[1:])
            if end > at:
                expected += [r["text"][at:start], MASK] if start >= at else []
                at = end
        assert after[i]["text"] == "".join([*expected, r["text"][at:]]) and after[i]["n_chars"] == len(after[i]["text"])


def test_tokens_are_those_of_the_library(stages):
    before, after = stages["bpe"]
    whole = Tokenizer.from_file(vocabulary_path())
    assert set(after) == set(before)
    for i, r in before.items():
        raw = np.array(whole.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(after[i]["ids"]) == raw and after[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()


def test_the_driver_gives_a_grown_heap_back():
    state = {"total": 300, "collected": 0}

    def collect():
        state["collected"] += 1

    runtime = SimpleNamespace(totalMemory=lambda: state["total"], maxMemory=lambda: 750, gc=collect)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))))
    heap = graph.Heap()
    heap.tidy(SimpleNamespace(_jvm=jvm))
    assert state["collected"] == 0
    state["total"] = 600
    heap.tidy(SimpleNamespace(_jvm=jvm))
    assert state["collected"] == 1
    heap.next = float("inf")  # too soon
    heap.tidy(SimpleNamespace(_jvm=jvm))
    assert state["collected"] == 1


def test_written_tables_and_training_leave_the_driver_tidy(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(graph, "HEAP", SimpleNamespace(tidy=lambda session: asked.append("heap")))
    monkeypatch.setattr(toxicity, "release_memory", lambda: asked.append("memory"))
    shelf = graph.Shelf()
    assert shelf.settled(spark.range(3)).count() == 3
    shelf.clear(spark)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == 20
    assert asked == ["heap", "memory"]
