"""Log lines, traces, chunks and neighbours."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.operators import logs as L
from wardlight.operators import retrieval as R
from wardlight.sources import readers

PATTERN = re.compile(L.LINE_PATTERN)


def test_log_file_with_broken_bytes(spark, tmp_path):
    raw = (
        b"[Mon] [error] [client 1.2.3.4] bad \xff byte\n"
        b"  [Tue] [Warn] no client  \n"
        b"not a log line\n"
        b"[Wed] [core:info] [client 5.6.7.8] sep \x1f inside\n"
        b"\x1f looks parsed\n"
        b"[Thu] [notice] [client 9.9.9.9] \n"
    ) + (
        "[Fri] [crit] [client ü] kept � sign\n".encode()
    ) + b"[] [error] empty\n"
    (tmp_path / "log.txt").write_bytes(raw)
    got = sorted(tuple(r) for r in L.parse_log_line(readers.read_logs(spark, str(tmp_path))).select(
        "level", "client_ip", "message").collect())
    want = []
    for line in raw.decode("utf-8", errors="ignore").split("\n"):
        match = PATTERN.match(line.strip())
        if match:
            want.append((match.group(2).lower(), match.group(3) or "unknown", match.group(4).strip()))
    assert got == sorted(want) and len(got) == 5


def test_ranking_and_evidence(spark):
    lines = ["[t] [error] [client a] x"] * 2 + ["[t] [emerg] [client b] y"] + ["[t] [info] z"] * 200 + ["[t] [odd] w"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    evidence = json.loads(L.diagnostic_evidence(df).first()["evidence"])
    assert evidence == [
        {"client_ip": "unknown", "message": "z", "count": 200},
        {"client_ip": "a", "message": "x", "count": 2},
        {"client_ip": "b", "message": "y", "count": 1},
    ]
    none = spark.createDataFrame([], "line string")
    assert json.loads(L.diagnostic_evidence(none).first()["evidence"]) == []


def test_service_logs_from_files(spark, tmp_path):
    rows = [
        {"timestamp": "2024-01-01T00:00:02.5Z", "level": "ERROR", "logger": "b", "message": "two", "incident_id": "i"},
        {"timestamp": "2024-01-01T00:00:01Z", "level": "INFO", "logger": "a", "message": "one", "incident_id": "i"},
        {"timestamp": "2024-01-01T00:00:03Z", "level": "INFO", "logger": "a", "message": "none"},
    ]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, rows)) + "\nTraceback: {\n")
    records, rejects = readers.read_json_logs(spark, str(tmp_path))
    assert records.count() == 3 and rejects.count() == 1
    assert [r["message"] for r in L.trace_incident(records).collect()] == ["one", "two"]
    summary = L.trace_summary(records).first()
    assert (summary["services"], summary["entries"], summary["errors"], summary["last_message"]) == (2, 2, 1, "two")


@pytest.mark.parametrize("size, overlap", [(1000, 100), (10, 0), (10, 3), (10, 5), (2, 1)])
def test_chunks_are_sliding_windows(spark, size, overlap):
    texts = ["", "a", "x" * size, "é" * (size + 1), "".join(chr(97 + i % 26) for i in range(5 * size)), "😀b\n" * size]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in R.chunk_documents(df, size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    stride = size - overlap
    for i, text in enumerate(texts):
        want, start = [], 0
        while start < len(text):
            want.append(text[start:start + size])
            if start + size >= len(text):
                break
            start += stride
        assert got.get(i, []) == want


def vectors(spark, prefix, array):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(array)], f"{prefix}_id long, vector array<double>")


@pytest.mark.parametrize("inline", [2048, 7])
@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e4)])
def test_neighbours_equal_brute_force(spark, monkeypatch, inline, scale, shift):
    monkeypatch.setattr(R, "INLINE_QUERIES", inline)
    monkeypatch.setattr(R, "CHUNK_BLOCK", 60)
    rng = np.random.default_rng(1)
    # many equal distances; far from the origin the rough distances are far off
    chunks = rng.integers(0, 4, (150, 3)) * scale + shift
    queries = rng.integers(0, 4, (20, 3)) * scale + shift
    got = R.vector_topk(vectors(spark, "query", queries), vectors(spark, "chunk", chunks).repartition(5), k=4)
    found = {(r["query_id"], r["rank"]): (r["chunk_id"], r["distance"]) for r in got.collect()}
    for q, query in enumerate(queries):
        gaps = np.sqrt(np.einsum("ij,ij->i", chunks - query, chunks - query))
        for rank, c in enumerate(np.lexsort((np.arange(150), gaps))[:4], 1):
            assert found.pop((q, rank)) == (c, pytest.approx(gaps[c]))
    assert not found


def test_neighbours_of_nothing(spark):
    none = vectors(spark, "query", np.zeros((1, 2))).limit(0)
    some = vectors(spark, "chunk", np.zeros((2, 2)))
    assert R.vector_topk(none, some).count() == 0
    empty = some.limit(0)
    assert R.vector_topk(vectors(spark, "query", np.zeros((1, 2))), empty).count() == 0


def test_context_is_nearest_first(spark):
    chunks = vectors(spark, "chunk", np.array([[5.0], [1.0], [2.0]])).withColumn("chunk", F.concat(F.lit("t"), "chunk_id"))
    got = R.retrieve_context(vectors(spark, "query", np.array([[0.0]])), chunks)
    assert got.first()["context"] == "t1\nt2"
