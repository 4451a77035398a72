"""Whitening and near-duplicate vectors against plain versions."""

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from compare import differences
from pyspark.sql import functions as F

from wardlight.llm import vector_dup, whitening
from wardlight.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_whitening(rows):
    """Every row's n, exact deviation, whitened coordinates up to sign and explained shares."""
    able = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in able}]
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    y = [[n * x[k] - s[k] for k in range(d)] for x in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for at, (i, x) in enumerate(able):
        own = [n * x[k] - s[k] for k in range(d)]
        w = np.array([float(Fraction(c, n)) for c in own]) @ vectors[:, :4] / np.sqrt(values[:4])
        out[at] = (i, n, sum(c * c for c in own), np.abs(w), values[:4] / np.trace(cov))
    return out


def test_whitening_equals_plain(spark):
    table = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(table.vec_id, table.embedding)]
    wanted = {i: rest for i, *rest in plain_whitening(rows).values()}
    got = QUERIES["op11_embedding_whitening"](spark, FOLDER).toPandas()
    assert got.dtypes["deviation"] == "int64" and len(got) == 4 * len(rows)
    for i, own in got.groupby("vec_id"):
        n, deviation, whitened, explained = wanted[i]
        own = own.sort_values("component")
        assert (own.n == n).all() and (own.deviation == deviation).all() and own.component.tolist() == [1, 2, 3, 4]
        assert np.allclose(own.whitened.abs(), whitened, rtol=1e-6, atol=1e-8) and np.allclose(own.explained, explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_signs_are_the_same_for_all_rows(spark):
    got = QUERIES["op11_embedding_whitening"](spark, FOLDER).select("vec_id", "component", "whitened").toPandas().pivot(
        index="vec_id", columns="component", values="whitened")
    table = pd.read_parquet(f"{FOLDER}/embeddings.parquet").set_index("vec_id").embedding
    distinct = ~pd.Series([tuple(np.floor(256 * v.astype(float))) for v in table], index=table.index).duplicated()
    fit = got.loc[distinct[distinct].index]
    assert np.allclose(np.cov(fit.T, bias=True), np.eye(4), atol=1e-9)


@pytest.mark.parametrize("scale", [1, 1 << 24, 1 << 29, 1 << 45])
def test_squares_are_exact(scale):
    rng = random.Random(scale)
    x = np.array([[rng.randrange(-scale, scale + 1) for _ in range(3)] for _ in range(5000)])
    n, sums = 70_001, [int(s) for s in x.sum(axis=0)]
    y = whitening.centred(x, n, sums)
    wanted = [[n * int(c) - s for c, s in zip(r, sums)] for r in x]
    assert y.tolist() == wanted
    assert whitening.square_sums(y[:whitening.ROWS]) == [sum(r[k] ** 2 for r in wanted[:whitening.ROWS]) for k in range(3)]
    assert whitening.row_squares(y) == [sum(c * c for c in r) for r in wanted]


ODD = [
    (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [math.nan, 1.0], 0), (6, [math.inf, 1.0], 0),
    (7, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [-1.0, -2.0], 0), (11, [1.0, 2.0], None),
    (12, [1.0, 2.0], 1), (None, [1.0, 2.0], 0), (13, [1.0, 2.0, 3.0], 0), (14, [1e300, 2e300], 0), (15, [0.0, 1.0], 0), (15, [-0.0, 1.0], 0),
    (16, [1.0, 0.0], 0), (None, [5.0, -1.0], 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {c: F.lit("x") for c in ("id", "x", "size", "k0", "members", "component", "n", "links", "low")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


def test_whitening_of_odd_rows(spark, odd):
    got = whitening.whiten(odd).toPandas()
    kept = [i for i, v, _ in ODD if v and len(v) == 2 and all(c is not None and math.isfinite(c) and abs(c) < 1e16 for c in v)]
    assert sorted(got.vec_id.fillna(-1)) == sorted(2 * [-1 if i is None else i for i in kept])
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-9 and got.n.nunique() == 1
    assert whitening.whiten(odd.limit(0)).count() == 0 and whitening.whiten(odd.filter("vec_id = 1")).count() == 0
    one = whitening.whiten(odd.filter("vec_id IN (7, 8)")).toPandas()
    assert len(one) == 6 and one.whitened.isna().all() and one.explained.isna().all() and (one.deviation == 0).all() and one.identity_error.isna().all()
    line = whitening.whiten(odd.filter("vec_id IN (7, 9)")).toPandas()
    assert line[line.component == 1].whitened.abs().round(9).tolist() == [1, 1] and line[line.component == 2].whitened.isna().all()


def test_far_entries(spark):
    rows = [(i, [float((i * 7919) % 101) * 1e12, float(i % 13) * 1e13]) for i in range(60)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).toPandas()
    wanted = {i: rest for i, *rest in plain_whitening(rows).values()}
    for i, own in got.groupby("vec_id"):
        assert all(int(x) == wanted[i][1] for x in own.deviation)
        assert np.allclose(own.sort_values("component").whitened.abs(), wanted[i][2][:2], rtol=1e-9)


def plain_vectors(rows, threshold=0.93):
    """Sorted (vec_id, n_links, component_id, kept), every pair compared."""
    def able(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    units = [np.array(v, float) / np.abs(v).max() if able(v) else None for _, v, _ in rows]
    links = [[] for _ in rows]
    for a, (_, _, label) in enumerate(rows):
        for b in range(a):
            u, v = units[a], units[b]
            if label is not None and label == rows[b][2] and u is not None and v is not None and len(u) == len(v):
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= threshold:
                    links[a].append(b)
                    links[b].append(a)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = [b for b in links[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links[a]), low, i is None or i == low))
    return out


def frame(rows):
    return pd.DataFrame(rows, columns=["vec_id", "n_links", "component_id", "kept"])


def test_vectors_of_odd_rows(spark, odd):
    assert differences(vector_dup.near_duplicate_vectors(odd).toPandas(), frame(plain_vectors(ODD))) == []
    assert vector_dup.near_duplicate_vectors(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [3, 40, 10_000])
def test_vectors_equal_plain(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    heads = rng.normal(size=(25, 16))
    # many pairs close to the threshold, chains of links, copies, a label with a third of all rows
    rows = [(int(i), (heads[rng.integers(25)] + rng.normal(size=16) * rng.choice([0.2, 0.27, 0.35])).astype("f4").tolist(), int(rng.choice([0, 0, 1, 2]))) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_dup.near_duplicate_vectors(table, block_rows=block_rows).toPandas()
    assert got.n_links.sum() > 400 and differences(got, frame(plain_vectors(rows))) == []


@pytest.mark.parametrize("width", [1, 3, 64, 3000])
def test_bound_holds(width):
    rng = np.random.default_rng(width)
    units = vector_dup.unit_rows(rng.normal(size=(60, width)) ** 3)
    codes = vector_dup.quantised(units)
    cosine = units @ units.T
    q, s, r = codes
    off = np.abs(cosine - (q.astype(float) @ q.astype(float).T) * np.outer(s, s))
    assert (off <= r[:, None] + r[None, :] + np.outer(r, r) + 1e-12).all()
    for threshold in np.quantile(cosine, [0.1, 0.5, 0.9, 0.99]):
        found = set(zip(*vector_dup.possible(codes, codes, threshold)))
        assert set(zip(*np.nonzero(cosine >= threshold))) <= found
