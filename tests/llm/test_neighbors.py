"""Similar vectors: hot cells, equal vectors, and recall at two sizes with the settings in use."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosa.llm import neighbors as N

T0 = dt.datetime(2023, 7, 1)
VECTOR = "uuid string, embedding array<float>, model string"


def frame(spark, x):
    return [(N.usable_vectors(spark.createDataFrame([(f"u{i:05d}", v.tolist(), "m") for i, v in enumerate(x)], VECTOR), "f", "embedding", "model"), False)]


def clustered(n, d, seed):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(40, d))
    return (centers[r.integers(0, 40, n)] + r.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("n", [3_000, 12_000])
def test_recall_as_in_use(spark, n):
    x = clustered(n, 32, n)
    found = N.nearest(frame(spark, x), F.substring("id", 2, 5).cast("int") % 50 == 0).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in sorted(found, key=lambda r: r.rank_no):
        got.setdefault(int(r.query[1:]), []).append((int(r.neighbor[1:]), r.cos))
    assert sorted(got) == list(range(0, n, 50))
    hit = 0
    for q, mine in got.items():
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:10].tolist()) & {i for i, _ in mine})
        assert len(mine) == 10 and all(abs(c - s[i]) < 1e-6 for i, c in mine)  # by the vectors, not by their codes
        assert [c for _, c in mine] == sorted((c for _, c in mine), reverse=True)
    assert hit >= 0.9 * 10 * len(got)


def test_hot_cell_is_split_and_nothing_lost(spark, monkeypatch):
    """Most vectors nearly equal: no slot holds more than its bound, and all pairs come out."""
    monkeypatch.setattr(N, "CELL", 64)
    monkeypatch.setattr(N, "SPLIT", 100)
    monkeypatch.setattr(N, "VISITORS", 150)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=16) + 0.12 * r.normal(size=(700, 16)), r.normal(size=(500, 16))]).astype(np.float32)
    sources = frame(spark, x)
    slots = N._slots(N._coded(sources, None, N._books(sources, N.CELL), None), True)
    most = slots.groupBy("grp", "cell", "i", "j", "among").count().agg(F.max("count")).first()[0]
    assert most <= 1.5 * (N.SPLIT + N.VISITORS)
    got = {(p.a, p.b) for p in N.similar_pairs(sources, 0.99).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.99, 1))
    want = {(f"u{a:05d}", f"u{b:05d}") for a, b in zip(i, j)}
    assert len(want) > 500 and got <= want and len(got) >= 0.99 * len(want)
    near = N.nearest(sources, F.lit(True)).groupBy("query").count().collect()
    assert len(near) == len(x) and all(n["count"] == 10 for n in near)


def test_equal_vectors_and_few(spark):
    x = np.ones((30, 4), np.float32)
    found = N.nearest(frame(spark, x), F.col("id") == "u00007").orderBy("rank_no").collect()
    assert [r.neighbor for r in found] == [f"u{i:05d}" for i in range(11) if i != 7] and all(r.cos == 1 for r in found)
    assert [(r.query, r.neighbor) for r in N.nearest(frame(spark, x[:2]), F.lit(True)).orderBy("query").collect()] == [("u00000", "u00001"), ("u00001", "u00000")]
    assert N.nearest(frame(spark, x[:1]), F.lit(True)).count() == 0
