"""Hard negatives: packed products are exact, mining equals a brute-force search, odd inputs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import hard_negatives as H
from cohortlens.llm import queries as Q

VECS = "vec_id long, embedding array<float>, label int"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 7), st.integers(1, 9), st.integers(0, 40), st.sampled_from([0, 1, 300, 2**20, 2**40, 2**70]), st.randoms())
def test_packed_products_are_exact(dim, anchors, rows, size, rng):
    def draw(n):
        x = np.array([[rng.randint(-size, size) for _ in range(dim)] for _ in range(n)], dtype=object).reshape(n, dim)
        return x if size >= 2**62 else x.astype(np.int64)

    a, c = draw(anchors), draw(rows)
    got = H.Packed(c, H.reach(a)).scores(a)
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert [[int(x) for x in r] for r in got] == want


def test_unit_vectors_share_words():
    """Components up to 1 at 64 coordinates: three candidates in a machine word."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    x = np.floor(256 * x / np.sqrt((x**2).sum(1))[:, None]).astype(np.int64)
    p = H.Packed(x, H.reach(x))
    assert p.fields >= 2 and p.words.dtype == np.int64 and p.words.shape == (-(-50 // p.fields), 64)
    assert (p.scores(x) == x @ x.T).all()


def brute(rows):
    def ok(r):
        return None not in r and all(x is not None and math.isfinite(x) for x in r[1])

    x = sorted({(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * np.float32(v).item()) for v in vec))
                for i, vec, lab in rows if ok((i, vec, lab))})
    out = []
    for a in x:
        if a[0] % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1]) for b in x if b != a and len(a[2]) == len(b[2])]
        for s, i, _ in sorted(t for t in scored if t[2] == a[1])[:5]:
            near = sorted(t for t in scored if t[2] != a[1] and 30 * -s <= 100 * -t[0] <= 90 * -s)[:10]
            out += [(a[0], i, k, t[1], -s, -t[0]) for k, t in enumerate(near, 1)]
    return sorted(out)


def rows_of(rng, n, dim):
    return [(i * 5, [rng.gauss(0, 1) / dim**0.5 for _ in range(dim)], rng.randrange(4)) for i in range(n)]


def run(spark, rows, monkeypatch, **kw):
    df = spark.createDataFrame(rows, VECS).withColumns({"id": F.lit("clash"), "own": F.lit(1), "place": F.lit(2), "v": F.lit(3)})
    monkeypatch.setattr(Q, "read", lambda *_: df)
    if kw:
        monkeypatch.setattr(H, "mine", lambda *a, f=H.mine: f(*a, **kw))
    return sorted(map(tuple, Q.hard_negatives_query(spark, None).collect()))


@pytest.mark.parametrize("kw", [{}, dict(anchor_rows=4, block_rows=37)])
def test_query_matches_brute_force(spark, monkeypatch, kw):
    rows = rows_of(random.Random(5), 300, 12)
    rows += [(1500 + i, rows[i % 9][1], i % 4) for i in range(40)]  # ties by id
    want = brute(rows)
    assert len(want) > 100
    got = run(spark, rows, monkeypatch, **kw)
    assert got == want


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = rows_of(rng, 60, 4)
    rows += [(None, [1.0] * 4, 1), (7000, None, 1), (7100, [1.0, None, 1.0, 1.0], 1), (7200, [1.0] * 4, None),
             (7300, [float("nan")] * 4, 1), (7400, [float("inf"), 0.0, 0.0, 0.0], 1), (7500, [], 1), (7600, [], 1), (7601, [], 2),
             (7700, [1.0, 2.0], 1), (7701, [1.0, 2.0], 1), (7702, [0.5, 1.0], 3), (7800, [0.0] * 4, 1)]
    rows += rows[:10]  # repeated rows are one
    assert run(spark, rows, monkeypatch) == brute(rows)


def test_huge_components(spark, monkeypatch):
    """Fields beyond a machine word, scores beyond a long: no crash, the order is exact."""
    rows = [(0, [1e12, 3.0], 1), (1, [1e12, 2.0], 2), (2, [1e12, 5.0], 1), (3, [4e11, 1.0], 2), (4, [3e38, 1.0], 1), (5, [1e-3, 2.0], 2)]
    got = run(spark, rows, monkeypatch)
    assert {r[1] for r in got} <= {2, 4} and all(abs(r[4]) <= H.MOST and abs(r[5]) <= H.MOST for r in got)


def test_empty_table(spark, monkeypatch):
    assert run(spark, [], monkeypatch) == []
    assert run(spark, [(1, [1.0], 0)], monkeypatch) == []
