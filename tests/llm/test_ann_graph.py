"""Nearest neighbours: skewed clusters, inner products of unequal norms, many queries of a list."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import ann


def walk(graph, start):
    seen, todo = {start}, [start]
    while todo:
        for k in graph[todo.pop()].tolist():
            if k not in seen:
                seen.add(k)
                todo.append(k)
    return seen


def skewed(rng):
    """13 clusters of unequal size, the small ones of a few cells."""
    sizes = [6000, 5000, 3000, 2000, 1000, 700, 500, 300, 150, 120, 100, 70, 60]
    return np.vstack([rng.standard_normal((n, 16)) * 0.3 + rng.standard_normal(16) * 4 for n in sizes])


def test_every_centroid_is_reached():
    rng = np.random.default_rng(3)
    x = skewed(rng)
    ix = ann.fit(x, float(np.sqrt((x**2).sum(1).max())), 64, 20, 0.98, 0.15, 8, 4)
    everything = set(range(len(ix.centroids)))
    assert all(walk(ix.graph, k) == everything for k in range(0, len(ix.centroids), 7))
    assert all(i in ix.graph[j] for i in everything for j in ix.graph[i].tolist())


def test_graph_of_one_and_two_centroids():
    for n in (1, 2):
        graph, _ = ann.centroid_graph(np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float))
        assert [g.tolist() for g in graph] == [[j for j in range(n) if j != i] for i in range(n)]


def test_a_query_is_not_its_own_neighbour():
    """Under inner product another vector may be the first hit; it counts as a neighbour."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 4)) * rng.uniform(0.1, 3, 400)[:, None]
    ix = ann.fit(x, float(np.sqrt((x**2).sum(1).max())), 20, 1, 1.0, 0.15, 8, 1)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    best = score.argmax(1)
    rows, lists = ann.replicas_of(ix.centroids, ann.lift(x, ix.norm), ix.closure, ix.replicas)
    q = np.hstack([x, np.zeros((len(x), 1))])
    d = ann._distances(q, ix.centroids)
    need = [(d[i, lists[rows == best[i]]].min() / d[i].min()) for i in range(len(x))]
    assert np.isclose(ix.ratio, max(need))


def test_many_queries_of_a_list_are_split(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    result = lambda rows: sorted(map(tuple, ann.search(df, F.col("id") % 2 == 0, k=5, cell=100, group_rows=rows).collect()))
    want = result(20_000)
    scan = ann._scan

    def bounded(k):
        inner = scan(k)

        def run(left, right):
            if left.num_rows > 100:
                raise ValueError(f"{left.num_rows} queries in one group")
            return inner(left, right)

        return run

    monkeypatch.setattr(ann, "_scan", bounded)
    assert result(40) == want


def read_and_recall(x, ix, k=20):
    """(share of the table that a query reads, recall at k by query) over every tenth vector."""
    rows, lists = ann.replicas_of(ix.centroids, ann.lift(x, ix.norm), ix.closure, ix.replicas)
    in_list = [rows[lists == c] for c in range(len(ix.centroids))]
    read, recall = [], []
    for i in range(0, len(x), 10):
        got = np.concatenate([in_list[c] for c in ann.lists_of(ix, np.append(x[i], 0.0))])
        read.append(len(got) / len(x))
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(np.isin(np.argsort(-score, kind="stable")[:k], got).mean())
    return float(np.mean(read)), np.array(recall)


def test_clustered_vectors_are_pruned():
    """Large and small clusters: few vectors are read, the small clusters are found too."""
    x = skewed(np.random.default_rng(6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ix = ann.fit(x, 1.0, 64, 20, 0.98, 0.15, 8, 4)
    read, recall = read_and_recall(x, ix)
    print(f"read {read:.3f} of the table, recall {recall.mean():.3f}, smallest clusters {recall[-50:].mean():.3f}")
    assert read < 0.25 and recall.mean() >= 0.95 and recall[-50:].mean() >= 0.9


def test_vectors_without_clusters_are_read_at_most_like_a_scan():
    x = np.random.default_rng(7).standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    wide = ann.fit(x, 1.0, 64, 20, 0.98, 0.15, 8, 4)
    read, recall = read_and_recall(x, wide)
    print(f"read {read:.3f} of the table, recall {recall.mean():.3f}, replicas {wide.replicas}, closure {wide.closure}")
    assert read < 1.3 and recall.mean() >= 0.95


def test_sample_is_of_the_smallest_hashes(spark):
    df = spark.range(5000).selectExpr("id", "array(cast(id as double)) v")
    want = [r.v for r in df.orderBy(F.xxhash64("id"), "id").limit(40).select("v").collect()]
    assert ann._smallest_hashes(df, 40)["v"].to_pylist() == want
    same = spark.range(3000).selectExpr("7L id", "array(1d) v")
    assert ann._smallest_hashes(same, 40).num_rows == 40
    assert ann._smallest_hashes(df, 9000).num_rows == 5000
