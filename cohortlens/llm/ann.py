"""Approximate nearest neighbours with balanced posting lists (largest inner product).

Inner products become distances by one more component: x' = (x, sqrt(M^2 - |x|^2)), q' = (q, 0),
M being the largest norm of the table; then |x' - q'|^2 falls as <x, q> grows.

Index. Centroids come from a bounded sample (the ``sample`` smallest hashes of the ids): it is
halved again and again by a two-means direction at the median, so all cells hold equally many
sample vectors, however dense a region is. Every vector of the table is assigned to its nearest
centroid's list and, near a boundary, replicated to further centroids up to ``replicas`` whose
distance is at most (1 + ``closure``) times the nearest, unless a chosen centroid stands so near
to that centroid (SPREAD times the vector's distance) that its list covers the same ground. How
far replication goes below these bounds is fitted on the sample by the vectors a query then reads.

Search. A query finds its nearest centroids in an in-memory graph (each centroid linked both ways
with its nearest ones, parts left apart linked too, best-first walk from a few hubs) and takes the lists within the distance ratio
of the nearest; the ratio is fitted on the sample so that lists holding ``target`` of the true
neighbours of sample queries are taken, at least ``least_lists``. Lists are scanned in groups of
bounded size: a list with many vectors is split by hash, and so are many queries of a list; each
block of queries goes to each part. Each group returns a top k per query; one ranking joins them.

Exactly equal vectors are one entry: of each vector value the k + 1 smallest ids are kept,
all that a top k with ties to smaller ids can show; the ranking limit is applied before the
shuffle, so a vector shared by a third of all rows is cheap.

Broadcast: centroids, graph and lists of at most ``sample`` / ``cell`` cells.

Defined results: vectors that are null, empty, zero, of another length than most of the sample,
or hold a null or non-finite component take no part, as query or candidate; with fewer than k
candidates, all are returned; rows with a null id take no part; ids should be unique; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.sinks import materialize


#: Fixed value: how near two centroids stand, against a vector's distance, to count as one place.
SPREAD = 0.5


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, dim + 1)
    graph: list[np.ndarray]  # centroids linked to each
    hubs: np.ndarray
    norm: float
    ratio: float
    least_lists: int
    closure: float  # as fitted
    replicas: int


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


def balanced_cells(x: np.ndarray, cell: int) -> list[np.ndarray]:
    """Rows of x in cells of equal size (to one), by halving along two-means directions."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= cell:
            done.append(rows)
            continue
        part = x[rows]
        a, b = part[0], part[np.argmax(((part - part[0])**2).sum(1))]
        for _ in range(6):
            near = ((part - a)**2).sum(1) <= ((part - b)**2).sum(1)
            if near.all() or not near.any():
                break
            a, b = part[near].mean(0), part[~near].mean(0)
        order = rows[np.argsort(part @ (b - a), kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return done


def graph_search(ix: Index, q: np.ndarray, width: int) -> list[tuple[float, int]]:
    """Best-first walk on the centroid graph: up to ``width`` nearest (distance, centroid)."""
    def dist(rows):
        return np.sqrt(((ix.centroids[rows] - q)**2).sum(1))

    seen = set(ix.hubs.tolist())
    d = dist(ix.hubs)
    heap = sorted(zip(d.tolist(), ix.hubs.tolist()))
    best = heap[:width]
    while heap:
        d0, c = heapq.heappop(heap)
        if len(best) >= width and d0 > best[-1][0]:
            break
        new = [k for k in ix.graph[c].tolist() if k not in seen]
        if not new:
            continue
        seen.update(new)
        for item in zip(dist(np.array(new)).tolist(), new):
            if len(best) < width or item[0] < best[-1][0]:
                heapq.heappush(heap, item)
                insort(best, item)
                del best[width:]
    return best


def lists_of(ix: Index, q: np.ndarray) -> list[int]:
    """Lists a query reads: those within the distance ratio of its nearest centroid."""
    width = ix.least_lists
    while True:
        found = graph_search(ix, q, min(width, len(ix.centroids)))
        limit = found[0][0] * ix.ratio
        if found[-1][0] > limit or len(found) >= len(ix.centroids) or width > len(found):
            return [c for k, (d, c) in enumerate(found) if d <= limit or k < ix.least_lists]
        width *= 2


def replicas_of(c: np.ndarray, x: np.ndarray, closure: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) assignments of lifted vectors, with boundary replicas."""
    rows, lists = [], []
    between = _distances(c, c)
    for i in range(0, len(x), 4096):
        d = _distances(x[i:i + 4096], c)
        near = np.argsort(d, axis=1, kind="stable")[:, :2 * most]
        dn = np.take_along_axis(d, near, axis=1)
        chosen = np.zeros(near.shape, bool)
        chosen[:, 0] = True
        for k in range(1, near.shape[1]):
            ok = (dn[:, k] <= (1 + closure) * dn[:, 0]) & (chosen.sum(1) < most)
            for j in range(k):  # a chosen list whose centroid stands next to this one covers it
                ok &= ~(chosen[:, j] & (between[near[:, k], near[:, j]] < SPREAD * dn[:, k]))
            chosen[:, k] = ok
        r, k = np.nonzero(chosen)
        rows.append(r + i)
        lists.append(near[r, k])
    return np.concatenate(rows), np.concatenate(lists)


def _parts(links: np.ndarray) -> np.ndarray:
    """Least row that each row of a symmetric link matrix hangs together with."""
    part = np.arange(len(links))
    while True:
        low = np.minimum(part, np.where(links, part, len(part)).min(axis=1))
        if (low == part).all():
            return part
        part = low


def centroid_graph(d: np.ndarray, degree: int = 24) -> tuple[list[np.ndarray], np.ndarray]:
    """(links, parts): each centroid linked both ways with its nearest ones, and each part of the
    graph that these links leave apart with its nearest centroid outside, until all hang together."""
    links = np.zeros(d.shape, bool)
    near = np.argsort(np.where(np.eye(len(d), dtype=bool), -1.0, d), axis=1, kind="stable")[:, 1:degree + 1]
    np.put_along_axis(links, near, True, axis=1)
    links |= links.T
    first = part = _parts(links)
    while part.any():
        for p in np.unique(part):
            rows, others = np.flatnonzero(part == p), np.flatnonzero(part != p)
            i, j = np.unravel_index(d[np.ix_(rows, others)].argmin(), (len(rows), len(others)))
            links[rows[i], others[j]] = links[others[j], rows[i]] = True
        part = _parts(links)
    return [np.flatnonzero(x) for x in links], first


def _ratio(ranks: np.ndarray, holds: np.ndarray, true: np.ndarray, target: float) -> float:
    """Smallest distance ratio at which ``target`` of the true neighbours stand in a list that is read."""
    need = np.sort(np.array([np.where(holds[t], r, np.inf).min(axis=1) for t, r in zip(true, ranks)]).ravel())
    return float(need[min(len(need) - 1, int(target * len(need)))]) * (1 + 1e-9) if len(need) else 1.0


def fit(sample: np.ndarray, norm: float, cell: int, k: int, target: float, closure: float, replicas: int, least_lists: int) -> Index:
    """Centroids, graph, closure and distance ratio from the sample vectors. ``closure`` and
    ``replicas`` are upper bounds: of them and their halves, the pair that reads fewest vectors
    per sample query at ``target`` is taken."""
    x = lift(sample, norm)
    c = np.array([x[rows].mean(axis=0) for rows in balanced_cells(x, cell)])
    d = _distances(c, c)
    graph, parts = centroid_graph(d)
    # hubs spread over the order of cells, and one in each part that hung together by near links alone
    hubs = np.linspace(0, len(c) - 1, min(len(c), max(8, int(len(c)**0.5)))).astype(np.int64)
    hubs = np.unique(np.append(hubs, np.unique(parts, return_index=True)[1]))
    ask = np.arange(0, len(x), max(1, len(x) // 400))
    q = np.hstack([sample[ask], np.zeros((len(ask), 1))])
    score = sample[ask] @ sample.T
    score[np.arange(len(ask)), ask] = -np.inf  # a query is no neighbour of itself
    true = np.argsort(-score, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    dq = _distances(q, c)
    ranks = dq / dq.min(axis=1, keepdims=True)
    choices = {(closure / 2**i, max(min(replicas, 2), replicas >> i)) for i in range(4)}
    plans = []
    for near, most in sorted(choices):
        rows, lists = replicas_of(c, x, near, most)
        holds = np.zeros((len(x), len(c)), bool)
        holds[rows, lists] = True
        ratio = _ratio(ranks, holds, true, target)
        plans.append((float(((ranks <= ratio) * holds.sum(axis=0)).sum()), ratio, near, most))
    _, ratio, near, most = min(plans)
    return Index(c, graph, hubs, norm, ratio, least_lists, near, most)


def usable(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v): rows that take part; v as doubles."""
    v = F.col(vec).cast("array<double>")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    good = F.forall("v", lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)))
    return x.filter(F.coalesce(good, F.lit(False)) & F.exists("v", lambda a: a != 0))


def _smallest_hashes(vectors: DataFrame, sample: int) -> pa.Table:
    """v of the ``sample`` rows of smallest id hash. A threshold on the hash goes before the sort, so
    that the last task meets about twice the sample and not the first rows of every partition."""
    total, share = vectors.count(), 2 * sample + 1000
    while True:
        few = vectors
        if share < total:
            few = vectors.filter(F.xxhash64("id") < -2**63 + (share * 2**64) // total)
        top = few.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
        if top.num_rows >= sample or share >= total:
            return top
        share *= 4


def build(vectors: DataFrame, k: int, sample: int, cell: int, target: float, closure: float, replicas: int, least_lists: int) -> Index | None:
    """Fit the index on the ``sample`` rows of smallest id hash. vectors: (id, v)."""
    top = _smallest_hashes(vectors, sample)
    if not top.num_rows:
        return None
    lengths = [len(v) for v in top["v"].to_pylist()]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = np.array([v for v in top["v"].to_pylist() if len(v) == dim], dtype=np.float64)
    most = vectors.filter(F.size("v") == dim).agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))).first()[0]
    return fit(x, float(np.sqrt(most)), cell, k, target, closure, replicas, least_lists)


def post(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, id, v): the posting lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for b in batches:
            if b.num_rows:
                rows, lists = replicas_of(ix.centroids, lift(_matrix(b.column(1)), ix.norm), ix.closure, ix.replicas)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["list", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "list int, id long, v array<double>")


def route(queries: DataFrame, index: Index) -> DataFrame:
    """(list, id, v): the lists each query reads."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for b in batches:
            q = _matrix(b.column(1)) if b.num_rows else np.zeros((0, 0))
            found = [lists_of(ix, np.append(x, 0.0)) for x in q]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            lists = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0).take(rows), b.column(1).take(rows)], names=["list", "id", "v"])

    return queries.select("id", "v").mapInArrow(run, "list int, id long, v array<double>")


def _scan(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Top k of the list's vectors (right) per query (left), ties to smaller ids."""
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            qid, ids = left["id"].to_numpy(), right["id"].to_numpy()
            Q, X = _matrix(left["v"].combine_chunks()), _matrix(right["v"].combine_chunks())
            for i in range(0, len(Q), 256):
                rough = Q[i:i + 256] @ X.T
                rough[qid[i:i + 256, None] == ids] = -np.inf
                n = min(k + 4, len(ids))
                cut = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
                # every candidate as good as the cut, up to rounding of the matrix product
                r, c = np.nonzero((rough >= cut[:, None] - 1e-9 * np.maximum(np.abs(cut[:, None]), 1e-30)) & np.isfinite(rough))
                s = (Q[i + r] * X[c]).sum(axis=1)
                order = np.lexsort((ids[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                out_q.append(qid[i + r[keep]])
                out_v.append(ids[c[keep]])
                out_s.append(s[keep])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64), "score": cat(out_s, np.float64)})

    return run


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec: str = "embedding", sample: int = 20_000,
           cell: int = 64, target: float = 0.98, closure: float = 0.15, replicas: int = 8, least_lists: int = 4,
           group_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row where ``is_query`` (a
    condition on ``id``) holds, among all other rows."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec)
    by_value = Window.partitionBy("v").orderBy("id")
    distinct = materialize(rows.withColumn("_r", F.row_number().over(by_value)).filter(F.col("_r") <= k + 1).drop("_r"), "vectors")
    index = build(distinct, k, sample, cell, target, closure, replicas, least_lists)
    if index is None:
        return spark.createDataFrame([], result)
    dim = index.centroids.shape[1] - 1
    lists = materialize(post(distinct.filter(F.size("v") == dim), index), "posting-lists")
    size = lists.groupBy("list").agg(F.count(F.lit(1)).alias("_c"))  # at most one row per centroid
    size = size.select("list", F.ceil(F.col("_c") / group_rows).cast("int").alias("_parts"))
    x = lists.join(F.broadcast(size), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    q = materialize(route(rows.filter(is_query & (F.size("v") == dim)), index), "routed-queries")
    asked = q.groupBy("list").agg(F.count(F.lit(1)).alias("_q"))  # at most one row per centroid
    asked = asked.select("list", F.ceil(F.col("_q") / group_rows).cast("int").alias("_blocks"))
    x = x.join(F.broadcast(asked), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    q = q.join(F.broadcast(size), "list").join(F.broadcast(asked), "list")
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    group = ["list", "part", "block"]
    found = (q.select(*group, "id", "v").groupBy(*group)
             .cogroup(x.select(*group, "id", "v").groupBy(*group))
             .applyInArrow(_scan(k), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
