"""Decontamination, n-gram join, components, LM scoring, nearest neighbours, pipeline: against
brute force on small tables, with odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann, components, decontaminate, gated_lm, ngram_join
from cohortlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# --- decontamination ---------------------------------------------------------------------------
def least_edits(window, text):
    """Edit distance of ``window`` to its nearest stretch of ``text`` (free ends in the text)."""
    row = [0] * (len(text) + 1)
    for a in window:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def windows_of(item, w):
    x = bytes(decontaminate.fold(item.encode()))
    last = max(len(x) - w, 0)
    return [x[a:a + w] for a in sorted({*range(0, last, w // 2), last})] if len(x) >= decontaminate.Q else []


def brute_hits(docs, items, w=64, errors=0.05):
    out = set()
    for d, t in docs:
        x = bytes(decontaminate.fold((t or "").encode()))
        for i, item in items:
            if any(least_edits(p, x) <= decontaminate.budget(len(p), errors) for p in windows_of(item or "", w)):
                out.add((d, i))
    return out


def garbled(rng, text, edits):
    x = list(text)
    for _ in range(edits):
        at = rng.randrange(len(x))
        rng.choice([lambda: x.__setitem__(at, "#"), lambda: x.insert(at, "#"), lambda: x.pop(at)])()
    return "".join(x)


def test_contaminations_match_brute_force(spark):
    rng = random.Random(5)
    words = ["shore", "lantern", "of", "the", "quietly", "marble", "and", "seven", "ox", "thunder", "é", "vale"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, say(20)), (2, say(9)), (3, "short one 12"), (4, None), (5, "tiny"), (6, say(40)), (1, say(15))]
    docs = []
    for k in range(60):
        i, item = rng.choice([x for x in items if x[1] and len(x[1]) >= 12])
        part = item if k % 3 else item[:rng.randrange(30, 120)]
        docs.append((k, say(rng.randrange(6)) + " " + garbled(rng, part.upper() if k % 5 == 0 else part, rng.randrange(6)) + "\n" + say(8)))
    docs += [(100, None), (101, ""), (102, say(30)), (102, items[0][1]), (103, "#" * 3000 + items[0][1])]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(9))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    for block in (1 << 21, 150):
        got = decontaminate.contaminations(df, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    assert 20 < len(want) < 64
    clean = [r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()]
    bad_texts = {(d, t) for d, t in docs if brute_hits([(d, t)], items)}
    assert sorted(clean) == sorted(d for d, t in docs if (d, t) not in bad_texts)
    assert decontaminate.contaminations(df.limit(0), bench).count() == 0
    assert decontaminate.contaminations(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_planted_passages_are_found(spark):
    docs = [(r.doc_id, r.text) for r in Q.read(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in Q.read(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in Q.decontamination_query(spark, SF).collect()}
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got


# --- components --------------------------------------------------------------------------------
def brute_components(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (3, 4), (4, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items() if k != v}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join -------------------------------------------------------------------------------
def brute_join(rows, k=3, num=90, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = brute_components(edges)
    return {(i, len(s), comp.get(i, i)) for i, s in sets.items()}


def near_copies(rng, n, length, words=400, most=6):
    base = [f"w{rng.randrange(words)}" for _ in range(length)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randrange(most)):
            x[rng.randrange(len(x))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
@pytest.mark.parametrize("opts", [{}, dict(light_list=2, block_rows=7, hot_limit=50, broadcast_rows=0), dict(light_list=4, block_bytes=9000)])
def test_join_matches_brute_force(spark, k, num, opts):
    rng = random.Random(k)
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "a  B c", "a b c d"]
    for n, length in ((25, 120), (12, 60), (8, 30), (10, 14), (10, 9), (12, 22), (6, 400)):
        texts += near_copies(rng, n, length, most=4 if length < 40 else 9)
    line = " ".join(f"b{i}" for i in range(40))  # a passage that many texts share
    texts += [line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 60))) for _ in range(30)]
    texts += [line] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.join_components(spark.createDataFrame(rows, DOCS), k=k, num=num, **opts).collect()
    assert {tuple(r) for r in got} == brute_join(rows, k, num) and len(got) == len(rows)


def test_join_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in Q.read(spark, SF, "documents").collect()]
    assert {tuple(r) for r in Q.ngram_join_query(spark, SF).collect()} == brute_join(rows)


def test_join_odd_inputs(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 5), (None, "x y z", 1), (4, None, 1), (3, "a b c d", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(map(tuple, ngram_join.join_components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (4, 0, 4), (3, 2, 1)], key=str)
    assert ngram_join.join_components(df.limit(0)).count() == 0
    kept = ngram_join.keep_first(df).collect()
    assert sorted(map(tuple, kept), key=str) == sorted((r for r in rows if r[0] != 3), key=str)


def test_boundary_follows_the_cost():
    assert ngram_join.boundary({}, 90, 100) == 0
    assert ngram_join.boundary({5: 100, 400: 9}, 90, 100) >= 5  # one key a set is cheaper than lists
    assert ngram_join.boundary({25: 100}, 90, 100) < 25  # hundreds of keys a set are not


# --- LM scoring --------------------------------------------------------------------------------
def test_lm_counts_and_base_are_exact_and_the_model_is_better(spark):
    rows = [(r.doc_id, r.text or "") for r in Q.read(spark, SF, "documents").collect()]
    toks = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None] for i, t in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i in toks if not held(i) for w in toks[i])
    n, v = sum(c.values()), len(c)
    for direct in (65_536, 20):  # with and without words counted in buckets
        out = gated_lm.score_documents(Q.read(spark, SF, "documents"), Q.held_out(7), direct=direct, bucket_bytes=200_000).collect()
        assert len(out) == len(rows)
        for r in out:
            w = toks[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
            assert r.score < 0
        h = [r for r in out if r.held_out]
        assert sum(r.score for r in h) > sum(r.base_score for r in h)


def small_model():
    rng = np.random.default_rng(0)
    voc = gated_lm.Vocabulary(np.arange(40, dtype=np.uint64), np.arange(40, 0, -1), np.full(64, 3), np.full(64, 2), 1000, 150)
    y = rng.integers(0, 104, 90).astype(np.int32)
    return voc, gated_lm.Model(voc, 4), y


def test_model_is_a_distribution():
    voc, m, _ = small_model()
    h = np.random.default_rng(1).standard_normal((3, 4), dtype=np.float32)
    ids = np.arange(len(voc.head) + 64, dtype=np.int32)
    for s in h:
        assert np.exp(gated_lm.log_probs(m, np.tile(s, (len(ids), 1)), ids)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_matches_differences():
    voc, m, y = small_model()
    X = np.concatenate([[len(m.x) - 1], y[:-1]]).reshape(-1, 1)[:12].astype(np.int32)
    Y, S = y[:12, None], np.zeros((12, 1), bool)
    S[[0, 5]] = True
    h0 = np.full((1, 4), 0.3, np.float32)

    def loss():
        h, total = h0, 0.0
        for t in range(12):
            h = gated_lm._step(m, X[t], np.where(S[t][:, None], np.float32(0), h))[0]
            total -= gated_lm.log_probs(m, h, Y[t])[0]
        return total / 12

    g, _ = gated_lm._backward(m, X, Y, S, h0)
    for i in np.random.default_rng(2).choice(np.flatnonzero(np.abs(g) > 1e-3), 25):
        old = m.flat[i]
        m.flat[i] = old + 1e-2
        up = loss()
        m.flat[i] = old - 1e-2
        down = loss()
        m.flat[i] = old
        assert g[i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3)


def test_state_is_carried_over_windows():
    voc, m, y = small_model()
    first = np.array([0, 7, 7, 90])
    whole = gated_lm.neural(m, y, first)
    assert np.allclose(whole, gated_lm.neural(m, y, first, memory=2), atol=1e-4)
    h, total = np.zeros((1, 4), np.float32), 0.0
    for t in range(7, 90):
        x = np.array([y[t - 1] if t > 7 else len(m.x) - 1])
        h = gated_lm._step(m, x, h)[0]
        total += gated_lm.log_probs(m, h, y[t:t + 1])[0]
    assert whole[2] == pytest.approx(total, abs=1e-3) and whole[1] == 0


def test_lm_odd_inputs(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "a b"), (1, "a b")], DOCS).withColumn("train", F.lit(1)).withColumn("n", F.lit(2))
    out = gated_lm.score_documents(df, F.lit(True), rounds=1).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 3, 3] and {r.base_score for r in out} == {0.0}
    mixed = gated_lm.score_documents(df, F.col("doc_id").isNull(), rounds=1).collect()
    assert sorted(r.n_known for r in mixed) == [1, 1, 3, 3]
    assert gated_lm.score_documents(df.limit(0), F.lit(False), rounds=1).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------
def brute_near(x, ids, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def test_ann_recall_and_scores(spark):
    t = Q.read(spark, SF, "embeddings").toPandas()
    x, ids = np.array(t.embedding.tolist(), np.float64), t.vec_id.to_numpy()
    want = brute_near(x, ids, np.flatnonzero(ids % 20 == 0), 20)
    got = defaultdict(list)
    place = {int(v): i for i, v in enumerate(ids)}
    for r in Q.ann_query(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id])
        assert r.score == pytest.approx(float(x[place[r.query_id]] @ x[place[r.vec_id]]), rel=1e-12)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_ann_odd_vectors_ties_and_few_candidates(spark):
    one, nan, inf = [1.0, 0.0], float("nan"), float("inf")
    rows = [(20, one), (40, None), (60, []), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [None, 1.0]), (160, [1.0, 2.0, 3.0]),
            (None, one), *[(i, one) for i in range(1, 8)], (9, [0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    out = ann.search(df, F.col("id") % 20 == 0, k=5).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(20, k, k, 1.0) for k in range(1, 6)]
    more = ann.search(df, F.col("id") % 20 == 0, k=50).orderBy("rank").collect()
    assert [r.vec_id for r in more] == [*range(1, 8), 9]
    split = ann.search(df, F.col("id") % 20 == 0, k=5, group_rows=2).orderBy("rank").collect()
    assert split == out
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_cells_are_balanced_and_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((300, 8)), np.full((300, 8), 0.1)])
    cells = ann.balanced_cells(x, 20)
    assert sorted(np.concatenate(cells).tolist()) == list(range(600))
    assert max(map(len, cells)) <= 20 and min(map(len, cells)) >= 9
    ix = ann.fit(rng.standard_normal((400, 8)), 10.0, 10, 5, 0.98, 0.15, 4, 4)
    hits = 0
    for q in np.hstack([rng.standard_normal((50, 8)), np.zeros((50, 1))]):
        best = int(((ix.centroids - q)**2).sum(1).argmin())
        hits += ann.graph_search(ix, q, 4)[0][1] == best
    assert hits >= 48


# --- pipeline ----------------------------------------------------------------------------------
def test_pipeline_matches_its_stages_by_brute_force(spark):
    import corpus_pipeline as P

    docs = Q.read(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    step = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    a = P.identify_language(spark, docs, SF)
    assert a.columns == columns
    kept = {r.doc_id for r in a.collect()}
    assert all(i in kept for i, r in rows.items() if len(r.text or "") > 40)  # clean documents stay
    b = P.dedup_lines(spark, a, SF)
    lines = Counter(k for i in kept for k in {x.strip(" \t\n\v\f\r").lower() for x in rows[i].text.split("\n")} - {""})
    for r in b.collect():
        want = "\n".join(x for x in rows[r.doc_id].text.split("\n") if lines[x.strip(" \t\n\v\f\r").lower()] < 10)
        assert (r.text, r.n_chars) == (want, len(want))
    c = P.drop_near_duplicates(spark, b, SF)
    texts = [(r.doc_id, r.text) for r in b.collect()]
    assert {r.doc_id for r in c.collect()} == {i for i, _, root in brute_join(texts, 5, 80) if i == root}
    d = P.drop_contaminated(spark, c, SF)
    items = [(r.item_id, r.text) for r in Q.read(spark, SF, "benchmark").collect()]
    found = {r.doc_id for r in decontaminate.contaminations(c, Q.read(spark, SF, "benchmark")).collect()}
    assert {i for i, t in texts for _, x in items if x in t} & {r.doc_id for r in c.collect()} <= found
    left = {r.doc_id for r in d.collect()}
    assert left == {r.doc_id for r in c.collect()} - found and d.columns == columns
    out = P.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left
    assert step["packing"](spark, docs.limit(0), SF).count() == 0
