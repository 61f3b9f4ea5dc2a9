"""N-gram join with rows that have no id, repeat, or share an id."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_joins import DOCS, brute_components, brute_join, near_copies

from cohortlens.llm import ngram_join


def brute_rows(rows, k=3, num=90, den=100):
    """Component of each row: nodes are rows; rows of one id and linked rows hang together."""
    numbered = list(enumerate(rows))
    comp = {i: c for i, _, c in brute_join([(i, t) for i, (_, t) in numbered], k, num, den)}
    words = {i: n for i, n, _ in brute_join([(i, t) for i, (_, t) in numbered], k, num, den)}
    first = {}
    ties = []
    for i, (d, _) in numbered:
        if d is not None and words[i]:
            ties.append((first.setdefault(d, i), i))
    whole = brute_components([(comp[i], i) for i in comp] + ties)
    out = []
    for i, (d, _) in numbered:
        ids = [rows[j][0] for j in whole if whole[j] == whole[i] and rows[j][0] is not None and words[j]]
        out.append((d, words[i], (min(ids) if ids else None) if words[i] else d))
    return sorted(out, key=str)


def long_text(rng, n=60):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def edited(text, at):
    x = text.split()
    x[at] = f"new{at}"
    return " ".join(x)


def test_near_copy_without_an_id(spark):
    text = long_text(random.Random(1), 100)
    rows = [(1, text), (None, edited(text, 5)), (None, edited(text, 5))]
    got = sorted(map(tuple, ngram_join.join_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 98, 1), (None, 98, 1), (None, 98, 1)], key=str) == brute_rows(rows)


def test_documents_linked_through_a_text_without_an_id(spark):
    text = long_text(random.Random(2), 100)
    a, b = edited(edited(text, 3), 4), edited(edited(text, 90), 91)
    rows = [(7, a), (9, b), (None, text)]
    assert [c for _, _, c in brute_rows(rows)] == [7, 7, 7] and len({c for _, _, c in brute_join([(7, a), (9, b)])}) == 2
    got = sorted(map(tuple, ngram_join.join_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == brute_rows(rows)


@pytest.mark.parametrize("opts", [{}, dict(light_list=2, block_rows=7, hot_limit=50, broadcast_rows=0)])
def test_rows_without_an_id_match_brute_force(spark, opts):
    rng = random.Random(6)
    texts = [None, "", "a", "a b c"]
    for n, length in ((14, 120), (8, 60), (8, 30), (8, 9)):
        texts += near_copies(rng, n, length, most=9 if length > 40 else 4)
    rows = [(None if rng.random() < 0.4 else i, t) for i, t in enumerate(texts)]
    rows += rng.sample(rows, 12) + [(rng.randrange(20), t) for t in rng.sample(texts, 6)]
    rng.shuffle(rows)
    got = ngram_join.join_components(spark.createDataFrame(rows, DOCS), **opts).collect()
    assert sorted(map(tuple, got), key=str) == brute_rows(rows)


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline as P

    rng = random.Random(9)
    a, b = long_text(rng), long_text(rng)
    clean = long_text(rng)
    rows = [(3, a, 1), (3, a, 1), (3, a, 1), (None, a, 2), (None, b, 3), (None, b, 3), (None, edited(b, 2), 4),
            (5, edited(a, 59), 5), (5, clean, 6), (8, None, 7), (8, None, 7), (9, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    for docs in (df, df.withColumn("_id", F.lit(1)).withColumn("_t1", F.lit(2))):
        out = P.drop_near_duplicates(spark, docs, None)
        assert out.columns == docs.columns
        got = sorted((r.doc_id or 0, r.row) for r in out.collect())
        assert got in ([(0, x), (3, 1), (5, 6), (8, 7), (8, 7), (9, 8)] for x in (3, 4))


def test_one_row_of_each_group_matches_brute_force(spark):
    rng = random.Random(10)
    texts = [t for n, length in ((10, 120), (8, 60), (6, 12)) for t in near_copies(rng, n, length, most=6)]
    rows = [(None if rng.random() < 0.3 else rng.randrange(15), t) for t in texts]
    rows += rng.sample(rows, 10)
    got = [tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    comp = {i: c for i, _, c in brute_join([(i, t) for i, (_, t) in enumerate(rows)])}
    groups = {c: [rows[i] for i in comp if comp[i] == c] for c in comp.values()}
    assert len(got) == len(groups)
    for members in groups.values():
        [one] = [r for r in got if r in members]
        assert one[0] == min((d for d, _ in members if d is not None), default=None)


def test_frequent_elements_alone_do_not_gather_sets(spark, monkeypatch):
    """Before, all sets of a long list were a group, and whole sets were shipped for every pair of its blocks."""
    from cohortlens.sources import sinks

    rng = random.Random(11)
    passages = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(24)]
    texts = [" ".join(rng.sample(passages, 8)) for _ in range(60)]
    near = [edited(texts[k], 20) for k in (0, 1, 2)] + [edited(edited(texts[0], 1), 90)]
    rows = list(enumerate(texts + near))
    grouped = {}
    monkeypatch.setattr(sinks, "recorder", lambda name, df: grouped.update({name: df.count()}) if name in ("long-lists", "groups") else None)
    opts = dict(light_list=4, block_rows=1)  # blocks of 8 members of a list
    got = ngram_join.join_components(spark.createDataFrame(rows, DOCS), **opts).collect()
    assert {tuple(r) for r in got} == brute_join(rows)
    assert grouped["long-lists"] >= 60 and grouped["groups"] <= 100


def test_sketches_differ_in_no_more_places_than_sets():
    rng = np.random.Generator(np.random.PCG64(3))
    for num, den in ((90, 100), (50, 100), (100, 100)):
        sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 40, 200, 300, 2000)]
        for s in sets:
            t = np.sort(np.concatenate([s[len(s) // 20:], rng.integers(0, 2**63, 1 + len(s) // 30, dtype=np.uint64)]))
            n, m = sorted((len(s), len(t)))
            a, b = (np.frombuffer(ngram_join.sketch(x, num, den), np.uint64) for x in (s, t))
            width = min(len(a), len(b))
            a, b = (np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in (a, b))
            common = len(np.intersect1d(s, t))
            assert np.bitwise_count(a ^ b).sum() <= n + m - 2 * common
            assert ngram_join._linked(common, n, m, num, den) == (n + m - 2 * common <= ngram_join._apart(n, m, num, den))


def test_lists_are_tied_where_sets_may_link():
    rng = np.random.Generator(np.random.PCG64(4))
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (60, 120, 240, 500, 1000)]
    sets = sorted((np.concatenate([s[k * len(s) // 60:], rng.integers(0, 2**63, k * len(s) // 60, dtype=np.uint64)]) for s in base for k in range(5)), key=len)
    n = np.array([len(s) for s in sets])
    marks = [ngram_join.sketch(s, 90, 100) for s in sets]
    zero, side = np.zeros(len(sets), np.int64), np.arange(len(sets)) % 2
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if ngram_join._linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j], 90, 100)}
    for sides, guests in ((zero, zero), (side, zero), (zero, side)):
        a, b = ngram_join.scan_sketches(n, zero, sides, guests.astype(bool), marks, 90, 100)
        met = [(i, j) for i, j in linked if (sides[i] != sides[j] or not sides.any()) and not (guests[i] and guests[j])]
        alone = [(x, x) for x in range(len(sets))]
        trees, joined = brute_components(alone + met), brute_components(alone + list(zip(a.tolist(), b.tolist())))
        assert met and all(joined[i] == joined[j] for i, j in met)
        assert len(base) <= len(set(joined.values())) == len(sets) - len(a) <= len(set(trees.values()))
