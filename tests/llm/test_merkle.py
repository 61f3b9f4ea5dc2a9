"""Merkle manifest: proofs against a plain recursive tree, folding, tampering, odd inputs."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import merkle
from cohortlens.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row):
    d, text, lang, source, n = row
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text))


def paths(nodes):
    """(top, per node the siblings' (before, after) from the bottom up) of one tree."""
    steps = [[] for _ in nodes]
    of = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a:a + 3]
            for k in range(len(run)):
                for i in of[a + k]:
                    steps[i].append((run[:k], run[k + 1:]))
            up.append(sha(run))
            below.append([i for k in range(len(run)) for i in of[a + k]])
        nodes, of = up, below
    return nodes[0], steps


def brute(rows):
    """Result rows of the query, from scratch."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], []
    for g in groups:
        own = sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, steps = paths([leaf(r) for r in own])
        tops.append(top)
        inner.append((own, steps))
    root, outer = paths(tops)
    out = []
    for top, (own, steps), more in zip(tops, inner, outer):
        for r, s in zip(own, steps):
            acc = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                acc = leaf((r[0], r[1] and r[1].replace("\n", ""), *r[2:]))
            for before, after in s + more:
                acc = sha(before + [acc] + after)
            out.append((r[0], leaf(r), top, root, sha(x for b, a in s + more for x in b + a), acc, acc == root))
    return sorted(out, key=str)


def query(spark, rows, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows, DOCS).withColumns({"r": F.lit("clash"), "digest": F.lit(1), "known": F.lit(2), "path": F.lit(3)})
    monkeypatch.setattr(Q, "read", lambda *_: df)
    return sorted(map(tuple, Q.merkle_query(spark, None).collect()), key=str)


def rows_of(rng, sizes):
    out, d = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "plain", "a\nb", "é\n\nü", "x" * 5000 + "\n"]) if rng.random() < 0.4 else f"{rng.random()}\nend"
            out.append((d, text, rng.choice([None, "", "en"]), source, rng.choice([None, 0, 7])))
            d += rng.randint(1, 3)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {None: 2, "a": 1}, {"a": 3, "b": 4, "": 9, None: 10}, {"hot": 300, "é": 82, "z": 81, "y": 27, "one": 1},
    {f"s{k}": 1 + k % 3 for k in range(100)}])
def test_query_matches_brute_force(spark, sizes, tmp_path, monkeypatch):
    rows = rows_of(random.Random(len(sizes)), sizes)
    got = query(spark, rows, tmp_path, monkeypatch)
    assert got == brute(rows)
    assert {g[-1] for g in got if zlib.crc32(str(g[0]).encode()) % 2} <= {True}


def test_null_ids_repeated_rows_and_equal_blocks(spark, tmp_path, monkeypatch):
    rows = [(None, "t", "en", "s", 1)] * 200 + [(5, None, None, None, None)] * 4 + [(1, "a\n", "en", "s", 2), (1, "a\n", "en", "s", 2)]
    assert query(spark, rows, tmp_path, monkeypatch) == brute(rows)


def test_empty_table(spark, tmp_path, monkeypatch):
    assert query(spark, [], tmp_path, monkeypatch) == []
    assert merkle.manifest(spark.createDataFrame([], DOCS)).root is None


def test_some_requests_and_a_forged_proof(spark):
    rows = rows_of(random.Random(3), {"a": 200, "b": 5, "c": 1})
    m = merkle.manifest(spark.createDataFrame(rows, DOCS))
    full = {(r.name, r.r): r for r in merkle.prove(m).collect()}
    assert len(full) == len(rows) and {r.root for r in full.values()} == {m.root}
    some = merkle.prove(m, m.leaves.filter("r % 50 = 3"))
    got = {(r.name, r.r): r for r in some.collect()}
    assert set(got) == {k for k in full if k[1] % 50 == 3} and all(got[k].proof == full[k].proof for k in got)
    assert some.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    # another leaf's proof, or a place changed, leads elsewhere
    other = some.withColumn("leaf", F.sha2("leaf", 256))
    assert other.filter(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).isEmpty()
    moved = F.transform("proof", lambda s: F.struct(((s["place"] + 1) % 2).alias("place"), s["others"].alias("others")))
    assert some.filter(F.size("proof") > 0).filter(merkle.fold(F.col("leaf"), moved) == F.col("root")).isEmpty()


def test_records_are_addressed_by_content(spark):
    """Every record's digest is the digest of its children, level by level."""
    m = merkle.manifest(spark.createDataFrame(rows_of(random.Random(4), {"a": 250, "b": 2}), DOCS))
    for b in m.trees.blocks + m.upper.blocks:
        for r in b.collect():
            nodes = r.levels[0]
            for level in r.levels[1:] + [[r.digest]]:
                nodes = [sha(nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
                assert nodes == level
