"""Sharding, line dedup, language ID, licences, chat format, packing: brute force, round trips,
and odd inputs (nulls, empty tables, repeated rows, clashing columns)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import chat_format, language_id, license_scan, line_dedup, packing, sharding
from cohortlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, schema=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# --- sharding ----------------------------------------------------------------------------------
def test_table_is_full_balanced_and_stable():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill(names, 1009)
    sizes = Counter(owner)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    # dropping one shard moves its slots and few others
    gone = sharding.moved(names, names[:-1], 1009)
    assert sizes[6] <= gone <= 2 * sizes[6]


def test_fill_takes_turns_by_preference():
    names, size = ["a", "b", "c"], 11
    pref = [[(sharding._number(f"{s}#offset") + j * (sharding._number(f"{s}#skip") % 10 + 1)) % size for j in range(size)] for s in names]
    table = {}
    for t in range(size):
        table[next(p for p in pref[t % 3] if p not in table)] = t % 3
    assert sharding.fill(names, size) == [table[k] for k in range(size)]


@pytest.mark.parametrize("names, size", [([], 11), (["a", "a"], 11), (["a"], 12), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(names, size):
    with pytest.raises(ValueError):
        sharding.fill(names, size)


def test_assign_nulls_clashes_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y"), (1, "z")], "doc_id long, shard string")
    out = sharding.assign(df, "doc_id", ["a", "b"], 11).collect()
    assert len(out) == 3 and {r.shard for r in out} <= {"a", "b"}
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    assert sharding.assign(df.limit(0), "doc_id", ["a"], 11).count() == 0
    assert sum(r.rows for r in sharding.balance(sharding.assign(df, "doc_id", ["a", "b"], 11)).collect()) == 3


# --- line dedup --------------------------------------------------------------------------------
def brute_lines(texts, min_docs, min_chars=1):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    df = Counter(k for ls in split for k in {key(x) for x in ls} if len(k) >= min_chars)
    kept = [[x for x in ls if df[key(x)] < min_docs] for ls in split]
    return [("\n".join(k), len(ls), len(ls) - len(k)) for ls, k in zip(split, kept)]


TEXTS = ["A b\n c \nd", "a B\nc\nÉ", " a b\t\nx", None, "", "\n\n", "é\nÉ", "a b\na b", "C\r\nc", "ß" * 3, "x" * 5000 + "\nc"]


@pytest.mark.parametrize("min_docs", [2, 3])
@pytest.mark.parametrize("bound", [0, 262_144])
def test_lines_match_brute_force(spark, min_docs, bound):
    out = line_dedup.dedup_lines(docs_of(spark, TEXTS), min_docs=min_docs, n_batches=3, broadcast_keys=bound).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in out] == brute_lines(TEXTS, min_docs)


def test_lines_odd_inputs(spark):
    df = spark.createDataFrame([(1, "a\nb", 7), (1, "a\nb", 7), (None, "a", None)], "doc_id long, text string, n_dropped int")
    out = line_dedup.dedup_lines(df, min_docs=3).collect()
    assert sorted((r.text, r.n_dropped) for r in out) == [("", 1), ("b", 1), ("b", 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    few = line_dedup.dedup_lines(docs_of(spark, ["ab\nc", "ab\nc"]), min_docs=2, min_chars=2).collect()
    assert [r.text for r in few] == ["c", "c"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_settle_and_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for n in (3, 1, 1, 1):
        runs.add(spark.createDataFrame([(1, 1, n), (2, 2, 1)], "h1 long, h2 long, n_docs long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {r.h1 for r in runs.frequent().collect()} == {1, 2}
    # the settled key was not counted again
    assert {r.h1: r.n_docs for r in spark.table(runs.levels[2][0]).collect()} == {1: 3, 2: 4}
    runs.close()


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_count_like_a_dictionary(spark, fanout):
    rng = np.random.default_rng(8)
    runs, total = line_dedup.LineRuns(spark, min_docs=40, fanout=fanout), Counter()
    for _ in range(5):
        keys = rng.integers(0, 60, 400).tolist()
        total.update(keys)
        runs.add(spark.createDataFrame([(k, -k, 1) for k in keys], "h1 long, h2 long, n_docs long"))
    assert sum(map(len, runs.levels)) < 5
    assert sorted(r.h1 for r in runs.frequent().collect()) == sorted(k for k, n in total.items() if n >= 40)
    runs.close()


def test_runs_are_merged_where_they_lie(spark):
    """A batch is shuffled once and merge-joined with runs that are neither shuffled nor sorted."""
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=3)
    batch = spark.createDataFrame([(k % 50, k % 7, 1) for k in range(500)], "h1 long, h2 long, n_docs long")
    for _ in range(2):
        runs.add(batch)
    with line_dedup._sorted_scans(spark):
        anti = plan_of(runs.unsettled(batch))
        merge = plan_of(runs._merged(*runs.levels[0]))
    assert anti.count("SortMergeJoin") == 2 and anti.count("LeftAnti") == 2 and "Broadcast" not in anti
    assert anti.count("Exchange") == 1 and anti.count("Sort [") == 1
    assert merge.count("SortMergeJoin") == 1 and "Exchange" not in merge and "Sort [" not in merge
    runs.close()
    assert not any(t.name.startswith("cohortlens_run_") for t in spark.catalog.listTables())


# --- language ID -------------------------------------------------------------------------------
def test_grams_are_those_of_each_text():
    texts = ["Ab, é", "", "x", "ab"]
    buckets = 1 << 16
    got = [Counter() for _ in texts]
    for h, s, e in language_id._grams(texts, (1, 2, 3), buckets):
        for i, (a, b) in enumerate(zip(s, e)):
            got[i].update(h[a:min(b, len(h))].tolist())
    for i, t in enumerate(texts):
        alone = Counter()
        for h, s, e in language_id._grams([t], (1, 2, 3), buckets):
            alone.update(h.tolist())
        assert got[i] == alone and sum(alone.values()) == sum(max(len(t) + 2 - n + 1, 0) for n in (1, 2, 3))


def test_naive_bayes_matches_brute_force(spark):
    rows = [(0, "the cat", "en"), (1, "le chat", "fr"), (2, "the hat and", "en"), (3, None, "fr"), (4, "12 !!", "en"), (5, "chat hat", None), (6, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.train(df, buckets=1 << 12)
    count = defaultdict(Counter)
    for _, t, lang in rows:
        if lang:
            for h, _, _ in language_id._grams([t or ""], (1, 2, 3), 1 << 12):
                count[lang].update(h.tolist())
    n = Counter(r[2] for r in rows if r[2])
    for r in language_id.predict(df, m).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {}
        for lang, c in count.items():
            total = sum(c.values()) + 0.5 * (1 << 12)
            logs[lang] = np.log(n[lang] / 6) + sum(np.log((c[g] + 0.5) / total) for h, _, _ in language_id._grams([r.text], (1, 2, 3), 1 << 12) for g in h.tolist())
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(np.exp(logs[best]) / sum(map(np.exp, logs.values())), rel=1e-4)


def test_language_held_out_accuracy(spark):
    out = Q.language_id_query(spark, SF).join(Q.read(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out and lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 20


def test_language_odd_inputs(spark):
    df = spark.createDataFrame([(1, "abc", None, "x")], "doc_id long, text string, lang string, score string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(df).collect()] == [("und", 0.0)]
    assert language_id.identify(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "a", str(i)) for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(many, max_labels=4)


# --- licences ----------------------------------------------------------------------------------
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify.
The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""


def test_licence_rules():
    names = lambda t: [(r, lic) for r, lic, _, _ in license_scan.scan_text(t)]
    assert names("Some text.\nReleased under the MIT License.\nmore") == [("mit-notice", "MIT")]
    assert names("Licensed under the Apache License, Version 2.0.") == [("apache2-notice", "Apache-2.0")]
    assert names(MIT) == [("mit-grant-notice", "MIT")]
    assert names("Licensed under the Foo Licence here.") == [("mention", "UNKNOWN")]
    assert names("no such words") == [] and names("") == []
    two = names("All rights reserved.\nLicensed under CC BY-NC 4.0.")
    assert two == [("all-rights", "Proprietary"), ("cc-by-nc", "CC-BY-NC-4.0")]
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
           "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
           "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
    assert names(bsd) == [("bsd2", "BSD-2-Clause")]


def test_rule_order_and_gaps_match_brute_force():
    """Every rule alone, in order, with one unknown sentence between, is found as itself."""
    for rule, licence, ids in license_scan.RULES:
        found = [(i, i, "", k) for i, k in enumerate(ids)]
        assert license_scan.match_rules(found)[0][:2] == (rule, licence)
        if len(ids) > 1:
            gap = [found[0], (9, 9, "", None), *found[1:]]
            assert license_scan.match_rules(gap)[0][:2] == (rule, licence)
            apart = [found[0], (9, 9, "", None), (9, 9, "", None), *found[1:]]
            assert (rule, licence) not in [m[:2] for m in license_scan.match_rules(apart)]


def test_every_known_sentence_holds_a_stem():
    assert all(any(s in pattern for s in license_scan.STEMS) for pattern in license_scan.SENTENCES.values())


def test_licence_scan_is_the_scan_of_every_text(spark):
    docs = Q.read(spark, SF, "documents")
    want = sorted((r.doc_id, *m) for r in docs.collect() for m in license_scan.scan_text(r.text or ""))
    assert sorted(tuple(r) for r in Q.license_query(spark, SF).collect()) == want and want
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "All rights reserved."), (2, "All rights reserved.")], DOCS)
    assert [r.license for r in license_scan.scan(odd).collect()] == ["Proprietary"] * 2
    assert license_scan.scan(odd.limit(0)).count() == 0
    assert license_scan.licenses(odd).collect()[0].matches == 2


# --- chat format -------------------------------------------------------------------------------
piece = st.sampled_from(["a", "</s>", "[INST]", "[/INST]", "%5B", "%", "<s>", "<s%>", "[ROLE=x]", "[/ROLE]", "<<SYS>>", "é\n", "", "[INST%]", "<", "["])
turn = st.tuples(st.sampled_from(["user", "assistant", "system", "tool]%<", "", None]), st.lists(piece, max_size=4).map("".join))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(turn, min_size=1, max_size=4), min_size=1, max_size=6))
def test_chat_round_trip(spark, convs):
    rows = [(c, t, r, x) for c, ts in enumerate(convs) for t, (r, x) in enumerate(ts)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(convs)
    for r in out:
        want = [(a or "", b) for a, b in convs[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == want
        told = [chat_format_unescape(r.formatted[s.start:s.end], r.formatted[s.start - 2]) for s in r.loss_spans]
        assert "".join(told) == r.loss_text == "".join(b for a, b in want if a == "assistant")
        inner = [b for a, b in want]
        assert r.escaped == 0 or any(re.search(chat_format.CONTROL, b) for b in inner)


def chat_format_unescape(text, mark):
    return text.replace("%3C", "<").replace("%5B", "[").replace("%25", "%") if mark == "%" else text


def test_chat_odd_inputs(spark):
    rows = [(None, 0, "user", None), (1, None, "user", "b"), (1, 1, "user", "c"), (1, 1, "assistant", "c"), (1, 1, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.format_conversations(df).collect()}
    assert out == {None: [("user", "")], 1: [("user", "b"), ("assistant", "c"), ("user", "c"), ("user", "c")]}
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_stays_native(spark):
    plan = Q.chat_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- packing -----------------------------------------------------------------------------------
def test_tokens_are_the_tokenizers(spark):
    t = packing.word_tokenizer(VOCAB)
    texts = [r.text for r in Q.read(spark, SF, "documents").collect()]
    texts += ["", " ", "İstanbul ΟΔΟΣ", "é café!!", "it's we'll x1y2", "a\x1cb \x85 c", "​", "<|endoftext|> a", "naïve-déjà", "ﬁ", "ÄÖÜß", "don't!", "a.b,c", "ab's", "x" * 300]
    for text, ids in zip(texts, t.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def brute_pack(lengths, size):
    gaps, out = [], []
    for s in lengths:
        n = Counter(g for g in gaps if 0 < g < size)
        options = {}
        for g in sorted(set(g for g in gaps if s <= g < size)) + ([size] if s < size else []):
            after = Counter(n)
            if g < size:
                after[g] -= 1
            if 0 < g - s < size:
                after[g - s] += 1
            options[g] = sum(v * v for v in after.values())
        if not options:
            gaps.append(size - s)
            out.append((len(gaps) - 1, 0))
            continue
        g = min(options, key=lambda k: (options[k], k))
        if g == size:
            gaps.append(size - s)
            out.append(size - s)
        else:
            gaps[max(i for i, x in enumerate(gaps) if x == g)] -= s
            out.append(g - s)
    return sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_sum_of_squares_matches_brute_force(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 12)
    fill = Counter()
    for b, o, s in zip(bins.tolist(), offsets.tolist(), lengths):
        assert o == fill[b]
        fill[b] += s
    assert sorted(12 - v for v in fill.values()) == brute_pack(lengths, 12)


def test_packing_query_is_whole_and_tight(spark):
    rows = Q.packing_query(spark, SF).collect()
    t = packing.word_tokenizer(VOCAB)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for d in Q.read(spark, SF, "documents").collect():
        ids = np.array(t.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        got = sorted(by_doc.pop(d.doc_id), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in got)
    assert not by_doc
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= 1.02 * -(-total // 2048) + 2


def test_packing_odd_inputs_and_sequences(spark):
    df = docs_of(spark, [None, "", "a b c", "a b c", "word " * 5000])
    placed = packing.pack_documents(df, VOCAB, size=64, group_rows=20)
    t = packing.word_tokenizer(VOCAB)
    ids = {r.sequence_id: r.ids for r in packing.sequences(df, placed, VOCAB, size=64).collect()}
    for r in placed.collect():
        text = df.filter(F.col("doc_id") == r.doc_id).first().text or ""
        whole = t.tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert ids[r.sequence_id][r.offset:r.offset + r.length] == whole[r.start:r.start + r.length]
    assert packing.pack_documents(df.limit(0), VOCAB).count() == 0


# --- oracle SQL --------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    rel = con.sql(Q.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(str, df.select(cols).collect())) == sorted(
        map(str, spark.createDataFrame(rel.df()[cols], df.select(cols).schema).collect()))


def test_line_digest(spark):
    r = Q.line_dedup_query(spark, SF).filter("n_dropped = 0").first()
    text = Q.read(spark, SF, "documents").filter(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_equal_pieces_spread_over_groups(spark):
    """A third of all rows may be one empty text without an id."""
    df = spark.range(0, 4000, 1, 4).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "1L length", "7L ids_crc32")
    out = packing.place(df, group_rows=500).selectExpr("sequence_id >> 32 g").groupBy("g").count().collect()
    assert len(out) == 8 and max(r["count"] for r in out) < 1000
