"""Decontamination against a brute force that takes every start of an item."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from test_joins import DOCS, garbled, least_edits

from cohortlens.llm import decontaminate

WORDS = ["shore", "lantern", "of", "the", "quietly", "marble", "and", "seven", "ox", "thunder", "é", "vale"]


def folded(text):
    return re.sub(rb"[ \t\n\v\f\r]+", b" ", (text or "").encode()).lower()


def brute_starts(docs, items, w=64, errors=0.05):
    """{(document, item): (windows, fewest edits)}, every window start of every item."""
    out = {}
    for d, t in docs:
        for i, item in items:
            x = folded((item or "").strip(" \t\n\v\f\r"))
            if len(x) < decontaminate.Q:
                continue
            n = min(len(x), w)
            edits = [least_edits(x[a:a + n], folded(t)) for a in range(len(x) - n + 1)]
            edits = [e for e in edits if e <= decontaminate.budget(n, errors)]
            if edits:
                out[d, i] = (len(edits), min(edits))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_start_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(1, say(18)), (2, "  " + say(16) + "\n"), (3, say(9)), (4, None), (5, "short one 12")]
    docs = []
    for k in range(45):
        item = rng.choice([x for _, x in items if x])
        at = rng.randrange(max(len(item) - 66, 1))
        part = garbled(rng, item[at:at + rng.randrange(60, 95)], rng.choice([0, 0, 1, 2, 4]))
        if k % 3 == 0:
            part = part.replace(" ", rng.choice(["\n    ", "  ", "\t\t "]))
        docs.append((k, say(rng.randrange(5)) + " " + part + "\n" + say(5)))
    docs += [(100, " \n\n "), (101, None), (102, items[0][1]), (103, " \n " + items[1][1].replace(" ", "  "))]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_starts(docs, items)
    for block in (1 << 21, 150):
        got = decontaminate.contaminations(df, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id): (r.windows, r.edits) for r in got} == want and len(got) == len(want)
    assert len(want) > 20
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_verbatim_passage_off_the_grid_and_its_span(spark):
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghijklm nopqrstuvwxyz") for _ in range(200)).replace("  ", "x ").strip()
    docs = [(at, "é! " + item[at:at + 64] + " Z") for at in range(0, 130) if " " not in (item[at], item[at + 63])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.windows, r.edits, r.start, r.end) for r in decontaminate.contaminations(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert set(got) == {at for at, _ in docs}
    assert all(e == 0 and y <= 4 and z >= 68 for _, e, y, z in got.values())


def test_rewrapped_copy_is_found_with_its_stored_span(spark):
    rng = random.Random(4)
    item = " ".join(rng.choice(WORDS) for _ in range(25))
    text = "#" * 20 + "\n" + item.replace(" ", "\n        ") + "\n" + "#" * 20
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    [r] = decontaminate.contaminations(spark.createDataFrame([(1, text)], DOCS), bench).collect()
    stored = text.encode()[r.start:r.end].decode()
    assert r.edits == 0 and stored.split() == item.split()


def test_repetitive_texts_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    items = [(1, "x" * 150), (2, "ab " * 40), (3, "x" * 90 + "ab " * 20), (3, "y" * 12 + "-" * 70), (4, "x" * 150)]
    docs = [(1, "x" * 300), (2, "ab " * 60 + "x" * 63), (3, "-" * 200 + "y"), (4, "ab" * 100), (5, garbled(rng, "x" * 140, 3))]
    want = brute_starts(docs, items[:3] + items[4:])
    want |= {(d, 3): (v[0] + want.get((d, 3), (0, 9))[0], min(v[1], want.get((d, 3), (0, 9))[1]))
             for (d, _), v in brute_starts(docs, items[3:4]).items()}  # two items of one id are one
    bench = pd.DataFrame(items, columns=["item_id", "text"])
    col = pa.array([t for _, t in docs], pa.large_string())
    for part, piece in ((250_000, 1024), (300, 1024), (50, 5)):
        monkeypatch.setattr(decontaminate, "PART", part)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        ix = decontaminate.Index(items, 64, 0.05)
        got = {}
        for doc, item, edits, _, _, n in decontaminate._by_item(ix, decontaminate._hits(ix, col)):
            for d, i, e, c in zip(doc.tolist(), item.tolist(), edits.tolist(), n.tolist()):
                key = docs[d][0], ix.owner[i]
                assert key not in got
                got[key] = (c, e)
        assert got == want
    monkeypatch.undo()
    df = spark.createDataFrame(docs, DOCS)
    rows = decontaminate.contaminations(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.windows, r.edits) for r in rows} == want and len(rows) == len(want)


def test_long_repetitive_text_takes_bounded_parts():
    ix = decontaminate.Index([(1, "a" * 2_000), (2, "b" + "a" * 500)], 64, 0.05)
    x = decontaminate.fold(b"a" * 20_000)
    parts = [len(p[0]) for p in decontaminate.shared_grams(ix, x, np.array([0, len(x)]))]
    assert max(parts) <= 2 * decontaminate.PART and sum(parts) < 200 * len(x)
    col = pa.array(["a" * 20_000], pa.large_string())
    [(doc, item, edits, begin, end, n)] = decontaminate._by_item(ix, decontaminate._hits(ix, col))
    assert item.tolist() == [0, 1] and edits.tolist() == [0, 0] and n.tolist()[0] == 1_937 and begin[0] == 0 and end[0] == 20_000
