"""N-gram Jaccard join: size-aware, light sets by fixed-size subsets, heavy sets by lists.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of sizes n
and m link when their Jaccard similarity is at least ``num``/``den`` (0.9 by default); then
their overlap is at least a(n) = ceil(n num/den), for either size.

1. Equal sets (128-bit digest) form classes; only the class goes on, as a node numbered by a
   hash of its digest (hashed anew should two classes get one number), so copies are never expanded
   into pairs, and texts without an id take part as any other.
2. *Small sets* (n <= boundary) are keyed by each of their subsets of at least a(n) elements.
   Linked sets share the subset that is their overlap. Within a key every set is tied to the
   key's smallest set alone, which suffices: a pair that links through a subset also links,
   through that subset, with the smallest set holding it.
3. *Large sets* post their first n - a(n) + 1 elements, in one global order, to inverted
   lists; linked sets share a list. The order puts frequent elements last. It is taken from
   counts over all documents' first elements and over whole sets of a hashed share of them;
   any order gives the same result, a good one gives short lists.
   - A list of up to ``light_list`` sets yields its pairs that pass the size and position
     filters. Over all lists, a pair is counted as often as it shares a list; the count, and all
     that may follow the posted elements, bounds its overlap. Pairs within the bound are candidates.
   - Members of a longer list are compared by sketches: parities of the set's elements by their low
     bits, of which two sets differ in no more places than they have elements apart. Who may link is
     tied in trees, list by list, so no pairs are written; sharing a frequent element alone ties nobody.
   - Candidates that hang together (components of candidate pairs and ties) form a group, so
     each whole set is shipped twice: groups are cut into size bands, and a set meets those of its
     band and of the band below. A large band is split into blocks of bounded rows and bytes, each
     block and pair of blocks a task's group of its own, in which overlaps are counted through
     the block's inverted index and only edges that join two trees are kept: no pairs are
     written, however large a group of near copies is, and blocks scan in parallel.
4. The boundary is the one of least estimated cost, from the histogram of small sizes.
5. Edges between classes, by exact overlap, and components over them; at the end a component
   is named by its smallest id.

Broadcast: at most ``hot_limit`` element hashes and ``broadcast_rows`` rows of group numbers.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing; its component is its own id. Rows that share a ``doc_id`` are one document with several
texts. A row with a null id takes part as a text, but is no component's smallest id; alone, its
component is null. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm._text import mix64, raw, slices, text_column, words
from cohortlens.llm._top import greatest
from cohortlens.llm.components import components
from cohortlens.sources.sinks import materialize, release

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SMALL = 29  # sets up to this size are kept whole for subset keys


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per document; under k words, the whole sequence is one."""
    h, _, _, first = words(data, offsets)
    mult = [_MULT[i % len(_MULT)] + np.uint64(2 * (i // len(_MULT))) for i in range(k)]
    full = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        full = full + h[i:i + len(full)] * mult[i]
    full = mix64(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(full[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            one = sum((h[a + i:a + i + 1] * mult[i] for i in range(b - a)), np.full(1, b - a, np.uint64))
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batch: pa.RecordBatch, k: int):
    """(row, set) of every document of an Arrow batch."""
    data, off = raw(text_column(batch))
    for i, j in slices(off):
        for row, s in enumerate(shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], k), i):
            yield row, s


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _least(n, num: int, den: int):
    """a(n): the overlap that a set of n elements needs with any partner."""
    return -(-n * num // den)


def _linked(inter, n, m, num: int, den: int):
    return den * inter >= num * (n + m - inter)


def _apart(n, m, num: int, den: int):
    """Elements that stand in only one of two linked sets of n and m elements, at most."""
    return n + m + 2 * (-(n + m) * num // (num + den))


def sketch(s: np.ndarray, num: int, den: int) -> bytes:
    """Parity of the number of elements by their low bits. The bits are a power of two, six times
    the elements that a linked set of this size has apart or more; so those of unlinked sets tell them
    apart, and a longer sketch folds (xor of its halves) to a shorter one."""
    bits = 128
    while bits < 6 * _apart(len(s), len(s), num, den):
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _sketch_bytes(n, num: int, den: int):
    """Bytes of a sketch, at most."""
    return 16 + 3 * n * (den - num) / (den + num)


def hot_elements(docs: DataFrame, k: int, num: int, den: int, limit: int, share: int = 16, least: int = 16) -> np.ndarray:
    """Frequent elements, the rarest first (at most ``limit``). Counted: the smallest hashes of
    every set, as many as a list prefix takes, and, with weight ``share``, the other elements of
    the sets of every ``share``-th text by hash."""

    def count(batches):
        for b in batches:
            got, weight = [], []
            for row, s in _sets(b, k):
                if len(s):
                    p = len(s) - _least(len(s), num, den) + 1
                    whole = int(s[0] ^ s[-1]) % share == 0
                    got.append(s if whole else s[:p])
                    w = np.ones(len(got[-1]), np.int64)
                    w[p:] = share
                    weight.append(w)
            if got:
                x, at = np.unique(np.concatenate(got), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate(weight)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], names=["e", "n"])

    counts = docs.select("text").mapInArrow(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    counts = materialize(counts.filter(F.col("n") >= 2 * least), "hot-elements")
    top = greatest(counts, "n", "e", limit).toArrow()
    release(counts)
    return top["e"].to_numpy()[::-1].view(np.uint64)


def signatures(docs: DataFrame, hot: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, place, _t1, _t2, n, f1, f2, rare, prefix, small, sketch): place and digest of the text (see ``link``), set size,
    digest, list prefix in the global order (its first ``rare`` elements are not frequent), the
    whole set if it is small, and its sketch."""
    order = np.argsort(hot).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def sign(batches):
        known, rank = shared.value
        for b in batches:
            n, f, rare, prefix, small, marks = [], [], [], [], [], []
            for _, s in _sets(b, k):
                n.append(len(s))
                f.append(_digest(s) if len(s) else bytes(16))
                p = len(s) - _least(len(s), num, den) + 1 if len(s) else 0
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                is_hot = known[at] == s if len(known) else np.zeros(len(s), bool)
                plain = s[~is_hot]
                head = plain[:p]
                if len(head) < p:
                    x = s[is_hot]
                    head = np.concatenate([head, x[np.argsort(rank[at[is_hot]])][:p - len(head)]])
                rare.append(min(len(plain), p))
                prefix.append(head.view(np.int64))
                small.append(s.view(np.int64) if len(s) <= _SMALL else None)
                marks.append(sketch(s, num, den) if len(s) else None)
            f = np.frombuffer(b"".join(f), dtype="<i8").reshape(-1, 2)
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(n, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.array(rare, pa.int32()),
                 pa.array(prefix, ints), pa.array(small, ints), pa.array(marks, pa.binary())],
                names=["doc_id", "place", "_t1", "_t2", "n", "f1", "f2", "rare", "prefix", "small", "sketch"])

    return docs.select("doc_id", "text", "place", "_t1", "_t2").mapInArrow(
        sign, "doc_id long, place long, _t1 long, _t2 long, n long, f1 long, f2 long, rare int, prefix array<long>, small array<long>, sketch binary")


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """Largest size handled by subsets. Cost of a set: its subset keys, or its list postings plus
    shipping itself for verification about once (8 elements cost one key)."""

    def keys(n):
        return sum(comb(n, d) for d in range(n - _least(n, num, den) + 1))

    def cost(b):
        return sum(c * ((keys(n) if n <= b else 0) + (n - _least(n, num, den) + 1 + n / 8 if n > b * num // den else 0))
                   for n, c in sizes.items())

    choices = [0] + [b for b in range(1, _SMALL + 1) if keys(b) <= 500]
    return min(choices, key=lambda b: (cost(b), b))


def small_pairs(base: DataFrame, b: int, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) of sets of up to b elements: ties to the smallest set of each key."""

    def keys(batches):
        for batch in batches:
            doc, key, size, left = [], [], [], []
            for d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = mix64(np.array(s, dtype=np.int64).view(np.uint64))
                n, whole = len(s), s.sum(dtype=np.uint64)
                for gone in range(n - int(_least(n, num, den)) + 1):
                    pick = np.array(list(combinations(range(n), gone)), dtype=np.int64).reshape(comb(n, gone), gone)
                    part = whole - s[pick].sum(axis=1, dtype=np.uint64)
                    key.append(part.view(np.int64))
                    left.append(np.full(len(part), n - gone, np.int32))
                    doc.append(np.full(len(part), d, np.int64))
                    size.append(np.full(len(part), n, np.int32))
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (doc, key, left, size)], names=["doc_id", "k", "c", "n"])

    own = base.filter((F.col("n") <= b) & (F.col("n") > 0)).select("doc_id", "small")
    keyed = own.mapInArrow(keys, "doc_id long, k long, c int, n int")
    centre = (keyed.groupBy("k", "c").agg(F.min(F.struct("n", "doc_id")).alias("m"), F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") > 1))
    pairs = keyed.join(centre, ["k", "c"]).filter(F.col("doc_id") != F.col("m.doc_id"))
    pairs = pairs.filter(_linked(F.col("c"), F.col("n"), F.col("m.n"), num, den))
    return pairs.select(F.col("m.doc_id").alias("a"), F.col("doc_id").alias("b"),
                        F.col("m.n").cast("long").alias("n"), F.col("n").cast("long").alias("m"))


def _pairs_of_lists(doc, n, pos, starts, s, num, den):
    """Pairs (rows i, j) of the lists of size s that pass the size and position filters: the shared
    element stands at pos, so at most the smaller pos lie before it and the smaller rest after."""
    at = starts[:, None] + np.arange(s)
    i, j = np.triu_indices(s, 1)
    A, B = at[:, i].ravel(), at[:, j].ravel()
    most = np.minimum(pos[A], pos[B]) + np.minimum(n[A] - pos[A], n[B] - pos[B])
    ok = _linked(most, n[A], n[B], num, den) & (doc[A] != doc[B])
    A, B = A[ok], B[ok]
    flip = doc[A] > doc[B]
    return np.where(flip, B, A), np.where(flip, A, B)


def light_lists(postings: DataFrame, num: int, den: int, light_list: int) -> DataFrame:
    """(e, a, b, n, m, pos): pairs of short lists with their sizes (e null), once per shared list;
    members of long lists (b null)."""
    names = ["e", "a", "b", "n", "m", "pos"]

    def scan(batches):
        rest = None
        for last, batch in _with_last(batches):
            cols = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            e = cols[0]
            begin = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
            end = np.append(begin[1:], len(e))
            if not last and len(begin):
                cut = begin[-1]
                rest, begin, end = [x[cut:] for x in cols], begin[:-1], end[:-1]
            doc, n, pos = cols[1:]
            size = end - begin
            for s in np.unique(size[(size > 1) & (size <= light_list)]).tolist():
                runs, step = begin[size == s], max(1, 1_000_000 // (s * s))
                for r in range(0, len(runs), step):
                    i, j = _pairs_of_lists(doc, n, pos, runs[r:r + step], s, num, den)
                    if len(i):
                        none = pa.nulls(len(i), pa.int64())
                        yield pa.RecordBatch.from_arrays([none, *map(pa.array, (doc[i], doc[j], n[i], n[j])), none], names=names)
            for x, y in zip(begin[size > light_list], end[size > light_list]):
                none = pa.nulls(int(y - x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(e[x:y]), pa.array(doc[x:y]), none, pa.array(n[x:y]), none, pa.array(pos[x:y])], names=names)

    sorted_ = postings.select("e", "doc_id", "n", "pos").repartition("e").sortWithinPartitions("e")
    return sorted_.mapInArrow(scan, "e long, a long, b long, n long, m long, pos long")


def bounded_pairs(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, n, m) whose shared lists, and all elements not posted, allow the overlap they need.
    Common elements up to the end of one of the two postings are all in shared lists."""
    n, m = F.col("n"), F.col("m")
    rest = lambda x: F.ceil(x * num / den) - 1  # noqa: E731  elements not posted
    x = pairs.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("_c"))
    return x.filter(_linked(F.col("_c") + F.greatest(rest(n), rest(m)), n, m, num, den)).select("a", "b", "n", "m")


def _with_last(batches):
    """(is last, batch) pairs; an empty stream has one empty batch."""
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["e", "doc_id", "n", "pos"])
    previous = None
    for b in batches:
        if previous is not None:
            yield False, previous
        previous = b
    yield True, previous if previous is not None else empty


def scan_block(doc, n, pos, side, guest, sets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join trees, among the sets of one block (or block pair: only across sides).
    Guests (of the next size band) are not compared with each other.
    Sets with few elements before their first long list come first: those nearest a centre."""
    order = np.lexsort((doc, pos))
    doc, n, pos, side, guest = doc[order], n[order], pos[order], side[order], guest[order].astype(bool)
    sets = [sets[i] for i in order]
    m = len(doc)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, at = np.unique(flat, return_inverse=True)
    df = np.bincount(at, minlength=len(values))
    shared = df[at] > 1
    code, owner = at[shared], owner[shared]
    by = np.argsort(code, kind="stable")
    lists = owner[by]
    start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    mine = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
    tree = np.arange(m)
    across = len(np.unique(side)) > 1
    a, b = [], []
    for i in range(m - 1):
        open_ = (tree != tree[i]) & _linked(np.minimum(n[i], n), n[i], n, num, den)
        open_[:i + 1] = False
        if across:
            open_ &= side != side[i]
        if guest[i]:
            open_ &= ~guest
        if not open_.any():
            continue
        own = code[mine[i]:mine[i + 1]]
        inter = np.bincount(np.concatenate([lists[start[c]:start[c + 1]] for c in own]) if len(own) else np.zeros(0, np.int64), minlength=m)
        for j in np.flatnonzero(open_ & _linked(inter, n[i], n, num, den)).tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                a.append(doc[i])
                b.append(doc[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def dealt(x: DataFrame, g: str, whole: Column, size: Column, num: int, den: int, block_rows: int, block_bytes: int) -> DataFrame:
    """``x`` (doc_id, n, ``g``, ...) by group, size band and block pair: columns band, lo, hi, side and
    guest (of the next size band). Groups that are ``whole`` have one band. size: bytes of a row."""
    # linked sets differ in size by at most den/num: band j compares its own sets with each other
    # and with those of band j + 1
    band = F.col("n") if num == den else F.floor(F.log(F.col("n") + F.lit(0.5)) / F.lit(float(np.log(den / num))))
    own = F.when(whole, 0).otherwise(band.cast("int"))
    x = x.withColumn("_own", own).withColumn("band", F.explode(F.when(whole, F.array(own)).otherwise(F.array(own, own - 1))))
    x = x.withColumn("guest", F.col("band") != F.col("_own"))
    sizes = x.groupBy(g, "band").agg(F.count(F.lit(1)).alias("_c"), F.sum(size).alias("_s"), F.count_if(~F.col("guest")).alias("_mine"))
    sizes = sizes.filter((F.col("_mine") > 0) & (F.col("_c") > 1))
    blocks = F.greatest(F.ceil(F.col("_c") / block_rows), F.ceil(F.col("_s") / block_bytes), F.lit(1)).cast("int")
    x = x.join(sizes.select(g, "band", blocks.alias("_nb")), [g, "band"])
    x = x.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("_nb")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return x.withColumns({"lo": F.least("side", "_o"), "hi": F.greatest("side", "_o")}).drop("_own", "_nb", "_o")


def scan_sketches(n, pos, side, guest, marks, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may link and join trees, among the members of one list, by sizes, places of
    the shared element and sketches; rows of unequal sides only, should there be two sides, and
    guests not with each other. Rows stand in order of n."""
    m = len(n)
    bits = np.array([len(x) for x in marks], np.int64) * 8
    end = np.searchsorted(n, n * den // num, side="right")  # beyond, sets are too large
    across = len(np.unique(side)) > 1
    tree, a, b = np.arange(m), [], []
    for width in np.unique(bits).tolist():
        first, last = np.searchsorted(bits, [width, width + 1]).tolist()
        stop = int(end[last - 1])
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(marks[x:y]), np.uint64).reshape(y - x, -1, width // 64), axis=1)
                  for x, y in ((max(first, x), min(stop, y)) for x, y in (np.searchsorted(bits, [w, w + 1]).tolist() for w in np.unique(bits[first:stop]).tolist()))]
        folded = np.concatenate(folded)
        for i in range(first, last):
            to = slice(i + 1, int(end[i]))
            open_ = tree[to] != tree[i]
            if across:
                open_ &= side[to] != side[i]
            if guest[i]:
                open_ &= ~guest[to]
            j = i + 1 + np.flatnonzero(open_)
            if len(j):
                j = j[_linked(np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]), n[i], n[j], num, den)]
            if len(j):
                j = j[np.bitwise_count(folded[j - first] ^ folded[i - first]).sum(axis=1, dtype=np.int64) <= _apart(n[i], n[j], num, den)]
            if len(j):
                met, one = np.unique(tree[j], return_index=True)
                tree[np.isin(tree, met)] = tree[i]
                a += [i] * len(one)
                b += j[one].tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def list_ties(members: DataFrame, base: DataFrame, num: int, den: int, block_rows: int, block_bytes: int) -> DataFrame:
    """Candidate pairs (a, b, n, m, p, q), with places of the shared element, that tie the members of each long
    list who may link. members: (e, doc_id, n, pos); base: (doc_id, sketch, ...). A list beyond the
    rows or bytes of a block is cut into size bands and those into blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        doc, n, pos, side, guest = (table[c].to_numpy() for c in ("doc_id", "n", "pos", "side", "guest"))
        i, j = scan_sketches(n, pos, side, guest.astype(bool), table["sketch"].to_pylist(), num, den)
        flip = doc[i] > doc[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        return pa.table({"a": doc[i], "b": doc[j], "n": n[i], "m": n[j], "p": pos[i], "q": pos[j]})

    size = _sketch_bytes(F.col("n"), num, den)
    whole = members.groupBy("e").agg(((F.count(F.lit(1)) <= block_rows) & (F.sum(size) <= block_bytes)).alias("_whole"))
    x = members.select("e", "doc_id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos")).join(whole, "e")
    x = dealt(x, "e", F.col("_whole"), size, num, den, block_rows, block_bytes).drop("_whole")
    x = x.join(base.select("doc_id", "sketch"), "doc_id")
    return x.groupBy("e", "band", "lo", "hi").applyInArrow(run, "a long, b long, n long, m long, p long, q long")


def candidate_groups(pairs: DataFrame, num: int, den: int, block_rows: int, block_bytes: int) -> DataFrame:
    """(doc_id, g, band, lo, hi, pos, side, guest): candidate sets by group, size band and block
    pair. pairs: (a, b, n, m, p, q) with sizes and places in long lists."""
    roots = components(pairs.select("a", "b"))
    ends = [pairs.select(F.col(c).alias("doc_id"), F.col(n).alias("n"), F.col(p).alias("pos")) for c, n, p in (("a", "n", "p"), ("b", "m", "q"))]
    x = ends[0].union(ends[1]).groupBy("doc_id").agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
    x = x.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    x = x.select("doc_id", "n", "pos", F.coalesce("root", "doc_id").alias("g"))
    x = dealt(x, "g", F.lit(False), F.col("n") * 8, num, den, block_rows, block_bytes)
    return x.select("doc_id", "g", "band", "lo", "hi", "pos", "side", "guest")


def group_edges(docs: DataFrame, grouped: DataFrame, k: int, num: int, den: int, broadcast_rows: int) -> DataFrame:
    """Edges (a, b) within the groups of ``candidate_groups``, with place and digest (f1) of their
    classes. The sets are made from the texts at that place which have the digest: where at most
    ``broadcast_rows`` rows are grouped (8 numbers each), they are broadcast and no text is
    shuffled; beyond, they are joined."""

    def make(batches):
        seen: set[int] = set()  # of repeated rows a task ships one
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows, got = [], []
                key = list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "g", "band", "lo", "hi"))))
                for (row, s), f1 in zip(_sets(part, k), part.column("f1").to_pylist()):
                    one = hash(key[row])
                    if one not in seen and len(s) and _digest(s)[:8] == f1.to_bytes(8, "little", signed=True):
                        seen.add(one)
                        rows.append(row)
                        got.append(s.tobytes())
                if rows:
                    part = part.drop_columns(["text", "f1"]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, "set"])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table["doc_id"].to_numpy(), return_index=True)[1]))
        doc, pos, side, guest = (table[c].to_numpy() for c in ("doc_id", "pos", "side", "guest"))
        s = [np.frombuffer(v, dtype="<u8") for v in table["set"].to_pylist()]
        a, b = scan_block(doc, np.array([len(v) for v in s], np.int64), pos, side, guest, s, num, den)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    few = grouped.limit(broadcast_rows + 1).count() <= broadcast_rows
    own = docs.select("text", "place").join(F.broadcast(grouped) if few else grouped.hint("shuffle_hash"), "place")
    own = own.select("text", *(c for c in grouped.columns if c != "place")).mapInArrow(make, "doc_id long, g long, band int, lo int, hi int, pos long, side int, guest boolean, set binary")
    return own.groupBy("g", "band", "lo", "hi").applyInArrow(run, "a long, b long")


def numbered(classes: DataFrame) -> Column:
    """Number of a class, from its digest; different for all of ``classes`` (f1, f2)."""
    seed = 0
    while True:
        node = F.xxhash64("f1", "f2", F.lit(seed))
        if classes.groupBy(node).count().filter("count > 1").isEmpty():
            return node
        seed += 1


def link(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, hot_limit: int = 1 << 20, light_list: int = 32,
         block_rows: int = 2048, block_bytes: int = 1 << 24, broadcast_rows: int = 1 << 19, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, edges): (doc_id, n_shingles, node, _t1, _t2) per document row with its text's digest, (node, first, copies)
    per class with its smallest id and rows, and verified edges (a, b) between nodes. A row without
    words has a null node."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # where a text is found again: its id, or without one a hash
    docs = docs.withColumn("place", F.coalesce("doc_id", F.xxhash64("text")))
    docs = docs.withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})
    hot = hot_elements(docs, k, num, den, hot_limit)
    sig = materialize(signatures(docs, hot, k, num, den), "signatures")
    classes = (sig.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.min("place").alias("place"), F.count(F.lit(1)).alias("copies")))
    classes = materialize(classes, "classes")
    node = numbered(classes)
    own = ["f1", "f2", "place"]
    base = (sig.filter("n > 0").select(*own, "n", "rare", "prefix", "small", "sketch").join(classes.select(*own), own, "left_semi").dropDuplicates(own))
    base = materialize(base.select(node.alias("doc_id"), "n", "rare", "prefix", "small", "sketch"), "representatives")
    wide, sig = sig, materialize(sig.select("doc_id", "_t1", "_t2", "n", "f1", "f2"), "digests")
    release(wide)
    sizes = {r["n"]: r["count"] for r in base.filter(F.col("n") <= _SMALL).groupBy("n").count().collect()}  # at most _SMALL rows
    b = boundary(sizes, num, den)
    small = small_pairs(base, b, num, den)
    lists = base.filter(F.col("n") > b * num // den)
    post = lists.select("doc_id", "n", "rare", F.posexplode("prefix").alias("pos", "e"))
    hot_post = post.filter("pos >= rare").drop("rare")
    counted = hot_post.groupBy("e").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    counted = materialize(counted, "list-sizes")
    plain = post.filter("pos < rare").drop("rare").unionByName(
        hot_post.join(counted.filter(F.col("_c") <= light_list).select("e"), "e", "left_semi").select("doc_id", "n", "pos", "e"))
    scanned = materialize(light_lists(plain, num, den, light_list), "lists")
    listed = bounded_pairs(scanned.filter("e is null").select("a", "b", "n", "m"), num, den)
    members = (hot_post.join(counted.filter(F.col("_c") > light_list).select("e"), "e", "left_semi").select("e", "doc_id", "n", "pos")
               .unionByName(scanned.filter("e is not null").select("e", F.col("a").alias("doc_id"), "n", "pos")))
    members = materialize(members, "long-lists")
    far = F.lit(1 << 30).cast("long")
    pairs = listed.unionByName(small.distinct()).withColumns({"p": far, "q": far})
    pairs = materialize(pairs.unionByName(list_ties(members, base, num, den, 8 * block_rows, block_bytes)), "pairs")
    release(base, scanned, counted, members)
    grouped = candidate_groups(pairs, num, den, block_rows, block_bytes)
    grouped = materialize(grouped.join(classes.select(node.alias("doc_id"), "place", "f1"), "doc_id"), "groups")
    release(pairs)
    edges = group_edges(docs, grouped, k, num, den, broadcast_rows)
    edges = materialize(edges.distinct(), "links")
    rows = sig.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, node).alias("node"), "_t1", "_t2")
    return rows, classes.select(node.alias("node"), "first", "copies"), edges


def named(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, first): the least ``first`` of a node's component, for nodes of several copies or in a
    component of several nodes."""
    grown = classes.join(components(edges), "node", "left").withColumn("g", F.coalesce("root", "node"))
    least = grown.groupBy("g").agg(F.min("first").alias("least"), F.sum("copies").alias("_c")).filter("_c > 1")
    return grown.join(least.drop("_c"), "g").select("node", F.col("least").alias("first"))


def join_components(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document row."""
    members, classes, edges = link(docs, **kw)
    # texts of one id hang together
    texts = members.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_b"))
    texts = materialize(texts.filter("a <> _b").select("doc_id", "a"), "several-texts")
    ties = members.join(texts, "doc_id").select("a", F.col("node").alias("b"))
    names = materialize(named(classes, edges.unionByName(ties.filter("b is not null"))), "names")
    return members.join(names, "node", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group; all columns kept. Of several
    equal-id rows all stay; rows with a null id stay."""
    groups = join_components(docs, id_col=id_col, **kw)
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(materialize(gone, "copies"), id_col, "left_anti")


def _key(doc_id: Column, text: Column) -> list[Column]:
    """(_id, _t1, _t2): id and 128-bit digest of a row's text."""
    return [doc_id.cast("long").alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def _known_small(keys: DataFrame, limit: int) -> DataFrame:
    """``keys`` to be broadcast where they are at most ``limit`` rows, counted."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", broadcast_rows: int = 1 << 18, **kw) -> DataFrame:
    """One row of each group of near-duplicate rows, all columns kept: the one of smallest id (rows
    without an id come last), then text digest; of rows equal in both, one. Rows group by their
    texts alone, also where they share an id; rows without words stay. Up to ``broadcast_rows`` keys
    (32 bytes each) of rows that go are broadcast and no text is shuffled; beyond, texts are once."""
    members, classes, edges = link(docs, id_col=id_col, text=text, **kw)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), "_t1", "_t2")
    rows = members.filter("node is not null").groupBy("node", "doc_id", "_t1", "_t2").agg(F.count(F.lit(1)).alias("_n"))
    rows = materialize(rows.select("node", best.alias("row"), "_n"), "rows")
    classes = classes.drop("first").join(rows.groupBy("node").agg(F.min("row").alias("first")), "node")
    names = named(classes, edges)
    found = materialize(rows.join(names, "node").select("row.*", (F.col("row") != F.col("first")).alias("gone"), "_n"), "copies")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *_key(F.col(id_col), F.col(text)))
    match = lambda k: (keyed["_id"].eqNullSafe(k["_id"])) & (keyed["_t1"] == k["_t1"]) & (keyed["_t2"] == k["_t2"])
    release(rows)
    out = _known_small(found.filter("gone or _n > 1").select("_id", "_t1", "_t2"), broadcast_rows)
    kept = keyed.join(out, match(out), "left_anti").select("_row.*")
    again = found.filter("not gone and _n > 1").select("_id", "_t1", "_t2")
    if again.isEmpty():
        return kept
    order = F.xxhash64(*(F.col("_row")[c] for c, t in docs.dtypes if "map<" not in t and t != "variant"))
    again = _known_small(again, broadcast_rows)
    one = keyed.join(again, match(again), "left_semi").groupBy("_id", "_t1", "_t2").agg(F.min_by("_row", order).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
