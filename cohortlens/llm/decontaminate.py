"""Benchmark decontamination: q-gram lemma filtering with overlapping diagonal bands.

Texts are folded: A-Z to a-z, runs of white-space characters to one space; spans are byte
positions of the UTF-8 text as stored. A benchmark item has a window of ``window`` bytes at each
of its bytes that leaves room for one; a shorter item is one window. A window of w bytes occurs
in a document when some stretch of the text is within edit distance
k = min(``errors`` x w, w // q - 1) of it; then it shares at least w + 1 - q (k + 1) >= 1
q-grams with that stretch, on diagonals at most k apart (the q-gram lemma).

Windows with the same bytes are one class: only the q-grams of each class's first window are
searched, and a hit counts for every place of its class. So periodic items and repeated items cost
no more than one period and one copy. Items are searched in pieces of at most ``PIECE`` windows.

Per slice of documents: every q-gram (12 bytes, read as two overlapping integers and mixed
into one code; codes may only add candidates, which bytes or alignment check) is looked up in a
hashed bit table of the benchmark's q-grams; the hits are expanded to (piece, place, diagonal), about
``PART`` hits at a time: stretches of a text that overlap by the longest stretch a window may match,
and, where one such stretch still has more hits, some of the pieces at a time. No hit is left out.
Windows whose q-grams all follow each other on one diagonal are verbatim. Else hits are taken in
bands of twice the step, each overlapping the next by half, so any k-wide set of diagonals
lies whole in one band; windows with enough hits in a band are verified by banded alignment, many
at a time, in the diagonals that the band's hits take. No text is shuffled; the benchmark is
handled in blocks of bounded size, each broadcast, and documents pass the blocks one after the
other.

Defined results: null and empty texts have no hit; null items and those under ``q`` bytes
match nothing; equal items are all reported; repeated documents are separate rows; an empty
benchmark or table gives an empty result; input columns do not clash (only id and text are read).
White space at the ends of an item is not part of it. A copied passage of under ``window`` bytes
of a longer item is no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.llm._text import LOWER, mix64, raw, slices, text_column

Q = 12
STEP = 16
PIECE = 1024  # windows of an item searched together
PART = 250_000  # q-gram hits held at a time
_TABLE_BITS = 22
_FOLD = LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32


def _kept(x: np.ndarray, starts=()) -> np.ndarray:
    """Bytes that stay when runs of spaces become one; ``starts``: first bytes of documents."""
    space = x == 32
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[np.asarray(starts, dtype=np.int64)] = True
    return keep


def fold(text: bytes) -> np.ndarray:
    x = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    return x[_kept(x)]


def budget(w: int, errors: float) -> int:
    """Edits allowed in a window of w bytes."""
    return min(int(errors * w), w // Q - 1)


def _grams(x: np.ndarray) -> np.ndarray:
    """A code per q-gram of contiguous bytes, from its first and last 8 bytes."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(x) - 7, dtype="<u8", buffer=np.ascontiguousarray(x), strides=(1,))
    return eight[:len(x) - Q + 1] * np.uint64(0xD6E8FEB86659FD93) + eight[Q - 8:] * np.uint64(0x9E3779B97F4A7C15)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams ^ (grams >> np.uint64(29))) & np.uint64((1 << _TABLE_BITS) - 1)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for all values from lo to hi of each row."""
    n = np.maximum(hi - lo + 1, 0)
    row = np.repeat(np.arange(len(lo)), n)
    return row, lo[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]


class Index:
    """Windows and q-grams of one block of the benchmark.

    ``begin``, ``size``, ``length``, ``edits`` and ``need`` are by piece. ``kind`` is the class of the window
    at each byte of ``text`` (-1: none), ``lead`` marks each class's first window; class c stands in the items
    ``kind_item[kind_first[c]:kind_first[c + 1]]``, ``kind_count`` times each."""

    def __init__(self, items: list[tuple[object, str]], window: int, errors: float):
        texts = [(item, fold((text or "").strip(" \t\n\v\f\r").encode())) for item, text in items]
        texts = [(item, x) for item, x in texts if len(x) >= Q]
        number = {item: i for i, item in enumerate(dict.fromkeys(item for item, _ in texts))}
        self.owner = list(number)
        self.text = np.concatenate([x for _, x in texts]) if texts else np.zeros(0, np.uint8)
        size = np.array([len(x) for _, x in texts], dtype=np.int64)
        start, length = np.cumsum(size) - size, np.minimum(size, window)
        windows = size - length + 1
        of, at = _ranges(np.zeros_like(size), (windows - 1) // PIECE)
        at = at * PIECE
        self.begin, self.length = start[of] + at, length[of]
        self.size = np.minimum(PIECE, windows[of] - at) + self.length - 1
        self.edits = np.array([budget(n, errors) for n in self.length.tolist()], dtype=np.int64)
        self.need = self.length + 1 - Q * (self.edits + 1)
        self.width = int(self.length.max()) if texts else 0
        self.reach = self.width + int(self.edits.max(initial=0))
        # diagonals are counted from here
        self.bias = (int(self.size.max()) // STEP + 1) * STEP if texts else 0
        searched = self._classes(np.array([number[item] for item, _ in texts], dtype=np.int64), start, length, windows)
        piece, pos = _ranges(np.zeros_like(self.size), self.size - Q)
        keep = searched[self.begin[piece] + pos]
        piece, pos = piece[keep], pos[keep]
        code = _grams(self.text)[self.begin[piece] + pos] if texts else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item, self.pos = piece[order].astype(np.int32), pos[order].astype(np.int32)
        self.code, self.first, gram = np.unique(code[order], return_index=True, return_inverse=True)
        self.last = np.append(self.first[1:], len(code)) if texts else self.first
        self.key = gram * len(self.size) + self.item  # ascending
        self.slots = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.slots[_slot(self.code)] = True

    def _classes(self, owner, start, length, windows) -> np.ndarray:
        """Finds the classes; returns which bytes start a q-gram of a class's first window."""
        item, at = _ranges(start, start + windows - 1)
        n = length[item]
        up = np.full(len(self.text) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
        up[:1] = 1
        up = np.multiply.accumulate(up)
        down = np.full(len(self.text) + 1, pow(0x9E3779B97F4A7C15, -1, 2**64), dtype=np.uint64)
        down[:1] = 1
        down = np.multiply.accumulate(down)
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.text.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * up[:-1])])
        _, first, kind = np.unique(mix64((acc[at + n] - acc[at]) * down[at] + n.astype(np.uint64)), return_index=True, return_inverse=True)
        col = np.arange(self.width)
        equal = np.ones(len(at), dtype=bool)  # bytes decide, not codes
        for a in range(0, len(at), 16_384):
            s = slice(a, a + 16_384)
            lead = first[kind[s]]
            own, other = (np.minimum(p[:, None] + col, len(self.text) - 1) for p in (at[s], at[lead]))
            equal[s] = (n[s] == n[lead]) & ((self.text[own] == self.text[other]) | (col >= n[s][:, None])).all(axis=1)
        odd = np.flatnonzero(~equal)
        kind[odd] = len(first) + np.arange(len(odd))
        first = np.append(first, odd)
        self.kind = np.full(len(self.text), -1, dtype=np.int64)
        self.kind[at] = kind
        self.lead = np.zeros(len(self.text), dtype=bool)
        self.lead[at[first]] = True
        owners = max(len(self.owner), 1)
        pair, self.kind_count = np.unique(kind * owners + owner[item], return_counts=True)
        self.kind_item = pair % owners
        self.kind_first = np.searchsorted(pair // owners, np.arange(len(first) + 1))
        edge = np.zeros(len(self.text) + 1, dtype=np.int64)
        np.add.at(edge, at[first], 1)
        np.add.at(edge, at[first] + n[first] - Q + 1, -1)
        return np.cumsum(edge)[:-1] > 0


def shared_grams(ix: Index, x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, piece, place in the piece, diagonal) of q-grams that texts share with pieces, in parts
    of about ``PART`` hits. All hits of a stretch that a window may match are in one part. x: folded bytes."""
    g = _grams(x)
    at = np.flatnonzero(ix.slots[_slot(g)]) if len(g) and len(ix.code) else np.zeros(0, np.int64)
    if not len(at):
        return
    k = np.searchsorted(ix.code, g[at])
    k[k == len(ix.code)] = 0
    doc = np.searchsorted(offsets, at, side="right") - 1
    good = (ix.code[k] == g[at]) & (at + Q <= offsets[doc + 1])
    at, k, doc = at[good], k[good], doc[good]
    sums = np.concatenate([[0], np.cumsum(ix.last[k] - ix.first[k])])
    begin = 0
    while begin < len(at):
        end = int(np.searchsorted(sums, sums[begin] + PART, side="right")) - 1
        end = max(end, int(np.searchsorted(at, at[begin] + 2 * ix.reach)))
        sel = slice(begin, end)
        many = min(-(-int(sums[min(end, len(at))] - sums[begin]) // PART), len(ix.size))
        for piece in np.array_split(np.arange(len(ix.size)), many) if many > 1 else [None]:
            lo, hi = ix.first[k[sel]], ix.last[k[sel]]
            if piece is not None:
                lo, hi = (np.searchsorted(ix.key, k[sel] * len(ix.size) + p) for p in (piece[0], piece[-1] + 1))
            row, hit = _ranges(lo, hi - 1)
            pos = ix.pos[hit].astype(np.int64)
            own = doc[sel][row]
            yield own, ix.item[hit].astype(np.int64), pos, at[sel][row] - offsets[own] - pos + ix.bias  # diagonal >= 0
        # the next part starts early enough to hold what crosses this end
        if end < len(at) and doc[end] == doc[end - 1]:
            end = max(int(np.searchsorted(at, at[end] - ix.reach)), int(np.searchsorted(doc, doc[end])))
        begin = end


def verbatim(ix: Index, x: np.ndarray, offsets: np.ndarray, doc, item, pos, diag) -> tuple[np.ndarray, ...]:
    """(document, item, place, diagonal) of windows that stand in a text byte by byte."""
    order = np.lexsort((pos, diag, item, doc))
    doc, item, pos, diag = doc[order], item[order], pos[order], diag[order]
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (diag[1:] == diag[:-1]) & (pos[1:] == pos[:-1] + 1)
    run = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(run[1:], len(pos)) - 1
    row, place = _ranges(pos[run], pos[last] - (ix.length[item[run]] - Q))
    doc, item, diag = doc[run][row], item[run][row], diag[run][row]
    lead = ix.lead[ix.begin[item] + place]
    doc, item, place, diag = doc[lead], item[lead], place[lead], diag[lead]
    true = np.zeros(len(place), dtype=bool)
    col = np.arange(ix.width)
    for a in range(0, len(place), 16_384):
        s = slice(a, a + 16_384)
        n = ix.length[item[s], None]
        own = np.minimum((ix.begin[item[s]] + place[s])[:, None] + col, len(ix.text) - 1)
        at = np.minimum((offsets[doc[s]] + place[s] + diag[s] - ix.bias)[:, None] + col, len(x) - 1)
        true[s] = ((ix.text[own] == x[at]) | (col >= n)).all(axis=1)
    return doc[true], item[true], place[true], diag[true]


def candidates(ix: Index, doc, item, pos, diag) -> tuple[np.ndarray, ...]:
    """(document, item, place, band, least and greatest diagonal) of windows that reach the q-gram
    bound within a band."""
    band = diag // STEP
    key = np.concatenate([(doc << 40) | band, (doc << 40) | np.maximum(band - 1, 0)])
    item, pos, diag = np.tile(item, 2), np.tile(pos, 2), np.tile(diag, 2)
    order = np.lexsort((pos, key, item))
    key, item, pos, diag = key[order], item[order], pos[order], diag[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (item[1:] != item[:-1])])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(diag, first), np.maximum.reduceat(diag, first)
    # two bands with the same hits
    again = np.concatenate([[False], (item[first][1:] == item[first][:-1]) & (key[first][1:] >> 40 == key[first][:-1] >> 40)
                            & (low[1:] == low[:-1]) & (high[1:] == high[:-1])])
    last = np.arange(len(pos)) + ix.need[item] - 1  # with this hit, a window that starts by pos has enough
    room = ix.length[item] - Q
    some = last < len(pos)
    last[~some] = 0
    some &= ~again[group] & (group[last] == group) & (pos[last] - pos <= room)
    j = np.flatnonzero(some)
    lo = np.maximum(pos[last[j]] - room[j], 0)
    hi = np.minimum(pos[j], ix.size[item[j]] - ix.length[item[j]])
    if len(j):  # ends grow within a group: each place once
        lo[1:] = np.where(group[j[1:]] == group[j[:-1]], np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
    row, place = _ranges(lo, hi)
    lead = ix.lead[ix.begin[item[j[row]]] + place]
    j, place = j[row[lead]], place[lead]
    return key[j] >> 40, item[j], place, key[j] & ((1 << 40) - 1), low[group[j]], high[group[j]]


def align(ix: Index, x: np.ndarray, offsets: np.ndarray, doc, item, place, low, high, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Banded alignment of windows against their diagonals: yields (rows, distance, end) of those
    within budget. Band column c of window byte i is text byte (first diagonal + c + i)."""
    order = np.argsort(high - low, kind="stable")
    for a in range(0, len(order), step):
        rows = order[a:a + step]
        own, win = doc[rows], item[rows]
        n, edits = ix.length[win], ix.edits[win]
        over = int(edits.max())
        col = np.arange(int((high[rows] - low[rows]).max()) + 2 * over + 1)
        lo, hi = offsets[own], offsets[own + 1]
        start = lo + place[rows] + low[rows] - ix.bias - over  # text byte of column 0 at window byte 0
        text = ix.begin[win] + place[rows]
        far = np.int32(1 << 20)
        # D[c]: cost of the first i window bytes ending before text byte start + c + i; free start
        D = np.where((start[:, None] + col >= lo[:, None]) & (start[:, None] + col <= hi[:, None]), np.int32(0), far)
        best, end = np.full(len(rows), far), np.zeros(len(rows), np.int64)
        width = int(n.max())
        for i in range(width + 1):
            done = n == i
            if done.any():
                c = D[done].argmin(axis=1)
                best[done] = D[done, c]
                end[done] = start[done] + c + i
            if i == width:
                break
            at = start[:, None] + col + i  # byte consumed by a match from column c
            ok = (at >= lo[:, None]) & (at < hi[:, None])
            same = x[np.clip(at, 0, max(len(x) - 1, 0))] == ix.text[np.minimum(text + i, len(ix.text) - 1)][:, None]
            E = np.where(ok, D + ~same, far)
            E[:, :-1] = np.minimum(E[:, :-1], D[:, 1:] + 1)  # window byte skipped
            # text byte skipped: running minimum along the band, inside the document only
            to = start[:, None] + col + i + 1
            E = np.where((to >= lo[:, None]) & (to <= hi[:, None]), E, far)
            D = np.minimum(E, np.minimum.accumulate(E - col, axis=1) + col).astype(np.int32)
            D = np.where((to >= lo[:, None]) & (to <= hi[:, None]), D, far)
        hit = np.flatnonzero(best <= edits)
        yield rows[hit], best[hit], end[hit]


def matches(ix: Index, x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, piece, place of the window, distance, end byte in x), by parts; a window that matches
    near the border of two parts may come twice. x: folded bytes."""
    bands = (int(np.diff(offsets).max(initial=0)) + ix.bias) // STEP + 1
    code = lambda doc, item, place, band: ((doc * len(ix.text) + ix.begin[item] + place) * bands) + band
    for part in shared_grams(ix, x, offsets):
        if not len(part[0]):
            continue
        doc, item, place, diag = verbatim(ix, x, offsets, *part)
        out = [(doc, item, place, np.zeros(len(doc), np.int64), offsets[doc] + place + diag - ix.bias + ix.length[item])]
        known = np.concatenate([code(doc, item, place, np.maximum(diag // STEP - b, 0)) for b in (0, 1)])
        cand = candidates(ix, *part)
        cand = [c[~np.isin(code(*cand[:4]), known)] for c in cand]
        for rows, dist, end in align(ix, x, offsets, *cand[:3], *cand[4:]):
            out.append((cand[0][rows], cand[1][rows], cand[2][rows], dist, end))
        yield tuple(map(np.concatenate, zip(*out)))


def _hits(ix: Index, col: pa.Array):
    """(document row, class, distance, start and end byte in the document) of an Arrow column."""
    data, off = raw(col)
    for i, j in slices(off):
        x = _FOLD[data[off[i]:off[j]]]
        own = off[i:j + 1] - off[i]
        keep = _kept(x, own[:-1][own[:-1] < len(x)])
        stored = np.flatnonzero(keep)
        folded = np.concatenate([[0], np.cumsum(keep)])[own]
        for doc, piece, place, dist, end in matches(ix, x[keep], folded):
            if len(doc):
                begin = stored[np.maximum(end - ix.length[piece], folded[doc])]
                yield doc + i, ix.kind[ix.begin[piece] + place], dist, begin - own[doc], stored[end - 1] + 1 - own[doc]


def _grouped(a, b, dist, begin, end, n) -> tuple[np.ndarray, ...]:
    """One row per (a, b): fewest edits, first byte, last byte, sum of n."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = [np.minimum.reduceat(v[order], at) for v in (dist, begin)]
    return a[at], b[at], *least, np.maximum.reduceat(end[order], at), np.add.reduceat(n[order], at)


def _by_item(ix: Index, hits) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, fewest edits, first byte, last byte, windows), some documents at a time."""
    found, held = [], 0
    for rows in hits:
        found.append(rows)
        held += len(rows[0])
        if held > 4 * PART:
            found, held = [_by_class(found)], 0
    if not found:
        return
    doc, kind, dist, begin, end = _by_class(found)
    sums = np.cumsum(ix.kind_first[kind + 1] - ix.kind_first[kind])
    at = 0
    while at < len(doc):  # whole documents, of about PART rows
        to = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PART, side="right"))
        to = int(np.searchsorted(doc, doc[min(max(to, at + 1), len(doc)) - 1], side="right"))
        s = slice(at, to)
        row, pair = _ranges(ix.kind_first[kind[s]], ix.kind_first[kind[s] + 1] - 1)
        yield _grouped(doc[s][row], ix.kind_item[pair], dist[s][row], begin[s][row], end[s][row], ix.kind_count[pair])
        at = to


def _by_class(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row per document and class."""
    rows = [np.concatenate(c) for c in zip(*found)]
    return _grouped(*rows, np.ones(len(rows[0]), np.int64))[:5]


def blocks(benchmark: DataFrame, window: int, errors: float, block_bytes: int,
           id_col: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes`` of text, each small enough to broadcast."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.octet_length("text") >= Q)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow()
        if part.num_rows:
            yield Index(list(zip(part["id"].to_pylist(), part["text"].to_pylist())), window, errors)


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = 64, errors: float = 0.05,
                   block_bytes: int = 1 << 21, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, edits, start, end): one row per document row and item with a
    hit: windows found, fewest edits of one, and the byte range from the first to the last."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("item_id", benchmark.schema["item_id"].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("windows", "edits", "start", "end")])
    item_type = to_arrow_type(schema["item_id"].dataType)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for index in blocks(benchmark, window, errors, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            ix = shared.value
            for b in batches:
                for doc, item, edits, begin, end, windows in _by_item(ix, _hits(ix, text_column(b))):
                    order = sorted(range(len(doc)), key=lambda r: (doc[r], str(ix.owner[item[r]])))
                    doc, item, *rest = (v[order] for v in (doc, item, windows, edits, begin, end))
                    ids = pa.array([ix.owner[w] for w in item.tolist()], item_type)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), ids, *map(pa.array, rest)], names=schema.names)

        part = source.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 64, errors: float = 0.05,
                      block_bytes: int = 1 << 21, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark hit, all columns kept; no shuffle."""
    for index in blocks(benchmark, window, errors, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for doc, *_ in _hits(shared.value, text_column(b, text)):
                    keep[doc] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
