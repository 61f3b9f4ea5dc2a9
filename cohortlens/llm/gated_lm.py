"""LM scoring: a gated recurrent language model over word tokens, trained in numpy.

Tokens are lower-cased words and one end token per document. The model is class-factored:
P(token | past) = P(class | state) x P(token | class, state). The ``head`` most frequent
training tokens stand in classes of equal size with a softmax of their own, given the state.
Every other token, seen or not, belongs to a class by its last two bytes, in which its share is
(c + 1) / (N_class + V_class + 1) with counts over the whole training corpus: the rule of the
unigram base score, applied within a class. The state is that of a gated recurrent unit.

Corpus counts: every scan batch adds up its words before the shuffle, so a frequent word costs
a row per batch. The ``direct`` most frequent words are broadcast with their counts. The others'
occurrences leave the scoring scan packed by hash bucket, together with the document they stand
in and whether it trains; a bucket holds all occurrences of its words, counts them, and returns
the documents' sums of log counts, packed by scan batch. Texts are not shuffled, and no table of all words is ever
broadcast or collected.

Training: truncated backpropagation (``window`` steps, state carried on) with Adam, over every
training document once. The documents are dealt into ``rounds``; in a round each task trains on
what it reads from the round's weights, and the weights are averaged by tokens in two grouped
steps. Broadcast and collected: the weights (fixed size), ``direct`` counts, class totals.

Scoring: all documents of a scan batch advance together, longest first, in windows between which
the state is carried, so a text is scored whole, whatever its length.

Defined results: a null or empty text is the end token alone; without training documents the
counts are zero and the model is its start values; an empty table gives an empty result; rows that
share an id are scored one by one; a null id counts as the empty text in the split. Only id
and text are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm._text import LOWER, mix64, raw, slices, text_column, words
from cohortlens.llm._top import greatest
from cohortlens.sources.sinks import materialize

END = np.uint64(0x5E0FD0C5E0FD0C5E)
CLASS_WORDS = 32
TAIL_CLASSES = 64


@dataclass(frozen=True)
class Vocabulary:
    """Head tokens (hashes, most frequent first, the end token among them) with their counts,
    and the tail classes' token and type totals."""

    head: np.ndarray
    head_count: np.ndarray
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    tokens: int
    types: int

    @property
    def head_classes(self) -> int:
        return -(-len(self.head) // CLASS_WORDS)

    @property
    def inputs(self) -> int:
        return len(self.head) + TAIL_CLASSES + 1  # the last one starts a document


def tokens(col: pa.Array, i: int, j: int, data: np.ndarray, off: np.ndarray):
    """(hash, tail class, first): tokens of documents i..j, the end token closing each."""
    x, own = data[off[i]:off[j]], off[i:j + 1] - off[i]
    h, s, e, first = words(x, own)
    end = e - 1
    before = np.maximum(end - 1, s)
    kind = (LOWER[x[end]].astype(np.int64) * 31 + LOWER[x[before]]) % TAIL_CLASSES if len(h) else np.zeros(0, np.int64)
    at = first[1:]
    return np.insert(h, at, END), np.insert(kind, at, 0), first + np.arange(len(first))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(w, kind, c): per scan batch, each distinct word and how often it stands there."""

    def count(batches):
        for b in batches:
            col = text_column(b)
            data, off = raw(col)
            hs, ks, cs = [], [], []
            for i, j in slices(off):
                h, k, _ = tokens(col, i, j, data, off)
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                hs.append(u)
                ks.append(k[at])
                cs.append(c)
            if hs:
                u, at, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
                c = np.bincount(inv, weights=np.concatenate(cs), minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate(ks)[at].astype(np.int32)), pa.array(c)],
                                                 names=["w", "kind", "c"])

    return docs.select("text").mapInArrow(count, "w long, kind int, c long")


def frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, sorted by hash; at most ``limit``."""
    top = greatest(counts.select("w", "c"), "c", "w", limit).toArrow()
    w, c = top["w"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(w)
    return w[order], c[order]


def vocabulary(counts: DataFrame, head: int) -> Vocabulary:
    """From (w, kind, c) with one row per token seen in training."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    end = int(END.view(np.int64))
    top = greatest(counts.filter(F.col("w") != end), "c", "w", head - 1).select("w", "kind", "c").toArrow()
    ends = counts.filter(F.col("w") == end).agg(F.sum("c")).first()[0] or 0
    w, c = np.append(top["w"].to_numpy().view(np.uint64), END), np.append(top["c"].to_numpy(), ends)
    order = np.lexsort((w, -c))
    tail = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n, v = (np.array([tail.get(k, (0, 0))[i] for k in range(TAIL_CLASSES)], np.int64) for i in (0, 1))
    kinds = np.append(top["kind"].to_numpy(), 0)
    n -= np.bincount(kinds, weights=c, minlength=TAIL_CLASSES).astype(np.int64)
    v -= np.bincount(kinds[c > 0], minlength=TAIL_CLASSES)
    return Vocabulary(w[order], c[order], n, np.maximum(v, 0), int(total[0] or 0), int(total[1]))


class Model:
    """Weights as one flat float32 vector with named views."""

    def __init__(self, voc: Vocabulary, hidden: int, flat: np.ndarray | None = None):
        self.hidden, self.n_head, self.n_classes = hidden, len(voc.head), voc.head_classes + TAIL_CLASSES
        self.head_classes = voc.head_classes
        H, padded = hidden, voc.head_classes * CLASS_WORDS
        shapes = {"x": (voc.inputs, 3 * H), "u": (H, 3 * H), "c": (H, self.n_classes), "cb": (self.n_classes,),
                  "w": (padded, H), "wb": (padded,)}
        self.size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(self.size, np.float32) if flat is None else flat
        at = 0
        self.views: dict[str, slice] = {}
        for name, s in shapes.items():
            n = int(np.prod(s))
            self.views[name] = slice(at, at + n)
            setattr(self, name, self.flat[at:at + n].reshape(s))
            at += n
        if flat is None:
            rng = np.random.Generator(np.random.PCG64(7))
            for name, scale in (("x", 0.1), ("u", H**-0.5), ("c", 0.05), ("w", 0.05)):
                view = getattr(self, name)
                view[...] = rng.standard_normal(view.shape, dtype=np.float32) * scale
            # biases start at the unigram distribution over classes and within them
            c = np.zeros(padded)
            c[:self.n_head] = voc.head_count
            groups = c.reshape(-1, CLASS_WORDS)
            self.cb[...] = np.log(np.concatenate([groups.sum(axis=1), voc.tail_tokens]) + 1.0)
            self.wb[...] = np.log(c + 0.5)
            self.wb[self.n_head:] = -1e4  # places without a word

    def split(self, ids: np.ndarray) -> np.ndarray:
        """Class of each token id: head ids by CLASS_WORDS, then tail classes."""
        return np.where(ids < self.n_head, ids // CLASS_WORDS, ids - self.n_head + self.head_classes)


def token_ids(voc: Vocabulary, order: np.ndarray, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Input ids: place in the head, or len(head) + tail class. ``order`` sorts the head."""
    known = voc.head[order]
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return np.where(known[at] == h, order[at], len(voc.head) + kind).astype(np.int32)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _step(m: Model, x, h):
    """One step of the unit: (new state, z, r, n, recurrent candidate)."""
    H = m.hidden
    a, g = m.x[x], h @ m.u
    zr = _sigmoid(a[:, :2 * H] + g[:, :2 * H])
    z, r, gn = zr[:, :H], zr[:, H:], g[:, 2 * H:]
    n = np.tanh(a[:, 2 * H:] + r * gn)
    return n + z * (h - n), z, r, n, gn


def _softmax(x):
    """Rows of ``x`` to probabilities, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _log_share(x, at):
    """Log probability of place ``at`` of each row under the row's softmax; uses up ``x``."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=1))


def _runs(cls: np.ndarray, n: int):
    """(class, rows) for each class under n that occurs."""
    small = cls.astype(np.uint16) if n < 2**15 else cls  # 16 bits sort by radix
    order = np.argsort(small, kind="stable")
    at = np.searchsorted(cls[order], np.arange(n + 1))
    for c in range(n):
        if at[c] < at[c + 1]:
            yield c, order[at[c]:at[c + 1]]


def log_probs(m: Model, states: np.ndarray, y: np.ndarray, step: int = 4096) -> np.ndarray:
    """Natural log of P(class | state), times P(token | class, state) for head tokens; ``step`` rows
    of class scores at a time, which stay in the processor's cache."""
    cls = m.split(y)
    out = np.empty(len(y))
    for i in range(0, len(y), step):
        z = states[i:i + step] @ m.c
        z += m.cb
        out[i:i + step] = _log_share(z, cls[i:i + step])
    for c, rows in _runs(cls, m.head_classes):
        own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
        out[rows] += _log_share(states[rows] @ m.w[own].T + m.wb[own], y[rows] - c * CLASS_WORDS)
    return out


def _backward(m: Model, X, Y, start, h0):
    """Gradient of the mean negative log-likelihood of a window, and the state after it."""
    T, B = Y.shape
    H = m.hidden
    hs, keep = np.empty((T + 1, B, H), np.float32), []
    begins = start.any(axis=1)
    hs[0] = h0
    for t in range(T):
        h_in = np.where(start[t][:, None], np.float32(0), hs[t]) if begins[t] else hs[t]
        hs[t + 1], z, r, n, gn = _step(m, X[t], h_in)
        keep.append((h_in, z, r, n, gn))
    s, y = hs[1:].reshape(T * B, H), Y.ravel()
    cls = m.split(y)
    g = np.zeros(m.size, np.float32)
    G = Model.__new__(Model)
    for name, view in m.views.items():
        setattr(G, name, g[view].reshape(getattr(m, name).shape))
    p = s @ m.c
    p += m.cb
    _softmax(p)
    p[np.arange(len(y)), cls] -= 1
    G.c[...] = s.T @ p
    G.cb[...] = p.sum(axis=0)
    ds = p @ m.c.T
    for c, rows in _runs(cls, m.head_classes):
        own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
        mine = s[rows]
        q = _softmax(mine @ m.w[own].T + m.wb[own])
        q[np.arange(len(rows)), y[rows] - c * CLASS_WORDS] -= 1
        G.w[own] = q.T @ mine
        G.wb[own] = q.sum(axis=0)
        ds[rows] += q @ m.w[own]
    ds = ds.reshape(T, B, H)
    dX = np.empty((T, B, 3 * H), np.float32)
    dh = np.zeros((B, H), np.float32)
    for t in reversed(range(T)):
        h_in, z, r, n, gn = keep[t]
        dh = dh + ds[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h_in - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dX[t] = np.concatenate([dz, dr, dn], axis=1)
        dG = np.concatenate([dz, dr, dn * r], axis=1)
        G.u += h_in.T @ dG
        dh = dh * z + dG @ m.u.T
        if begins[t]:
            dh[start[t]] = 0
    ids = X.ravel()
    order = np.argsort(ids.astype(np.uint16) if len(m.x) < 2**16 else ids, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    G.x[ids[order][new]] = np.add.reduceat(dX.reshape(T * B, -1)[order], new, axis=0)
    return g / np.float32(T * B), hs[T]


class Trainer:
    """Adam over windows of ``lanes`` streams."""

    def __init__(self, m: Model, lanes: int, window: int, rate: float):
        self.m, self.lanes, self.window, self.rate = m, lanes, window, rate
        self.a, self.b, self.t = np.zeros(m.size, np.float32), np.zeros(m.size, np.float32), 0
        self.tokens = 0

    def run(self, y: np.ndarray, first: np.ndarray) -> None:
        """One pass over tokens ``y`` of documents starting at ``first``."""
        n = len(y)
        x = np.empty(n, np.int32)
        x[1:] = y[:-1]
        start = np.zeros(n, bool)
        start[first[:-1]] = True
        x[start] = len(self.m.x) - 1
        lanes = max(1, min(self.lanes, n // self.window))
        length = n // lanes
        cut = lambda v: v[:lanes * length].reshape(lanes, length).T
        X, Y, S = cut(x), cut(y), cut(start)
        S = S.copy()
        S[0] = True
        h = np.zeros((lanes, self.m.hidden), np.float32)
        for at in range(0, length, self.window):
            w = slice(at, min(at + self.window, length))
            g, h = _backward(self.m, X[w], Y[w], S[w], h)
            self._adam(g)
        if rest := n - lanes * length:  # what did not fill the lanes
            w = slice(n - rest, n)
            s = start[w, None].copy()
            s[0] = True
            g, _ = _backward(self.m, x[w, None], y[w, None], s, np.zeros((1, self.m.hidden), np.float32))
            self._adam(g * np.float32(rest / (self.lanes * self.window)))
        self.tokens += n

    def _adam(self, g):
        self.t += 1
        norm = float(np.sqrt((g * g).sum()))
        if norm > 1:
            g = g / np.float32(norm)
        self.a += np.float32(0.1) * (g - self.a)
        self.b += np.float32(0.01) * (g * g - self.b)
        scale = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.m.flat -= np.float32(scale) * self.a / (np.sqrt(self.b) + np.float32(1e-6))


def _encoded(voc: Vocabulary, order: np.ndarray, col: pa.Array):
    """(ids, first) of a whole column."""
    data, off = raw(col)
    ys, firsts, at = [], [], 0
    for i, j in slices(off):
        h, k, first = tokens(col, i, j, data, off)
        ys.append(token_ids(voc, order, h, k))
        firsts.append(first[:-1] + at)
        at += len(h)
    return np.concatenate(ys + [np.zeros(0, np.int32)]), np.concatenate(firsts + [np.array([at])]).astype(np.int64)


def train(docs: DataFrame, voc: Vocabulary, hidden: int, rounds: int, lanes: int, window: int, rate: float) -> np.ndarray:
    """The weights, after one pass over all training documents in ``rounds`` averaged rounds."""
    spark = docs.sparkSession
    flat = Model(voc, hidden).flat
    block = 4096
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((voc, flat))

        def fit(batches, speed=rate / (1 + r)):
            voc, flat = shared.value
            order = np.argsort(voc.head)
            trainer = Trainer(Model(voc, hidden, flat.copy()), lanes, window, speed)
            seen = 0
            for b in batches:
                y, first = _encoded(voc, order, text_column(b))
                if len(y):
                    trainer.run(y, first)
                    seen += int(y[0]) + len(y)
            if trainer.tokens:
                parts = [trainer.m.flat[i:i + block].astype(np.float64) * trainer.tokens for i in range(0, len(flat), block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), seen % 64, np.int32)),
                     pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(np.full(len(parts), trainer.tokens, np.int64))],
                    names=["block", "salt", "v", "n"])

        own = docs.filter(F.col("train") & (F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(rounds)) == r))
        out = own.select("text").mapInArrow(fit, "block int, salt int, v binary, n long")
        out = out.groupBy("block", "salt").applyInArrow(_add, "block int, salt int, v binary, n long")
        out = out.groupBy("block").applyInArrow(_add, "block int, salt int, v binary, n long").toArrow()
        if out.num_rows:
            flat = flat.copy()
            for k, v, n in zip(out["block"].to_pylist(), out["v"].to_pylist(), out["n"].to_pylist()):
                flat[k * block:(k + 1) * block] = np.frombuffer(v, np.float64) / n
    return flat


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.float64) for v in table["v"].to_pylist())
    return pa.table({"block": table["block"][:1], "salt": table["salt"][:1], "v": pa.array([total.tobytes()], pa.binary()),
                     "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})


def neural(m: Model, y: np.ndarray, first: np.ndarray, memory: int = 1 << 16) -> np.ndarray:
    """Per document, the natural log of the model's class (and head token) probabilities. All
    documents advance together, longest first; the state is carried from window to window."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    total = np.zeros(len(length))
    longest = length[order]
    h = np.zeros((len(order), m.hidden), np.float32)
    t, most = 0, int(longest[0]) if len(longest) else 0
    while t < most:
        live = int(np.searchsorted(-longest, -t, side="left"))  # longer than t
        steps = int(min(max(1, memory // live), 64, most - t))
        states, ys, docs = [], [], []
        for u in range(t, t + steps):
            k = int(np.searchsorted(-longest, -u, side="left"))
            at = first[order[:k]] + u
            x = y[at - 1] if u else np.full(k, len(m.x) - 1, np.int32)
            h[:k] = _step(m, x, h[:k])[0]
            states.append(h[:k].copy())
            ys.append(y[at])
            docs.append(order[:k])
        total += np.bincount(np.concatenate(docs), weights=log_probs(m, np.concatenate(states), np.concatenate(ys)), minlength=len(length))
        t += steps
    return total


def _scan(shared, hidden: int, buckets: int):
    """Scan batches to document rows (bucket -1) and packed rest words (bucket 0 and up)."""

    def run(batches):
        voc, flat, w, c = shared.value
        m, order = Model(voc, hidden, flat), np.argsort(voc.head)
        w, c = np.append(w, np.uint64(2**64 - 1)), np.append(c, 0)
        share = np.log10(voc.tail_tokens + voc.tail_types + 1.0)
        for b in batches:
            if not b.num_rows:
                continue
            col = text_column(b)
            data, off = raw(col)
            train = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            parts: dict[str, list] = {k: [] for k in ("n", "k", "s", "m", "y", "first", "h", "row")}
            at = 0
            for i, j in slices(off):
                h, kind, first = tokens(col, i, j, data, off)
                place = np.searchsorted(w, h)
                direct = w[place] == h
                logc = np.where(direct, np.log10(c[place] + 1.0), 0.0)
                y = token_ids(voc, order, h, kind)
                out = y >= len(voc.head)
                inner = np.where(out, logc - share[np.where(out, y - len(voc.head), 0)], 0.0)
                begin = first[:-1]
                parts["n"].append(np.diff(first))
                parts["k"].append(np.add.reduceat((direct & (c[place] > 0)).astype(np.int64), begin))
                parts["s"].append(np.add.reduceat(logc, begin))
                parts["m"].append(np.add.reduceat(inner, begin))
                parts["y"].append(y)
                parts["first"].append(begin + at)
                rest = ~direct
                parts["h"].append(h[rest])
                parts["row"].append((np.repeat(np.arange(i, j), np.diff(first))[rest]).astype(np.uint32))
                at += len(h)
            g = {k: np.concatenate(v) for k, v in parts.items()}
            score = neural(m, g["y"], np.append(g["first"], at).astype(np.int64)) / np.log(10) + g["m"]
            rows = b.num_rows
            chunk = uuid.uuid4().int >> 65
            where = (g["h"] >> np.uint64(33)) % np.uint64(buckets)
            by = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[by], np.arange(buckets + 1))
            packed = [(k, by[ends[k]:ends[k + 1]]) for k in range(buckets) if ends[k] < ends[k + 1]]
            flags, n = train.tobytes(), len(packed)
            pad = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(n, t)])
            blank = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(np.full(rows, -1, np.int32)), pa.array([k for k, _ in packed], pa.int32())]),
                 pa.array(np.full(rows + n, chunk, np.int64)), pad(np.arange(rows, dtype=np.int32), pa.int32()),
                 pa.concat_arrays([b.column(0), pa.nulls(n, b.column(0).type)]), pad(~train, pa.bool_()),
                 pad(g["n"], pa.int64()), pad(g["k"], pa.int64()), pad(g["s"], pa.float64()), pad(score, pa.float64()),
                 pa.concat_arrays([blank, pa.array([g["h"][x].tobytes() for _, x in packed], pa.binary())]),
                 pa.concat_arrays([blank, pa.array([g["row"][x].tobytes() for _, x in packed], pa.binary())]),
                 pa.concat_arrays([blank, pa.array([flags] * n, pa.binary())])],
                names=["bucket", "chunk", "row", "doc_id", "held_out", "n", "k", "s", "m", "words", "rows", "flags"])

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """Per chunk, packed: its rows with words of this bucket, their sums of log10(c + 1) and
    numbers of known words."""
    words_ = [np.frombuffer(x, "<u8") for x in table["words"].to_pylist()]
    rows = [np.frombuffer(x, "<u4") for x in table["rows"].to_pylist()]
    flags = [np.frombuffer(x, bool) for x in table["flags"].to_pylist()]
    _, inv = np.unique(np.concatenate(words_), return_inverse=True)
    c = np.bincount(inv, weights=np.concatenate([f[r] for f, r in zip(flags, rows)]))[inv]
    logc, at = np.log10(c + 1.0), 0
    out: dict[str, list[bytes]] = {"rows": [], "s": [], "k": []}
    for r in rows:
        own = slice(at, at + len(r))
        at += len(r)
        s, k, n = np.bincount(r, weights=logc[own]), np.bincount(r, weights=c[own] > 0), np.bincount(r)
        there = np.flatnonzero(n)
        for name, x in (("rows", there.astype("<u4")), ("s", s[there]), ("k", k[there])):
            out[name].append(x.tobytes())
    return pa.table({"chunk": table["chunk"], **{n: pa.array(x, pa.binary()) for n, x in out.items()}})


def _sum_chunk(table: pa.Table) -> pa.Table:
    """(chunk, row, s, k) of one scan batch, over all buckets."""
    row, s, k = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("rows", "<u4"), ("s", "<f8"), ("k", "<f8")))
    there = np.flatnonzero(np.bincount(row))
    return pa.table({"chunk": np.full(len(there), table["chunk"][0].as_py(), np.int64), "row": there.astype(np.int32),
                     "_s": np.bincount(row, weights=s)[there], "_k": np.bincount(row, weights=k)[there].astype(np.int64)})


def score_documents(docs: DataFrame, held_out: Column, hidden: int = 16, head: int = 1024, direct: int = 65_536,
                    rounds: int = 3, lanes: int = 256, window: int = 32, rate: float = 0.02, bucket_bytes: int = 1 << 26,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document
    row; scores are log10. Learns from the rows where ``held_out`` is false."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = _word_counts(docs.filter(~F.col("held_out"))).groupBy("w", "kind").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "word-counts")
    voc = vocabulary(counts, head)
    flat = train(docs.withColumn("train", ~F.col("held_out")), voc, hidden, rounds, lanes, window, rate)
    w, c = frequent(counts, direct)
    if END not in w:  # few documents: the end token is always direct
        at = int(np.searchsorted(w, END))
        w, c = np.insert(w, at, END), np.insert(c, at, voc.head_count[voc.head == END][0])
    shared = spark.sparkContext.broadcast((voc, flat, w, c))
    buckets = max(1, -(-size // bucket_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"bucket int, chunk long, row int, doc_id {kind}, held_out boolean, n long, k long, s double, m double, "
              "words binary, rows binary, flags binary")
    scored = materialize(docs.mapInArrow(_scan(shared, hidden, buckets), schema), "scored")
    rest = (scored.filter("bucket >= 0").select("bucket", "chunk", "words", "rows", "flags").groupBy("bucket")
            .applyInArrow(_count_bucket, "chunk long, rows binary, s binary, k binary"))
    rest = rest.groupBy("chunk").applyInArrow(_sum_chunk, "chunk long, row int, _s double, _k long")
    x = scored.filter("bucket < 0").join(rest, ["chunk", "row"], "left")
    more, known = F.coalesce("_s", F.lit(0.0)), F.coalesce("_k", F.lit(0))
    each = float(np.log10(voc.tokens + voc.types + 1.0))
    return x.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("k") + known).alias("n_known"),
                    F.lit(voc.tokens).cast("long").alias("train_tokens"),
                    (F.col("s") + more - F.col("n") * F.lit(each)).alias("base_score"), (F.col("m") + more).alias("score"))
