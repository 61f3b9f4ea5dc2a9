"""Hard negatives by Kronecker-packed integer products.

Vectors become integers, floor(SCALE * x) per component, and are compared by their exact inner
product. For an anchor, positives are the first rows of its label; for each of them the negatives are
the best rows of another label whose score lies in a band below the positive's.

Kronecker packing. Candidate components are biased by their least value, so none is negative, and
several candidates' components on the same coordinate are laid side by side as fields of one wide
integer. One multiplication by an anchor's component multiplies them all; summed over the
coordinates, every field holds one candidate's product with the anchor. A field has the bits of

    sum |anchor components| * largest biased component,  and a sign,

so sums never reach the next field. Adding half a field's range to each makes all fields
non-negative; they are cut out by shifts, and the half range and the bias times the anchor's sum are
taken off again: exact scores. With 64 components up to 1 in size three candidates fit a machine
word; where a field needs more than a word, Python's integers of any width hold the fields.

Work. Every anchor meets every row, in blocks: anchors and rows are dealt by hash to blocks of
bounded rows, and a task takes one pair of blocks, twice, for the positives and then for the
negatives. A block keeps only its best rows per anchor (per positive), so what is shuffled on is
(row blocks) x (few rows) per anchor, and the ranking limits it again before its shuffle.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part.
Rows equal in id, label and vector are one row. Rows that share an id only are rows of their own
(ids should be unique); an anchor is no partner of itself. Vectors of different lengths have no
product; empty ones score 0. Scores beyond a 64-bit integer are compared exactly within a block and
reported as the largest one. Bounds of the band are percentages of the positive's score, so a
negative positive score has no negatives, and zero admits zero. An empty table gives an empty result.
Only the id, vector and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.sinks import materialize

MOST = 2**63 - 1
ROW = "id long, own long, label int, v array<double>"


def usable(rows: DataFrame, id_col: str, vec: str, label: Column) -> DataFrame:
    """(id, own, label, v): rows that take part; ``own`` tells apart rows that share an id."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    good = F.forall("v", lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)))
    x = x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    return x.dropDuplicates(["id", "label", "v"]).withColumn("own", F.xxhash64("label", "v"))


def integers(col: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where that does not hold them. Vectors of one
    length."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() * scale >= 2.0**62:  # from 2^53 on doubles are whole numbers
        flat = np.array([int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in flat], dtype=object)
    else:
        flat = np.floor(flat * float(scale)).astype(np.int64)
    return flat.reshape(len(col), len(flat) // max(len(col), 1))


def pack(rows: np.ndarray, bits: int, fields: int) -> np.ndarray:
    """(words, components): ``fields`` rows side by side in each integer. rows: non-negative."""
    words = -(-len(rows) // fields)
    padded = np.zeros((words * fields, rows.shape[1]), rows.dtype)
    padded[:len(rows)] = rows
    out = padded[0::fields].copy()
    for k in range(1, fields):
        out += padded[k::fields] << (bits * k)
    return out


class Packed:
    """Candidate rows packed for anchors of a known size (the largest sum of |components|)."""

    def __init__(self, rows: np.ndarray, reach: int):
        self.n = len(rows)
        self.bias = int(rows.min()) if rows.size else 0
        biased = rows - self.bias
        top = int(biased.max()) if rows.size else 0
        self.bits = max(reach * top, 1).bit_length() + 1
        self.fields = 62 // self.bits if reach * abs(self.bias) < 2**62 else 0
        if not self.fields:  # wider than a word: integers of any width
            self.fields, biased = 8, biased.astype(object)
        self.words = pack(biased, self.bits, self.fields)
        self.half = sum(1 << (self.bits * (k + 1) - 1) for k in range(self.fields))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, rows): exact inner products."""
        if self.words.dtype == object:
            anchors = anchors.astype(object)
        wide = anchors @ self.words.T + self.half
        mask, low = (1 << self.bits) - 1, 1 << (self.bits - 1)
        out = np.empty((len(anchors), wide.shape[1], self.fields), wide.dtype)
        for k in range(self.fields):
            out[:, :, k] = ((wide >> (self.bits * k)) & mask) - low
        out = out.reshape(len(anchors), -1)[:, :self.n]
        return out + self.bias * anchors.sum(axis=1)[:, None]


def reach(anchors: np.ndarray) -> int:
    return max((int(x) for x in np.abs(anchors).sum(axis=1)), default=0)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id (``own`` decides among equal ids)."""
    at = np.arange(len(scores))
    if len(scores) > k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    order = sorted(at.tolist(), key=lambda i: (-scores[i], ids[i], own[i])) if scores.dtype == object \
        else at[np.lexsort((own[at], ids[at], -scores[at]))]
    return np.asarray(order[:k], dtype=np.int64)


def _clip(scores) -> list[int]:
    return [max(min(int(s), MOST), -MOST) for s in scores]


def _columns(table: pa.Table) -> tuple:
    return tuple(table[c].to_numpy() for c in ("id", "own", "label"))


def _by_length(left: pa.Table, right: pa.Table, scale: int):
    """(anchor rows, their integers, candidate rows, their packed integers) for each vector length."""
    def lengths(t):
        return t["v"].combine_chunks().value_lengths().to_numpy() if t.num_rows else np.zeros(0, np.int64)

    la, lc = lengths(left), lengths(right)
    for n in np.intersect1d(la, lc):
        i, j = np.flatnonzero(la == n), np.flatnonzero(lc == n)
        a = integers(left["v"].combine_chunks().take(pa.array(i)), scale)
        c = integers(right["v"].combine_chunks().take(pa.array(j)), scale)
        if a.dtype == object or c.dtype == object:
            a, c = a.astype(object), c.astype(object)
        packed = Packed(c, reach(a))
        for s in range(0, len(a), 64):
            yield i[s:s + 64], packed.scores(a[s:s + 64]), j


def _positives(scale: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of the anchor's label in the block."""
        (aid, aown, alabel), (cid, cown, clabel) = _columns(left), _columns(right)
        out: list[list] = [[] for _ in range(5)]
        for rows, scores, cols in _by_length(left, right, scale):
            ids, own, label = cid[cols], cown[cols], clabel[cols]
            for r, s in zip(rows.tolist(), scores):
                other = np.flatnonzero((label == alabel[r]) & ((ids != aid[r]) | (own != aown[r])))
                best = other[_best(s[other], ids[other], own[other], k)]
                for col, x in zip(out, ([aid[r]] * len(best), [aown[r]] * len(best), ids[best], own[best], _clip(s[best]))):
                    col.extend(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "own", "positive_id", "_pown", "positive_score"])

    return run


def _negatives(scale: int, k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of other labels in the block, for each positive's band of scores."""
        (aid, aown, alabel), (cid, cown, clabel) = _columns(left), _columns(right)
        out: list[list] = [[] for _ in range(6)]
        positives = left["positives"].to_pylist()
        for rows, scores, cols in _by_length(left, right, scale):
            ids, own, label = cid[cols], cown[cols], clabel[cols]
            for r, s in zip(rows.tolist(), scores):
                for p in positives[r]:
                    # 100 s between low and high percent of the positive's score, in whole numbers
                    least, most = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
                    near = np.flatnonzero((label != alabel[r]) & (s >= least) & (s <= most))
                    best = near[_best(s[near], ids[near], own[near], k)]
                    m = len(best)
                    for col, x in zip(out, ([aid[r]] * m, [aown[r]] * m, [p["place"]] * m, ids[best], own[best], _clip(s[best]))):
                        col.extend(x)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "own", "place", "negative_id", "_nown", "negative_score"])

    return run


def _blocks(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def _dealt(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id", "own"), F.lit(blocks)).cast("int")


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, id_col: str = "vec_id", vec: str = "embedding", anchor_rows: int = 2048, block_rows: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where
    ``is_anchor`` (a condition on ``id``) holds; ``label`` is the label each row counts by."""
    x = materialize(usable(rows, id_col, vec, label).select("id", "own", "label", "v"), "integer-vectors")
    anchors = x.filter(is_anchor)
    many, asked = x.count(), anchors.count()
    a_blocks, c_blocks = _blocks(asked, anchor_rows), _blocks(many, block_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = ["_a", "_c"]
    own = x.select(*[F.col(c).alias(c) for c in x.columns])  # columns of their own beside the anchors'
    candidates = own.withColumn("_c", _dealt(c_blocks)).withColumn("_a", every(a_blocks)).groupBy(*pair)

    def against(left: DataFrame, run, schema: str) -> DataFrame:
        left = left.withColumn("_a", _dealt(a_blocks)).withColumn("_c", every(c_blocks))
        return left.groupBy(*pair).cogroup(candidates).applyInArrow(run, schema)

    found = against(anchors, _positives(scale, positives), "id long, own long, positive_id long, _pown long, positive_score long")
    first = Window.partitionBy("id", "own").orderBy(F.desc("positive_score"), "positive_id", "_pown")
    found = found.withColumn("place", F.row_number().over(first).cast("long")).filter(F.col("place") <= positives)
    found = materialize(found.drop("_pown"), "positives")
    lists = found.groupBy("id", "own").agg(F.collect_list(F.struct("place", "positive_score")).alias("positives"))
    found_neg = against(anchors.join(lists, ["id", "own"]), _negatives(scale, negatives, low, high),
                        "id long, own long, place long, negative_id long, _nown long, negative_score long")
    best = Window.partitionBy("id", "own", "place").orderBy(F.desc("negative_score"), "negative_id", "_nown")
    ranked = found_neg.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    out = ranked.join(found, ["id", "own", "place"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
