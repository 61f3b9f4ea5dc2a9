"""Merkle manifest of a dataset: one root digest, and for every row a proof that it is in it.

Rows are leaves. Within a group (``source``) leaves ascend by id (nulls first, then by digest), and
while several nodes remain, every ARITY consecutive ones (the last run may be shorter, even one)
become the digest of their digests. What remains is the group's subroot. Subroots in the order of
their groups (null first, bytewise) make one more such tree, whose top is the root.

Build. The rows' digests are written narrow, dealt by range of (group, id, digest) and sorted, so a
row's rank in its group is its place in its partition plus the rows of the group in the partitions
before: a window over at most one row per partition and group. STRIDE levels at a time, blocks of
ARITY ** STRIDE consecutive nodes become one record, *digest -> children by level*; a tree of N
leaves takes log(N) / log(81) groupings of geometrically falling size. No group holds more than 81
nodes, however many rows a source has.

Proofs. Content-addressed descent: requests are ranks, whose digits to the base ARITY name the child
taken on each level. The root's digest finds its record; the digits of every request choose children,
the unselected ones of each level are appended to the request's path, and the digest of the child
reached finds the next record. Requests that share a block descend as one row until the blocks
part, so each record is joined about once and no key is hot; the subroot's path is where a group's
descent begins. At the leaf the path segments are reversed: the siblings from the leaf up.

Records are found by digest only, so blocks of equal content (a table of equal rows) are one record.
Where very many requests descend through one such record, AQE splits the join's partition.

Defined results: a null field is ``-``, any other its byte count, ``:`` and its text, so nulls, empty
texts and shifted borders differ; a null group is a group of its own; rows with a null id come
first; equal rows are leaves of their own, each with its own place; an empty table has no root and no
proofs. Only the named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.sinks import materialize

ARITY, STRIDE = 3, 4
BLOCK = ARITY ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
KEY = ["known", "name"]  # a group: is its name known (null first), and the name
STEP = "struct<place:int,others:array<string>>"


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as its byte count, ``:`` and text, or ``-``."""
    texts = [c.cast("string") for c in fields]
    return _sha(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with KEY) with ``r``, the place within the group by ``order`` from 0, and ``n``, the
    group's rows. Equal rows are told apart by where they were read, so a range border may cut them."""
    x = rows.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*KEY, *order, "_salt"]
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    x = materialize(x.withColumn("_at", F.monotonically_increasing_id()), name)
    x = x.withColumn("_part", F.shiftright("_at", 33))
    parts = x.groupBy(*KEY, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*KEY)
    before = F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"_before": F.coalesce(before, F.lit(0)), "n": F.sum("_c").over(group)})
    parts = materialize(parts.drop("_c"), f"{name}-parts")
    x = x.join(parts, [*KEY, "_part"])
    return x.withColumn("r", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_before", "_first")


def _up(nodes: Column) -> Column:
    """Digests of the runs of ``nodes``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: _sha(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), "")))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(known, name, r, n, digest, levels): the nodes STRIDE levels up, fewer where one node remains
    before; ``levels`` holds the children on each level below, the lowest first."""
    x = nodes.groupBy(*KEY, "n", F.floor(F.col("r") / BLOCK).alias("r")).agg(
        F.array_sort(F.collect_list(F.struct("r", "digest"))).alias("_x"))
    x = x.withColumn("_0", F.transform("_x", lambda s: s["digest"])).drop("_x")
    for k in range(STRIDE):
        x = x.withColumn(f"_{k + 1}", _up(F.col(f"_{k}")))
    height = F.lit(STRIDE)
    for k in range(STRIDE - 1, 0, -1):
        height = F.when(F.col("n") <= ARITY**k, F.lit(k)).otherwise(height)
    x = x.withColumn("_h", height)
    top = F.array(*[F.col(f"_{k + 1}")[0] for k in range(STRIDE)])
    levels = F.array(*[F.col(f"_{k}") for k in range(STRIDE)])
    return x.select(*KEY, "r", F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(top, F.col("_h")).alias("digest"),
                    F.slice(levels, 1, F.col("_h")).alias("levels"))


@dataclass(frozen=True)
class Tree:
    """Trees of all groups: ``tops`` (known, name, size, digest) and, per STRIDE levels, the written
    blocks whose (digest, levels) are the records."""

    tops: DataFrame
    blocks: list[DataFrame]


def _build(leaves: DataFrame, name: str) -> Tree:
    """leaves: (known, name, r, n, digest), written."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select(*KEY, "r", "n", "digest")
    tops = nodes.filter("n = 1").select(*KEY, "digest", F.lit(0).alias("depth"))
    blocks: list[DataFrame] = []
    while most > 1:
        b = materialize(_blocks(nodes.filter("n > 1")), f"{name}-records")
        blocks.append(b)
        nodes, most = b.select(*KEY, "r", "n", "digest"), -(-most // BLOCK)
        tops = tops.unionByName(nodes.filter("n = 1").select(*KEY, "digest", F.lit(len(blocks)).alias("depth")))
    return Tree(tops, blocks)


def _taken(levels: Column, at: Column) -> Column:
    """The steps from a block's top to its node number ``at``: on each level the digit of ``at``, which
    is the place of the child taken, and the children not taken."""
    width = F.array(*[F.lit(ARITY**k) for k in range(STRIDE + 1)])

    def step(i):
        chosen = F.floor(at / width[i])
        place = (chosen % ARITY).cast("int")
        run = F.slice(levels[i], (chosen - place + 1).cast("int"), ARITY)
        return F.struct(place.alias("place"), F.filter(run, lambda _, k: k != place).alias("others"))

    return F.transform(F.sequence(F.size(levels) - 1, F.lit(0), F.lit(-1)), step)


def _descend(tree: Tree, start: DataFrame, requests: DataFrame, carry: list[str]) -> DataFrame:
    """``requests`` (known, name, r, n, ...) with ``path``, the steps from the root to the leaf. start:
    (known, name, digest, depth, path, *carry), a row per group."""
    wanted = [requests]
    for _ in tree.blocks:
        x = wanted[-1].filter("n > 1").groupBy(*KEY, F.floor(F.col("r") / BLOCK).alias("r"), F.ceil(F.col("n") / BLOCK).alias("n"))
        wanted.append(x.agg(F.count(F.lit(1)).alias("_c")).drop("_c"))
    asked = None
    out = [*KEY, "path", *carry]
    for depth in range(len(tree.blocks), 0, -1):
        here = start.filter(F.col("depth") == depth).select(*out, F.lit(0).cast("long").alias("_b"), "digest")
        asked = here if asked is None else asked.select(*out, F.col("r").alias("_b"), "digest").unionByName(here)
        records = tree.blocks[depth - 1].groupBy("digest").agg(F.first("levels").alias("_levels"))
        state = asked.join(records, "digest").drop("digest")
        down = wanted[depth - 1].filter("n > 1").withColumn("_b", F.floor(F.col("r") / BLOCK)).join(state, [*KEY, "_b"])
        at = F.col("r") - F.col("_b") * BLOCK
        asked = down.withColumn("path", F.concat("path", _taken(F.col("_levels"), at)))
        if depth > 1:
            asked = asked.withColumn("digest", F.col("_levels")[0][at.cast("int")])
        asked = asked.drop("_levels", "_b")
    alone = requests.filter("n = 1").join(start.filter("depth = 0").select(*out), KEY)
    return alone if asked is None else asked.select(*alone.columns).unionByName(alone)


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (known, name, r, n, digest and the columns kept), the groups' trees, ``groups`` (the
    leaves of the upper tree) and the tree over them."""

    leaves: DataFrame
    trees: Tree
    groups: DataFrame
    upper: Tree

    @property
    def root(self) -> str | None:
        """The dataset's digest; null for an empty table."""
        row = self.upper.tops.select("digest").first()
        return row and row[0]


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
             keep: dict[str, Column] | None = None) -> Manifest:
    """Digest every row over ``fields`` and build the trees; ``keep`` names further columns of leaves."""
    name = F.col(group).cast("string")
    leaves = rows.select(name.isNotNull().alias("known"), F.coalesce(name, F.lit("")).alias("name"), F.col(order).alias("id"),
                         leaf_digest([F.col(f) for f in fields]).alias("digest"), *[c.alias(k) for k, c in (keep or {}).items()])
    leaves = _ranked(materialize(leaves, "merkle-rows"), ["id", "digest"], "merkle-leaves")
    trees = _build(leaves, "merkle")
    one = {"known": F.lit(False), "name": F.lit("")}  # the upper tree is one group
    tops = trees.tops.select(F.struct(*KEY).alias("_of"), "digest", "depth").withColumns(one)
    groups = _ranked(tops, ["_of"], "merkle-groups")
    return Manifest(leaves, trees, groups, _build(groups, "merkle-upper"))


def prove(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``requests`` (rows of ``m.leaves``; all by default) with ``subroot``, ``root`` and ``proof``: per
    level from the leaf up, the place in the run and the others' digests."""
    requests = m.leaves if requests is None else requests
    start = m.upper.tops.select(*KEY, "digest", "depth", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    groups = m.groups
    if requests is not m.leaves:  # groups without a request are left out
        groups = groups.join(requests.select(F.struct(*KEY).alias("_of")).distinct(), "_of", "left_semi")
    found = _descend(m.upper, start, groups.withColumnRenamed("digest", "subroot").withColumnRenamed("depth", "_depth"), ["root"])
    start = materialize(found.select("_of.*", F.col("_depth").alias("depth"), F.col("subroot").alias("digest"), "subroot", "root", "path"), "merkle-subroots")
    out = _descend(m.trees, start, requests.withColumnRenamed("digest", "leaf"), ["subroot", "root"])
    return out.withColumn("proof", F.reverse("path")).drop("path")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    def up(acc, s):
        left, right = F.slice(s["others"], 1, s["place"]), F.slice(s["others"], s["place"] + 1, ARITY)
        return _sha(F.concat(F.array_join(left, ""), acc, F.array_join(right, "")))

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, level by level."""
    return _sha(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""))


def audit(rows: DataFrame, altered: dict[str, Column], where: Column, fields: Sequence[str] = FIELDS,
          group: str = "source", order: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified): every row proved against the manifest,
    the rows of ``where`` (a null condition is none) with the fields of ``altered`` in place of theirs."""
    changed = leaf_digest([altered.get(f, F.col(f)) for f in fields])
    m = manifest(rows, fields, group, order, {"altered": F.when(where, changed)})
    x = prove(m).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return x.select("id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
