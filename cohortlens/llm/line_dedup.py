"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A line's key is the line without white space at both ends and with A-Z lower-cased; its hash
is 128 bits (two longs). Documents are dealt into batches. Each batch is reduced to (hash,
number of documents) inside the scan tasks, so a line that stands in a third of all documents
costs one row per task. A batch then meets the *runs*: tables of (hash, number of documents),
dealt by hash into the same buckets, each one sorted file. Keys that a run already holds as
frequent are settled; the batch, shuffled once by hash, is merge-anti-joined with every run and
the rest is written as a new level-0 run. When a level has ``fanout`` runs, they are merged, file
by file, into one sorted run of the next level: runs are never shuffled or sorted again. At the
end a merge of the remaining runs gives the keys found in at least ``min_docs`` documents.

Dropping: while the frequent keys number at most ``broadcast_keys`` (16 bytes each), they are
broadcast and each document is filtered where it is read, without a shuffle. Beyond that bound
the (document, line) hashes are joined with the frequent keys, and the documents with theirs.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code
points never count; rows count as documents even when a ``doc_id`` repeats or is null; a line
that repeats within a document counts once; an empty table gives an empty table; a text whose
lines all go becomes ''. Input columns ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm._text import SPACES, raw, slices, text_column, with_columns
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.sinks import delete, materialize

KEY = ["h1", "h2"]
_PAIR = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def line_keys(text: bytes) -> list[bytes]:
    """Keys of all lines of one text, in order (bytes.lower changes A-Z only)."""
    return [x.strip(SPACES) for x in text.lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _hashes(keys: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, keys)), dtype=_PAIR)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts as bytes, about 1 MB of them held at a time."""
    col = text_column(batch)
    for i, j in slices(raw(col)[1]):
        yield from col.slice(i, j - i).cast(pa.large_binary()).to_pylist()


def batch_counts(docs: DataFrame, n_batches: int, min_chars: int) -> DataFrame:
    """(batch, h1, h2, n_docs) with one row per key, batch and Arrow batch of the scan."""

    def count(batches):
        for b in batches:
            seen: list[Counter] = [Counter() for _ in range(n_batches)]
            for part, text in zip(b.column(0).to_pylist(), _texts(b)):
                seen[part].update({k for k in line_keys(text) if _long_enough(k, min_chars)})
            for part, keys in enumerate(seen):
                if keys:
                    h = _hashes(list(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), part, np.int32)), pa.array(h["h1"]), pa.array(h["h2"]),
                         pa.array(np.fromiter(keys.values(), np.int64, len(h)))],
                        names=["batch", "h1", "h2", "n_docs"])

    part = F.pmod(F.xxhash64("text"), F.lit(n_batches)).cast("int").alias("batch")
    return docs.select(part, "text").mapInArrow(count, "batch int, h1 long, h2 long, n_docs long")


class LineRuns:
    """The levelled runs: tables of (h1, h2, n_docs) in buckets by hash, one sorted file a bucket.

    All runs have the same buckets, as many as a shuffle has partitions, so a bucket of one run
    meets the same bucket of another, and a batch grouped by hash meets them all, by merge join
    without moving or sorting the runs again.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, max(2, fanout)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortlens-tables/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self._names: list[str] = []

    def _write(self, counts: DataFrame) -> str:
        """Name of a new run. Rows arrive dealt by hash, so each bucket is one task's file."""
        name = f"cohortlens_run_{uuid.uuid4().hex}"
        self._names.append(name)
        w = counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        with _sorted_scans(self.spark):
            w.option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two sorted runs merged into one, bucket by bucket."""
        left = self.spark.table(a).withColumnRenamed("n_docs", "_a")
        right = self.spark.table(b).withColumnRenamed("n_docs", "_b").hint("merge")
        n = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
        return left.join(right, KEY, "full").select(*KEY, n.alias("n_docs"))

    def _compact(self, runs: list[str]) -> str:
        """One run of several, two and two."""
        while len(runs) > 1:
            runs = runs[2:] + [self._write(self._merged(*runs[:2]))]
        return runs[0]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The batch by key, merge-anti-joined against the keys that a run holds as frequent."""
        new = counts.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"))
        for run in (r for level in self.levels for r in level):
            settled = self.spark.table(run).filter(F.col("n_docs") >= self.min_docs).select(*KEY)
            new = new.join(settled.hint("merge"), KEY, "left_anti")
        return new

    def add(self, counts: DataFrame) -> None:
        """Anti-join a batch with the runs, add its own run, and compact full levels."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.unsettled(counts)))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            merged = self._compact(self.levels[k])
            self.levels[k] = []
            if len(self.levels) == k + 1:
                self.levels.append([])
            self.levels[k + 1].append(merged)
            k += 1

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents over all batches added (at least one)."""
        last = self._compact([r for level in self.levels for r in level])
        return self.spark.table(last).filter(F.col("n_docs") >= self.min_docs).select(*KEY)

    def close(self) -> None:
        """Forget the runs and delete their files; nothing built on them may still be unwritten."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.root)


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While a run is planned and written: scans of one-file buckets keep the order of the file."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 4,
                   fanout: int = 2) -> DataFrame:
    """(h1, h2) of the line keys found in at least ``min_docs`` documents, as a written table."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    path = f"{runs.root}/batches"
    batch_counts(docs, n_batches, min_chars).write.partitionBy("batch").parquet(path)
    # the schema is given: an empty table has no files to read it from
    table = spark.read.schema("h1 long, h2 long, n_docs long, batch int").parquet(path)
    for k in range(n_batches):
        runs.add(table.filter(F.col("batch") == k).select(*KEY, "n_docs"))
    found = materialize(runs.frequent(), "frequent-lines")
    runs.close()
    return found


def _filtered(batch: pa.RecordBatch, drop_of, min_chars: int) -> pa.RecordBatch:
    """Drop lines; ``drop_of(row)`` is the set of 16-byte hashes that go from this row."""
    texts, lines, dropped = [], [], []
    digest = xxhash.xxh3_128_digest
    for row, text in enumerate(_texts(batch)):
        parts, drop = text.split(b"\n"), drop_of(row)
        kept = parts
        if drop:
            kept = [x for x, k in zip(parts, line_keys(text))
                    if not (digest(k) in drop and _long_enough(k, min_chars))]
        texts.append(b"\n".join(kept))
        lines.append(len(parts))
        dropped.append(len(parts) - len(kept))
    return with_columns(batch, {
        "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()),
        "n_dropped": pa.array(dropped, pa.int64())})


def _schema(docs: DataFrame, drop: tuple = ()) -> T.StructType:
    own = ("n_lines", "n_dropped")
    fields = [T.StructField(f.name, T.StringType()) if f.name == "text" else f
              for f in docs.schema.fields if f.name not in own + drop]
    return T.StructType(fields + [T.StructField(c, T.LongType()) for c in own])


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1,
               broadcast_keys: int = 262_144) -> DataFrame:
    """All columns of ``docs`` with the frequent lines gone from ``text``, plus ``n_lines``
    (before dropping) and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    few = frequent.limit(broadcast_keys + 1).toArrow()  # bounded: 16 bytes a key
    if few.num_rows <= broadcast_keys:
        h = np.empty(few.num_rows, dtype=_PAIR)
        for c in KEY:
            h[c] = few[c].to_numpy()
        keys = docs.sparkSession.sparkContext.broadcast(h.tobytes())

        def here(batches):
            data = keys.value
            drop = {data[i:i + 16] for i in range(0, len(data), 16)}
            for b in batches:
                yield _filtered(b, lambda row: drop, min_chars)

        return docs.mapInArrow(here, _schema(docs))
    return _drop_by_join(docs, frequent, min_chars)


def _drop_by_join(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """The way beyond the broadcast bound. A row is known by a hash of its text, since all
    rows of one text drop the same lines; the hot line's rows are split by the skew join."""

    def pairs(batches):
        for b in batches:
            for text in _texts(b):
                h = _hashes(list({k for k in line_keys(text) if _long_enough(k, min_chars)}))
                one = np.frombuffer(xxhash.xxh3_128_digest(text), _PAIR)[0]
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), one["h1"])), pa.array(np.full(len(h), one["h2"])),
                         pa.array(h["h1"]), pa.array(h["h2"])], names=["_t1", "_t2", "h1", "h2"])

    def keyed(batches):
        for b in batches:
            h = _hashes(list(_texts(b)))
            yield with_columns(b, {"_t1": pa.array(h["h1"]), "_t2": pa.array(h["h2"])})

    def apply(batches):
        for b in batches:
            gone = b.column(b.schema.get_field_index("_gone")).to_pylist()
            sets = [{np.array([(x["h1"], x["h2"])], _PAIR).tobytes() for x in g or ()} for g in gone]
            yield _filtered(b.drop_columns(["_t1", "_t2", "_gone"]), sets.__getitem__, min_chars)

    found = docs.select("text").mapInArrow(pairs, "_t1 long, _t2 long, h1 long, h2 long")
    gone = (found.join(frequent, KEY, "left_semi").groupBy("_t1", "_t2")
            .agg(F.collect_set(F.struct(*KEY)).alias("_gone")))
    keyed_schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in ("_t1", "_t2")])
    both = docs.mapInArrow(keyed, keyed_schema).join(gone, ["_t1", "_t2"], "left")
    return both.select(*docs.columns, "_t1", "_t2", "_gone").mapInArrow(apply, _schema(docs))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n_batches: int = 4,
                fanout: int = 2, broadcast_keys: int = 262_144) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents, everywhere."""
    frequent = frequent_lines(docs, min_docs, min_chars, n_batches, fanout)
    return drop_lines(docs, frequent, min_chars, broadcast_keys)
