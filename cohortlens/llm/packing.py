"""Best-fit packing by the sum-of-squares rule.

A document is its token ids, then one end id. Only longer documents are cut, into pieces of
``size`` tokens; the last piece may be shorter. A full piece is a sequence of its own. Every
other piece goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number
of open sequences with g free places; a new sequence is one of the choices, ties go to the
smaller gap. Pieces are taken longest first.

Tokenizing runs where the documents are read: words between white space are tokenized once
per worker and kept in a bounded table, as no token crosses white space. Only piece lengths
are shuffled: pieces are dealt by hash and row number into groups of about ``group_rows`` (a long
document's pieces and equal rows spread over the groups), each packed on its own, so the work
grows linearly.

Defined results: a null or empty text is the end id alone; an empty table gives no pieces;
rows that share a ``doc_id`` are separate documents; equal documents take separate places;
a null ``doc_id`` stays null.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm._text import raw, slices, text_column
from cohortlens.sources.sinks import materialize

SIZE = 2048
END_ID = 0
# White space of Python's split() that the tokenizer's \s need not share: such texts go whole.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
# Letters that NFC and lower-casing treat one by one, then ASCII marks without the apostrophe:
# the tokenizer's pattern cuts such a word into its letters and its marks.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")
_KEPT_WORDS = 400_000
_loaded: dict[str, "WordTokenizer"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest count up from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _Words(dict):
    """word -> ids as little-endian uint32 bytes, tokenized when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.parts: dict[str, bytes] = {}
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            tokens = self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
            ids = self.parts[part] = array("I", [t.id for t in tokens]).tobytes()
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            ids = self.whole(word)
        else:
            ids = b"".join(self._part(x) for x in (plain[1].lower(), plain[2]) if x)
        self[word] = ids
        return ids


class WordTokenizer:
    """ids of whole texts as little-endian uint32 bytes, with a bounded table of known words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) + len(self.words.parts) > _KEPT_WORDS:
            self.words.clear()
            self.words.parts.clear()
        ids = self.words.__getitem__
        return [self.words.whole(t) if _ODD.search(t) or any(s in t for s in self.special) else b"".join(map(ids, t.split())) for t in texts]


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _ids(path: str, texts: list[str]) -> list[bytes]:
    end = np.array([END_ID], dtype="<u4").tobytes()
    return [x + end for x in word_tokenizer(path).encode(texts)]


def _batches_of_texts(col: pa.Array):
    """(first row, texts) of slices of about 1 MB, so that ids of few documents are held at once."""
    _, off = raw(col)
    for i, j in slices(off):
        yield i, col.slice(i, j - i).to_pylist()


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece of every document."""

    def cut(batches):
        for b in batches:
            for at, texts in _batches_of_texts(text_column(b, "text")):
                doc, piece, length, crc = [], [], [], []
                for k, ids in enumerate(_ids(tokenizer_path, texts)):
                    for p, i in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[i:i + 4 * size]
                        doc.append(at + k)
                        piece.append(p)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                piece = np.array(piece, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * size),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order. Full lengths get bins of their own."""
    n = len(lengths)
    place, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by gap
    count = np.zeros(size + 1, dtype=np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        gap = -1
        if s < size:
            # change of the sum of squares when a bin of gap g becomes one of gap g - s
            change = 1 - 2 * count[s:]
            change[1:] += 2 * count[1:size + 1 - s] + 1
            change[-1] = 2 * count[size - s] + 1  # gap ``size``: a new bin
            change[:-1][count[s:size] == 0] = np.iinfo(np.int64).max
            gap = s + int(change.argmin())
        if gap < 0 or gap == size:
            b, gap = used, size
            used += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        place[i], offset[i] = b, size - gap
        if rest := gap - s:
            open_bins[rest].append(b)
            count[rest] += 1
    return place, offset


def place(cut: DataFrame, size: int = SIZE, group_rows: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``; groups of about ``group_rows``."""
    cut = materialize(cut, "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    schema = T.StructType([f for f in cut.schema.fields] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])

    def pack(key, pdf):
        order = [c for c in ("length", "doc_id", "piece") if c in pdf]
        pdf = pdf.sort_values(order, ascending=[False] + [True] * (len(order) - 1), kind="stable")
        b, off = sum_of_squares(pdf["length"].to_numpy(), size)
        return pdf.assign(sequence_id=b + (int(key[0]) << 32), offset=off).drop(columns="_group")

    # the row number of the written table spreads equal rows too
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return cut.withColumn("_group", group).groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id",
                   text: str = "text", group_rows: int = 100_000) -> DataFrame:
    """One row per piece: where it stands in which sequence (no ids; see ``sequences``)."""
    return place(pieces(docs, tokenizer_path, size, id_col, text), size, group_rows)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, size: int = SIZE,
              id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed token ids. Needs ``doc_id`` to be unique."""

    def fill(batches):
        for b in batches:
            got: dict[str, list] = {"sequence_id": [], "offset": [], "part": []}
            texts = text_column(b, "_text").cast(pa.string()).to_pylist()
            seq, off, start, n = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("sequence_id", "offset", "start", "length"))
            for k, t in enumerate(texts):
                ids = np.frombuffer(_ids(tokenizer_path, [t])[0], dtype="<u4")
                got["sequence_id"].append(seq[k])
                got["offset"].append(off[k])
                got["part"].append(ids[start[k]:start[k] + n[k]].astype(np.int32))
            yield pa.RecordBatch.from_pydict(got, schema=pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.list_(pa.int32()))]))

    both = placed.join(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    parts = both.mapInArrow(fill, "sequence_id long, offset long, part array<int>")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])
    return parts.groupBy("sequence_id").agg(F.flatten(whole).alias("ids"))
