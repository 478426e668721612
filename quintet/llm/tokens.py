"""Token-ID output: documents as token ids in rANS files, in ascending order of doc_id, and read back.

Texts are dealt to tasks by ranges of doc_id. A task encodes its documents
with the tokenizers library, one piece between spaces at a time, and keeps
the ids of pieces it has seen: no token of a byte-level BPE with this
pre-tokenizer reaches over a piece's edge.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.llm import rans
from quintet.llm.common import materialize, new_dir, partitions_for, put_file

END_ID = 2
#: Tokens of a file, about; and input bytes of a range.
FILE_TOKENS = 4 << 20
RANGE_BYTES = 8 << 20
#: Pieces whose ids a Python worker keeps, and the longest it keeps.
KEPT_PIECES = 700_000
KEPT_CHARS = 48
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

#: White space of the pre-tokenizer; Python's also has \x1c-\x1f.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: What a text of lines of words, with one space or line feed between any two, has not.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_UNEVEN_WIDE = (*"\x85\xa0\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000")
_PIECE = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer writes for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of ``prefix + piece`` as little-endian 32-bit numbers.

    Letters are one token of the pre-tokenizer, and punctuation after them another, so
    the model takes them as they are; all else goes through the whole tokenizer.
    """

    letters = str.maketrans(_byte_letters())

    def __init__(self, tokenizer, prefix: str, marks: _Pieces | None = None):
        self.tokenizer, self.model, self.prefix, self.marks, self.missed = tokenizer, tokenizer.model, prefix, marks, 0
        self.lead = prefix.translate(self.letters)

    def word(self, word: str) -> bytes:
        """Ids of letters by the model alone; ASCII letters are written as they are."""
        text = self.lead + word if word.isascii() else self.lead + word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(text)])
        return ids.tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if self.marks is not None and piece.isalpha():
            ids = self.word(piece)
        else:
            word = piece.rstrip(string.punctuation)
            if self.marks is None or len(word) == len(piece) or not word.isalpha():
                ids = np.array(self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                ids = self[word] + self.marks[piece[len(word) :]]
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.missed += 1
                if self.missed < KEPT_PIECES:
                    return ids
                self.clear()  # what was kept is no longer what comes
                self.missed = 0
            self[piece] = ids
        return ids


class Encoder:
    """The ids of whole texts by a tokenizer file of the tokenizers library, without special tokens around them.

    Texts are only cut in pieces for a byte-level BPE that neither normalises
    nor adds a space; other tokenizers get them whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        said = json.loads(tokenizer.to_str())
        before = said["pre_tokenizer"] or {}
        self.cuts = said["model"]["type"] == "BPE" and not said["normalizer"] and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.segments = _Pieces(tokenizer, "")
        self.first = _Pieces(tokenizer, "", self.segments)
        self.spaced = _Pieces(tokenizer, " ", self.segments)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return np.array(self.whole(text), "<u4").tobytes()
        if any(x in text for x in _UNEVEN) or not text.isascii() and any(x in text for x in _UNEVEN_WIDE):
            return b"".join(map(self.segments.__getitem__, _PIECE.findall(text)))
        spaced, out = self.spaced.__getitem__, []
        for line in text.split("\n"):
            first, *more = line.split(" ")
            out.append(self.first[first] + b"".join(map(spaced, more)))
        return self.segments["\n"].join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, as tasks of one worker meet the same pieces."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write ``*.rans`` files to a new folder of the shared store; returns it, and a table ``(name, part, n)`` of the files' tokens.

    Documents lie in ascending order of doc_id over the files in order of
    name, null ids first, ties by a hash of the text; each ends with ``end_id``.
    A null text is empty; rows that repeat an id are documents each. ``path`` is the tokenizer's file, which every worker
    can read. Other columns are not read. An empty table gives a file without documents.
    """
    path = path or default_path()
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    n = partitions_for(docs, range_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, k = TaskContext.get().partitionId(), encoder(path), 0
        ids: list = []
        counts: list[int] = []
        held: list[bytes] = []
        size = 0
        names: list[str] = []
        sizes: list[int] = []

        def flush() -> None:
            nonlocal k, size
            name = f"part-{part:07d}-{k:04d}.rans"
            put_file(folder, name, rans.encode(np.frombuffer(b"".join(held), "<u4"), ids, counts))
            names.append(name)
            sizes.append(size)
            k, size = k + 1, 0
            for x in (ids, counts, held):
                x.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = encode(text.as_py()) + end
                ids.append(doc_id)
                counts.append(len(data) // 4)
                held.append(data)
                size += counts[-1]
                if size >= FILE_TOKENS:
                    flush()
        if ids:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([part] * len(names), pa.int64()), pa.array(sizes, pa.int64())], ["name", "part", "n"])

    files = materialize(rows.mapInArrow(run, "name string, part long, n long"), "files")
    if files.isEmpty():
        put_file(folder, "part-none.rans", rans.encode(np.zeros(0, np.uint32), [], []))
    return folder, files


def tokens_before(files: DataFrame, run: int = 1000) -> DataFrame:
    """``(name, before)``: the tokens of all files before each, in order of name, by sums of runs of parts and sums within a run."""
    block = F.floor(F.col("part") / run)
    per = files.groupBy(block.alias("b")).agg(F.sum("n").alias("n"))  # a row for each thousand tasks
    earlier = per.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.coalesce(F.sum("n").over(W.partitionBy("b").orderBy("name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("b", block).withColumn("own", own).join(earlier, "b").select("name", (F.col("earlier") + F.col("own")).alias("before"))


def read_tokens(spark, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the documents of a folder's files, and their ``ids`` if asked for.

    ``files`` is the table that ``write_tokens`` returns. Documents come one by one, repeated ids and null ids too; a file
    without documents, as of an empty table, gives none. Raises ValueError where a checksum differs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file = rans.File(content.as_buffer())
                tokens = file.decode().astype("<u4")
                ends = np.cumsum(file.doc_tokens.astype(np.int64))
                starts = ends - file.doc_tokens.astype(np.int64)
                raw = memoryview(tokens.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array([name] * len(crcs), pa.string()), pa.array(file.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["name", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(folder)
    found = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    start = (F.col("before") + F.col("within")).alias("start")
    return found.join(tokens_before(files), "name").select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
