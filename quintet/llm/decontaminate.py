"""Benchmark decontamination: passages of benchmark items in documents, by an FM-index of each shard of documents.

A shard's words are numbered and indexed once. The windows of the items, block by block, are its phrases: those whose words the
shard all has are searched for backwards at once; the found ranges are located by sampled suffix
positions, and the words they cover merge to removal spans. Items lie in the shared folder, where tasks
read them; a worker holds one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quintet.llm.common import ASCII_LOWER, by_bytes, new_dir, store
from quintet.llm.fmindex import FMIndex

WINDOW = 13
#: One word of a document in so many must be hit for it to be contaminated.
ONE_IN = 20
#: Symbols that one index holds; documents go on in the next with an overlap.
SHARD = 1 << 20
#: Text of the items that are searched for at once; more items come in further blocks.
BLOCK_BYTES = 8 << 20

_WORD = bytes(ASCII_LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.translate(_WORD).split() if text else []


class Phrases:
    """Distinct windows of a block of items, with the items of each; rows of ``patterns`` are right-aligned numbers of words, from 1."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [symbols.setdefault(w, len(symbols) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.words = list(symbols)
        self.items = [sorted(x for x in v if x is not None) for v in windows.values()]
        self.lengths = np.array([len(k) for k in windows], np.int64)
        longest = int(self.lengths.max()) if windows else 0
        self.patterns = np.zeros((len(windows), longest), np.int64)
        for row, k in zip(self.patterns, windows, strict=True):
            row[longest - len(k) :] = k


class Shard:
    """Texts laid end to end as numbers of their words, from 2, with a 1 after each."""

    def __init__(self, texts: list[bytes | None]):
        self.numbers: defaultdict[bytes, int] = defaultdict(count(2).__next__)
        parts = []
        for t in texts:
            ws = words(t)
            parts.append(np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws)))
        self.counts = [len(x) for x in parts]
        self.starts = np.concatenate(([0], np.cumsum(np.array(self.counts, np.int64) + 1)))
        self.whole = np.ones(int(self.starts[-1]), np.int64)
        for a, x in zip(self.starts.tolist(), parts, strict=False):
            self.whole[a : a + len(x)] = x
        self.sigma = len(self.numbers) + 1
        self.numbers.default_factory = None

    def find(self, blocks: Callable[[], Iterator[Phrases]], window: int) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray]]:
        """``(block, phrase, place)`` of all occurrences; a text longer than an index goes on in the next, with an overlap."""
        for a in range(0, len(self.whole), SHARD):
            index = None
            for p in blocks():
                mine = np.array([0, *(self.numbers.get(w, 0) for w in p.words)], np.int64)[p.patterns]
                had = np.flatnonzero((mine > 0).sum(1) == p.lengths)
                if not len(had):
                    continue
                if index is None:
                    index = FMIndex(self.whole[a : a + SHARD + window - 1], self.sigma)
                low, high = index.search(mine[had], p.lengths[had])
                some = np.flatnonzero(high > low)
                which, at = index.locate(low[some], high[some])
                if len(at):
                    yield p, had[some[which]], at + a


def search(texts: list[bytes | None], blocks: list[Phrases] | Callable[[], Iterator[Phrases]], window: int = WINDOW) -> list[tuple[int, int, list, list[tuple[int, int]]]]:
    """For each text: words, words hit, items found, and spans of hit words."""
    shard = Shard(texts)
    items: dict[int, set] = defaultdict(set)
    hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for p, phrase, at in shard.find(blocks if callable(blocks) else blocks.__iter__, window):
        by = np.argsort(at, kind="stable")
        phrase, at = phrase[by], at[by]
        doc = np.searchsorted(shard.starts, at, side="right") - 1
        cut = np.flatnonzero(np.diff(doc, prepend=-1, append=len(texts) + 1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            d = int(doc[a])
            first = at[a:b] - shard.starts[d]
            hits[d].append((first, first + p.lengths[phrase[a:b]]))
            for k in np.unique(phrase[a:b]).tolist():
                items[d].update(p.items[k])
    out = []
    for d, n in enumerate(shard.counts):
        spans: list[tuple[int, int]] = []
        if d in hits:
            begin, end = (np.concatenate(x) for x in zip(*hits[d], strict=True))
            by = np.argsort(begin, kind="stable")
            begin, end = begin[by], np.maximum.accumulate(end[by])
            fresh = np.concatenate(([True], begin[1:] > end[:-1]))
            last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(end) - 1]))
            spans = list(zip(begin[fresh].tolist(), end[last].tolist(), strict=True))
        out.append((n, sum(b - a for a, b in spans), sorted(items[d]) if d in items else [], spans))
    return out


#: The block of a folder of items that has only one, kept by a worker for its next tasks.
_one: dict[tuple, Phrases] = {}


def _written(benchmark: DataFrame, window: int, block_bytes: int, item_col: str, text_col: str) -> Callable[[], Iterator[Phrases]]:
    """Write the items to the shared folder; returns a function that reads them there, a block of so many bytes of text after another."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    path = new_dir(benchmark.sparkSession, "items")
    rows.write.parquet(path)

    def blocks() -> Iterator[Phrases]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        from quintet.llm import decontaminate

        key = (path, window, block_bytes)
        if key in decontaminate._one:
            yield decontaminate._one[key]
            return
        system, folder = store(path)
        held, size, n = [], 0, 0
        for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")):
            with system.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(1000):
                    for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        held.append((item, text))
                        size += len(text or b"")
                        if size >= block_bytes:
                            yield Phrases(held, window)
                            held, size, n = [], 0, n + 1
        last = Phrases(held, window)
        if n == 0:
            decontaminate._one.clear()
            decontaminate._one[key] = last
        yield last

    return blocks


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together that make about one index."""
    held, size = [], 0
    for b in by_bytes(batches):
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= 6 * SHARD:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` for every row of ``docs``.

    A phrase is ``window`` consecutive words of an item, or all words of a
    shorter one. ``items`` are the ids, of their own type, with a phrase in the document,
    ``spans`` the runs of words, from start up to stop, that phrases cover. Null
    texts have no words; an item without words has no phrase; an item of null id hits words but
    is not listed. Each row is judged on its own, repeated ones alike. The
    items come in blocks of ``block_bytes`` of text, and a shard's
    task holds one block at a time. Other columns are not read. Empty tables of documents or items are fine.
    """
    blocks = _written(benchmark, window, block_bytes, item_col, item_text_col)
    item = benchmark.schema[item_col].dataType
    kinds = pa.list_(to_arrow_type(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            n, hit, items, spans = zip(*search(t.column(1).to_pylist(), blocks, window), strict=True)
            arrays = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, kinds), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), *arrays], ["doc_id", "n_words", "n_hit", "items", "spans"])

    schema = f"doc_id long, n_words long, n_hit long, items array<{item.simpleString()}>, spans array<struct<start:int,stop:int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body")).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all its columns, of which phrases hit less than one word in ``one_in``, or none.

    Rows are judged one by one, so rows that repeat an id are kept or dropped each by its text; null and empty texts are
    kept, as they have no words. Without items all rows are kept.
    """
    blocks = _written(benchmark, window, block_bytes, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            found = search(t.column(at).cast(pa.binary()).to_pylist(), blocks, window)
            yield from t.filter(pa.array([not hit or one_in * hit < n for n, hit, _, _ in found])).to_batches()

    return docs.mapInArrow(run, docs.schema)


def contaminated(one_in: int = ONE_IN):
    return (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans' words and what lies between them."""
    data = text.encode("utf-8", "surrogatepass")
    spaced = np.frombuffer(data.translate(_WORD), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], spaced.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def items_sha256(items):
    """Digest of the ids as strings, sorted and joined by commas; of the empty string if there are none."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


#: DuckDB SQL of the digest columns.
DECONTAMINATE_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
b AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(items, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
