"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has the sign bits of a vector. Each shard of codes is indexed once, by the
values of its segments. For a block of queries, buckets are probed in order of
the radius within a segment, one segment after another. When segments up to j
are probed to radius r and the others to r - 1, all codes within
``m * r + j`` bits are found (m segments, j from 0), so a query is done when its
kth verified distance is no more than that. What a query finds in a sample of the codes bounds its kth distance from the start, so
a shard is probed no further, and returns only what may be among the k best. The best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.llm.common import materialize, new_dir, store

K = 10
EVERY = 50
#: Queries searched for at once, codes of a shard and of the sample that bounds distances, and candidates verified at once.
QUERY_BLOCK = 16_384
SHARD_CODES = 1 << 20
SAMPLE_CODES = 1 << 17
CANDIDATES = 1 << 20


def sign_codes(vectors: DataFrame, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, code)``: a bit for each of the first ``bits`` values, set if it is above 0, in whole bytes.

    Missing values, nulls and NaN give 0; rows with a null id or vector have no code and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.minimum(np.asarray(lists.value_lengths()), bits)
            starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            above = np.asarray(lists.flatten().to_numpy(zero_copy_only=False)) > 0
            out = np.zeros((len(lists), bits), bool)
            row = np.repeat(np.arange(len(lists)), sizes)
            col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[row, col] = above[starts[row] + col]
            data = np.packbits(out, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in data], pa.binary())], ["vec_id", "code"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(run, "vec_id long, code binary")


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    n, width = codes.shape
    out = np.zeros((n, -(-width // 8) * 8), np.uint8)
    out[:, :width] = codes
    return out.view(np.uint64)


class MultiIndex:
    """The segments of a shard's codes (rows of bytes), and the search over them."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.ids, self.n = ids, len(codes)
        bits = 8 * codes.shape[1]
        width = int(min(16, max(4, np.log2(max(2, self.n)))))
        self.m = -(-bits // width)
        self.edges = [round(bits * j / self.m) for j in range(self.m + 1)]
        self.codes = _words(codes)
        self.order, self.starts = [], []
        for j, value in enumerate(self.segments(codes)):
            self.order.append(np.argsort(value, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << (self.edges[j + 1] - self.edges[j]))))))

    def segments(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.unpackbits(codes, axis=1).astype(np.int64)
        for a, b in zip(self.edges, self.edges[1:], strict=False):
            yield bits[:, a:b] @ (1 << np.arange(b - a)[::-1])

    def search(self, queries: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, distance, id)`` of the k nearest of each query, ties by id; only those at a distance of at most ``most``, if given."""
        q_words, q_segments = _words(queries), list(self.segments(queries))
        far = 8 * queries.shape[1] + 1
        best_d = np.full((len(queries), k), far, np.int32)
        best_row = np.full((len(queries), k), -1, np.int64)
        if most is not None:
            best_d[:] = most[:, None]
        active = np.arange(len(queries)) if self.n else np.zeros(0, np.int64)
        widest = max(b - a for a, b in zip(self.edges, self.edges[1:], strict=False))
        for r in range(widest + 1):
            for j in range(self.m):
                size = self.edges[j + 1] - self.edges[j]
                if r <= size:
                    masks = np.array([sum(1 << b for b in c) for c in combinations(range(size), r)], np.int64)
                    at_once = max(1, CANDIDATES // len(masks))
                    for a in range(0, len(active), at_once):
                        self._probe(j, masks, active[a : a + at_once], q_segments[j], q_words, best_d, best_row)
                last = best_d[active, -1]
                found = (best_row[active] >= 0).sum(1)
                active = active[(last > self.m * r + j) & (found < self.n)]
                if not len(active):
                    break
            if not len(active):
                break
        q, c = np.nonzero(best_row >= 0)
        return q, best_d[q, c], self.ids[best_row[q, c]]

    def _probe(self, j, masks, active, q_segment, q_words, best_d, best_row) -> None:
        """Verify the buckets of one segment at one radius, and merge them with the best so far."""
        value = q_segment[active][:, None] ^ masks
        lo, hi = self.starts[j][value].ravel(), self.starts[j][value + 1].ravel()
        count = hi - lo
        owner = np.repeat(active, len(masks))
        ends = np.cumsum(count)
        a = 0
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CANDIDATES, side="right")))
            n, before = count[a:b], ends[a:b] - count[a:b]
            which = np.repeat(np.arange(a, b), n)
            place = lo[which] + np.arange(len(which)) + (ends[a - 1] if a else 0) - np.repeat(before, n)
            row, q = self.order[j][place], owner[which]
            d = np.bitwise_count(q_words[q] ^ self.codes[row]).sum(1).astype(np.int32)
            near = d <= best_d[q, -1]
            self._merge(q[near], d[near], row[near], best_d, best_row)
            a = b

    def _merge(self, q, d, row, best_d, best_row) -> None:
        if not len(q):
            return
        k = best_d.shape[1]
        own = np.unique(q)
        old_q, old_c = np.nonzero(best_row[own] >= 0)
        q, d, row = np.concatenate((q, own[old_q])), np.concatenate((d, best_d[own[old_q], old_c])), np.concatenate((row, best_row[own[old_q], old_c]))
        by = np.lexsort((row, self.ids[row], d, q))
        q, d, row = q[by], d[by], row[by]
        once = np.concatenate(([True], (q[1:] != q[:-1]) | (row[1:] != row[:-1])))
        q, d, row = q[once], d[once], row[once]
        first = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - first
        top = rank < k
        best_d[q[top], rank[top]], best_row[q[top], rank[top]] = d[top], row[top]


def _held(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches together that have so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, bits: int = 64, query_block: int = QUERY_BLOCK, sample: int = SAMPLE_CODES, shard: int = SHARD_CODES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the k codes nearest to each query, itself included, ties by vec_id.

    Queries are the rows whose id is divisible by ``every``; one for each
    distinct id and code. They lie in the shared folder, and each shard's task reads them in blocks, against its one index. The
    sample that bounds distances, about ``sample`` codes of least hash and twice that at most, is the only thing sent out. Repeated rows are
    neighbours each. With fewer than k codes all are returned; an empty table
    gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    codes = materialize(sign_codes(vectors, bits, id_col, vector_col), "codes")
    n = codes.count()
    near = codes if n <= sample else codes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n)).limit(2 * sample)
    t = near.toArrow()
    sent = spark.sparkContext.broadcast((_codes(t.column(1)) if t.num_rows else np.zeros((0, -(-bits // 8)), np.uint8), t.column(0).to_numpy()))
    path = new_dir(spark, "queries")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(*sent.value)
        for t in _held(batches, query_block):
            for a in range(0, t.num_rows, query_block):
                part = t.slice(a, query_block)
                q, d, _ = index.search(_codes(part.column(1)), k)
                count, last = np.bincount(q, minlength=part.num_rows), np.zeros(part.num_rows, np.int32)
                np.maximum.at(last, q, d)
                most = np.where(count == k, last, bits + 8)  # a sample with fewer than k codes bounds nothing
                yield pa.RecordBatch.from_arrays([part.column(0).combine_chunks(), part.column(1).combine_chunks(), pa.array(most.astype(np.int32))], ["query_id", "q", "most"])

    asked = codes.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    asked.mapInArrow(bound, "query_id long, q binary, most int").write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, folder = store(path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))
        for t in _held(batches, shard):
            index = MultiIndex(_codes(t.column(1)), t.column(0).to_numpy())
            for name in files:
                with system.open_input_file(name) as f:
                    for b in pq.ParquetFile(f).iter_batches(query_block):
                        ids, own, most = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
                        q, d, found = index.search(_codes(own), k, most)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), own.take(pa.array(q)).cast(pa.binary()), pa.array(d, pa.int32()), pa.array(found, pa.int64())], ["query_id", "q", "distance", "vec_id"])

    found = materialize(codes.mapInArrow(run, "query_id long, q binary, distance int, vec_id long"), "nearest")
    order = W.partitionBy("query_id", "q").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")


#: DuckDB SQL of ``top_k`` with its defaults.
TOP_K_SQL = """
WITH c AS (
  SELECT vec_id, list_aggregate([CASE WHEN x > 0 THEN '1' ELSE '0' END for x in embedding], 'string_agg', '')::BIT AS code
  FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM c AS q, c WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
WHERE rank <= 10
"""
