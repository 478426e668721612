"""k nearest references of each query, in three plans with one result.

``broadcast``: references up to a checked size are packed once and sent to the
executors; queries stream past them without a shuffle. ``chunked``: beyond that, references lie in
cells of bounded size with boxes (an index, made here if there is none); a query goes to the
nearest cell of its partition for a bound, then only to cells whose box the bound reaches.
``exact``: a plain join, for small inputs and as the yardstick. Ties go to the smaller ref_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.functions.features import Q, distance
from quintet.functions.responses import K, frauds_of
from quintet.operators.kernel import LEAF_ROWS, Blocks, box_bounds
from quintet.sources.scratch import kept, scratch_dir

#: Packed references that are sent to executors whole at most: 60 bytes a row of 14 values, so about 2.8 million.
BROADCAST_BYTES = 160 << 20
#: Cells whose boxes are sent to executors at most; a cell has this many references or more where there would be more cells.
CELLS = 200_000
CELL_ROWS = 50_000
#: A cell's number is its owner's, and below that so many bits of a node's.
NODE_BITS = 44
BATCH = 4_000
#: Queries of a cell that one task searches for; more go to several tasks, each with the cell's references.
CELL_QUERIES = 200_000
#: Numbers that bounds of a batch to all boxes may have at once.
BOUNDS = 4 << 20
#: Requests of fewer bytes, by Catalyst's estimate, may lie in few partitions and are spread over all cores.
SPREAD_BYTES = 1 << 30
NEIGHBOURS = "qid long, rn int, ref_id long, distance long, label int"


def rows_to_send(columns: int = len(Q)) -> int:
    return BROADCAST_BYTES // (2 * columns + 32)


def _matrix(t: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in names], axis=1) if t.num_rows else np.zeros((0, len(names)), np.int16)


def pack(refs: DataFrame, columns: list[str] = Q) -> Blocks:
    """The references as blocks on the driver, by their leaves if they have a column of that name; raises ValueError for too many."""
    leaf = [c for c in ("leaf", "part") if c in refs.columns]
    block = F.xxhash64("part", "leaf") if leaf[:1] == ["leaf"] else F.col(leaf[0]).cast("long") if leaf else F.lit(0).cast("long")
    most = rows_to_send(len(columns))
    t = refs.select("ref_id", "label", block.alias("block"), *columns).limit(most + 1).toArrow()
    if t.num_rows > most:
        raise ValueError(f"over {most} references to send out")
    return Blocks(t.column("ref_id").to_numpy(), _matrix(t, columns), t.column("label").to_numpy(), t.column("block").to_numpy(), t.num_rows if "leaf" in leaf else LEAF_ROWS)


def _rows(blocks: Blocks, qid: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    d, row = blocks.nearest(queries, k)
    at, rn = np.nonzero(row >= 0)
    r = row[at, rn]
    ref = blocks.ref_id[r] if len(r) else np.zeros(0, np.int64)
    label = blocks.label[r] if len(r) else np.zeros(0, np.int64)
    arrays = [pa.array(qid[at], pa.int64()), pa.array((rn + 1).astype(np.int32)), pa.array(ref, pa.int64()), pa.array(d[at, rn], pa.int64()), pa.array(label.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, ["qid", "rn", "ref_id", "distance", "label"])


def spread(rows: DataFrame) -> DataFrame:
    """Small tables over all cores."""
    if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SPREAD_BYTES:
        return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows


def search_packed(queries: DataFrame, sent, k: int = K, columns: list[str] = Q) -> DataFrame:
    """Neighbours by blocks that have been sent out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                s = b.slice(a, BATCH)
                yield _rows(sent.value, s.column("qid").to_numpy(), _matrix(s, columns), k)

    return spread(queries.select("qid", *columns)).mapInArrow(run, NEIGHBOURS)


def broadcast_neighbours(queries: DataFrame, refs: DataFrame, k: int = K, columns: list[str] = Q) -> DataFrame:
    return search_packed(queries, queries.sparkSession.sparkContext.broadcast(pack(refs, columns)), k, columns)


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy("distance", "ref_id")
    return found.withColumn("rn", F.row_number().over(order).cast("int")).where(F.col("rn") <= k).select("qid", "rn", "ref_id", "distance", "label")


def exact_neighbours(queries: DataFrame, refs: DataFrame, k: int = K) -> DataFrame:
    """All distances by a nested loop, then the best of each query: quadratic, for small inputs."""
    pairs = queries.alias("a").crossJoin(refs.select("ref_id", "label", *Q).alias("b"))
    return best(pairs.select("a.qid", "b.ref_id", distance("a", "b").alias("distance"), F.col("b.label").cast("int").alias("label")), k)


def boxes(refs: DataFrame, *keys: str) -> DataFrame:
    """``(keys, n, lo0.., hi0..)``: bounds of the references by keys."""
    both = [f(q).alias(f"{n}{i}") for i, q in enumerate(Q) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return refs.groupBy(*keys).agg(F.count("*").alias("n"), *both)


class Cells:
    """The boxes of cells as arrays, to choose by: cell, owner (partition or cluster), rows, low and high."""

    def __init__(self, table: DataFrame, owner: str):
        t = table.select("cell", owner, "n", *(f"{n}{i}" for n in ("lo", "hi") for i in range(len(Q)))).limit(CELLS + 1).toArrow()
        if t.num_rows > CELLS:
            raise ValueError(f"over {CELLS} cells")
        order = np.argsort(t.column("cell").to_numpy(), kind="stable")
        self.cell, self.owner, self.rows = (t.column(c).to_numpy()[order] for c in ("cell", owner, "n"))
        self.low, self.high = (_matrix(t, [f"{n}{i}" for i in range(len(Q))])[order] for n in ("lo", "hi"))

    def merged(self, most: int) -> tuple[Cells, np.ndarray]:
        """Cells of a forest, those under one node made one if they have at most ``most`` rows, and the new cell of each."""
        node, to = self.cell & ((1 << NODE_BITS) - 1), self.cell.copy()
        for up in range(1, NODE_BITS):
            above = self.cell - node + (node >> up)
            names, at = np.unique(above, return_inverse=True)
            small = (node >> up > 0) & (np.bincount(at, self.rows, len(names))[at] <= most)
            if not small.any():
                break
            to[small] = above[small]
        out = Cells.__new__(Cells)
        by = np.argsort(to, kind="stable")
        out.cell, start = np.unique(to[by], return_index=True)
        out.owner = self.owner[by][start]
        out.rows = np.add.reduceat(self.rows[by], start) if len(by) else self.rows
        out.low = np.minimum.reduceat(self.low[by], start) if len(by) else self.low
        out.high = np.maximum.reduceat(self.high[by], start) if len(by) else self.high
        return out, to


#: Which cells a batch of queries goes to: of (batch, vectors, bounds to the cells, cells) a mask of queries by cells.
Choice = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, Cells], np.ndarray]


def go(queries: DataFrame, sent, choose: Choice) -> DataFrame:
    """``(qid, cell, q0..q13)``: a row for each cell that a query is to be searched in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        step = max(1, min(BATCH, BOUNDS // max(1, len(cells.cell))))
        for b in batches:
            for a in range(0, b.num_rows, step):
                s = b.slice(a, step)
                x = _matrix(s, Q)
                at, cell = np.nonzero(choose(s, x, box_bounds(x, cells.low, cells.high), cells))
                yield pa.RecordBatch.from_arrays([pa.array(s.column("qid").to_numpy()[at]), pa.array(cells.cell[cell], pa.int64()), *(pa.array(x[at, i].astype(np.int16)) for i in range(len(Q)))], ["qid", "cell", *Q])

    return spread(queries).mapInArrow(run, "qid long, cell long, " + ", ".join(f"{q} smallint" for q in Q))


def nearest_cell(batch: pa.RecordBatch, x: np.ndarray, bound: np.ndarray, cells: Cells) -> np.ndarray:
    """The nearest cell of a query's own partition, of any if that has none."""
    own = batch.column("part").to_numpy()[:, None] == cells.owner
    bound = np.where(own, bound, bound + (np.int64(1) << 40))
    return (np.arange(len(cells.cell)) == bound.argmin(1)[:, None]) if len(cells.cell) else np.zeros((len(x), 0), bool)


def other_cells(batch: pa.RecordBatch, x: np.ndarray, bound: np.ndarray, cells: Cells) -> np.ndarray:
    """Cells within a query's bound but the one that it has been searched in."""
    return (bound <= batch.column("d").to_numpy()[:, None]) & ~nearest_cell(batch, x, bound, cells)


def search_cells(wanted: DataFrame, refs: DataFrame, k: int, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The best of each (query, cell): rows of a cell meet in one task, references first, queries in batches.

    Queries that crowd a cell are dealt to several tasks, each with that cell's references.
    """
    spark = refs.sparkSession
    wanted = kept(wanted, "wanted")
    # A cell's rows have one owner. Four leaves of a node are one block, as few boxes are compared sooner.
    leaf = F.shiftright("leaf", 2) if "leaf" in refs.columns else F.lit(0).cast("long")
    leaves = LEAF_ROWS if "leaf" not in refs.columns else 1 << 40
    r = refs.select("cell", F.lit(0).alias("slice"), F.lit(0).alias("kind"), F.col("ref_id").alias("id"), F.col("label").cast("int").alias("label"), leaf.alias("leaf"), *Q)
    q = wanted.select("cell", F.lit(0).alias("slice"), F.lit(1).alias("kind"), F.col("qid").alias("id"), F.lit(0).alias("label"), F.lit(0).cast("long").alias("leaf"), *Q)
    sizes = wanted.groupBy("cell").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > cell_queries).select("cell", F.ceil(F.col("n") / cell_queries).cast("int").alias("s"))
    r = r.join(sizes.select("cell"), "cell", "left_semi")
    if not crowded.isEmpty():
        s = F.coalesce("s", F.lit(1))
        r = r.join(crowded, "cell", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), s - 1))).select(*q.columns)
        q = q.join(crowded, "cell", "left").withColumn("slice", F.pmod(F.xxhash64("id"), s).cast("int")).select(*q.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks = None, [], None
        for b in batches:
            key, part, kind = (b.column(c).to_numpy() for c in ("cell", "slice", "kind"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if a == e:
                    continue
                if (key[a], part[a]) != now:
                    now, held, blocks = (key[a], part[a]), [], None
                rows = b.slice(a, e - a)
                if kind[a] == 0:
                    held.append(rows)
                    continue
                if blocks is None:
                    t = pa.Table.from_batches(held) if held else pa.Table.from_batches([b.slice(0, 0)])
                    blocks = Blocks(t.column("id").to_numpy(), _matrix(t, Q), t.column("label").to_numpy(), t.column("leaf").to_numpy(), leaves)
                for s in range(0, rows.num_rows, BATCH):
                    piece = rows.slice(s, BATCH)
                    yield _rows(blocks, piece.column("id").to_numpy(), _matrix(piece, Q), k)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return r.unionByName(q).repartition(n, "cell", "slice").sortWithinPartitions("cell", "slice", "kind").mapInArrow(run, NEIGHBOURS)


def cell_neighbours(queries: DataFrame, refs: DataFrame, sent, k: int = K) -> DataFrame:
    """Two phases over ``refs(cell, ..)``: the nearest cell of the query's partition gives a bound, then cells within it are searched."""
    queries = queries.select("qid", "part", *Q)
    first = kept(best(search_cells(go(queries, sent, nearest_cell), refs, k), k), "first")
    bound = first.groupBy("qid").agg(F.max("distance").alias("d"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "d")
    open_ = queries.join(bound, "qid", "left").withColumn("d", F.coalesce("d", F.lit(1 << 62)))
    return best(first.unionByName(search_cells(go(open_, sent, other_cells), refs, k)), k)


def chunked_neighbours(queries: DataFrame, refs: DataFrame, k: int = K, chunk_rows: int = CELL_ROWS) -> DataFrame:
    """Over an index that is made for this search; ``open_index`` searches one that is there."""
    from quintet.operators import index as ix

    path = scratch_dir(refs.sparkSession, "index")
    ix.build_index(refs.sparkSession, refs, path, cell_rows=chunk_rows)
    return ix.open_index(refs.sparkSession, path).neighbours(queries, k, mode="chunked")


def neighbours(queries: DataFrame, refs: DataFrame, k: int = K, mode: str = "auto", broadcast_rows: int | None = None) -> DataFrame:
    """``(qid, rn, ref_id, distance, label)``: the k nearest references of ``queries(qid, q0..q13, part)``.

    With ``auto`` the number of references chooses between ``broadcast`` and ``chunked``.
    """
    if mode == "auto":
        mode = "broadcast" if refs.count() <= (rows_to_send() if broadcast_rows is None else broadcast_rows) else "chunked"
    plan = {"broadcast": broadcast_neighbours, "chunked": chunked_neighbours, "exact": exact_neighbours}
    return plan[mode](queries, refs, k)


def votes(found: DataFrame) -> DataFrame:
    """``(qid, frauds)``: fraud labels among the neighbours."""
    return found.groupBy("qid").agg(frauds_of(F.sum("label")).alias("frauds"))
