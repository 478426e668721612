"""An index of references, built, written, opened and searched: clusters with layout and boxes, or a forest of median-split trees.

A written index is a folder of Parquet tables: ``meta`` (kind, version, rows), ``refs`` with their cell, ``cells`` (boxes), and
``boxes`` of leaves and ``partitions`` (kd) or ``centroids`` and ``boxes`` of clusters (ivf).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.functions.features import DIMS, Q, partition_key, quantized
from quintet.functions.responses import K, frauds_of
from quintet.operators import knn
from quintet.operators.kernel import split
from quintet.operators.knn import CELL_ROWS, CELLS, NODE_BITS, Cells, best, boxes, go, search_cells, spread
from quintet.sources.scratch import drop_dir, kept, scratch_dir

# Fixed values of the builder.
CLUSTERS, ITERATIONS, SAMPLE = 4096, 15, 500_000
LANES, LEAF_MOST = 8, 128
#: Rows of a node that a task cuts down on its own; only larger nodes are cut in Spark.
TASK_ROWS = 500_000
# Fixed values of the staged search: probes at first and in the first repair, and the distance under which a unanimous vote ends it.
PROBES, REPAIR, EARLY, BORDER = 2, 32, 20_160_000, (1, 4)
VERSION = 1
#: Centroids that are sent to executors at most.
BROADCAST_CENTROIDS = 100_000


def sample(refs: DataFrame, most: int = SAMPLE, seed: int = 42) -> DataFrame:
    """About ``most`` references, the same ones on each run: those with a small hash."""
    n = refs.count()
    if n <= most:
        return refs
    return refs.where(F.pmod(F.xxhash64("ref_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def kmeans(refs: DataFrame, k: int = CLUSTERS, iterations: int = ITERATIONS, most: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``(cluster, c0..c13)``: quantised centroids of a bounded sample, by k-means|| seeds and Lloyd iterations.

    A cluster without members gets a row of the sample, another one in each iteration; so do seeds that are
    missing, as where the sample has fewer distinct rows than k. Centroids come to the driver, k rows an iteration.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    spark = refs.sparkSession
    path = scratch_dir(spark, "sample")
    rows = kept(sample(refs, most, seed).select("ref_id", *Q), "sample", path)
    try:
        model = KMeans(k=k, maxIter=0, tol=0.0, seed=seed, initMode="k-means||").fit(VectorAssembler(inputCols=Q, outputCol="features").transform(rows).select("features"))
        centres = {i: [int(np.sign(x) * np.floor(abs(x) + 0.5)) for x in c] for i, c in enumerate(model.clusterCenters()[:k])}
        for t in range(iterations + 1):
            if missing := [i for i in range(k) if i not in centres]:
                spare = rows.orderBy(F.xxhash64("ref_id", F.lit(seed + t)), "ref_id").limit(len(missing)).collect()
                centres |= {i: [int(x) for x in r[1:]] for i, r in zip(missing, spare, strict=False)}
            table = spark.createDataFrame([(i, *c) for i, c in sorted(centres.items())], "cluster int, " + ", ".join(f"c{i} int" for i in range(DIMS)))
            if t < iterations:
                centres = {x["cluster"]: [x[f"c{i}"] for i in range(DIMS)] for x in lloyd_step(assign(rows, table)).collect()}
    finally:
        drop_dir(spark, path)
    return table


def _centroids(centroids: DataFrame, most: int) -> np.ndarray:
    """Rows of cluster and centre, in order of cluster; raises ValueError for too many. They are the model, and go out whole."""
    rows = sorted(centroids.select("cluster", *(f"c{i}" for i in range(DIMS))).limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"over {most} centroids")
    return np.array(rows, np.int64).reshape(-1, DIMS + 1)


def _to_centroids(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centroids, exact."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    return np.rint((x * x).sum(1)[:, None] + (c * c).sum(1) - 2.0 * (x @ c.T)).astype(np.int64)


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(q).to_numpy() for q in Q], axis=1)


def assign(refs: DataFrame, centroids: DataFrame, most: int = BROADCAST_CENTROIDS) -> DataFrame:
    """Add the cluster of the nearest centroid (the first of equals) and its squared distance, by one matrix product a batch."""
    sent = refs.sparkSession.sparkContext.broadcast(_centroids(centroids, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, c = sent.value[:, 0], sent.value[:, 1:]
        step = max(1, (4 << 20) // max(1, len(c)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                d = _to_centroids(_vectors(b), c)
                at = d.argmin(1)
                out = [*b.columns, pa.array(name[at].astype(np.int32)), pa.array(d[np.arange(len(d)), at])]
                yield pa.RecordBatch.from_arrays(out, [*b.schema.names, "cluster", "d_centroid"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema)
    return refs.mapInArrow(run, f"{kinds}, cluster int, d_centroid long")


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """``(cluster, n, c0..c13)``: means of the members, rounded half away from zero."""
    means = [F.round(F.sum(q).cast("double") / F.count("*")).cast("int").alias(f"c{i}") for i, q in enumerate(Q)]
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), *means)


def sse(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d_centroid").cast("long").alias("sse"), F.count("*").alias("n"))


def cluster_sizes(assigned: DataFrame, clusters: int) -> DataFrame:
    """Least, most and mean (whole) size over all clusters, empty ones too."""
    every = assigned.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    n = every.join(assigned.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.floor(F.sum("n") / F.lit(clusters)).cast("long").alias("mean"))


def block_offsets(assigned: DataFrame, lanes: int = LANES) -> DataFrame:
    """``(cluster, n, blocks, block_off)``: blocks of ``lanes`` rows, and those of the clusters before."""
    n = assigned.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / lanes).cast("long"))
    before = W.orderBy("cluster").rowsBetween(W.unboundedPreceding, -1)  # a row for each cluster
    return n.withColumn("block_off", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("long"))


def layout(assigned: DataFrame, lanes: int = LANES) -> DataFrame:
    """``(ref_id, cluster, block, lane)``: rows of a cluster by distance to its centroid, then ref_id."""
    rn = F.row_number().over(W.partitionBy("cluster").orderBy("d_centroid", "ref_id")) - 1
    offsets = block_offsets(assigned, lanes).select("cluster", "block_off")
    rows = assigned.withColumn("rn", rn).join(offsets, "cluster")
    return rows.select("ref_id", "cluster", (F.col("block_off") + F.floor(F.col("rn") / lanes)).cast("long").alias("block"), (F.col("rn") % lanes).cast("int").alias("lane"))


def cluster_boxes(assigned: DataFrame) -> DataFrame:
    return boxes(assigned, "cluster")


def probe_rank(queries: DataFrame, centroids: DataFrame, most: int = REPAIR) -> DataFrame:
    """``(qid, rank, cluster, d_centroid)``: each query's nearest centroids, the first of equals first.

    Raises ValueError for over ``BROADCAST_CENTROIDS`` centroids.
    """
    sent = queries.sparkSession.sparkContext.broadcast(_centroids(centroids, BROADCAST_CENTROIDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, c = sent.value[:, 0], sent.value[:, 1:]
        k = min(most, len(c))
        step = max(1, (4 << 20) // max(1, len(c)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                d = _to_centroids(_vectors(b), c)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                arrays = [pa.array(np.repeat(b.column("qid").to_numpy(), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))), pa.array(name[order.ravel()].astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel())]
                yield pa.RecordBatch.from_arrays(arrays, ["qid", "rank", "cluster", "d_centroid"])

    return spread(queries.select("qid", *Q)).mapInArrow(run, "qid long, rank int, cluster int, d_centroid long")


def with_cells(assigned: DataFrame, cell_rows: int | None = None, path: str | None = None) -> DataFrame:
    """Add the cell and leaf of each row of a clustering: a tree of median splits in each cluster, so boxes of its cells are small."""
    rows = assigned.withColumnsRenamed({"part": "_part", "cluster": "part"})
    return forest(rows, path, cell_rows=cell_rows).withColumnsRenamed({"part": "cluster", "_part": "part", "node": "leaf"})


def staged_neighbours(queries: DataFrame, refs: DataFrame, cells: Cells, centroids: np.ndarray, k: int = K, probes: int = PROBES, repair: int = REPAIR, border: tuple[int, int] = BORDER) -> DataFrame:
    """``(qid, frauds)`` for every query, by up to three stages over ``refs(cell, ref_id, label, q0..q13)``.

    The nearest ``probes`` clusters that have members decide if their vote is unanimous and near. Else clusters up to
    rank ``repair`` are added, and for a vote within ``border``, or fewer than k neighbours, all others; where a box is beyond the kth
    distance, it isn't searched. Of the first clusters, the nearest cell is searched before others, for a distance. Each stage is a search of
    the queries that are still open, and is written out.
    """
    sc = queries.sparkSession.sparkContext
    sent = sc.broadcast(cells)
    held = centroids[np.isin(centroids[:, 0], cells.owner)]
    model = sc.broadcast((held[:, 1:], np.searchsorted(held[:, 0], cells.owner)))

    def within(low: int, high: int, nearest: bool | None = None):
        """Cells of clusters of these ranks within the bound; only the nearest one of all those, or all but that."""

        def choose(batch: pa.RecordBatch, x: np.ndarray, bound: np.ndarray, cells: Cells) -> np.ndarray:
            c, owner = model.value
            order = np.argsort(_to_centroids(x, c), axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
            rank = rank[:, owner]
            among = (rank >= low) & (rank < high)
            near = np.zeros_like(among)
            if nearest is not None and len(owner):
                near = among & (np.arange(len(owner)) == np.where(among, bound, 1 << 62).argmin(1)[:, None])
            return near if nearest else among & ~near & (bound <= batch.column("d").to_numpy()[:, None])

        return choose

    far = F.lit(1 << 62)
    open_, found, out = queries.select("qid", *Q, far.alias("d")), None, []
    first = kept(best(search_cells(go(open_, sent, within(0, probes, True)), refs, k), k), "first")
    bound = first.groupBy("qid").agg(F.max("distance").alias("d"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "d")
    bounded = open_.drop("d").join(bound, "qid", "left").withColumn("d", F.coalesce("d", far))
    for stage, (low, high) in enumerate(((0, probes), (probes, repair), (repair, 1 << 30))):
        if stage == 0:
            more = first.unionByName(search_cells(go(bounded, sent, within(low, high, False)), refs, k))
        else:
            more = search_cells(go(open_, sent, within(low, high)), refs, k)
        found = kept(best(more if found is None else found.unionByName(more), k), "stage")
        per = found.groupBy("qid").agg(F.count("*").alias("n"), F.sum("label").cast("int").alias("frauds"), F.max("distance").alias("far"))
        state = kept(open_.drop("d").join(per, "qid", "left").select("qid", *Q, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("frauds", F.lit(0)).alias("frauds"), F.when(F.col("n") == k, F.col("far")).otherwise(far).alias("d")), "state")
        f, full = F.col("frauds"), F.col("n") == k
        done = (full & f.isin(0, k) & (F.col("d") <= EARLY), full & ~f.between(*border), F.lit(True))[stage]
        out.append(state.where(done).select("qid", frauds_of(f).alias("frauds")))
        open_ = state.where(~done).select("qid", *Q, "d")
        found = found.join(open_.select("qid"), "qid", "left_semi")
        if stage < 2 and open_.isEmpty():
            break
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def staged_votes(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, probes: int = PROBES, repair: int = REPAIR, border: tuple[int, int] = BORDER, cell_rows: int | None = None) -> DataFrame:
    """``(qid, frauds)`` by the staged cluster search over references that have been assigned to centroids."""
    refs = kept(with_cells(assigned, cell_rows), "clusters")
    return staged_neighbours(queries, refs, Cells(boxes(refs, "cell", "cluster"), "cluster"), _centroids(centroids, BROADCAST_CENTROIDS), K, probes, repair, border)


def split_level(state: DataFrame, most: int = LEAF_MOST) -> DataFrame:
    """One level of the forest: nodes of over ``most`` rows are cut at the median of their widest dimension.

    ``state(ref_id, part, node, q0..q13)``; the left half of n rows are the first n div 2 by value, then ref_id. The first of equally
    wide dimensions is cut. Node n becomes 2n and 2n + 1. No node is sorted: the row at the cut is found digit by digit, by counts of the
    values and then of 16 bits of the ids of equal ones, for all nodes at once.
    """
    extent = [F.max(q).cast("int") - F.min(q).cast("int") for q in Q]
    widest = F.array_max(F.array(*(F.struct(e.alias("w"), F.lit(-i).alias("d")) for i, e in enumerate(extent))))
    per = state.groupBy("part", "node").agg(F.count("*").alias("_n"), (-widest["d"]).alias("_d")).where(F.col("_n") > most)
    # nodes that are cut have over ``most`` rows, so their table is small against the rows
    cuts = kept(per.select("part", "node", "_d", F.floor(F.col("_n") / 2).alias("_left")), "cuts")
    keys = [F.element_at(F.array(*Q), F.col("_d") + 1).cast("long"), *(F.shiftright(F.col("ref_id"), s).bitwiseAND(F.lit(0xFFFF if s < 48 else -1).cast("long")) for s in (48, 32, 16, 0))]
    own = W.partitionBy("part", "node").orderBy("_k")
    equal = None
    for digit in range(5):
        if digit == 1:  # only rows that have the value at the cut are counted by id
            equal = kept(state.join(cuts, ["part", "node"]).where(keys[0] == F.col("_t0")).select("part", "node", "ref_id"), "equal")
        rows = (state if equal is None else equal).join(cuts, ["part", "node"]).withColumn("_k", keys[digit])
        for k in range(1, digit):
            rows = rows.where(keys[k] == F.col(f"_t{k}"))
        counts = rows.groupBy("part", "node", "_k").agg(F.count("*").alias("_c"))
        counts = counts.withColumn("_to", F.sum("_c").over(own.rowsBetween(W.unboundedPreceding, 0)))
        at = counts.join(cuts, ["part", "node"]).where((F.col("_to") >= F.col("_left")) & (F.col("_to") - F.col("_c") < F.col("_left")))
        cuts = kept(at.select("part", "node", "_d", *(f"_t{k}" for k in range(digit)), F.col("_k").alias(f"_t{digit}"), (F.col("_left") - F.col("_to") + F.col("_c")).alias("_left"), (F.col("_left") == F.col("_to")).alias("_whole")), "cuts")
        if digit < 4 and cuts.where("not _whole").isEmpty():
            break  # everywhere all rows with these digits are left
        cuts = cuts.drop("_whole") if digit < 4 else cuts
    upto = F.lit(True)
    for k in reversed(range(digit + 1)):
        x, t = keys[k], F.col(f"_t{k}")
        upto = (x < t) | (x == t) & upto
    rows = state.join(cuts, ["part", "node"], "left")
    node = F.when(F.col("_t0").isNull(), F.col("node")).otherwise(2 * F.col("node") + (~upto).cast("long"))
    return rows.select(*(c for c in state.columns if c != "node"), node.alias("node"))


def forest(refs: DataFrame, path: str | None = None, most: int = LEAF_MOST, cell_rows: int | None = None, levels: int = 62, task_rows: int = TASK_ROWS) -> DataFrame:
    """``refs`` with the cell and the leaf (node) of each row. The trees have at most ``levels`` levels of cuts, beyond which leaves are of any size.

    Nodes of over ``task_rows`` rows are cut level by level in Spark; each level is written under ``path``, and the one before deleted.
    What is left is cut by tasks on their own, to cells of at most ``cell_rows`` rows and to leaves of at most ``most``. There are
    no more than ``CELLS`` cells of a forest: where it has many rows, cells are larger.
    """
    spark = refs.sparkSession
    path = path or scratch_dir(spark, "forest")
    state = kept(refs.withColumn("node", F.lit(1).cast("long")), "level", f"{path}/level=0")
    cell_rows = max(most, cell_rows or max(CELL_ROWS, 4 * state.count() // CELLS))
    task_rows = max(cell_rows, task_rows)
    for level in range(1, levels + 1):
        if state.groupBy("part", "node").count().where(F.col("count") > task_rows).isEmpty():
            break
        state = kept(split_level(state, task_rows), "level", f"{path}/level={level}")
        drop_dir(spark, f"{path}/level={level - 1}")
    names = [c for c in state.columns if c != "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def held_node() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ref, root = t.column("ref_id").to_numpy(), int(t.column("node")[0].as_py())
            order = np.argsort(ref, kind="stable")
            q = np.stack([t.column(x).to_numpy() for x in Q], axis=1)[order]
            cell, leaf = np.empty(len(ref), np.int64), np.empty(len(ref), np.int64)
            for top, rows in split(q, np.arange(len(ref)), cell_rows, root, levels):
                cell[order[rows]] = top
                for name, few in split(q, rows, most, top, levels):
                    leaf[order[few]] = name
            cell += int(t.column("part")[0].as_py()) << NODE_BITS
            return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in names), pa.array(cell), pa.array(leaf)], [*names, "cell", "node"])

        for b in batches:
            part, node = b.column("part").to_numpy(), b.column("node").to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(node) != 0)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if a == e:
                    continue
                piece = b.slice(a, e - a)
                if node[a] >= 1 << levels:  # not cut, so it may be large and is not held
                    key = np.full(e - a, (int(part[a]) << NODE_BITS) + int(node[a]))
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(key), piece.column("node")], [*names, "cell", "node"])
                    continue
                if held and (held[0].column("part")[0], held[0].column("node")[0]) != (piece.column("part")[0], piece.column("node")[0]):
                    yield held_node()
                    held = []
                held.append(piece)
        if held:
            yield held_node()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name != "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return state.repartition(n, "part", "node").sortWithinPartitions("part", "node").mapInArrow(run, f"{kinds}, cell long, node long")


def build_index(spark: SparkSession, refs: DataFrame, path: str, kind: str = "kd", clusters: int = CLUSTERS, cell_rows: int | None = None, centroids: DataFrame | None = None) -> dict:
    """Write an index: ``kd`` (references by partition with cell and leaf, and boxes) or ``ivf`` (by cluster, centroids, boxes).

    Rows are dealt to files by ranges, so a partition or cluster that has most of them is not one task's. Returns
    the index's figures: rows, and the least, most and mean size of its leaves or clusters, as observed while writing.
    """
    if kind not in ("kd", "ivf"):
        raise ValueError(f"no index of kind {kind!r}")
    path = path.rstrip("/")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if kind == "kd":
        leaves = forest(refs, f"{path}/build", cell_rows=cell_rows).withColumnRenamed("node", "leaf")
        leaves.repartitionByRange(n, "part", "cell", "ref_id").sortWithinPartitions("part", "cell", "leaf", "ref_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/refs")
        drop_dir(spark, f"{path}/build")
        back = spark.read.schema(leaves.schema).parquet(f"{path}/refs")
        groups = boxes(back, "part", "leaf")
        boxes(back, "cell", "part").write.mode("overwrite").parquet(f"{path}/cells")
        boxes(back, "part").write.mode("overwrite").parquet(f"{path}/partitions")
    else:
        centroids = centroids if centroids is not None else kmeans(refs, clusters)
        centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        centroids = spark.read.schema(centroids.schema).parquet(f"{path}/centroids")
        with_cells(assign(refs, centroids), cell_rows, f"{path}/build").repartitionByRange(n, "cluster", "d_centroid", "ref_id").sortWithinPartitions("cluster", "d_centroid", "ref_id").write.mode("overwrite").parquet(f"{path}/refs")
        drop_dir(spark, f"{path}/build")
        back = spark.read.parquet(f"{path}/refs")
        groups = boxes(back, "cluster").join(block_offsets(back).select("cluster", "block_off"), "cluster")
        boxes(back, "cell", "cluster").write.mode("overwrite").parquet(f"{path}/cells")
    seen = Observation("index")
    figures = [F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")]
    groups.observe(seen, *figures).write.mode("overwrite").parquet(f"{path}/boxes")
    said = {"kind": kind, "version": VERSION, **seen.get}
    spark.createDataFrame([(kind, VERSION, said["rows"])], "kind string, version int, rows long").write.mode("overwrite").parquet(f"{path}/meta")
    return said


_TABLES = {"kd": {"refs": {"ref_id", "label", "part", "cell", "leaf", *Q}, "cells": {"cell", "part"}, "boxes": {"part", "leaf", "n"}, "partitions": {"part", "n"}}, "ivf": {"refs": {"ref_id", "label", "cluster", "cell", "d_centroid", *Q}, "cells": {"cell", "cluster"}, "boxes": {"cluster", "n", "block_off"}, "centroids": {"cluster", *(f"c{i}" for i in range(DIMS))}}}


class Index:
    """A written index. What a search sends out is packed once, and serves all searches of this object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{path}/meta").first()
        self.kind, self.rows = meta["kind"], meta["rows"]
        if meta["version"] != VERSION or self.kind not in _TABLES:
            raise ValueError(f"no index of version {VERSION}: {path}")
        self.tables = {name: spark.read.parquet(f"{path}/{name}") for name in _TABLES[self.kind]}
        for name, columns in _TABLES[self.kind].items():
            if missing := columns - set(self.tables[name].columns):
                raise ValueError(f"no index: {name} lacks {sorted(missing)}")

    @property
    def refs(self) -> DataFrame:
        return self.tables["refs"]

    @cached_property
    def packed(self):
        """The references by leaf, sent out; only for a checked number of them."""
        return self.spark.sparkContext.broadcast(knn.pack(self.refs))

    @cached_property
    def cells(self) -> Cells:
        return Cells(self.tables["cells"], "part" if self.kind == "kd" else "cluster")

    @cached_property
    def _merged(self):
        """Cells for a search, sent out, and the references by them: small cells of a tree are taken together, as a query is compared with each."""
        cells, to = self.cells.merged(CELL_ROWS)
        refs = self.refs
        if len(cells.cell) < len(to):
            names = self.spark.createDataFrame(pa.table({"cell": self.cells.cell, "_to": to}))  # CELLS rows at most
            refs = refs.join(F.broadcast(names), "cell").withColumn("cell", F.col("_to")).drop("_to")
        return self.spark.sparkContext.broadcast(cells), refs

    def neighbours(self, queries: DataFrame, k: int = K, mode: str = "auto") -> DataFrame:
        """The k nearest of ``queries(qid, q0..q13, part)``, exact, by an index of kind kd: packed if it is small enough, else by cells."""
        if self.kind != "kd":
            raise ValueError("an index of clusters gives votes, not neighbours")
        if mode == "auto":
            mode = "broadcast" if self.rows <= knn.rows_to_send() else "chunked"
        if mode == "broadcast":
            return knn.search_packed(queries, self.packed, k)
        sent, refs = self._merged
        return knn.cell_neighbours(queries, refs, sent, k)

    def votes(self, queries: DataFrame, **options) -> DataFrame:
        """``(qid, frauds)``: exact for kd; staged for ivf, with the options of ``staged_neighbours``."""
        if self.kind == "kd":
            return knn.votes(self.neighbours(queries, **options))
        return staged_neighbours(queries, self.refs, self.cells, _centroids(self.tables["centroids"], BROADCAST_CENTROIDS), **options)

    def warm(self, n: int = 1000, seed: int = 7) -> int:
        """Search for some random vectors, which sends out and loads what searches share; returns their votes."""
        from quintet.sources.requests import synthetic_vectors

        rows = from_vectors(synthetic_vectors(self.spark, n, seed)).withColumnRenamed("ref_id", "qid")
        return int(self.votes(rows).agg(F.coalesce(F.sum("frauds"), F.lit(0))).first()[0])


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``build_index`` wrote; raises ValueError if its version or tables are others."""
    return Index(spark, path)


def from_vectors(df: DataFrame) -> DataFrame:
    """Quantise v0..v13 and add the partition key."""
    return quantized(df).withColumn("part", partition_key())


def bit_words(part: Column) -> tuple[Column, Column]:
    """Word and mask of a partition in a 256-bit set of four 64-bit words."""
    return F.shiftright(part, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), part.bitwiseAND(F.lit(63)))
