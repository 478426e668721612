"""SimHash near-duplicates: fingerprints, and links between them by a binary trie self-join.

Fingerprints are collapsed to one row each. The self-join of their binary trie walks pairs of nodes downwards
at once, adds up differing bits, and drops a pair of nodes when they exceed the budget. Two
fingerprints within the budget agree in all bits of ``blocks - budget`` of ``blocks`` blocks at least. So there
is a trie for each choice of that many blocks, over the bits in an order that has the chosen blocks first, and its walk
allows no error within these: only pairs of a node with itself come through, and are dealt to tasks. A pair of nodes with too many
fingerprints for a task is walked further down in Spark, four bits a step, and the pairs of nodes below it within the
budget are dealt instead. Tasks walk the pairs they get down to single fingerprints. They keep a
spanning forest of what they find, never all pairs; the components of the forests are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintet.llm.common import ASCII_LOWER, connected_components, materialize, by_bytes

SEED = 42
SHINGLE = 4
BUDGET = 4
#: Fingerprints of one pair of nodes that a task walks; beyond that Spark walks down, so many bits a step.
NODE_ROWS = 20_000
STEP = 4
#: Node pairs that the walk holds at once.
FRONTIER = 1 << 17

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half the shingles' XXH64 values."""
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row, fp as a signed long; a null text has no words and fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _verify(codes: np.ndarray, la, ha, lb, hb, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs of the node pairs, by their whole codes."""
    na, nb = ha - la, hb - lb
    n = na * nb
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    i, j = la[at] + k // nb[at], lb[at] + k % nb[at]
    keep = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
    return i[keep], j[keep]


def trie_self_join(codes: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, budget: int, leaf: int = 1, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of codes that differ in at most ``budget`` bits, in chunks, below the given pairs of nodes.

    A node is a range of ``codes`` (uint64) that is sorted and agrees in its first ``depth`` bits; ``nodes`` are begins and ends of
    first and second ones, where a pair of equal ranges is a node with itself. The zeros of a node's next bit come before its ones.
    Pairs of at most ``leaf`` code pairs are compared by whole codes. With ``label``, which the caller brings up to date,
    pairs of nodes whose codes all have one label are dropped too, so a dense cluster isn't walked pair by pair.
    """
    n = len(codes)
    if not n or not len(nodes[0]):
        return
    la, ha, lb, hb = nodes
    e = np.bitwise_count((codes[la] ^ codes[lb]) >> np.uint64(64 - depth)).astype(np.int8) if depth else np.zeros(len(la), np.int8)
    keep = (e <= budget) & ((la != lb) | (ha - la > 1))
    stack = [(depth, *(x[keep] for x in (la, ha, lb, hb, e)))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, la, ha, lb, hb, e = stack.pop()
        if label is not None and len(la) >= FRONTIER >> 4:
            other = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            apart = (other[la] != other[ha - 1]) | (other[lb] != other[hb - 1]) | (label[la] != label[lb])
            la, ha, lb, hb, e = (x[apart] for x in (la, ha, lb, hb, e))
        size = (ha - la) * (hb - lb)
        small = (size <= leaf) | (d == 64)
        for part in np.array_split(np.flatnonzero(small), max(1, int(size[small].sum()) // FRONTIER + 1)):
            if len(part):
                yield _verify(codes, la[part], ha[part], lb[part], hb[part], budget)
        la, ha, lb, hb, e = (x[~small] for x in (la, ha, lb, hb, e))
        if not len(la):
            continue
        if len(la) > FRONTIER:
            h = len(la) // 2
            stack += [(d, la[:h], ha[:h], lb[:h], hb[:h], e[:h]), (d, la[h:], ha[h:], lb[h:], hb[h:], e[h:])]
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((codes >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)))
        c = ones[d]
        ma, mb, own = ha - (c[ha] - c[la]), hb - (c[hb] - c[lb]), (la == lb) & (ha == hb)
        far = e + np.int8(1)
        quads = ((la, ma, lb, mb, e), (ma, ha, mb, hb, e), (la, ma, mb, hb, far), (ma[~own], ha[~own], lb[~own], mb[~own], far[~own]))
        la, ha, lb, hb, e = (np.concatenate(x) for x in zip(*quads, strict=True))
        keep = (ha > la) & (hb > lb) & (e <= budget) & ((la != lb) | (ha - la > 1))
        stack.append((d + 1, *(x[keep] for x in (la, ha, lb, hb, e))))


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j in place; labels are the smallest index of a component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def trie_links(pairs: np.ndarray, sides: np.ndarray, codes: np.ndarray, ids: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of pairs of nodes, as pairs of ids.

    Each code has the pair of nodes it is in, and its side: 1 or 2, or 0 if the pair is one node with itself.
    """
    order = np.lexsort((codes, sides, pairs))
    pairs, sides, codes, ids = pairs[order], sides[order], codes[order], ids[order]
    n = len(codes)
    start = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (sides[1:] != sides[:-1])))) if n else np.zeros(0, np.int64)
    stop = np.concatenate((start[1:], [n]))[: len(start)]
    self_ = np.flatnonzero(sides[start] == 0)
    first = np.flatnonzero((sides[start[:-1]] == 1) & (sides[start[1:]] == 2) & (pairs[start[:-1]] == pairs[start[1:]])) if n else self_
    a, b = np.concatenate((self_, first)), np.concatenate((self_, first + 1))
    label = np.arange(n)
    for i, j in trie_self_join(codes, (start[a], stop[a], start[b], stop[b]), depth, budget, label=label):
        _hook(label, i, j)
    child = np.flatnonzero(label != np.arange(n))
    return ids[child], ids[label[child]]


def blocks_for(n: int, budget: int = BUDGET) -> int:
    """Blocks so that a node behind the chosen ones has about 500 evenly spread fingerprints at most, or budget + 4."""
    for m in range(budget + 1, budget + 4):
        if n >> (64 // m * (m - budget)) <= 500:
            return m
    return budget + 4


def _tries(code: Column, blocks: int, budget: int) -> tuple[Column, int]:
    """For every choice of blocks its number, the code with these blocks' bits first, and how many they are; the least of these."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    spans = list(zip(edges, edges[1:], strict=False))
    out, least = [], 64
    for k, chosen in enumerate(combinations(range(blocks), blocks - budget)):
        turned, at = F.lit(0).cast("long"), 64
        for x in [*chosen, *(x for x in range(blocks) if x not in chosen)]:
            a, e = spans[x]
            at -= e - a
            turned = turned.bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (e - a)) - 1).cast("long")), at))
        first = sum(spans[x][1] - spans[x][0] for x in chosen)
        least = min(least, first)
        out.append(F.struct(F.lit(k).alias("choice"), turned.alias("code"), F.lit(first).alias("depth")))
    return F.array(*out), least


def _walk_down(rows: DataFrame, node_rows: int) -> DataFrame:
    """Pairs of nodes with over ``node_rows`` codes, replaced by the pairs of nodes below them within the budget, until none is so large.

    ``rows(id, code, pair, side, depth, left)``: left is the budget that differing bits so far leave. A step goes down
    ``STEP`` bits; pairs of which one side has no code are dropped. Only rows of large pairs are read again.
    """
    done = []
    while True:
        sizes = rows.groupBy("pair").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
        large = sizes.where((F.col("n") > node_rows) & (F.col("d") + STEP <= 64)).select("pair", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        marked = materialize(rows.join(large, "pair", "left"), "nodes")
        done.append(marked.where("large is null").drop("large"))
        rows = marked.where("large").drop("large").withColumn("x", F.expr(f"cast(shiftrightunsigned(code, {64 - STEP} - depth) & {(1 << STEP) - 1} as int)"))
        rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)))).withColumn("left", F.col("left") - F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).where("left >= 0")
        own = F.col("side") == 0
        a = F.when(own, F.least("x", "y")).when(F.col("side") == 1, F.col("x")).otherwise(F.col("y"))
        b = F.when(own, F.greatest("x", "y")).when(F.col("side") == 1, F.col("y")).otherwise(F.col("x"))
        side = F.when(own & (F.col("x") == F.col("y")), 0).when(own, F.when(F.col("x") < F.col("y"), 1).otherwise(2)).otherwise(F.col("side"))
        rows = rows.select("id", "code", F.xxhash64("pair", a, b).alias("pair"), side.cast("int").alias("side"), (F.col("depth") + STEP).alias("depth"), "left")
        both = rows.groupBy("pair").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = 0 or lo < hi").select("pair")
        rows = materialize(rows.join(both, "pair", "left_semi").select(*rows.columns), "below")
    for x in done:
        rows = rows.unionByName(x)
    return rows


def fingerprint_links(codes: DataFrame, budget: int = BUDGET, blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges ``(u, v)`` of ids that span the same components as all pairs within ``budget`` bits.

    ``codes(id, fp)`` has one row for each distinct fp. A fingerprint goes to one node for each choice of blocks,
    and to more pairs of nodes only where a node has over ``node_rows``.
    """
    blocks = blocks or blocks_for(codes.count(), budget)
    tries, depth = _tries(F.col("fp"), blocks, budget)
    rows = codes.select("id", F.explode(tries).alias("t")).select("id", "t.*")
    node = F.expr("shiftrightunsigned(code, 64 - depth)")
    rows = rows.select("id", "code", F.xxhash64("choice", node).alias("pair"), F.lit(0).alias("side"), "depth", F.lit(budget).alias("left"))
    rows = _walk_down(rows, node_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            pair, side, code, ids = (table.column(c).to_numpy() for c in ("pair", "side", "code", "id"))
            u, v = trie_links(pair, side, code.view(np.uint64), ids, depth, budget)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole pairs of nodes of what is held; the last may go on in the next batch."""
            table = pa.Table.from_batches(held)
            pair = table.column("pair").to_numpy()
            end = len(pair) if last else int(np.flatnonzero(pair == pair[-1])[0])
            held[:] = [] if end == len(pair) else table.slice(end).to_batches()
            if end:
                yield links(table.slice(0, end))

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= 4 * NODE_ROWS:
                    yield from ready(False)
        if held:
            yield from ready(True)

    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("id", "code", "pair", "side")
    return rows.repartition(n, "pair").sortWithinPartitions("pair").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``budget``
    differing bits reach, the row's own included. Null and empty texts have
    fingerprint zero and link like others. Every row, repeated ones too, takes
    the component of its fingerprint; fingerprints with one smallest doc_id
    count as linked. A null doc_id names no component: its row's is null if no
    row that it reaches has an id. Other columns are not
    read, so their names may be anything. An empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    codes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "codes")
    known = codes.where("id is not null")
    edges = materialize(fingerprint_links(known, budget, blocks, node_rows), "links")
    components = connected_components(edges)
    placed = codes.join(components, codes["id"] == components["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(placed, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all its columns, that have the smallest id of their component.

    Of rows that repeat such an id one stays. Rows of a null id name no
    document to keep or drop and stay.
    """
    found = materialize(near_duplicates(docs, id_col, text_col, **options), "components").where("doc_id is not null")
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(dropped, id_col, "left_anti").select(docs.columns)
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
