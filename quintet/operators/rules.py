"""Decision trees as tables, and the leaf rules of the cascade.

A tree is a parameter: rows ``(node, feature, threshold, left, right)``, where a
child below 0 is leaf ``-1 - child``, and rows with ``feature <= threshold`` go left. It is a model of a checked size, and
is sent out whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintet.functions.features import Q

#: Nodes that are sent to executors at most.
MODEL_NODES = 100_000
Node = tuple[int, int, int, int, int]

# The conjunctions that decide the cascade, as (feature, at most, above) bounds, and their votes.
_P = [(11, None, 5000), (3, 2826, None), (13, 100, None), (12, None, 6250), (1, None, 4584), (2, None, 6693)]
_R = [*_P, (5, None, 299), (0, 3656, None)]
_S = [*_R, (6, 4758, None), (7, 5270, None), (8, 6750, None)]
RULES: dict[int, tuple[list[tuple[int, int | None, int | None]], int | None, int]] = {
    # leaf: bounds, partition it is limited to, votes
    0: ([(11, 5000, None), (2, 666, None)], None, 0),
    250: ([*_P, (5, 299, None)], None, 5),
    264: ([*_S, (1, 8750, 7916), (3, 1956, None)], None, 5),
    266: ([*_S, (1, None, 8750)], None, 5),
    269: ([*_R, (6, None, 4758)], 253, 5),
    270: ([*_P, (5, None, 299), (0, None, 3656)], 249, 5),
}


def holds(bounds: list[tuple[int, int | None, int | None]]) -> Column:
    """A conjunction of ``feature <= most`` and ``feature > above``."""
    tests = [t for f, most, above in bounds for t in ([F.col(f"q{f}") <= most] if most is not None else []) + ([F.col(f"q{f}") > above] if above is not None else [])]
    return reduce(lambda a, b: a & b, tests)


def rule_leaf() -> Column:
    """The leaf of the cascade that a row falls in, null for all other leaves."""
    out = F.lit(None).cast("int")
    for leaf, (bounds, _, _) in RULES.items():
        out = F.when(holds(bounds), leaf).otherwise(out)
    return out


def rule_frauds() -> Column:
    """The votes of the cascade's rules, null where the neighbours must decide."""
    out = F.lit(None).cast("int")
    for bounds, part, frauds in RULES.values():
        out = F.when(holds(bounds) if part is None else holds(bounds) & (F.col("part") == part), frauds).otherwise(out)
    return out


def route(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """Add the leaf of each row: a batch of rows goes down the tree together, a level a step. A tree without nodes is leaf 0."""
    if len(nodes) > MODEL_NODES:
        raise ValueError(f"over {MODEL_NODES} nodes")
    names = {n[0]: k for k, n in enumerate(nodes)}
    if nodes and 0 not in names:
        raise ValueError("a tree begins with node 0")
    child = [[names[c] if c >= 0 else c for c in n[3:]] for n in nodes]
    sent = rows.sparkSession.sparkContext.broadcast((np.array([n[1] for n in nodes], np.int64), np.array([n[2] for n in nodes], np.int64), np.array(child, np.int64).reshape(-1, 2), names.get(0, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, threshold, below, first = sent.value
        for b in batches:
            q = np.stack([b.column(x).to_numpy() for x in Q], axis=1)
            at = np.full(len(q), first, np.int64)
            left = np.flatnonzero(at >= 0)
            while len(left):
                node = at[left]
                at[left] = below[node, (q[left, feature[node]] > threshold[node]).astype(np.int64)]
                left = left[at[left] >= 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((-1 - at).astype(np.int32))], [*b.schema.names, "leaf"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, leaf int")


def even_tree(cuts: list[tuple[int, int]]) -> list[Node]:
    """A full tree that tests one feature on each level; leaves are numbered from the left."""
    depth, nodes = len(cuts), []
    for d, (f, t) in enumerate(cuts):
        for k in range(2**d):
            node, child = 2**d - 1 + k, 2 ** (d + 1) - 1 + 2 * k
            kids = (child, child + 1) if d + 1 < depth else (-1 - 2 * k, -2 - 2 * k)
            nodes.append((node, f, t, *kids))
    return nodes
