import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quintet.functions import responses as rs
from quintet.functions.features import DIMS, Q
from quintet.operators import calibrate as cal
from quintet.operators import evaluate as ev
from quintet.operators import index as ix
from quintet.operators import knn
from quintet.operators.kernel import Blocks


def brute(q, refs, ids, k=5):
    d = ((q.astype(np.int64) - refs.astype(np.int64)) ** 2).sum(1)
    return sorted(zip(d.tolist(), ids.tolist()))[:k]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 300), st.integers(1, 40), st.sampled_from([3, 100, 20000]))
def test_kernel_equals_brute_force(seed, n, leaf_rows, spread):
    rng = np.random.default_rng(seed)
    refs = rng.integers(-spread // 2, spread // 2 + 1, (n, DIMS)).astype(np.int16)
    ids = rng.permutation(n) * 7
    part = rng.integers(0, 4, n)
    q = rng.integers(-spread // 2, spread // 2 + 1, (5, DIMS))
    b = Blocks(ids, refs, np.zeros(n), part, leaf_rows)
    assert sum(map(len, b.rows)) == n and all(len(r) <= leaf_rows for r in b.rows)
    d, row = b.nearest(q)
    for i in range(5):
        assert [(x, int(b.ref_id[r])) for x, r in zip(d[i].tolist(), row[i]) if r >= 0] == brute(q[i], refs, ids)


def table(spark, n, seed, spread=50):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 2)), *map(int, rng.integers(0, spread, DIMS))) for i in range(n)]
    return spark.createDataFrame(rows, "ref_id long, part int, label int, " + ", ".join(f"{q} smallint" for q in Q))


def test_plans_agree(spark):
    refs = table(spark, 300, 1)
    queries = table(spark, 40, 2).drop("label").withColumnRenamed("ref_id", "qid")
    want = sorted(knn.exact_neighbours(queries, refs).collect())
    assert sorted(knn.broadcast_neighbours(queries, refs).collect()) == want
    assert sorted(knn.chunked_neighbours(queries, refs, chunk_rows=30).collect()) == want
    assert sorted(knn.neighbours(queries, refs, broadcast_rows=10).collect()) == want


def test_empty_partition_of_a_query_is_searched_elsewhere(spark):
    refs = table(spark, 50, 3).where("part <> 1")
    queries = table(spark, 20, 4).drop("label").withColumnRenamed("ref_id", "qid")
    assert sorted(knn.chunked_neighbours(queries, refs).collect()) == sorted(knn.exact_neighbours(queries, refs).collect())


def test_forest_partitions_the_rows(spark, tmp_path):
    refs = table(spark, 700, 5)
    leaves = ix.forest(refs, str(tmp_path / "f"), most=32)
    sizes = [r["count"] for r in leaves.groupBy("part", "node").count().collect()]
    assert sum(sizes) == 700 and max(sizes) <= 32
    assert leaves.select("ref_id").distinct().count() == 700


def test_staged_search_is_exact_when_all_is_probed(spark):
    refs = table(spark, 200, 6, 10000)
    centroids = spark.createDataFrame([(i, *map(int, np.random.default_rng(i).integers(0, 10000, DIMS))) for i in range(6)], "cluster int, " + ", ".join(f"c{i} int" for i in range(DIMS)))
    queries = table(spark, 15, 7, 10000).drop("label").withColumnRenamed("ref_id", "qid")
    want = {r["qid"]: r["frauds"] for r in knn.votes(knn.exact_neighbours(queries, refs)).collect()}
    got = ix.staged_votes(queries, ix.assign(refs, centroids), centroids, probes=6)
    assert {r["qid"]: r["frauds"] for r in got.collect()} == want


def test_clusters_repair_a_borderline_vote(spark):
    q = [0, 100, 3000, 3001, 3002, 3003, 3004]
    kinds = ", ".join(f"{x} smallint" for x in Q)
    assigned = spark.createDataFrame([(i, label, cluster, *[v] * DIMS) for i, (v, label, cluster) in enumerate(zip(q, [1, 0, 1, 1, 1, 1, 1], [0, 0, 1, 1, 1, 1, 1]))], f"ref_id long, label int, cluster int, {kinds}")
    centroids = spark.createDataFrame([(0, *[50] * DIMS), (1, *[3002] * DIMS)], "cluster int, " + ", ".join(f"c{i} int" for i in range(DIMS)))
    queries = spark.createDataFrame([(1, *[0] * DIMS), (2, *[3000] * DIMS)], f"qid long, {kinds}")
    got = ix.staged_votes(queries, assigned, centroids, probes=1)
    assert {r["qid"]: r["frauds"] for r in got.collect()} == {1: 4, 2: 5}


def test_calibration_and_cross_validation(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        leaf, part = int(rng.integers(0, 3)), int(rng.integers(0, 3))
        approved = leaf == 0 or (part == 1 and leaf == 1) or bool(rng.integers(0, 2) and leaf == 2)
        rows.append((i, leaf, part, approved, 0.0 if approved else 1.0))
    e = spark.createDataFrame(rows, "entry_id long, leaf int, part int, approved boolean, score double")
    counts = spark.createDataFrame([(0, 1), (1, 0), (2, 5), (3, 0)], "leaf int, frauds int")
    got = {r["leaf"]: r["reason"] for r in cal.leaf_reasons(e, counts, 20).collect()}
    assert got == {0: "safe", 1: "mixed", 2: "mixed", 3: "unseen"}
    open_ = cal.open_entries(e, cal.leaf_reasons(e, counts, 20))
    pairs = cal.safe_pairs(cal.pair_support(open_), 20, None, None)
    assert {(r["leaf"], r["part"]): r["verdict"] for r in pairs.collect()} == {(1, 0): 5, (1, 1): 0, (1, 2): 5}
    assert cal.leaf_verdicts(pairs).count() == 0  # pairs of leaf 1 differ
    cal.require_clean(cal.audit(open_, pairs.where("verdict = 5")))
    with pytest.raises(ValueError):
        cal.require_clean(spark.createDataFrame([(1, 1, 0)], "fires int, fn int, fp int"))
    for r in cal.cross_validate(open_, 20, leaves=None, parts=None).collect():
        train = [x for x in rows if x[1] > 0 and x[0] % 5 != r["fold"]]
        safe = {p for p in {(x[1], x[2]) for x in train} if len({x[3] for x in train if (x[1], x[2]) == p}) == 1 and sum((x[1], x[2]) == p for x in train) >= 20}
        assert r["fires"] == sum((x[1], x[2]) in safe for x in rows if x[1] > 0 and x[0] % 5 == r["fold"])


def test_summaries(spark):
    rows = spark.createDataFrame([(1, 2.0, True), (2, 4.0, False), (3, 9.0, True)], "at int, v double, good boolean")
    assert ev.summary(rows, "counter", "v").first().asDict() == {"count": 3, "sum": 15.0}
    assert ev.summary(rows, "gauge", "v").first().asDict() == {"value": 9.0, "min": 2.0, "max": 9.0}
    assert ev.summary(rows, "rate", "good").first()["passes"] == 2
    assert ev.summary(rows, "trend", "v").first()["med"] == 4.0
    xml = ev.junit(ev.checks(rows, {"a<b": rows["good"], "all": rows["v"] > 0})).first()["xml"]
    assert 'name="a&lt;b"' in xml and 'failures="1"' in xml


def test_indexes_are_written(spark, tmp_path):
    refs = table(spark, 300, 8)
    ix.build_index(spark, refs, str(tmp_path / "kd"))
    back = spark.read.parquet(str(tmp_path / "kd/refs"))
    assert back.count() == 300 and {"leaf", "part", *Q} <= set(back.columns)
    assert ix.open_index(spark, str(tmp_path / "kd")).rows == 300
    assert spark.read.parquet(str(tmp_path / "kd/partitions")).count() == 3
    ix.build_index(spark, refs, str(tmp_path / "ivf"), kind="ivf", clusters=4)
    boxes = spark.read.parquet(str(tmp_path / "ivf/boxes"))
    assert boxes.agg({"n": "sum"}).first()[0] == 300 and "block_off" in boxes.columns
    with pytest.raises(ValueError):
        ix.build_index(spark, refs, str(tmp_path / "x"), kind="other")


def test_formats(spark):
    row = spark.createDataFrame([(999.0, 1500.0, 2.5e6, 0.5, 12.345, 75_000.0)], "a double, b double, c double, d double, e double, f double").select(
        rs.human_bytes(F.col("a")).alias("b0"), rs.human_bytes(F.col("b")).alias("b1"), rs.human_bytes(F.col("c")).alias("b2"),
        rs.human_duration(F.col("d")).alias("t0"), rs.human_duration(F.col("e")).alias("t1"), rs.human_duration(F.col("f")).alias("t2"),
        rs.trimmed_fixed(F.col("b")).alias("n0"), rs.trimmed_fixed(F.col("d")).alias("n1"), rs.percent_floor(F.lit(2), F.lit(3)).alias("p"),
    ).first()
    assert tuple(row) == ("999 B", "1.5 kB", "2.5 MB", "500µs", "12.34ms", "1m15s", "1500", "0.5", 66.66)


def test_probe_rank_refuses_what_it_cannot_send(spark, monkeypatch):
    monkeypatch.setattr(ix, "BROADCAST_CENTROIDS", 3)
    rows = lambda n, name, c: spark.createDataFrame([(i, *[i] * DIMS) for i in range(n)], f"{name} long, " + ", ".join(f"{x} int" for x in c))
    queries, columns = rows(2, "qid", Q), [f"c{i}" for i in range(DIMS)]
    with pytest.raises(ValueError):
        ix.probe_rank(queries, rows(4, "cluster", columns), 2)
    assert ix.probe_rank(queries, rows(3, "cluster", columns), 2).count() == 4


def test_forest_equals_brute_force_with_many_ties(spark):
    rng = np.random.default_rng(11)
    n = 3000
    q = rng.integers(0, 3, (n, DIMS)) * 100
    q[:, 9] = rng.integers(0, 2, n) * 10000
    ids = rng.permutation(n).astype(np.int64) * 300_000_007 - 2**40
    part = (rng.random(n) < 0.2).astype(int)
    refs = spark.createDataFrame([(int(i), int(p), 0, *map(int, v)) for i, p, v in zip(ids, part, q)], "ref_id long, part int, label int, " + ", ".join(f"{x} smallint" for x in Q))
    want = {}

    def cut(rows, p, node):
        if len(rows) <= 40:
            want.update({int(ids[r]): (p, node) for r in rows})
            return
        d = int((q[rows].max(0) - q[rows].min(0)).argmax())
        rows = sorted(rows, key=lambda r: (q[r, d], ids[r]))
        cut(rows[: len(rows) // 2], p, 2 * node)
        cut(rows[len(rows) // 2 :], p, 2 * node + 1)

    for p in (0, 1):
        cut(list(np.flatnonzero(part == p)), p, 1)
    for cell_rows in (5000, 700, 40):
        leaves = ix.forest(refs, most=40, cell_rows=cell_rows)
        rows = leaves.collect()
        assert {r["ref_id"]: (r["part"], r["node"]) for r in rows} == want
        sizes = {}
        for r in rows:
            sizes[r["cell"]] = sizes.get(r["cell"], 0) + 1
        assert max(sizes.values()) <= cell_rows


def test_indexes_are_searched(spark, tmp_path, monkeypatch):
    refs = table(spark, 900, 21, 3000)
    queries = table(spark, 60, 22, 3000).drop("label").withColumnRenamed("ref_id", "qid")
    want = sorted(knn.exact_neighbours(queries, refs).collect())
    said = ix.build_index(spark, refs, str(tmp_path / "kd"), cell_rows=128)
    assert said["rows"] == 900 and said["most"] <= 128
    index = ix.open_index(spark, str(tmp_path / "kd"))
    assert len(index.cells.cell) >= 6
    assert sorted(index.neighbours(queries, mode="broadcast").collect()) == want
    assert sorted(index.neighbours(queries, mode="chunked").collect()) == want
    monkeypatch.setattr(knn, "CELL_QUERIES", 5)
    monkeypatch.setattr(knn.search_cells, "__defaults__", (5,))  # crowded cells are searched by several tasks
    assert sorted(index.neighbours(queries, mode="chunked").collect()) == want
    monkeypatch.undo()
    votes = sorted(knn.votes(knn.exact_neighbours(queries, refs)).collect())
    centres = spark.createDataFrame([(i, *map(int, np.random.default_rng(i).integers(0, 3000, DIMS))) for i in range(7)], "cluster int, " + ", ".join(f"c{i} int" for i in range(DIMS)))
    ix.build_index(spark, refs, str(tmp_path / "ivf"), kind="ivf", centroids=centres, cell_rows=50)
    clusters = ix.open_index(spark, str(tmp_path / "ivf"))
    assert sorted(clusters.votes(queries, probes=7).collect()) == votes
    assert clusters.votes(queries).count() == 60
    assert 0 <= index.warm(20) <= 100 and 0 <= clusters.warm(20) <= 100
    with pytest.raises(ValueError):
        clusters.neighbours(queries)
    spark.createDataFrame([("kd", 99, 1)], "kind string, version int, rows long").write.mode("overwrite").parquet(str(tmp_path / "kd/meta"))
    with pytest.raises(ValueError):
        ix.open_index(spark, str(tmp_path / "kd"))


def test_what_is_sent_out_is_bounded(spark, monkeypatch):
    refs = table(spark, 50, 23)
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 60 * 49)
    with pytest.raises(ValueError):
        knn.pack(refs)
    queries = table(spark, 5, 24).drop("label").withColumnRenamed("ref_id", "qid")
    assert sorted(knn.neighbours(queries, refs).collect()) == sorted(knn.exact_neighbours(queries, refs).collect())


def test_kmeans_fills_empty_clusters(spark):
    rows = [(i, *([0] * DIMS if i < 30 else [9000] * DIMS)) for i in range(60)] + [(60 + i, *[100 * i] * DIMS) for i in range(8)]
    refs = spark.createDataFrame(rows, "ref_id long, " + ", ".join(f"{q} smallint" for q in Q))
    got = ix.kmeans(refs, k=6, iterations=4).collect()
    assert [r["cluster"] for r in got] == list(range(6))
    assert ix.assign(refs, spark.createDataFrame(got)).select("cluster").distinct().count() >= 5


@pytest.mark.parametrize("held", [10, 100, 10**6])
def test_percentiles_of_any_size(spark, held):
    rng = np.random.default_rng(12)
    v = np.round(rng.gamma(2, 50, 3000), 2)
    v[rng.random(3000) < 0.3] = 77.0
    rows = spark.createDataFrame([(("a", None, "b")[min(2, i % 7)], float(x)) for i, x in enumerate(v)] + [("empty", None)], "k string, v double")
    shares = [0.0, 0.31, 0.5, 0.99, 1.0]
    got = {r["k"]: r["p"] for r in ev.percentiles(rows, "v", shares, ("k",), held).collect()}
    for name, keep in (("a", [i % 7 == 0 for i in range(3000)]), (None, [i % 7 == 1 for i in range(3000)]), ("b", [i % 7 > 1 for i in range(3000)])):
        assert got[name] == pytest.approx(np.quantile(v[keep], shares).tolist(), abs=1e-9)
    assert ev.latency(rows, "v").first()["p99"] == pytest.approx(np.quantile(v, 0.99))
    assert ev.latency(rows.limit(0), "v").first()["p99"] is None
    assert ev.percentiles(rows.limit(0), "v", shares, ("k",), held).count() == 0


def test_judged_predictions(spark):
    expected = spark.createDataFrame([(1, True), (2, False), (3, True)], "entry_id long, expected boolean")
    said = spark.createDataFrame([(1, True), (1, False), (2, True), (9, True)], "entry_id long, approved boolean")
    assert sorted(tuple(r) for r in ev.judge(said, expected).collect()) == [(1, True, False), (2, False, True), (3, True, None)]


def nodes(q, ids, part, most, levels):
    """The node of each id, by sorting."""
    want = {}

    def cut(rows, p, node):
        if len(rows) <= most or node >= 1 << levels:
            want.update({int(ids[r]): (p, node) for r in rows})
            return
        d = int((q[rows].max(0) - q[rows].min(0)).argmax())
        rows = sorted(rows, key=lambda r: (q[r, d], ids[r]))
        cut(rows[: len(rows) // 2], p, 2 * node)
        cut(rows[len(rows) // 2 :], p, 2 * node + 1)

    for p in set(part.tolist()):
        cut(list(np.flatnonzero(part == p)), p, 1)
    return want


def test_forest_of_few_levels(spark):
    rng = np.random.default_rng(31)
    q, ids, part = rng.integers(0, 3, (1500, DIMS)) * 100, rng.permutation(1500) * 70_001, rng.integers(0, 2, 1500)
    refs = spark.createDataFrame([(int(i), int(p), 0, *map(int, v)) for i, p, v in zip(ids, part, q)], "ref_id long, part int, label int, " + ", ".join(f"{x} smallint" for x in Q))
    for levels, task_rows in ((3, 10_000), (3, 200), (3, 40), (62, 100)):
        rows = ix.forest(refs, most=20, cell_rows=60, levels=levels, task_rows=task_rows).collect()
        assert {r["ref_id"]: (r["part"], r["node"]) for r in rows} == nodes(q, ids, part, 20, levels)
        cells = {}
        for r in rows:
            cells.setdefault(r["cell"], []).append(r["node"])
        assert all(len(x) <= 60 or set(x) <= set(range(8, 16)) for x in cells.values())


def test_small_cells_are_searched_together(spark, tmp_path):
    refs = table(spark, 2000, 41, 3000)
    queries = table(spark, 50, 42, 3000).drop("label").withColumnRenamed("ref_id", "qid")
    ix.build_index(spark, refs, str(tmp_path / "kd"), cell_rows=128)
    index = ix.open_index(spark, str(tmp_path / "kd"))
    cells, to = index.cells.merged(400)
    assert len(index.cells.cell) >= 16 and len(cells.cell) <= 9 and cells.rows.sum() == 2000 and cells.rows.max() <= 400
    for i, c in enumerate(cells.cell):
        assert (cells.low[i] == index.cells.low[to == c].min(0)).all() and (cells.high[i] == index.cells.high[to == c].max(0)).all()
    sent, _ = index._merged
    assert len(sent.value.cell) == 3
    assert sorted(index.neighbours(queries, mode="chunked").collect()) == sorted(knn.exact_neighbours(queries, refs).collect())


def test_cells_of_clusters_are_apart(spark):
    refs = table(spark, 1500, 43, 3000)
    centroids = spark.createDataFrame([(i, *[i * 1500] * DIMS) for i in range(2)], "cluster int, " + ", ".join(f"c{i} int" for i in range(DIMS)))
    rows = ix.with_cells(ix.assign(refs, centroids), 130).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r["cluster"], r["cell"]), []).append([r[q] for q in Q])
    assert len(rows) == 1500 and len(cells) >= 12 and max(map(len, cells.values())) <= 130
    boxes = [(np.min(x, 0), np.max(x, 0)) for x in cells.values()]
    inside = sum(int(((low <= v) & (v <= high)).all()) for x in cells.values() for v in x for low, high in boxes)
    assert inside < 2 * 1500  # by id, a row lies in the boxes of most cells


def test_features_of_clusters_query_are_worked_out_once(spark, monkeypatch):
    from quintet.plans import queries as plans

    calls, real = [], plans.rq.requests_from_events
    monkeypatch.setattr(plans.rq, "requests_from_events", lambda df: calls.append(1) or real(df))
    assert plans.queries()["score_with_clusters"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_keys_of_blocks_are_exact_in_both_forms():
    rng = np.random.default_rng(8)
    q = rng.integers(-10_000, 10_001, (3000, 14)).astype(np.int16)
    q[1000:2000] = q[:1000]  # ties
    x = np.concatenate((q[500:700], rng.integers(-10_000, 10_001, (100, 14)).astype(np.int16)))
    d = ((x[:, None].astype(np.int64) - q.astype(np.int64)) ** 2).sum(2)
    want = np.sort((d << 12) | np.arange(3000), axis=1)[:, :5]
    for most in (None, 1 << 28):  # too large for double precision
        b = Blocks(np.arange(3000), q, np.zeros(3000), np.zeros(3000, np.int64), 64)
        b.most = most or b.most
        distance, row = b.nearest(x)
        assert (distance == want >> 12).all() and (row == want & 4095).all()
