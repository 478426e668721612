"""Vectors worked out by hand, and edge cases of parsing and scoring."""

import json

import pytest
from pyspark.sql import functions as F

from quintet.functions.features import Q
from quintet.operators.rules import even_tree, route, rule_frauds, rule_leaf
from quintet.operators.score import score
from quintet.sources import requests as rq


def request(**changes):
    base = {
        "id": "x",
        "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"},
        "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001"]},
        "merchant": {"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.7090520965},
        "last_transaction": {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774},
    }
    for k, v in changes.items():
        if isinstance(v, dict):
            base[k] = {**base[k], **v} if base[k] else v
        else:
            base[k] = v
    return base


LATE = request(
    transaction={"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    customer={"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008"]},
    merchant={"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    terminal={"is_online": False, "card_present": True, "km_from_home": 952.27},
)
NO_LAST = {**LATE, "last_transaction": None}
AHEAD = {
    **LATE,
    "transaction": {**LATE["transaction"], "amount": 12000, "installments": 12},
    "customer": {**LATE["customer"], "tx_count_24h": 25},
    "merchant": {**LATE["merchant"], "mcc": "9999"},
    "terminal": {**LATE["terminal"], "is_online": True, "card_present": False},
    "last_transaction": {"timestamp": "2026-03-14T06:15:12Z", "km_from_current": 5000},
}


def parsed(spark, *rows):
    texts = [(str(i), r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    return rq.parse_requests(spark.createDataFrame(texts, "id string, value string").withColumnRenamed("id", "n"), keep=("n",))


@pytest.mark.parametrize(
    "row, want, part, leaf, frauds",
    [
        (request(), [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299], 5, 0, 0),
        (NO_LAST, [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55], 252, 250, 5),
        (AHEAD, [10000, 10000, 10000, 2174, 8333, 0, 10000, 9523, 10000, 10000, 0, 10000, 5000, 55], 235, None, None),
    ],
)
def test_golden_vectors(spark, row, want, part, leaf, frauds):
    got = rq.vectors(parsed(spark, row), ("n",)).select("*", rule_leaf().alias("leaf"), rule_frauds().alias("frauds")).first()
    assert [got[q] for q in Q] == want
    assert (got["part"], got["leaf"], got["frauds"]) == (part, leaf, frauds)


def test_zero_average_known_limit_and_missing_parts(spark):
    rows = [
        request(customer={"avg_amount": 0.0}),
        request(customer={"avg_amount": 0.0}, transaction={"amount": 0.0}),
        request(customer={"avg_amount": 0.0}, transaction={"amount": -1.0}),
        request(customer={"known_merchants": [f"M{i}" for i in range(16)] + ["MERC-001"]}),
        {"transaction": {"requested_at": "2026-03-11T20:23:35"}},
    ]
    got = [r.asDict() for r in rq.vectors(parsed(spark, *rows), ("n", "malformed")).orderBy("n").collect()]
    assert [r["q2"] for r in got[:3]] == [10000, 10000, 0]
    assert got[3]["q11"] == 10000 and got[0]["q11"] == 0
    assert not got[4]["malformed"] and got[4]["q0"] == 0 and got[4]["q5"] == -10000 and got[4]["q12"] == 5000


def test_malformed_is_approved_and_few_references_count_as_legit(spark):
    refs = rq.vectors(parsed(spark, request(), request()), ("n",)).select(F.col("n").cast("long").alias("ref_id"), *Q, F.lit(1).cast("byte").alias("label"), "part")
    rows = parsed(spark, request(), "no json", NO_LAST).drop("id").withColumnRenamed("n", "id")
    got = {r["id"]: r for r in score(rows, refs).collect()}
    assert (got["0"]["frauds"], got["0"]["approved"], got["0"]["fraud_score"]) == (2, True, 0.4)
    assert (got["1"]["frauds"], got["1"]["approved"], got["1"]["malformed"]) == (0, True, True)
    ruled = {r["id"]: r for r in score(rows, refs, rules=True).collect()}
    assert ruled["2"]["frauds"] == 5 and not ruled["2"]["approved"]
    assert {r["frauds"] for r in score(rows, refs.limit(0)).collect()} == {0}


def test_tree_routes_rows_to_leaves(spark):
    uneven = [(0, 0, 10, 5, -1), (5, 3, 20, -2, 9), (9, 0, 5, -3, -4)]
    points = [(x, y) for x in (0, 5, 6, 10, 11) for y in (20, 21)]
    rows = spark.createDataFrame([(x, 0, 0, y, *[0] * 10) for x, y in points], ", ".join(f"{q} smallint" for q in Q))
    got = {(r["q0"], r["q3"]): r["leaf"] for r in route(rows, uneven).collect()}
    assert got == {(x, y): 0 if x > 10 else 1 if y <= 20 else 2 if x <= 5 else 3 for x, y in points}
    full = {(r["q0"], r["q3"]): r["leaf"] for r in route(rows, even_tree([(0, 10), (3, 20), (0, 5)])).collect()}
    assert full == {(x, y): 4 * (x > 10) + 2 * (y > 20) + (x > 5) for x, y in points}
    assert {r["leaf"] for r in route(rows, []).collect()} == {0}


def test_model_files(spark, tmp_path):
    nodes = even_tree([(0, 10), (3, 20), (0, 5)])
    rq.write_model(spark, nodes, [0, 1, 2, 3, 4, 5, 0, 1], str(tmp_path / "m"))
    back, leaves = rq.read_model(spark, str(tmp_path / "m"))
    assert back == sorted(nodes) and [r["frauds"] for r in leaves.orderBy("leaf").collect()] == [0, 1, 2, 3, 4, 5, 0, 1]
    for bad, counts in ((nodes[:-1], list(range(8))), (nodes, list(range(7))), ([*nodes, (99, 0, 0, -1, -2)], list(range(8)))):
        rq.write_model(spark, bad, counts, str(tmp_path / "bad"))
        with pytest.raises(ValueError):
            rq.read_model(spark, str(tmp_path / "bad"))


def test_scores_do_not_depend_on_ids(spark):
    rows = [request(transaction={"amount": float(a), "installments": a % 12}, id=i) for a, i in ((10, None), (5000, None), (9000, "a"), (20, "a"), (10, "b"))]
    want = None
    refs = spark.createDataFrame([(k, k % 2, 0, *[k * 700 % 10000] + [500 * (k % 7)] * 13) for k in range(60)], "ref_id long, label int, part int, " + ", ".join(f"{q} smallint" for q in Q))
    plain = [request(transaction={"amount": float(a), "installments": a % 12}, id=str(k)) for k, a in enumerate((10, 5000, 9000, 20, 10))]
    want = [r["frauds"] for r in score(parsed(spark, *plain), refs).orderBy("id").collect()]
    got = score(parsed(spark, *rows).withColumn("id", F.col("id")), refs, id_col="n").orderBy("id").collect()
    assert [r["frauds"] for r in got] == want
    by_id = score(parsed(spark, *rows), refs).collect()
    assert sorted((str(r["id"]), r["frauds"]) for r in by_id) == sorted((str(r["id"]), f) for r, f in zip(rows, want))
    assert score(parsed(spark, *rows).limit(0), refs).count() == 0


def test_references_and_evaluation_from_json(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps([{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [-1] * 15, "label": "legit", "x": 1}, {"vector": [1] * 13, "label": "fraud"}, {"label": "fraud"}, {"vector": [0] * 14}]))
    got = rq.read_references(spark, str(tmp_path / "refs.json")).orderBy("ref_id").collect()
    assert [(r["ref_id"], r["q0"], r["q13"], r["label"]) for r in got] == [(0, -10000, -10000, 0), (1, 5000, 5000, 1)]  # in order of their values
    rq.write_references(rq.read_references(spark, str(tmp_path / "refs.json")), str(tmp_path / "t"))
    assert rq.open_references(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"request": request(), "expected_approved": True, "expected_fraud_score": 0.2}], "stats": {}}))
    e = rq.read_evaluation(spark, str(tmp_path / "e.json")).first()
    assert e["expected_approved"] and e["transaction"]["installments"] == 3
    (tmp_path / "log").write_text('k6-1  | up\nk6-1  | {\nother | x\nk6-1  |   "a": 1\nk6-1  | }\nk6-1  | bye\n')
    assert [r["line"] for r in rq.read_result_log(spark, str(tmp_path / "log")).collect()] == ["{", '  "a": 1', "}"]
