import random

import numpy as np

from quintet.llm import toxicity as tx


def test_ordinal_fit_recovers_order():
    rng = random.Random(3)
    rows, grades = [], []
    for _ in range(1500):
        r = {f: 1.0 for f in ("mild", "bad", "n1", "n2", "n3") if rng.random() < 0.4}
        z = 2.5 * ("mild" in r) + 5 * ("bad" in r) + rng.gauss(0, 1)
        rows.append(r)
        grades.append((z > 2) + (z > 5))
    m = tx.OrdinalModel.fit(rows, grades)
    assert m.weights["bad"] > m.weights["mild"] > 1 and abs(m.weights["n1"]) < 0.6
    assert m.thresholds[0] < m.thresholds[1]
    above = m.at_least(np.array([-3.0, 0, 3, 9]))
    assert (np.diff(above, axis=0) > 0).all() and (above[:, 0] > above[:, 1]).all()


def test_one_kind_of_label_gives_no_weights():
    assert tx.OrdinalModel.fit([{"a": 1.0}] * 3, [0, 0, 0]).weights == {}
    assert not (tx.OrdinalModel.fit([], []).at_least(np.zeros(1)) >= 0.5).any()


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    rows, truth = [], {}
    for i in range(900):
        ws = rng.choices(vocabulary, k=rng.randrange(3, 120))
        truth[i] = i % 4 == 0
        if truth[i]:
            for _ in range(rng.randrange(2, 8)):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(["Insult", "scorn" + rng.choice(["ed", "ing", "ful", "s"]), "vile!"]))
        rows.append((i, " ".join(ws), 1))
    rows += [(1000, None, 1), (1001, "", 1), (None, "vile insult scorned", 1), (1, rows[1][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(t)) for i, t in truth.items() if i < 600] + [(5, None), (None, 1), (5000, 1), (1, 0)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [r["toxic"] == truth[r["doc_id"]] for r in got if r["doc_id"] is not None and 600 <= r["doc_id"] < 900]
    assert sum(held) / len(held) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert by[None]["toxic"] and not by[1000]["toxic"] and not by[1001]["toxic"]
    assert by[None]["expected_severity"] > by[1001]["expected_severity"]
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in got)
    assert not tx.score(docs, tx.train(docs, labels.limit(0))).where("toxic").count()
    assert tx.score(docs.limit(0), model).count() == 0


def test_scores_equal_the_formula(spark):
    import math
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = tx.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert model.weights
    got = {r["doc_id"]: r for r in tx.score(docs, model, probability=True).collect()}
    for r in docs.collect():
        count = {}
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", (r["text"] or "").lower()):
            for f in [w, *(w[:k] + "*" for k in (4, 5) if len(w) >= k)]:
                count[f] = count.get(f, 0) + 1
        z = sum(model.weights.get(f, 0.0) * (1 + math.log(n)) for f, n in count.items())
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        row = got[r["doc_id"]]
        assert abs(row["expected_severity"] - sum(above)) < 1e-9 and abs(row["p_toxic"] - above[0]) < 1e-9
        assert row["grade"] == max(range(3), key=lambda k: (each[k], -k)) and row["toxic"] == (above[0] > 0.5)


def test_conflicting_rows_make_one_model(spark):
    texts = [f"calm words number {i} here" if i % 3 else f"vile scorn number {i} insult" for i in range(90)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "calm"), (3, "another text of three"), (4, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(6, 0), (7, 1), (8, None)]
    models = []
    for turn in (1, -1):
        d, label = (spark.createDataFrame(x[::turn], s).repartition(3) for x, s in ((docs, "doc_id long, text string"), (labels, "doc_id long, toxic int")))
        models.append(tx.train(d, label))
    assert models[0].weights == models[1].weights and models[0].weights
    assert (models[0].thresholds == models[1].thresholds).all()


def test_held_out_rows_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    row = tx.held_out(docs, labels).first()
    print(row)
    assert row["n"] > 300 and row["accuracy"] > 0.97 and row["recall"] > 0.9 and row["precision"] > 0.9
    assert abs(row["predicted"] - row["toxic"]) < 0.03 and row["brier"] < 0.03
