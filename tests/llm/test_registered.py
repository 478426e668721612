"""The registered queries: those with SQL against DuckDB, the pipeline against its stages by brute force."""

import duckdb
import pytest

import corpus_pipeline
from quintet.llm import queries as llm
from quintet.llm import simhash, tokens, toxicity
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def hits(text, items):
    """Words of a text, and those in an occurrence of an item's window."""
    w, hit = words(text), set()
    places = {}
    for n in {len(g) for g in items}:
        for k in range(len(w) - n + 1):
            places.setdefault(tuple(w[k : k + n]), []).append(k)
    for g in items:
        for k in places.get(g, ()):
            hit.update(range(k, k + len(g)))
    return len(w), len(hit)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = llm.queries()[name](spark, SF)
    assert set(got.columns) == set(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, cur.fetchall()))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    kept = stages["toxicity"](spark, docs, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if model.at_least([model.score(t)])[0, 0] < 0.5}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(rows)
    root = brute_components([(i, brute_fingerprint(t)) for i, t in rows.items()])
    rows = {i: t for i, t in rows.items() if root[i] == i}
    kept = stages["simhash"](spark, kept, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(rows)
    bench = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(p[k : k + 13]) for p in bench for k in range(max(1, len(p) - 12) if p else 0)}
    hit = {i: hits(t, windows) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if not (hit[i][1] and 20 * hit[i][1] >= hit[i][0])}
    kept = stages["decontamination"](spark, kept, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(rows)
    mixed = stages["mixing"](spark, kept, SF)
    assert mixed.columns == docs.columns
    want = sorted((r["doc_id"], len(tokens.encoder(tokens.default_path()).whole(r["text"])) + 1) for r in mixed.collect())
    assert {i for i, _ in want} <= set(rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in stages["tokens"](spark, mixed, SF).collect()) == want


def test_one_of_each_group_stays_with_repeats_and_null_ids(spark):
    rows = [(5, "same text here for all"), (3, "same text here for all"), (3, "same text here for all"), (None, "same text here for all"), (9, "another one entirely, with words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one_of_each(docs).collect()) == ["3", "9", "None"]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_with_nulls_repeats_other_columns_and_empty_tables(spark, tmp_path, empty):
    long = "A very long text without any white space: " + "x" * 300_000
    rows = [(1, "calm words of one document here", "en", "a", 5), (1, "calm words of one document here", "en", "a", 5), (None, "no id at all, but a text of its own", None, None, None), (3, None, "en", "b", 0), (4, "", "en", None, 0), (5, " \n\t ", "xx", "b", 3), (6, long, "en", "a", 9), (7, long + " y", "en", "a", 9), (8, "What is the capital city of that far country, asked the teacher of the class again?", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("fp", "pair", "bucket", "size", "copies", "key", "component_id", "toxic", "start", "_id"):
        docs = docs.withColumn(c, docs["n_chars"])
    bench = spark.createDataFrame([(1, "What is the capital city of that far country, asked the teacher of the class again?"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (3, None, 1), (None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", bench), ("labels", labels)):
        (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns, name
        ids = [r["doc_id"] for r in kept.collect()]
        if empty:
            assert ids == []
        elif name == "simhash":
            assert ids.count(1) == 1 and None in ids and 3 in ids and 4 not in ids and 5 not in ids
        elif name == "decontamination":
            assert 8 not in ids and {1, 3} <= set(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not got if empty else {r["doc_id"] for r in got} >= {None, 1}
    assert all(r["n_tokens"] > 0 for r in got)
