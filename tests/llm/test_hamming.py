import numpy as np
import pytest

from quintet.llm import hamming as hm


@pytest.mark.parametrize("n, width, spread", [(0, 8, 1), (1, 8, 1), (7, 8, 3), (400, 8, 4), (900, 8, 64), (300, 3, 24), (200, 16, 20)])
def test_search_equals_brute_force(n, width, spread):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2, (4, 8 * width))
    bits = centre[rng.integers(0, 4, n)] ^ (rng.random((n, 8 * width)) < spread / 200)
    codes = np.packbits(bits.astype(bool), axis=1).reshape(n, width)
    ids = rng.permutation(n) // 2  # some ids twice
    queries = np.concatenate((codes[:20], rng.integers(0, 256, (5, width)).astype(np.uint8)))
    q, d, found = hm.MultiIndex(codes, ids).search(queries, 10)
    for i in range(len(queries)):
        all_d = np.unpackbits(codes ^ queries[i], axis=1).sum(1) if n else np.zeros(0, int)
        assert sorted(zip(d[q == i].tolist(), found[q == i].tolist())) == sorted(zip(all_d.tolist(), ids.tolist()))[:10]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=64)], "x") for i in range(120)]
    rows += [(None, [1.0] * 64, "x"), (130, None, "x"), (150, [], "x"), (200, [float("nan"), None, 2.0], "x"), (7, rows[7][1], "x"), (50, rows[50][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance string")
    coded = [(i, sum(1 << k for k, x in enumerate(v[:64]) if x is not None and x > 0)) for i, v, _ in rows if i is not None and v is not None]
    for options in ({}, {"query_block": 2}, {"sample": 20, "shard": 30}, {"sample": 4, "shard": 7, "query_block": 2}):
        got = {}
        for r in hm.top_k(df, **options).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
        assert set(got) == {0, 50, 100, 150, 200}
        for i, code in coded:
            if i in got:
                want = sorted(((code ^ c).bit_count(), j) for j, c in coded)[:10]
                assert [x[1:] for x in sorted(got[i])] == want
    assert hm.top_k(df.limit(0)).count() == 0
