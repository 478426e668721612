from quintet.llm import mixing


def brute_targets(sizes):
    """Share by weight, cap, and share the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    return target


def table(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")


def test_mix(spark):
    rows = [(k, "w " * (k % 17), ["a", "b", "c", "d", "é", None][k % 6] if k % 3 else "hot") for k in range(400)]
    rows += [(400, None, "empty"), (401, "", "empty"), (None, "x y", "a"), (7, "w w", "a"), (7, "w w", "a"), (402, "big " * 3000, "d")]
    df = table(spark, rows)
    for ranges in (16_384, 1):
        got = mixing.mix(df, ranges=ranges).collect()
        assert len(got) == len(rows)
        sizes = {}
        for r in got:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        want = brute_targets(sizes)
        for s in sizes:
            own = [r for r in got if r["source"] == s]
            assert {r["source_size"] for r in own} == {sizes[s]}
            assert abs(own[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
            assert sum(r["taken"] for r in own) == int(own[0]["target"])
            assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert sorted(map(str, mixing.mix(df.repartition(3), ranges=ranges).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_are_whole(spark):
    rows = [(k, f"t{k} " * 5, "ab"[k % 2]) for k in range(60)] + [(None, "u v", "a")]
    df = table(spark, rows)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    found = got.collect()
    assert {(r["doc_id"], r["text"]) for r in found} <= {(r[0], r[1]) for r in rows}
    words = {s: sum(len(r["text"].split()) for r in found if r["source"] == s) for s in "ab"}
    want = brute_targets({"a": 152, "b": 150})
    assert all(abs(words[s] - want[s]) <= 5 for s in "ab")
