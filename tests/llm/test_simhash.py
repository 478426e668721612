import random

import numpy as np
import xxhash

from quintet.llm import simhash
from quintet.llm.common import connected_components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, budget=4):
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in items:
        for b, y in items:
            if a < b and (x ^ y).bit_count() <= budget:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in items}


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "A", "a b c", "a b c d", "Ä Éa b\x0bC d\x1ce f", "x " * 5000]
    texts += [" ".join(rng.choice("ab cd ef gh Ij klé mn".split()) for _ in range(rng.randrange(1, 60))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)])
    groups = np.arange(len(codes)) % 3
    order = np.lexsort((codes, groups))
    codes, groups = codes[order], groups[order]
    cut = np.concatenate((np.flatnonzero(np.diff(groups, prepend=-1)), [len(codes)]))
    own = (cut[:-1], cut[1:], cut[:-1], cut[1:])
    for leaf in (1, 48):
        found = {(int(a), int(b)) for i, j in simhash.trie_self_join(codes, own, 0, 4, leaf) for a, b in zip(i, j)}
        want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if groups[i] == groups[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}
        assert found == want


def test_the_walk_prunes_and_compares_few_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    codes = np.sort(np.concatenate((rng.integers(0, 2**63, 3000, dtype=np.uint64), np.uint64(7) << rng.integers(0, 60, 500).astype(np.uint64))))
    codes = np.unique(codes)
    compared = []
    verify = simhash._verify
    monkeypatch.setattr(simhash, "_verify", lambda codes, la, ha, lb, hb, budget: compared.append(int(((ha - la) * (hb - lb)).sum())) or verify(codes, la, ha, lb, hb, budget))
    zero, n = np.array([0]), np.array([len(codes)])
    found = sum(len(i) for i, _ in simhash.trie_self_join(codes, (zero, n, zero, n), 0, 4))
    x = codes[:, None] ^ codes
    assert found == int((np.triu(np.bitwise_count(x), 1) + 99 * np.tri(len(codes)) <= 4).sum())
    assert sum(compared) < len(codes) ** 2 / 4  # of half as many pairs


def test_two_nodes_are_walked_together():
    rng = np.random.default_rng(6)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in rng.integers(0, 2**63, 30, dtype=np.uint64)]))
    ids = np.arange(len(codes)) + 100
    side = np.where(codes >> np.uint64(62) == 0, 1, 2)
    u, v = simhash.trie_links(np.full(len(codes), 9), side, codes, ids, 0, 4)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if side[i] != side[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}
    items = [int(x) for x in ids]
    got = {(int(a), int(b)) for a, b in zip(u, v)}
    root = {i: i for i in items}

    def parts(links):
        root = {i: i for i in items}
        for a, b in links:
            p, q = root[a], root[b]
            root = {k: min(p, q) if r in (p, q) else r for k, r in root.items()}
        return root

    assert parts(got) == parts({(i + 100, j + 100) for i, j in want}) and root


def test_components_equal_brute_force_with_any_blocks_and_nodes_walked_down(spark):
    rng = random.Random(5)
    items = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            items.append(x)
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
    items = [(k, x) for k, x in enumerate(dict.fromkeys(items))]
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in items]
    codes = spark.createDataFrame(signed, "id long, fp long")
    want = brute_components(items)
    for blocks, rows in ((5, 20_000), (6, 20_000), (7, 3), (5, 2)):
        links = simhash.fingerprint_links(codes, blocks=blocks, node_rows=rows)
        got = {r.node: r.component for r in connected_components(links).collect()}
        assert {k: got.get(k, k) for k, _ in items} == want


def test_documents_with_nulls_copies_and_other_columns(spark):
    long = "Lorem ipsum " * 30_000
    rows = [(5, None), (3, ""), (9, " \n"), (7, "a b c d e"), (2, "A B C D E"), (2, "A B C D E"), (None, "a b c d e"), (11, long), (12, long + "x"), (20, "quite other words here now")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[(5, "0" * 16)] == by[(3, "0" * 16)] == by[(9, "0" * 16)] == 3
    same = f"{brute_fingerprint('a b c d e'):016x}"
    assert by[(7, same)] == by[(2, same)] == by[(None, same)] == 2
    items = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute_components(list(dict(items).items()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 230)] + [(None, 3), (4, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {x: 100 for x in range(100, 161)} | {x: 200 for x in range(200, 230)}
