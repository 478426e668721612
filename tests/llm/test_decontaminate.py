import hashlib
import random
import re

from quintet.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, phrase in items:
        p = words(phrase)
        for i in range(max(1, len(p) - 12) if p else 0):
            g = p[i : i + 13]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None), hit


def cases():
    rng = random.Random(4)
    pool = "the of and to In cat dog Über naïve a1 b2 c3".split()
    items = [(1, " ".join(rng.choices(pool, k=30))), (2, "Short one, here!"), (3, None), (4, " .. "), (2, "Short one, here!"), (None, "nobody knows this phrase"), (50, " ".join(rng.choices(pool, k=13)))]
    texts = [None, "", "...", "short ONE here", "a short-one: HERE and short one here.", items[0][1], "nobody knows this phrase", "x " * 300 + items[0][1] + " y" * 300]
    for _ in range(40):
        t = rng.choices(pool, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            p = words(rng.choice([items[0][1], items[6][1]]))
            a = rng.randrange(0, len(p))
            at = rng.randrange(0, len(t) + 1)
            t[at:at] = p[a : a + rng.randrange(5, 30)]
        texts.append(" ".join(t))
    return items, texts


def test_search_equals_brute_force_in_any_shards(monkeypatch):
    items, texts = cases()
    data = [t.encode() if t is not None else None for t in texts]
    block = [(i, t.encode() if t is not None else None) for i, t in items]
    for shard, blocks in ((1 << 20, [block]), (17, [block]), (50, [block[:2], block[2:]])):
        monkeypatch.setattr(dc, "SHARD", shard)
        for t, (n, hit, found, spans) in zip(texts, dc.search(data, [dc.Phrases(b) for b in blocks])):
            want = brute(t, items)
            assert (n, hit, found) == want[:3]
            assert {k for a, b in spans for k in range(a, b)} == want[3]
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_removal_of_spans():
    text = "One, two three! Four five."
    (_, _, _, spans), = dc.search([text.encode()], [dc.Phrases([(1, b"two THREE")])])
    assert spans == [(1, 3)] and dc.remove_spans(text, spans) == "One, ! Four five."


def test_documents(spark):
    items, texts = cases()
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(texts)] + [(None, "short one here", 0, "z")] * 2, "doc_id long, text string, n_hit int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 1):
        got = {r["doc_id"]: r for r in dc.find_passages(docs, bench, block_bytes=size).collect()}
        for i, t in enumerate(texts):
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute(t, items)[:3]
    kept = {r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not (brute(t, items)[1] and 20 * brute(t, items)[1] >= brute(t, items)[0])}
    assert dc.drop_contaminated(docs, bench).columns == docs.columns
    assert dc.find_passages(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert dc.find_passages(docs.limit(0), bench).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_items_keep_their_type(spark):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(f"q-{i}" if i is not None else None, t) for i, t in items], "item_id string, text string")
    found = dc.find_passages(docs, bench)
    want = {i: sorted(f"q-{x}" for x in brute(t, items)[2]) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["items"] for r in found.collect()} == want
    digest = {r["doc_id"]: r["d"] for r in found.select("doc_id", dc.items_sha256(found["items"]).alias("d")).collect()}
    assert digest == {i: hashlib.sha256(",".join(x).encode()).hexdigest() for i, x in want.items()}
