import zlib

import numpy as np
import pytest

from quintet.llm import rans, tokens


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 8192, 8193, 32768, 32769, 70001])
def test_file_round_trip_and_parts(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.geometric(0.01, n), 60000).astype(np.uint32)
    f = rans.File(rans.encode(x, [None, 5], [n // 2, n - n // 2]))
    assert np.array_equal(f.decode(), x) and f.doc_ids == [None, 5]
    for a, b in ((0, 1), (n // 3, n // 2), (n - 5, n), (8000, 9000), (n, n + 3)):
        a = max(0, a)
        assert np.array_equal(f.decode(a, b), x[a:b])


def test_damage_is_noticed():
    x = np.arange(50_000, dtype=np.uint32) % 700
    good = rans.encode(x, [1], [50_000])
    for at in (20, len(good) // 2, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.File(bytes(bad)).decode()
    with pytest.raises(ValueError):
        rans.File(good[:-8])


def test_code_is_near_entropy():
    rng = np.random.default_rng(0)
    x = rng.choice(256, 200_000, p=(w := 1 / np.arange(1, 257)) / w.sum()).astype(np.uint32)
    p = np.bincount(x) / len(x)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(x)
    assert len(rans.encode(x, [1], [len(x)])) * 8 < 1.06 * bits


TEXTS = ["Hello, world! It's don't 've", "  two  spaces\n\nand\tmore \n x ", "naïve Übung 中文 ²ª ǅ", "", "a" * 5000, "<|endoftext|> inside", "word,word; (x) 'quoted' \x1c sep \x85 nel\xa0nbsp", "line\nline.\n", "tail ", " head", "x!!! y*** z%%%"]


def test_pieces_equal_whole_texts():
    e = tokens.Encoder(tokens.default_path())
    assert e.cuts
    for t in TEXTS:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole(t)


def test_pieces_survive_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 5)
    e = tokens.Encoder(tokens.default_path())
    for t in TEXTS * 3:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole(t)


def test_files_of_documents(spark):
    rows = [(k * 7 % 50, f"document {k} " + TEXTS[k % len(TEXTS)]) for k in range(50)] + [(3, "again"), (3, "again"), (None, "no id"), (99, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    folder, before = tokens.write_tokens(docs, range_bytes=200)
    got = tokens.read_tokens(spark, folder, before, with_ids=True).collect()
    whole = tokens.Encoder(tokens.default_path()).whole
    want = sorted((i is not None, i or 0, tuple(whole(t or "") + [2])) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert tokens.read_tokens(spark, *tokens.write_tokens(docs.limit(0))).count() == 0
