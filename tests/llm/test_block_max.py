"""Ranked search against scores computed document by document."""

import math
import random
import re

import numpy as np
import pytest

from orderlens.llm import block_max
from orderlens.llm.block_max import build_index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    held = [(doc, terms(text)) for doc, text in docs]
    held = [(doc, t) for doc, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for word in set(t):
            df[word] = df.get(word, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, t in held:
            m = 100 - 25 + (25 * len(t) * n_docs) // total
            score = 0
            for word in terms(text):
                tf = t.count(word)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[word] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def random_docs(seed, n=1500):
    rng = random.Random(seed)
    words = [f"{'aéñ'[i % 3]}W{i}" for i in range(300)]
    docs = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 20, 60, 400 if i % 97 == 0 else 5])
        docs.append((i * 3 % n, rng.choice([" ", "\n", ", ", "-"]).join(words[int(300 * rng.random() ** 3)] for _ in range(size))))
    docs += docs[5:8] * 40 + [(None, "aw0 éw1 ñw2"), (None, None), (7, None), (8, "...")]
    items = [(i, " ".join(words[int(300 * rng.random() ** 2)] for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(30)]
    return docs, [*items, (90, None), (91, ""), (92, "unknown words"), (3, "AW0 aw0 ÉW1"), (None, "ñw2")]


@pytest.mark.parametrize(("shard", "window", "seed"), [(1 << 23, 2048, 1), (20_000, 128, 2), (3_000, 16, 3)])
def test_same_as_brute_force(spark, shard, window, seed):
    docs, items = random_docs(seed)
    index = build_index(spark.createDataFrame(docs, SCHEMA).repartition(3), shard_bytes=shard)
    found = search(index, spark.createDataFrame(items, "item_id long, text string"), window=window)
    assert rows(found) == brute(docs, items)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(block_max, "ITEMS_AT_ONCE", 7)
    docs, items = random_docs(5, 200)
    index = build_index(spark.createDataFrame(docs, SCHEMA))
    assert rows(search(index, spark.createDataFrame(items, "item_id long, text string"), k=3)) == brute(docs, items, 3)


def test_empty_tables_and_texts(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs in ([], [(1, None), (2, ""), (3, "!!")]):
        found = search(build_index(spark.createDataFrame(docs, SCHEMA)), items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and not found.collect()
    index = build_index(spark.createDataFrame([(1, "a b")], SCHEMA))
    assert not search(index, items.limit(0)).collect()


def test_long_text_ties_and_clashing_columns(spark):
    long = "common " * 300_000 + "rare " * 70_000
    docs = [(5, "rare"), (4, "rare"), (9, long), (6, "common")]
    frame = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, shard int, term binary")
    items = spark.createDataFrame([(1, "rare common", 3)], "item_id long, text string, score int")
    assert rows(search(build_index(frame, shard_bytes=4096), items)) == brute(docs, [(1, "rare common")])


def test_terms_of_equal_polynomial_name_stay_apart(spark):
    """Thue-Morse words of 2,048 letters have one value under any polynomial modulo 2**64."""
    sign = np.array([bin(i).count("1") % 2 for i in range(2048)])
    one, two = ("".join("ab"[b] for b in s) for s in (sign, 1 - sign))
    docs = [(1, one), (2, two)]
    index = build_index(spark.createDataFrame(docs, SCHEMA))
    found = search(index, spark.createDataFrame([(1, one)], "item_id long, text string"))
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_rejected_blocks_stay_packed(spark):
    """Bounds drop candidates, so frequent terms are not unpacked everywhere."""
    n = 4096
    lengths = np.full(n, 10)
    penalty = 75 + 25 * lengths // 10

    def postings(docs, counts, weight):
        size = len(docs)
        blocks = range(0, size, block_max.BLOCK)
        heads = np.zeros(len(blocks), dtype=block_max._HEAD)
        pairs = np.zeros(len(blocks), dtype=block_max._PAIR)
        payload = b""
        for i, b in enumerate(blocks):
            ds, cs = docs[b : b + 128], counts[b : b + 128]
            gaps = np.diff(np.r_[docs[b - 1] if b else -1, ds])
            heads[i] = (ds[-1], 4, 4, 1)
            pairs[i] = (cs.max(), 10)
            payload += gaps.astype("<u4").tobytes() + cs.astype("<u4").tobytes()
        scale = lambda x: 75 + 25 * x // 10
        return block_max._Postings(weight, size, heads.tobytes(), pairs.tobytes(), payload, penalty, scale)

    everywhere = postings(np.arange(n), np.r_[np.full(128, 9), np.ones(n - 128, dtype=int)], 10)
    rare = postings(np.arange(0, n, 64), np.r_[np.full(20, 5), np.ones(44, dtype=int)], 5000)
    best = block_max._Best(20)
    block_max._search_shard([(1, everywhere), (1, rare)], best, np.zeros(n, bool), np.arange(n), 1280)
    assert best.id.tolist()[:2] == [0, 64] and len(best.id) == 20
    assert everywhere._packed.sum() > len(everywhere._packed) // 2
