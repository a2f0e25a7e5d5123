"""Fingerprints against a plain loop, edit distances against dynamic programming, successors by sorting."""

import hashlib
import random

import numpy as np

from orderlens.llm import piecewise_hash as ph


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances():
    pick = random.Random(2)
    letters = ph.ALPHABET.tobytes().decode()
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("A" * 64, "A" * 63 + "B")]
    for _ in range(300):
        a = "".join(pick.choices(letters[: pick.choice([2, 8, 64])], k=pick.randrange(65)))
        b = list(a)
        for _ in range(pick.randrange(20)):
            b[pick.randrange(len(b) + 1) : pick.randrange(len(b) + 1)] = pick.choices(letters, k=pick.randrange(3))
        pairs.append((a, "".join(b)[:64]))
    got = ph.edit_distances(*zip(*pairs, strict=True))
    assert got.tolist() == [distance(a, b) for a, b in pairs]


def test_fingerprints_do_not_depend_on_neighbours():
    pick = random.Random(3)
    texts = [bytes(pick.choices(range(97, 123), k=pick.choice([0, 1, 5, 100, 5000, 70_000]))) for _ in range(40)]
    alone = [ph.fingerprints([t])[0] for t in texts]
    assert ph.fingerprints(texts) == alone
    for text, (block, one, two) in zip(texts, alone, strict=True):
        rolled = ph._rolling(np.frombuffer(bytes(7) + text, dtype=np.uint8))[7:] if text else np.zeros(0, np.uint32)
        for size, signature in ((block, one), (2 * block, two)):
            cuts = [i + 1 for i in range(len(text) - 1) if int(rolled[i]) % size == 0]
            assert len(signature) == (min(len(cuts) + 1, 64) if text else 0)
        assert len(two) <= len(one) <= 64


def test_likeness_of_known_cases():
    pick = random.Random(4)
    text = bytes(pick.choices(range(97, 123), k=3000))
    other = bytes(pick.choices(range(97, 123), k=3000))
    a, b, c = ph.fingerprints([text, text[:2000] + other[:1000], other])
    assert ph.likeness([a], [a])[0] == 1
    assert ph.likeness([a], [b])[0] > 0.5
    assert ph.likeness([a], [c])[0] < 0.2
    assert ph.likeness(ph.fingerprints([b""]), ph.fingerprints([b""]))[0] == 1


def expected(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-r[0] if r[0] is not None else float("inf"), r[1].encode()))
    out = []
    for k, (d, text) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + follow[:n]
        x, y, z = ph.fingerprints([text.encode(), changed.encode(), follow.encode()])
        near = [float(ph.likeness([x], [v])[0]) for v in (y, z)]
        out.append((d, len(text), hashlib.sha256(changed.encode()).hexdigest(), ph.shown(x), ph.shown(y), *near))
    return sorted(out, key=str)


def test_successors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for buckets in (1, 7, 300):
        assert sorted(map(tuple, ph.edited_likeness(docs, buckets).collect()), key=str) == expected(rows)


def test_rows_of_any_kind(spark):
    rows = [(1, "é" * 50, "x"), (1, "é" * 50, "x"), (1, "b", "x"), (None, "c d e f", "y"), (2, None, "y"), (-5, "z" * 100_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    for buckets in (1, 4):
        assert sorted(map(tuple, ph.edited_likeness(docs, buckets).collect()), key=str) == expected([r[:2] for r in rows])
    assert ph.edited_likeness(docs.limit(0), 4).count() == 0
    one = docs.filter("doc_id = 2")
    assert sorted(map(tuple, ph.edited_likeness(one, 4).collect()), key=str) == expected([(2, None)])
