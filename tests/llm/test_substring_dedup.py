"""Removed windows against brute force, and the locality of symbols."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import substring_dedup as dedup
from orderlens.llm.words import chunks, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    """rows: doc_id, text; the result by row."""
    key = lambda d: float("inf") if d is None else d
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            least[x] = min(least.get(x, float("inf")), key(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < key(d):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=120):
    pick = random.Random(seed)
    passages = [[f"p{k}w{pick.randrange(9)}" for k in range(pick.randrange(10, 40))] for _ in range(6)] + [["a"] * 20, ["a", "b"] * 12, ["x"] * 13 + ["y"] * 13]
    rows = []
    for d in range(n):
        words = []
        for _ in range(pick.randrange(5)):
            words += [f"w{pick.randrange(30)}" for _ in range(pick.randrange(30))]
            passage = pick.choice(passages)
            a = pick.randrange(len(passage))
            words += passage[a : a + pick.randrange(1, 40)] * pick.choice([1, 1, 2])
        rows.append((d, "".join(w + pick.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words)))
    pick.shuffle(rows)
    return rows


def run(frame, **more):
    return sorted(map(tuple, dedup.remove_repeats(frame, keep_text=False, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = made(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(frame.repartition(6)) == brute(rows)
    assert run(frame.coalesce(1)) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(docs.repartition(5)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_other_windows(spark):
    rows = made(3, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (5, 8, 21):
        assert run(frame, window=window) == brute(rows, window)
    with pytest.raises(ValueError):
        dedup.remove_repeats(frame, window=4)


def test_rows_of_any_kind(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [(1, a), (1, a), (1, b), (2, a + " " + b), (None, b), (None, "x " + a), (3, None), (4, ""), (5, "é " * 30_000), (6, "é " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", dedup.F.lit("clash"))
    assert run(frame.repartition(3)) == brute(rows)
    assert run(frame.limit(0)) == []
    kept = {r.doc_id: r.kept for r in dedup.remove_repeats(frame.filter("doc_id in (1, 2)")).collect()}
    assert kept[2] == ""


def test_rows_without_their_own_id(spark, monkeypatch):
    """Many texts without an id or with a repeated one: right results, and no array gathers what several texts share."""
    rows = [(pick if pick is None else min(pick, 5), t) for pick, (_, t) in zip([None, 5, 1, 7] * 60, made(6, 240), strict=True)]
    seen = []
    by_document = dedup._by_document

    def watched(pairs):
        seen.append(by_document(pairs).count())
        return by_document(pairs)

    monkeypatch.setattr(dedup, "_by_document", watched)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(batch)
    spark.conf.set(batch, "7")  # a name's rows come in several batches
    try:
        for parts in (1, 9):
            assert run(frame.repartition(parts)) == brute(rows)
    finally:
        spark.conf.set(batch, own)
    assert min(seen) > 20  # by doc alone there would be three groups


def test_rows_with_their_own_id_send_no_hash(spark, monkeypatch):
    """Hashes go only with ids that several rows have, or with all where too many repeat; results are the same."""
    rows = [(None if d % 10 == 0 else d // 2 * 2 if d % 10 == 3 else d, t) for d, t in made(8)]
    shared = {2, 12, 22, 32, 42, 52, 62, 72, 82, 92, 102, 112, dedup.NO_ID}
    sent, shared_names, told_apart = [], dedup.shared_names, dedup._told_apart

    def watched(names, providers):
        sent.append({r.doc for r in names.select("doc", dedup.F.explode("hashes").alias("h")).filter("h != 0").select("doc").distinct().collect()})
        return shared_names(names, providers)

    monkeypatch.setattr(dedup, "shared_names", watched)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(frame) == brute(rows)
    assert sent[0] and sent[0] <= shared and sent[1] <= shared
    monkeypatch.setattr(dedup, "_told_apart", lambda docs: told_apart(docs, most=3))
    assert run(frame) == brute(rows)
    assert sent[2] - shared


def test_equal_windows_have_equal_symbols():
    pick = random.Random(4)
    for _ in range(50):
        passage = [pick.choice("abcdef") for _ in range(13)]
        found = set()
        for _ in range(8):
            text = " ".join([pick.choice("abcdef") for _ in range(pick.randrange(6))] + passage + [pick.choice("abcdef") for _ in range(pick.randrange(6))])
            chunk = next(chunks(pa.array([text])))
            words = words_of(chunk)
            start, symbol = dedup.window_symbols(words)
            assert np.all(symbol > 0)
            own = text.split()
            found |= {int(s) for i, s in zip(start, symbol, strict=True) if own[i : i + 13] == passage}
        assert len(found) == 1


def test_long_words_of_two_letters_stay_apart(spark):
    """Thue-Morse words share one value under any polynomial modulo 2**64; their names differ."""
    sign = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in sign) for flip in (0, 1))
    around = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([*around[:6], one, *around[6:]])), (2, " ".join([*around[:6], two, *around[6:]])), (3, " ".join([*around[:6], one, *around[6:]]))]
    got = {r.doc_id: r.n_removed for r in dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
