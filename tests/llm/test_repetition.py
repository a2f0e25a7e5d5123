"""Suffix-array measures against brute force."""

import random
import re

import numpy as np

from orderlens.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    n = len(words)
    prefix = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            prefix[i] = max(prefix[i], k)
    cover = lambda least, length: len({x for i in range(n) if prefix[i] >= least for x in range(i, i + (length or prefix[i]))})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    repeated, long = cover(5, 5), cover(repetition.LONG_REPEAT, 0)
    failed = n < 10 or 100 * repeated > 20 * n
    longest = max(prefix, default=0)
    limited = long > repetition.MAX_COVERED * n or longest >= repetition.LONG_REPEAT and longest > repetition.MAX_LONGEST * n
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)),
        "n_repeat_words": repeated,
        "covered_words": long,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": not failed and not limited,
    }


def made(seed):
    pick = random.Random(seed)
    out = [None, "", " \n\t ", "a", "a " * 40, "a b " * 30, "x\n\nx\n y\nx", "é ü 漢 # * <>"]
    for _ in range(60):
        few = pick.choice([2, 5, 40, 400])
        words = [pick.choice("abcdéfgh*") + str(pick.randrange(few)) for _ in range(pick.randrange(1, 120))]
        if pick.random() < 0.6:
            a, n = pick.randrange(len(words)), pick.randrange(1, 30)
            words += words[a : a + n]
        out.append("".join(w + pick.choice([" ", "  ", "\n", "\r\n", " ", "\x1c"]) for w in words))
    return out


def test_brute_force(spark):
    own = made(4)
    docs = spark.createDataFrame([(k, t, t) for k, t in enumerate(own)], "doc_id long, text string, n_words string").repartition(3)
    rows = repetition.repetition(docs).collect()
    assert len(rows) == len(own)
    for row in rows:
        assert {k: v for k, v in row.asDict().items() if k != "doc_id"} == brute(own[row.doc_id]), repr(own[row.doc_id])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 1500}
    for row in repetition.repetition(docs).collect():
        if row.doc_id in short:
            assert {k: v for k, v in row.asDict().items() if k != "doc_id"} == brute(short[row.doc_id])


def test_long_runs():
    symbols = np.zeros(50_000, dtype=np.uint64)
    rows = np.zeros(50_000, dtype=np.int64)
    got = repetition.common_prefixes(symbols, rows)
    assert got[0] == 49_999 and got[-1] == 1 and got[-2] == 2


def test_rows_of_any_kind(spark):
    prose = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, prose, "k"), (1, prose, "k"), (None, prose, None), (2, None, "x")], "doc_id long, text string, kept string")
    got = repetition.keep_documents(docs)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=str) == sorted(docs.collect()[:3], key=str)
    assert repetition.repetition(docs.limit(0)).count() == 0


def test_a_document_that_only_its_longest_repeat_rejects(spark):
    """A passage of 7 % copied once covers 14 %; short repeats that cover as much are kept."""
    words = [f"w{k}" for k in range(4650)]
    once = " ".join([*words, *words[100:450]])
    many = " ".join([*words, *(w for k in range(12) for w in words[k * 300 : k * 300 + 27])])
    docs = spark.createDataFrame([(1, once), (2, many)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repetition.repetition(docs).collect()}
    assert not rows[1].base_failed and rows[1].covered_words <= repetition.MAX_COVERED * rows[1].n_words and not rows[1].kept
    assert rows[2].kept and rows[2].covered_words > 0.12 * rows[2].n_words
