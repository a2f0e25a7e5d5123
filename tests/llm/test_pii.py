"""Base spans against the plain patterns in Python, EM against a plain loop, added spans on planted text."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from orderlens.llm import native_spans, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    counts = Counter(kind for *_, kind in found)
    return tuple(counts[k] for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest(), listed


def texts(seed):
    pick = random.Random(seed)
    parts = ["a@b.c", "_x@d.e", "x@y", "@", "1.2.3.4", "01.002.3.255", "1.2.3.256", "1.2.3.4.5.6.7.8", "10.0.0.1", "192.168.0.10", "0.0.0.0", "00.000.0.255", "0.0.0.00256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (310) 555-4510"]
    parts += ["+49 30 1234", "+", "12", " ", "\n", ".", "-", "é", "🙂", "AKIA", "(310) 555-4510", "123-45-6789", "@example.com", "user.name+tag", "%", "0" * 30]
    return [None, ""] + ["".join(pick.choice(parts) + pick.choice(["", "", " "]) for _ in range(pick.randrange(30))) for _ in range(400)]


def test_base_spans(spark):
    own = texts(1)
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    rows = pii.pii_digest(docs.repartition(4)).collect()
    assert len(rows) == len(own)
    for r in rows:
        counts, digest, listed = base(own[r.doc_id])
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, digest), repr(own[r.doc_id])
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    own = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op1_pii(spark, sf).collect():
        counts, digest, listed = base(own[r.doc_id])
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (counts, digest)
        assert r.spans == listed  # these documents hold nothing else


def test_very_long_texts(spark):
    """Counts that are known: the plain patterns take quadratic time on such texts."""
    long = {
        "1" * 200_000: (0, 0, 0, 0),
        "a.b" * 70_000: (0, 0, 0, 0),
        "x@" + "a.b" * 70_000: (1, 0, 0, 0),
        "1.2.3.4 " * 20_000: (0, 20_000, 0, 0),
        "+" + "1-" * 100_000: (0, 0, 0, 0),
        "a@b.c " * 30_000: (30_000, 0, 0, 0),
    }
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in pii.pii_digest(docs).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == list(long.values())[r.doc_id]


def test_rows_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "a@b.com"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.pii_digest(docs).collect()), key=str)
    assert got == sorted([(1, 1, "email:0:7"), (1, 1, "email:0:7"), (None, 1, "email:0:7"), (2, 0, "")], key=str)
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_added_spans(spark):
    plain = [f"Word number {k} and then some more words follow here." for k in range(200)]
    marked = [f"Please call my phone 212-555-{1000 + k} soon." for k in range(30)] + [f"mail me at some.one{k} [at] example [dot] com today" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(plain + marked)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_digest(docs).collect()}
    assert not any(got[k] for k in range(200))
    assert all(got[200 + k] == "local_phone:21:33" for k in range(30))
    assert all(got[230 + k].startswith("spelled_email:11:") for k in range(30))


def test_em_against_a_plain_loop(spark):
    pick = random.Random(3)
    patterns = Counter((pick.randrange(len(pii.KINDS)), tuple(pick.choices([0, 1, 2], k=pii.LABELERS))) for _ in range(500))
    rows = [(k, list(v)) for (k, v), n in patterns.items() for _ in range(n)]
    spans = spark.createDataFrame(rows, "rank int, votes array<int>")
    got = pii.pattern_probabilities(spans).first().probability
    prior = [0.5] * len(pii.KINDS)
    yes, no = [list(pii.START_TRUE) for _ in range(pii.LABELERS)], [list(pii.START_FALSE) for _ in range(pii.LABELERS)]

    def probability(k, v):
        a = math.prod(yes[i][x] for i, x in enumerate(v)) * prior[k]
        b = math.prod(no[i][x] for i, x in enumerate(v)) * (1 - prior[k])
        return a / (a + b)

    for _ in range(pii.ROUNDS):
        p = {x: probability(*x) for x in patterns}
        prior = [(1 + sum(n * p[x] for x, n in patterns.items() if x[0] == k)) / (2 + sum(n for x, n in patterns.items() if x[0] == k)) for k in range(len(prior))]
        for shares, start, w in ((yes, pii.START_TRUE, lambda x: p[x]), (no, pii.START_FALSE, lambda x: 1 - p[x])):
            for i in range(pii.LABELERS):
                sums = [pii.ANCHOR * start[v] + sum(n * w(x) for x, n in patterns.items() if x[1][i] == v) for v in range(3)]
                shares[i] = [s / sum(sums) for s in sums]
    for k, v in patterns:
        assert abs(got[f"{k}:{''.join(map(str, v))}"] - probability(k, v)) < 1e-9


def test_running_sums(spark):
    pick = random.Random(5)
    rows = [(k, [pick.randrange(9) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 10, 100, 1000])]
    frame = spark.createDataFrame(rows, "k int, v array<int>")
    for r in frame.select("k", "v", native_spans.running_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
