"""The join against brute force, its parts against plain loops."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import chosen_path as cp
from orderlens.llm.components import connected_components
from orderlens.llm.words import chunks, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    """rows: doc_id, text; class_id, copies, links for each, sorted."""
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(n):
            same = sets[i] == sets[j]
            if i != j and (same or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                root[find(i)] = find(j)
                links[i] += not same
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i)), sets.count(sets[i]), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def made(seed, n=60):
    pick = random.Random(seed)
    rows, common = [], [f"c{k}" for k in range(40)]
    while len(rows) < n:
        words = [f"w{pick.randrange(500)}" for _ in range(pick.choice([3, 5, 30, 80, 200]))]
        if pick.random() < 0.5:
            words[2:2] = common
        rows.append(words)
        for _ in range(pick.choice([0, 0, 1, 3, 8])):
            copy = list(words)
            for _ in range(pick.choice([0, 1, 2, 4])):
                copy[pick.randrange(len(copy))] = f"e{pick.randrange(99)}"
            rows.append(copy)
    return [(d, " ".join(w)) for d, w in enumerate(rows)]


def run(frame):
    return sorted((tuple(r) for r in cp.similar_documents(frame).collect()), key=str)


def test_brute_force(spark):
    rows = made(1)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    """Crowded nodes go on, and blocks of a few sets find the same."""
    rows = made(2, 50)
    monkeypatch.setattr(cp, "BLOCK", 4)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(docs.repartition(3)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_of_any_kind(spark):
    a = " ".join(f"a{k}" for k in range(60))
    rows = [(1, a), (1, a), (1, "x y"), (None, a + " end"), (None, "x y"), (7, None), (8, ""), (9, " \n"), (10, "é " * 30_000), (11, "z z z z z z z z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", cp.F.lit("clash"))
    assert run(frame) == brute(rows)
    assert run(frame.limit(0)) == []
    assert run(frame.filter("doc_id = 10")) == [(10, 10, 1, 0)]


def test_recall_of_a_run(spark):
    """Pairs at the threshold meet as often as the number of runs assumes."""
    pick = np.random.default_rng(3)
    pairs = 400
    shared = pick.integers(0, 2**63, (pairs, 160), dtype=np.uint64)
    left, right = (np.hstack([shared, pick.integers(0, 2**63, (pairs, 20), dtype=np.uint64)]) for _ in range(2))
    values = np.sort(np.vstack([left, right]), axis=1)
    embedded = cp.embedding(values.ravel(), np.arange(0, values.size + 1, 180))
    runs = cp.runs_needed(0.99)
    node, at = cp._paths(embedded, runs, cp.LEVELS)
    nodes = [set() for _ in range(2 * pairs)]
    for x, r in zip(node.tolist(), at.tolist(), strict=True):
        nodes[r].add(x)
    assert sum(bool(nodes[k] & nodes[pairs + k]) for k in range(pairs)) >= 0.97 * pairs
    assert cp.runs_needed(0.99999) > runs
    likeness = (embedded[:pairs] == embedded[pairs:]).mean()
    assert abs(likeness - 0.8) < 0.01


def test_recall_in_a_crowded_node(spark, monkeypatch):
    """Some thousand pairs at the threshold, all with the same boilerplate, so that their nodes stay crowded."""
    monkeypatch.setattr(cp, "BLOCK", 24)
    pairs = 2500
    rows = []
    for k in range(pairs):
        common, own = [f"c{i}" for i in range(114)], [f"p{k}_{i}" for i in range(50)]
        rows += [(2 * k + side, " ".join(common + own + [f"q{k}_{side}_{i}" for i in range(20)])) for side in (0, 1)]
    first, second = shingles(rows[0][1]), shingles(rows[1][1])
    assert len(first & second) == 0.8 * len(first | second)
    got = {r.doc_id: r.n_links for r in cp.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert sum(got[2 * k] == 0 for k in range(pairs)) == 0
    assert all(n <= 1 for n in got.values())


def test_runs_needed():
    """The chance over all levels, drawn with 128 coordinates that all runs share."""
    pick = np.random.default_rng(5)
    levels, pairs = cp.LEVELS + cp.MORE_LEVELS, 4000
    left = pick.integers(0, 2**32, (pairs, cp.COORDINATES), dtype=np.uint32)
    right = np.where(pick.random(left.shape) < 0.8, left, left + np.uint32(1))
    missed = {}
    for recall in (0.9, 0.99):
        node, at = cp._paths(np.vstack([left, right]), cp.runs_needed(recall, levels), levels)
        pair = np.unique(np.c_[node, at % pairs, at // pairs], axis=0)
        same = (pair[1:, :2] == pair[:-1, :2]).all(axis=1)
        missed[recall] = 1 - len(np.unique(pair[1:, 1][same])) / pairs
    met = lambda n, p: 1 if n == 0 else 1 - (0.75 * (1 - p * met(n - 1, p)) + 0.25 * (1 - p * met(n - 1, p)) ** 2)
    share = [math.comb(128, k) * 0.8**k * 0.2 ** (128 - k) for k in range(129)]
    for n in (cp.LEVELS, levels):
        assert sum(c * (1 - met(n, k / 128)) ** cp.runs_needed(cp.RECALL, n) for k, c in enumerate(share)) <= 1 - cp.RECALL
    assert missed[0.9] <= 0.12 and missed[0.99] <= 0.015


def test_sets():
    texts = ["a b c d e f", "a b c d e f a b c d e", "a b", "b a", "", "a a a a a a a"]
    for chunk in chunks(pa.array(texts)):
        value, bounds = cp.shingle_sets(words_of(chunk))
        assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
        keys = cp.set_keys(value, bounds).tolist()
        assert len(set(keys)) == len(texts)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want[start] = frozenset(seen)
    got = {r.node: r.label for r in connected_components(frame).collect()}
    assert {n: frozenset(m for m in got if got[m] == got[n]) for n in got} == want
    assert all(label in want[node] for node, label in got.items())


def test_shared_counts_by_ranges():
    """Counting by ranges of values gives the counts of whole sets."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    sets = [rng.choice(pool, size, replace=False) for size in (0, 1, 5, 60, 200, 400, 399)]
    at = np.arange(len(sets))
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for most in (1, 7, 100, 10_000):
        found = cp.shared_counts(sets, at, at, most)
        assert all(found[i, j] == expected[i][j] for i in at for j in at if i != j)
