"""Packing: every id once, gapless sequences, no padding, and the rule's choice by brute force."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orderlens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, ids_of, size):
    """rows: dicts of pieces; ids_of: doc_id to ids with the closing one."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            own = ids_of[doc][r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids_of[doc]))
            assert r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids_of[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and at & (at - 1) == 0


def test_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [r.asDict() for r in packing.pack_public(docs).collect()]
    ids_of = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    check(rows, ids_of, 1024)
    whole = sum(len(ids) for ids in ids_of.values())
    assert len({r["sequence_id"] for r in rows}) <= whole / 1024 + 3 * 11


def test_rows_of_any_kind(spark, tokenizer):
    long = "word " * 30_000
    rows = [(1, "a b <|endoftext|>", "x"), (2, None, "y"), (3, "", "z"), (4, long, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = [r.asDict() for r in packing.pack_public(docs).collect()]
    check(got, {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t, _ in rows}, 1024)
    again = spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")
    got = packing.pack_public(again, keep_ids=True).collect()
    assert sum(r.length for r in got) == 6 and sum(r.length for r in got if r.doc_id is None) == 2
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack_public(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, "", size=1000)


def test_control_strings_as_in_a_plain_call(tokenizer):
    """Texts with added tokens, odd white space and no blanks have the ids of one plain call each."""
    pick = random.Random(3)
    end = "<|endoftext|>"
    parts = [end, end + end, " " + end, "\n" + end, end + "\n", "a", " b", "don't", " 't", "\n", " ", "\t", "é", "日本", "\r", "\u00a0", "\u3000x", "<|", "endoftext|>", "12", "."]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(12))) for _ in range(4000)]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        coder = packing.coder(file.read())
    for first in range(0, len(texts), 100):
        some = texts[first : first + 100]
        for text, ids in zip(some, coder.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_ranked_form_is_used_and_refused_where_it_may_differ():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = json.load(file)
    assert packing.ranked_encoding(json.dumps(content)) is not None
    turned = {**content, "model": {**content["model"], "merges": content["model"]["merges"][::-1]}}
    assert packing.ranked_encoding(json.dumps(turned)) is None
    assert packing.ranked_encoding(json.dumps({**content, "normalizer": {"type": "NFC"}})) is None


def test_rule_by_brute_force():
    pick = random.Random(1)
    for _ in range(300):
        packer = packing.SumOfSquares(16, lambda window: None)
        packer._count[1:16] = [pick.randrange(4) for _ in range(15)]
        n = pick.randrange(1, 16)
        best = {}
        for h in range(17 - n):
            if h and not packer._count[h]:
                continue
            after = packer._count.copy()
            after[h] -= h > 0
            after[h + n] += h + n < 16
            best[h] = int((after[1:16] ** 2).sum())
        assert best[packer.level(n)] == min(best.values())


def test_crowded_levels_stay_bounded():
    made = []
    packer = packing.SumOfSquares(1024, made.append, per_level=4)
    for k in range(100):
        packer.place(k, 0, bytes(4 * 600))
        assert packer._count.max() <= 4
    packer.close()
    assert sum(len(ids) // 4 for window in made for _, _, ids in window) == 60_000
    lengths = [sum(len(ids) // 4 for _, _, ids in window) for window in made]
    assert all(n & (n - 1) == 0 for n in lengths)
