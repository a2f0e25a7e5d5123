"""License scans against a search of all places, and planted notices."""

import random
import re

import pytest

from orderlens.llm.licenses import BASE, TEMPLATES, LicenseIndex, op12_license_scan, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text):
    """n_words, n_base, first, last, base labels by looking at every place."""
    w = words(text)
    places = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


def base_of(row):
    return row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]


def check(rows, texts):
    for row, text in zip(sorted(rows, key=lambda r: r["doc_id"]), texts, strict=True):
        assert base_of(row) == brute(text), text
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0.0 <= row["score"] <= 1.0 and (row["score"] > 0) == (row["labels"] != "")


def scan(spark, texts, **more):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return scan_licenses(frame.repartition(3), ["doc_id"], **more).collect()


def test_base_same_as_brute_force_on_random_texts(spark):
    rng = random.Random(4)
    pool = ["cc", "by", "CC BY", "general", "public", "license", "GENERAL Public License", "all", "rights", "reserved"]
    pool += ["All rights reserved", "cç", "license2", "éall", "x", "the", "mit license", "4.0", "nc", "version 3", "gnu"]
    joins = [" ", "-", "\n", ". ", "_", "\t", "é", "", "/*", " "]
    texts = ["".join(rng.choice(pool) + rng.choice(joins) for _ in range(rng.choice([0, 1, 4, 30, 200]))) for _ in range(1500)]
    check(scan(spark, [*texts, None, "", "cc", "by cc", "cc by", "cc by cc by by"]), [*texts, None, "", "cc", "by cc", "cc by", "cc by cc by by"])


def test_base_same_as_brute_force_on_the_table(spark):
    rows = op12_license_scan(spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    check(rows, [r["text"] for r in table])
    # Each planted line is found by its own label as well.
    by_id = {r["doc_id"]: r["labels"].split(",") for r in rows}
    for line, label in (("MIT License.", "mit"), ("Apache License, Version 2.0.", "apache-2.0"), ("CC BY-NC 4.0.", "cc-by-nc-4.0")):
        planted = [r["doc_id"] for r in table if r["text"] and line in r["text"]]
        assert planted and all(label in by_id[d] for d in planted)


@pytest.mark.parametrize(("label", "text", "phrases"), TEMPLATES)
def test_each_template_is_found_between_other_words(spark, label, text, phrases):
    marked = "lorem ipsum the of license. " * 5 + "\n * ".join(text.upper().split(" ")) + " end of the notice"
    cut = text.replace(text.split(" ")[0], "", 1)
    gone = marked.lower().replace(phrases[0].split()[0], "gone")
    found = scan(spark, [marked, cut, gone])
    first, _, last = sorted(found, key=lambda r: r["doc_id"])
    assert label in first["labels"].split(",") and first["score"] == pytest.approx(1.0)
    assert any(m["label"] == label and m["start"] == 25 and m["score"] == pytest.approx(1.0) for m in first["matches"])
    assert label not in last["labels"].split(",")


def test_a_grant_with_changed_words_is_found_and_scores_less(spark):
    text = next(t for label, t, p in TEMPLATES if label == "mit" and len(p) == 2)
    (row,) = scan(spark, [text.replace("associated documentation files", "the files that go with it")])
    assert "mit" in row["labels"] and 0.3 < row["score"] < 1.0


def test_words_of_a_license_in_other_order_are_no_license(spark):
    texts = ["license mit", "the software is free and of charge; permission granted hereby is", "rights all reserved by cc", "public general license"]
    assert [r["labels"] for r in scan(spark, texts)] == [""] * 4


def test_own_templates_empty_table_and_clashing_names(spark):
    index = LicenseIndex([("house", "Internal use only", ("internal use",))], {"do not copy": "secret"})
    (row,) = scan(spark, ["DO NOT COPY: internal use only"], index=index)
    assert (row["labels"], row["base_labels"], row["n_base"]) == ("house,secret", "secret", 1)
    with pytest.raises(ValueError):
        LicenseIndex([("x", "a b", ("b a",))])
    frame = spark.createDataFrame([(1, "cc by", 5, "z")], "doc_id long, text string, score int, labels string")
    assert scan_licenses(frame, ["doc_id", "score"]).collect()[0][:2] == (1, 5)
    assert scan_licenses(frame.limit(0), ["doc_id"]).collect() == []
    assert [r["n_words"] for r in scan(spark, [None, None])] == [0, 0]


def test_very_long_text_and_repeated_rows(spark):
    long = "the license all rights " * 200_000 + "all rights reserved"
    rows = scan(spark, [long, "cc by", "cc by"])
    check(rows, [long, "cc by", "cc by"])
    one, two = (tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])[1:])
    assert one == two
