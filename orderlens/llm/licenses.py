"""License scans by a positional index of license words.

Notices and grants of public licenses are templates; the index holds, for each of their words, the
templates and positions it stands at. How many documents hold a word is counted over the corpus
first. In each file a template is looked at if the file holds all words of its mandatory key
phrases. The file's rarest words of that template are then looked up in the index: each occurrence
says where the template would begin, and the lists of the rarest words are intersected. At the
places that remain the key phrases are verified, word by word, and the place is scored by the share
of the template's weight (inverse document frequency) that stands at its position.

The three base phrases are templates too, their only key phrase being all their words, with no room
for shifts; so each of their places is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import terms_of
from .words import Chunk, chunks, text_column

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice or grant, mandatory key phrases in it.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "may not use this file except in compliance with the license"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and", "with or without fee is hereby granted"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    ("gpl-2.0", "under the terms of the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "gpl-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version of the License, or (at your option) any later version",
        ("gnu general public license as published by the free software foundation", "at your option any later version"),
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Rarest words of a template looked up in a file.
RAREST = 3
#: Words by which a key phrase may stand off its place beside the others.
SLACK = 8

_COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " matches array<struct<label:string,start:long,stop:long,score:double>>"
)
_MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return terms_of(Chunk(0, 1, data, np.array([0, len(data)]))).names.to_pylist()


@dataclass
class _Template:
    label: str
    base: bool
    words: np.ndarray  #: numbers of its words
    phrases: list[tuple[int, np.ndarray]]  #: where each key phrase begins, and its words
    needed: np.ndarray  #: distinct words of the key phrases
    postings: dict[int, np.ndarray]  #: positions of each word


class LicenseIndex:
    """Positional index of templates ``(label, text, key phrases)`` and of base phrases."""

    def __init__(self, templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES, base: dict[str, str] = BASE):
        given = [(label, _words(phrase), [_words(phrase)], True) for phrase, label in base.items()]
        given += [(label, _words(text), [_words(p) for p in phrases], False) for label, text, phrases in templates]
        self.vocabulary = sorted({w for _, words, _, _ in given for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.templates: list[_Template] = []
        for label, words, phrases, is_base in given:
            codes = np.array([number[w] for w in words])
            placed = []
            for phrase in phrases:
                at = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
                if not phrase or not at:
                    raise ValueError(f"{label}: key phrase {phrase} is not in the text")
                placed.append((at[0], np.array([number[w] for w in phrase])))
            needed = np.unique(np.concatenate([p for _, p in placed]))
            postings = {int(w): np.flatnonzero(codes == w) for w in np.unique(codes)}
            self.templates.append(_Template(label, is_base, codes, placed, needed, postings))

    def coded(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of a chunk (-1 if no license word), and where each text's words begin."""
        terms = terms_of(chunk)
        found = pc.index_in(terms.names, value_set=pa.array(self.vocabulary, pa.large_binary()))
        return found.fill_null(-1).to_numpy(zero_copy_only=False), terms.bounds

    def present(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which license words each text holds."""
        held = np.zeros((len(bounds) - 1, len(self.vocabulary)), dtype=bool)
        at = np.flatnonzero(code >= 0)
        held[np.searchsorted(bounds, at, side="right") - 1, code[at]] = True
        return held


def _starts(code: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where words stand consecutively."""
    at = np.flatnonzero(code[: max(len(code) - len(words) + 1, 0)] == words[0])
    for j in range(1, len(words)):
        at = at[code[at + j] == words[j]]
    return at


def _places(code: np.ndarray, template: _Template, held: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified beginnings of a template in one text, and their scores."""
    mine = [w for w in template.postings if held[w]]
    rarest = sorted(mine, key=lambda w: (-weight[w], w))[:RAREST]
    # Where the template would begin, by each of the rarest words; only what all agree on, or two of three.
    votes = [np.unique(np.concatenate([np.flatnonzero(code == w) - p for p in template.postings[w]])) for w in rarest]
    begin, agree = np.unique(np.concatenate(votes), return_counts=True)
    begin = begin[agree >= (len(rarest) if template.base else min(2, len(rarest)))]
    slack = 0 if template.base or len(template.phrases) == 1 else SLACK
    for offset, phrase in template.phrases:
        starts = _starts(code, phrase)
        nearest = np.searchsorted(starts, begin + offset - slack)
        within = nearest < len(starts)
        within[within] = starts[nearest[within]] <= begin[within] + offset + slack
        begin = begin[within]
    share = np.zeros(len(begin))
    for j, w in enumerate(template.words):
        at = begin + j
        inside = (at >= 0) & (at < len(code))
        share[inside] += weight[w] * (code[at[inside]] == w)
    return begin, np.minimum(share / weight[template.words].sum(), 1.0)


def document_frequencies(documents: DataFrame, index: LicenseIndex, text: str = "text") -> tuple[int, np.ndarray]:
    """Rows with a word, and how many rows hold each license word."""
    size = len(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for chunk in chunks(text_column(batch, "_text")):
                code, bounds = index.coded(chunk)
                found[:size] += index.present(code, bounds).sum(axis=0)
                found[size] += int((np.diff(bounds) > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array(found)], names=["word", "n"])

    rows = documents.select(F.col(f"`{text}`").cast("string").alias("_text"))
    counts = np.zeros(size + 1, dtype=np.int64)
    # One row per license word and one for all.
    for word, n in rows.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        counts[word] = n
    return int(counts[size]), counts[:size]


def _matches(label: str, start: np.ndarray, stop: np.ndarray, score: np.ndarray) -> list[dict]:
    columns = zip(start.tolist(), stop.tolist(), score.tolist(), strict=True)
    return [{"label": label, "start": a, "stop": b, "score": s} for a, b, s in columns]


def scan_licenses(
    documents: DataFrame, columns: list[str], index: LicenseIndex | None = None, text: str = "text"
) -> DataFrame:
    """``columns``, then ``n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` of each row.

    ``matches`` are the templates found beside the base phrases: label, first word, word after the
    last, score. ``score`` is the greatest score of any place, 1 at a base phrase, 0 without places.
    A null text counts as empty and has no words; texts are read whole, a very long one by itself;
    equal texts have equal results, whatever their ids, and an empty table gives no rows. Labels
    found in several places or by several templates are named once. The columns may have any names
    and hold nulls; others are not read.
    """
    index = index or LicenseIndex()
    rows, df = document_frequencies(documents, index, text)
    weight = np.array([math.log(1 + rows / (d + 1)) or 1.0 for d in df.tolist()])
    source = documents.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text}`").cast("string").alias("_text")
    )

    def scanned(code: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        held = index.present(code, bounds)
        n = len(bounds) - 1
        places: list[list[np.ndarray]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        matches: list[list[dict]] = [[] for _ in range(n)]
        score = np.zeros(n)
        for template in index.templates:
            for r in np.flatnonzero(held[:, template.needed].all(axis=1)).tolist():
                begin, share = _places(code[bounds[r] : bounds[r + 1]], template, held[r], weight)
                if not len(begin):
                    continue
                labels[r].add(template.label)
                score[r] = max(score[r], float(share.max()))
                if template.base:
                    base[r].add(template.label)
                    places[r].append(begin)
                else:
                    size = int(bounds[r + 1] - bounds[r])
                    start, stop = np.maximum(begin, 0), np.minimum(begin + len(template.words), size)
                    matches[r] += _matches(template.label, start, stop, share)
        first = [int(min(p[0] for p in found)) if found else None for found in places]
        last = [int(max(p[-1] for p in found)) if found else None for found in places]
        arrays = [
            pa.array(np.diff(bounds)),
            pa.array([sum(map(len, found)) for found in places], pa.int64()),
            pa.array(first, pa.int64()),
            pa.array(last, pa.int64()),
            pa.array([",".join(sorted(s)) for s in base], pa.string()),
            pa.array([",".join(sorted(s)) for s in labels], pa.string()),
            pa.array(score),
            pa.array([sorted(m, key=lambda one: (one["start"], one["label"], one["stop"])) for m in matches], pa.list_(_MATCH)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _COLUMNS.split(", ")[:8]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(text_column(batch, "_text")):
                found = scanned(*index.coded(chunk))
                kept = batch.slice(chunk.first, chunk.rows).columns[: len(columns)]
                names = [f"c{i}" for i in range(len(columns))] + found.schema.names
                yield pa.RecordBatch.from_arrays([*kept, *found.columns], names=names)

    kinds = source.drop("_text").schema
    for field in source.sparkSession.createDataFrame([], _COLUMNS).schema:
        kinds = kinds.add(field)
    return source.mapInArrow(run, kinds).toDF(*columns, *[f.name for f in kinds.fields[len(columns) :]])


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of each document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(documents, ["doc_id"]).drop("matches")
