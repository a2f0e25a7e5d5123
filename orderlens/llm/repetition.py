"""Repetition within a document by suffix arrays: maximal repeats, their covered share, a verdict.

The suffixes of the word sequences of many documents are sorted together by prefix doubling, on
names that hold the document, so suffixes of two documents never meet. Only suffixes that still share
their prefix with another go into the next doubling round. The longest common prefix of neighbours
in the array comes from the rounds' ranks; positions whose longest common prefix with a neighbour
has ``m`` words or more start a maximal repeat of that length, and the spans are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import SPACE, Words, chunks, covered, text_column, words_of

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: A document with fewer words fails.
MIN_WORDS = 10
#: Words of the windows of the base rule, and the percentage of words in repeated ones at most.
WINDOW, MAX_REPEATED_PERCENT = 5, 20
#: The verdict counts repeats from this many words on; shares of the document's words at most. A passage that
#: comes twice covers twice its length, so a limit of the longest repeat decides below half of the covered share.
LONG_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.15, 0.06


def suffix_array(symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes sorted by row, then by symbols; the ranks after 1, 2, 4, ... symbols.

    A suffix ends with its row. Equal ranks of a round mean equal prefixes of that length, within a row.
    """
    n = len(symbols)
    order = np.lexsort((symbols, rows))
    same = (symbols[order][1:] == symbols[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    rank = np.empty(n, dtype=np.int64)
    # The rank is where a group of equal prefixes begins in the array; row ends come before all.
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    ends = np.searchsorted(rows, rows, side="right")
    rounds, length = [rank], 1
    while True:
        size = np.diff(np.r_[first, n])
        tied = np.repeat(size > 1, size)
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, rounds
        at = order[slots]
        follow = at + length
        second = np.where(follow < ends[at], rank[np.minimum(follow, n - 1)], -1)
        by = np.lexsort((second, rank[at]))
        at, second, group = at[by], second[by], rank[at][by]
        order[slots] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        starts = np.flatnonzero(new)
        rank = rank.copy()
        rank[at] = np.repeat(slots[starts], np.diff(np.r_[starts, len(at)]))
        first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
        rounds.append(rank)
        length *= 2


def common_prefixes(symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each position the longest common prefix of its suffix with another suffix of its row."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    order, rounds = suffix_array(symbols, rows)
    ends = np.searchsorted(rows, rows, side="right")
    near = np.flatnonzero(rounds[0][order[1:]] == rounds[0][order[:-1]])
    left, right = order[near].copy(), order[near + 1].copy()
    length = np.zeros(len(near), dtype=np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        open_ = np.flatnonzero((left < ends[order[near]]) & (right < ends[order[near + 1]]))
        equal = open_[rounds[k][left[open_]] == rounds[k][right[open_]]]
        length[equal] += 1 << k
        left[equal] += 1 << k
        right[equal] += 1 << k
        left, right = np.minimum(left, n), np.minimum(right, n)
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, order[near], length)
    np.maximum.at(out, order[near + 1], length)
    return out


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each range of ``offsets``."""
    total = np.r_[0, np.cumsum(flags)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_starts(prefix: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """Starts of repeats of at least ``least`` words that no repeat from the word before contains."""
    start = np.flatnonzero(prefix >= least)
    before = np.maximum(start - 1, 0)
    inside = (start > 0) & (rows[before] == rows[start]) & (prefix[before] == prefix[start] + 1)
    return start[~inside]


@dataclass
class Limits:
    """Words a repeat must have to count, and the shares above which a document is rejected."""

    long_repeat: int = LONG_REPEAT
    max_covered: float = MAX_COVERED
    max_longest: float = MAX_LONGEST


def _measure(data: np.ndarray, offsets: np.ndarray, words: Words, limits: Limits) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    n_words = np.diff(words.bounds)
    point = ((data & 0xC0) != 0x80) & ~SPACE[data]
    prefix = common_prefixes(words.name, words.row)
    windows = np.flatnonzero(prefix >= WINDOW)
    repeated = _sums(covered(len(prefix), windows, windows + WINDOW), words.bounds)
    start = _repeat_starts(prefix, words.row, limits.long_repeat)
    in_long = _sums(covered(len(prefix), start, start + prefix[start]), words.bounds)
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, words.row, prefix)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)
    limited = (in_long > limits.max_covered * n_words) | ((longest >= limits.long_repeat) & (longest > limits.max_longest * n_words))
    return {
        "n_words": n_words,
        "word_chars": _sums(point, offsets),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": ~failed & ~limited,
        "covered_words": in_long,
        "longest_repeat": longest,
    }


def _duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), limits: Limits | None = None) -> DataFrame:
    """Repetition measures and the verdict for each row of documents; a map without a shuffle.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    longest_repeat`` (long), ``base_failed, kept`` (boolean) to the columns in ``keep``.
    ``covered_words`` counts words in maximal repeats of ``limits.long_repeat`` words or more,
    occurrences may overlap. A null text counts as empty: no words, failed. Ties need no rule: equal
    suffixes differ in length. Repeated rows each get their result. Other columns that bear the name
    of an added one are left out; the rest of a document's columns comes through by ``keep``.
    """
    limits = limits or Limits()
    made = [*LONGS, "base_failed", "kept"]
    if clash := set(keep) & {*made, "_text"}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{c} long" for c in LONGS] + ["base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "_text")
            for chunk in chunks(texts):
                found = _measure(chunk.data, chunk.offsets, words_of(chunk), limits)
                part = texts.slice(chunk.first, chunk.rows)
                found["n_dup_lines"] = np.array([_duplicate_lines(t) for t in part.to_pylist()], dtype=np.int64)
                columns = [c.slice(chunk.first, chunk.rows) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c]) for c in made)], names=[*batch.schema.names[:-1], *made])

    return kept.mapInArrow(run, kinds)


def keep_documents(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    measured = repetition(renamed.withColumn("text", F.col(text)), keep=tuple(names), limits=limits)
    return measured.filter("kept").select(*names).toDF(*docs.columns)


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for all documents."""
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long")))
