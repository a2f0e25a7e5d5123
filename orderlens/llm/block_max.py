"""Ranked lexical search over an inverted index by Block-Max MaxScore.

The index is a table. Each task cuts its documents into shards of bounded size; a shard has one row
per term with its postings (documents by their number in the shard, and counts) in blocks of 128,
and one row with the documents. A block's head gives its last document and the competitive pairs of
count and document length, so the greatest score inside a block follows for any corpus statistics
without unpacking it. Corpus statistics are sums over the index rows.

A search sends the rows of the items' terms to one task per shard. There, for each item, terms are
ordered by their greatest score in the shard. Terms whose bounds together stay below the item's
20th score so far cannot lift a document by themselves; only the others ("essential") are unpacked
to find candidates. Candidates are then completed from the remaining terms, best first: one whose
score, with the maximum of the block it falls into and the bounds of the terms still to come, stays
below the 20th score is dropped before that block is unpacked. A task keeps its best documents per
item over all its shards; the tasks' lists are merged at the end. No document that can be among the
best is ever dropped, so results are exact and do not depend on the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .terms import Terms, binaries, terms_of
from .words import Chunk, chunks, text_column

BLOCK = 128
#: Text bytes of a shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Documents of a shard scored together.
WINDOW = 16 * BLOCK
#: Shards searched by one task, on average; fewer where there are fewer than the session's shuffle partitions.
SHARDS_OF_A_TASK = 16
#: Items searched in one pass over the index.
ITEMS_AT_ONCE = 1000

_INDEX = "shard long, term binary, df long, total long, heads binary, impacts binary, payload binary"
_HEAD = np.dtype([("last", "<u4"), ("gap_bytes", "u1"), ("count_bytes", "u1"), ("pairs", "<u2")])
_PAIR = np.dtype([("count", "<u4"), ("length", "<u4")])


def _widths(largest: np.ndarray) -> np.ndarray:
    """Bytes for numbers up to ``largest``: one, two or four."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, width: np.ndarray, values: np.ndarray) -> None:
    """Write each value in its width, little-endian, at its position."""
    for k in range(4):
        wide = width > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 0xFF


def _index_rows(shard: int, ids: pa.Array, terms: Terms) -> pa.RecordBatch:
    """The rows of one shard: its documents, then its terms."""
    lengths = np.diff(terms.bounds)
    rows = len(lengths)
    coded = terms.names.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, count = np.unique(code * rows + np.repeat(np.arange(rows), lengths), return_counts=True)
    term, doc = pair // rows, pair % rows
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
    df = np.diff(np.r_[starts, len(term)])
    place = np.arange(len(term)) - np.repeat(starts, df)
    block_starts = np.flatnonzero(place % BLOCK == 0)
    block_sizes = np.diff(np.r_[block_starts, len(term)])
    block = np.repeat(np.arange(len(block_starts)), block_sizes)
    gap = doc - np.where(place == 0, -1, np.r_[0, doc[:-1]])

    heads = np.zeros(len(block_starts), dtype=_HEAD)
    pairs = np.zeros(0, dtype=_PAIR)
    payload = np.zeros(0, dtype=np.uint8)
    head_ends = pair_ends = payload_ends = np.zeros(1, dtype=np.int64)
    if len(term):
        heads["last"] = doc[block_starts + block_sizes - 1]
        heads["gap_bytes"] = _widths(np.maximum.reduceat(gap, block_starts))
        heads["count_bytes"] = _widths(np.maximum.reduceat(count, block_starts))
        # Competitive pairs: by falling count, those with a smaller length than all before.
        order = np.lexsort((lengths[doc], -count, block))
        shift = block * (int(lengths.max()) + 1)
        falling = lengths[doc][order] - shift
        least = np.minimum.accumulate(falling)
        competitive = order[np.r_[True, falling[1:] < least[:-1]]]
        pairs = np.zeros(len(competitive), dtype=_PAIR)
        pairs["count"], pairs["length"] = count[competitive], lengths[doc[competitive]]
        heads["pairs"] = np.bincount(block[competitive], minlength=len(heads))
        gap_bytes, count_bytes = heads["gap_bytes"].astype(np.int64), heads["count_bytes"].astype(np.int64)
        ends = np.r_[0, np.cumsum(block_sizes * (gap_bytes + count_bytes))]
        payload = np.zeros(int(ends[-1]), dtype=np.uint8)
        inside = np.arange(len(term)) - block_starts[block]
        _put(payload, ends[block] + inside * gap_bytes[block], gap_bytes[block], gap)
        counts_at = ends[block] + block_sizes[block] * gap_bytes[block]
        _put(payload, counts_at + inside * count_bytes[block], count_bytes[block], count)
        first_block = np.r_[np.flatnonzero(place[block_starts] == 0), len(block_starts)]
        head_ends = first_block * _HEAD.itemsize
        payload_ends = ends[first_block]
        pair_ends = np.r_[0, np.cumsum(heads["pairs"].astype(np.int64))][first_block] * _PAIR.itemsize

    n = len(df)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    documents = [
        binaries(part.view(np.uint8), np.array([0, part.nbytes]))
        for part in (numbers.astype("<i8"), missing.astype(np.uint8), lengths.astype("<i8"))
    ]
    names = coded.dictionary.take(pa.array(term[starts])) if n else terms.names.slice(0, 0)
    columns = [
        pa.array(np.full(n + 1, shard, dtype=np.int64)),
        pa.concat_arrays([pa.nulls(1, pa.large_binary()), names.cast(pa.large_binary())]),
        pa.array(np.r_[int((lengths > 0).sum()), df].astype(np.int64)),
        pa.array(np.r_[int(lengths.sum()), np.zeros(n, dtype=np.int64)].astype(np.int64)),
        pa.concat_arrays([documents[0], binaries(heads.view(np.uint8), head_ends)]),
        pa.concat_arrays([documents[1], binaries(pairs.view(np.uint8), pair_ends)]),
        pa.concat_arrays([documents[2], binaries(payload, payload_ends)]),
    ]
    small = [c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in columns]
    return pa.RecordBatch.from_arrays(small, names=["shard", "term", "df", "total", "heads", "impacts", "payload"])


def build_index(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The index of all rows, written to the shared folder: one row per shard and term.

    Every row is a document of its own, also where an id repeats or is null; a null or empty text
    has no terms. Texts are handled whole, a very long one as a shard of its own. An empty table
    gives an empty index. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_column(batch, "_text")
            for chunk in chunks(texts, shard_bytes):
                ids = batch.column(0).slice(chunk.first, chunk.rows)
                yield _index_rows(number, ids, terms_of(chunk))
                number += 1

    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return stored(rows.mapInArrow(run, _INDEX), "search-index")


def _term_counts(text: str | None) -> dict[bytes, int]:
    """The terms of a text with their occurrences."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = terms_of(Chunk(0, 1, data, np.array([0, len(data)]))).names.value_counts()
    return dict(zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist(), strict=True))


class _Postings:
    """One term's postings in a shard, unpacked block by block when asked for."""

    def __init__(self, weight: int, df: int, heads: bytes, impacts: bytes, payload: bytes, penalty: np.ndarray, scale):
        head = np.frombuffer(heads, dtype=_HEAD)
        pairs = np.frombuffer(impacts, dtype=_PAIR)
        self.last = head["last"].astype(np.int64)
        counts = np.full(len(head), BLOCK)
        counts[-1] = df - BLOCK * (len(head) - 1)
        self._gap_bytes, self._count_bytes = head["gap_bytes"], head["count_bytes"]
        self._at = np.r_[0, np.cumsum(counts * (self._gap_bytes.astype(np.int64) + self._count_bytes))]
        self._ends = np.r_[0, np.cumsum(counts)]
        self._payload, self._penalty, self._weight = payload, penalty, weight
        value = weight * _part(pairs["count"].astype(np.int64), scale(pairs["length"].astype(np.int64)))
        self.maxima = np.maximum.reduceat(value, np.r_[0, np.cumsum(head["pairs"].astype(np.int64))[:-1]])
        self.bound = int(self.maxima.max())
        # Until a block is unpacked its places hold its last document, so the array stays sorted.
        self.docs = np.repeat(self.last, counts)
        self.values = np.zeros(df, dtype=np.int64)
        self._packed = np.ones(len(head), dtype=bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[self._packed[blocks]].tolist():
            first, end = int(self._ends[b]), int(self._ends[b + 1])
            at, gap, count = int(self._at[b]), int(self._gap_bytes[b]), int(self._count_bytes[b])
            n = end - first
            gaps = np.frombuffer(self._payload, dtype=f"<u{gap}", count=n, offset=at)
            counts = np.frombuffer(self._payload, dtype=f"<u{count}", count=n, offset=at + n * gap).astype(np.int64)
            before = int(self.last[b - 1]) if b else -1
            docs = before + np.cumsum(gaps, dtype=np.int64)
            self.docs[first:end] = docs
            self.values[first:end] = self._weight * _part(counts, self._penalty[docs])
            self._packed[b] = False

    def between(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``start`` up to ``stop`` with their scores."""
        low, high = np.searchsorted(self.last, [start, stop - 1])
        self.unpack(np.arange(low, min(high + 1, len(self.last))))
        first, end = np.searchsorted(self.docs, [start, stop])
        return self.docs[first:end], self.values[first:end]


def _part(count: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """A term's share of a score before its weight."""
    return 1_000_000_000 * count // (1000 * count + 12 * penalty)


class _Best:
    """The best documents of an item so far: by score, then id, those without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.missing, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.least = 1

    def add(self, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        score, missing = np.r_[self.score, score], np.r_[self.missing, missing]
        ids = np.r_[self.id, ids]
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.missing, self.id = score[order], missing[order], ids[order]
        if len(order) == self.k:
            self.least = max(int(self.score[-1]), 1)


def _search_shard(lists: list[tuple[int, _Postings]], best: _Best, missing: np.ndarray, ids: np.ndarray, window: int) -> int:
    """Add a shard's best documents for one item; returns the number of candidates completed."""
    lists = sorted(lists, key=lambda one: one[0] * one[1].bound)
    reach = np.cumsum([times * p.bound for times, p in lists])
    completed = 0
    for start in range(0, len(ids), window):
        stop = min(start + window, len(ids))
        essential = int(np.searchsorted(reach, best.least))
        if essential == len(lists):
            return completed
        total = np.zeros(stop - start, dtype=np.int64)
        for times, postings in lists[essential:]:
            docs, values = postings.between(start, stop)
            total[docs - start] += times * values
        found = np.flatnonzero(total)
        for i in range(essential - 1, -1, -1):
            times, postings = lists[i]
            found = found[total[found] + reach[i] >= best.least]
            if not len(found):
                break
            block = np.searchsorted(postings.last, found + start)
            inside = block < len(postings.last)
            top = np.zeros(len(found), dtype=np.int64)
            top[inside] = times * postings.maxima[block[inside]]
            keep = total[found] + top + (reach[i - 1] if i else 0) >= best.least
            found, block = found[keep], block[keep]
            held = block < len(postings.last)
            some = found[held]
            postings.unpack(np.unique(block[held]))
            at = np.searchsorted(postings.docs, some + start)
            hit = postings.docs[at] == some + start
            total[some[hit]] += times * postings.values[at[hit]]
        found = found[total[found] >= best.least]
        completed += len(found)
        if len(found):
            best.add(total[found], missing[found + start], ids[found + start])
    return completed


def _search_block(
    index: DataFrame, items: list[tuple[int, int | None, dict[bytes, int]]], k: int, window: int
) -> DataFrame | None:
    """The ``k`` best documents of each item of one block, or None where no term is known."""
    spark = index.sparkSession
    numbers = {term: i for i, term in enumerate(sorted({t for _, _, counts in items for t in counts}))}
    documents, total, shards = index.filter("term IS NULL").agg(F.sum("df"), F.sum("total"), F.count("*")).first()
    if not numbers or not documents:
        return None
    # As many rows as the block of items has terms.
    terms = F.broadcast(spark.createDataFrame([(bytearray(t), i) for t, i in numbers.items()], "term binary, number int"))
    wanted = index.join(terms, "term")
    df = dict(wanted.groupBy("number").agg(F.sum("df")).collect())
    weights = {n: math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for n, d in df.items()}
    asked = [(i, key, [(numbers[t], c) for t, c in counts.items() if weights.get(numbers[t])]) for i, key, counts in items]

    def scale(lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * documents // total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in asked]

        def search(shard: pa.Table) -> None:
            postings: dict[int, _Postings] = {}
            columns = [shard.column(c).to_pylist() for c in ("number", "df", "heads", "impacts", "payload")]
            rows = list(zip(*columns, strict=True))
            head = next(row for row in rows if row[0] is None)
            ids, missing = np.frombuffer(head[2], "<i8"), np.frombuffer(head[3], np.uint8).astype(bool)
            penalty = scale(np.frombuffer(head[4], "<i8"))
            for number, count, *parts in rows:
                if number is not None and weights[number]:
                    postings[number] = _Postings(weights[number], count, *parts, penalty, scale)
            for one, (_, _, words) in zip(best, asked, strict=True):
                lists = [(times, postings[n]) for n, times in words if n in postings]
                if lists:
                    _search_shard(lists, one, missing, ids, window)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            shards = held.column("shard").to_numpy()
            ends = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            first = 0
            for end in ends.tolist():
                search(held.slice(first, end - first))
                first = end
            held = held.slice(first)
        if held is not None and held.num_rows:
            search(held)
        for one, (i, key, _) in zip(best, asked, strict=True):
            n = len(one.score)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i] * n, pa.int64()),
                        pa.array([key] * n, pa.int64()),
                        pa.array(one.id, pa.int64(), mask=one.missing),
                        pa.array(one.score, pa.int64()),
                    ],
                    names=["item", "item_id", "doc_id", "score"],
                )

    rows = wanted.select("shard", "number", "df", "heads", "impacts", "payload").unionByName(
        index.filter("term IS NULL").select("shard", F.lit(None).cast("int").alias("number"), "df", "heads", "impacts", "payload")
    )
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_OF_A_TASK)
    dealt = rows.repartition(partitions, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(
    index: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_column: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for each item.

    Equal scores rank by rising document id, rows without one last. Every row of ``items`` is an
    item of its own; one without terms has no rows. Items are the queries of a search, a stated
    set: they pass through the driver in blocks of a thousand.
    """
    spark = index.sparkSession
    rows = items.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`").cast("string")).toLocalIterator()
    parts: list[DataFrame] = []
    block: list[tuple[int, int | None, dict[bytes, int]]] = []

    def close() -> None:
        if block and (part := _search_block(index, list(block), k, window)) is not None:
            parts.append(part)
        block.clear()

    for i, (key, content) in enumerate(rows):
        block.append((i, key, _term_counts(content)))
        if len(block) == ITEMS_AT_ONCE:
            close()
    close()
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS t FROM documents),
l AS (SELECT doc_id, len(t)::HUGEINT AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::HUGEINT AS big_n, sum(n) AS big_l FROM l),
p AS (SELECT doc_id, term, count(*)::HUGEINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS w FROM f, g),
q AS (SELECT item_id, unnest({_SPLIT.format("text")}) AS term FROM benchmark),
s AS (
  SELECT q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * l.n * big_n) // big_l)))) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), g GROUP BY q.item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 20
"""
