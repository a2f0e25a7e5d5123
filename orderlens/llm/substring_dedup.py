"""Removal of word windows seen in earlier documents, by recompression.

Round one names symbols: neighbouring words become a pair where the first has an even and the second
an odd name bit, equal neighbours are named as parts of a run, and other words stay single. Whether a
word pairs depends on it and its neighbours alone, so equal passages get equal symbols inside. Round
two names each symbol with the word before and after it. Of the symbols inside a window the one that
stands highest in a fixed order (long ones first, as they are rare) stands for the window: equal
windows have equal high symbols.

A Spark round then finds which high symbols several documents share; only windows under those are
named in full and compared in a second round. Names are global because they are hashes: no
dictionary is built. Each round is one shuffle of small rows, in which a task sends a symbol once
for all its documents, so a passage in a third of all documents does not meet in one place. Texts
are shuffled once, compressed, and joined with their symbols and with their windows, by ``doc_id`` and,
for rows without an id or with a repeated one, a hash of the text: these spread like others. A row with its
own id sends no hash, which would be a third of all that is shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import stored
from .words import Chunk, Words, chunks, covered, mix, slices, text_column, window_names, window_starts, words_of

WINDOW = 13
#: Words on either side of a symbol that its high-level name takes in.
CONTEXT = 1

_PAIR, _RUN, _HIGH = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: ``hashes`` are those of a task's texts with the name and the ``doc``.
NAMES = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("hashes", pa.list_(pa.int64())), ("known", pa.bool_())])
NAMES_SQL = "name long, doc long, hashes array<long>, known boolean"
PAIRS = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("hash", pa.int64())])
#: The order of documents without an id.
NO_ID = 2**63 - 1
#: Repeated ids that are broadcast at most. With more, all rows are told apart by their hashes too.
MOST_REPEATED = 1_000_000


def high_symbols(words: Words) -> np.ndarray:
    """For each word the high symbol of the block that begins there; 0 where none begins or the row's edge is near.

    The top byte holds the length of the block's words in bytes, up to 255, the rest is its name.
    """
    name, row = words.name, words.row
    n = len(name)
    out = np.zeros(n, dtype=np.uint64)
    if n < 3:
        return out
    odd = (name >> np.uint64(17)) & np.uint64(1) == 1
    together = row[1:] == row[:-1]
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = together & ~odd[:-1] & odd[1:]
    second = np.r_[False, pair[:-1]]
    equal = np.r_[together & (name[1:] == name[:-1]), False]
    run = equal | np.r_[False, equal[:-1]]
    follow = np.r_[name[1:], np.uint64(0)]
    symbol = np.where(pair, mix(name * _PAIR + follow), np.where(run, mix(name + _RUN), name))
    length = np.where(pair, 2, 1)
    at = np.flatnonzero(~second)
    at = at[(at >= CONTEXT) & (at + length[at] + CONTEXT <= n)]
    after = at + length[at]
    inside = (row[at - CONTEXT] == row[at]) & (row[after + CONTEXT - 1] == row[at])
    at, after = at[inside], after[inside]
    high = mix((name[at - 1] * _HIGH + symbol[at]) * _HIGH + name[after])
    # Of the words alone: what stands between them may differ.
    letters = words.stop - words.start
    size = np.minimum(letters[at] + np.where(after - at == 2, letters[after - 1], 0), 255).astype(np.uint64)
    out[at] = (size << np.uint64(56)) | (high >> np.uint64(8))
    return out


def window_symbols(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and for each the highest symbol wholly inside it with its context."""
    start = window_starts(words.bounds, window)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    # Blocks hold two words at most: first words from the second on, so that block and context end inside.
    width = window - 2 * CONTEXT - 1
    best, reach = high_symbols(words), 1
    while reach < width:
        step = min(reach, width - reach)
        best = np.maximum(best[: len(best) - step], best[step:])
        reach += step
    return start, best[start + CONTEXT]


def _first_docs(name: np.ndarray, doc: np.ndarray, text: np.ndarray, providers: bool) -> pa.RecordBatch:
    """What a task sends for its names: a name's least document, and what is known here already.

    A document with a name that a smaller one of the same task has is ``known`` to share it; with
    ``providers`` so is the smaller one. Texts (hashes) of the least document go in one row.
    """
    order = np.lexsort((text, doc, name))
    name, doc, text = name[order], doc[order], text[order]
    keep = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])][: len(name)]
    name, doc, text = name[keep], doc[keep], text[keep]
    begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
    size = np.diff(np.r_[begin, len(name)])
    least = doc == np.repeat(doc[begin], size)
    total = np.r_[0, np.cumsum(least)]
    ends = np.r_[begin, len(name)]
    texts = total[ends[1:]] - total[ends[:-1]]
    known = ~least
    if providers:
        known = known | np.repeat(texts < size, size)
    at = np.flatnonzero(known)
    lists = [np.cumsum(np.r_[0, texts]), int(texts.sum()) + np.arange(1, len(at) + 1)]
    hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32)), pa.array(np.r_[text[least], text[at]]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[name[begin], name[at]].view(np.int64)),
            pa.array(np.r_[doc[begin], doc[at]]),
            hashes,
            pa.array(np.arange(len(begin) + len(at)) >= len(begin)),
        ],
        schema=NAMES,
    )


def _each_text(name: pa.Array, doc: pa.Array, hashes: pa.Array) -> pa.RecordBatch:
    """A row for each hash."""
    of = pa.compute.list_parent_indices(hashes)
    return pa.RecordBatch.from_arrays([name.take(of), doc.take(of), pa.compute.list_flatten(hashes)], schema=PAIRS)


def shared_names(rows: DataFrame, providers: bool) -> DataFrame:
    """``name, doc, hash`` for texts that have a name in common with a smaller document.

    ``rows`` has the columns of ``NAMES``. The rows of a name come in order of documents as a
    stream, so a task holds one batch. With ``providers`` the smallest document of a shared name is
    named too; its rows, several only for a repeated ``doc_id``, are held as hashes until a larger
    one comes. Without an id there is none larger, so nothing is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None  # name, its least document, whether a larger one came
        held: list[pa.RecordBatch] = []  # rows of that document
        for batch in batches:
            name, doc, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            out = known.copy()
            at = np.flatnonzero(~known)
            if len(at):
                name, doc = name[at], doc[at]
                begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                least = doc[begin].copy()
                came = np.zeros(len(begin), dtype=bool)
                carried = last is not None and last[0] == name[0]
                if carried:
                    least[0], came[0] = last[1:]
                else:
                    held = []
                of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(name)]))
                later = doc > least[of]
                out[at[later]] = True
                came[of[later]] = True
                if providers:
                    first = ~later
                    out[at[first & came[of]]] = True
                    if carried and came[0]:
                        yield from (_each_text(*h.columns[:3]) for h in held)
                        held = []
                    if len(begin) > 1:
                        held = []
                    waits = first & (of == len(begin) - 1) & ~came[of] & (doc != NO_ID)
                    if waits.any():
                        held.append(batch.take(pa.array(at[waits])))
                last = (int(name[-1]), int(least[-1]), bool(came[-1]))
            found = batch.filter(pa.array(out))
            yield _each_text(*found.columns[:3])

    # Rows that are known already only pass through, and go anywhere.
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("doc", F.get("hashes", F.lit(0)))).otherwise(F.col("name")))
    return dealt.sortWithinPartitions("name", "doc").mapInArrow(run, "name long, doc long, hash long")


def _by_document(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc", "hash").agg(F.collect_set("name").alias("names"))


def _told_apart(docs: DataFrame, most: int = MOST_REPEATED) -> DataFrame:
    """``doc_id, doc, hash, text``: the order of documents, and what tells the texts of one ``doc`` apart; 0 where it has one row.

    Runs a job that counts ids. Windows are judged by ``doc`` alone, so the hash never changes a result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    own = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), text.alias("text"))
    ids = docs.select(doc_id.alias("doc_id")).filter(F.col("doc_id").isNotNull())
    repeated = stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("doc_id"), "repeated-ids")
    n = repeated.count()
    alone = F.col("doc_id").isNotNull()
    if n > most:
        alone = F.lit(False)
    elif n:
        own = own.join(F.broadcast(repeated.withColumn("_repeated", F.lit(True))), "doc_id", "left")
        alone &= F.col("_repeated").isNull()
    return own.select("doc_id", "doc", F.when(alone, F.lit(0)).otherwise(F.xxhash64("text")).alias("hash"), "text")


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, hash, packed``: rows of ``_told_apart`` with their texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            packed = [pack(t.encode()) for t in text_column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["doc_id", "doc", "hash", "packed"])

    return docs.mapInArrow(run, "doc_id long, doc long, hash long, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, Words, list[np.ndarray]]]:
    """Chunks of a batch with ``packed`` texts, their words and the names in ``names`` for each row."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = pa.array([unpack(x) for x in batch.column("packed").to_pylist()], pa.large_binary())
    names = batch.column("names")
    offsets = names.offsets.to_numpy()  # of the slice, into all values
    values = names.values.to_numpy(zero_copy_only=False).view(np.uint64)
    valid = names.is_valid().to_numpy(zero_copy_only=False)
    for chunk in chunks(texts):
        rows = range(chunk.first, chunk.first + chunk.rows)
        yield chunk, words_of(chunk), [values[offsets[r] : offsets[r + 1]] if valid[r] else values[:0] for r in rows]


def _among(values: np.ndarray, bounds: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    """Which values, those of row r at ``bounds[r]:bounds[r + 1]``, are among the row's names."""
    out = np.zeros(len(values), dtype=bool)
    for r, own in enumerate(names):
        if len(own):
            out[bounds[r] : bounds[r + 1]] = np.isin(values[bounds[r] : bounds[r + 1]], own)
    return out


def symbols_of_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``name, doc, hashes, known``: the high symbols that stand for a window of each row of ``_told_apart``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc", "hash"))
            parts = []
            for chunk in chunks(text_column(batch, "text")):
                words = words_of(chunk)
                start, symbol = window_symbols(words, window)
                row = words.row[start]
                new = np.r_[True, (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])][: len(start)]
                parts.append((symbol[new], ids[chunk.first + row[new]], hashes[chunk.first + row[new]]))
            if parts:
                yield _first_docs(*(np.concatenate([p[k] for p in parts]) for k in range(3)), True)

    return docs.select("doc", "hash", "text").mapInArrow(run, NAMES_SQL)


def windows_of_documents(joined: DataFrame, window: int = WINDOW) -> DataFrame:
    """``name, doc, hashes, known``: full names of the windows under the symbols in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in slices(iter([batch])):
                ids, hashes = (part.column(c).to_numpy() for c in ("doc", "hash"))
                for chunk, words, names in _unpacked(part):
                    start, symbol = window_symbols(words, window)
                    bounds = np.searchsorted(start, words.bounds)
                    hit = _among(symbol, bounds, names)
                    full = window_names(words.name, window)
                    row = chunk.first + words.row[start[hit]]
                    parts.append((full[start[hit]], ids[row], hashes[row]))
            if parts:
                yield _first_docs(*(np.concatenate([p[k] for p in parts]) for k in range(3)), False)

    return joined.mapInArrow(run, NAMES_SQL)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Each document without the words of windows that also start in a document with a smaller ``doc_id``.

    Columns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``kept``: the
    words that stay, joined by blanks. Windows are judged on the input. A null text has no words. A
    null ``doc_id`` counts as larger than all others; rows of one ``doc_id`` never remove each
    other's words and each get their own result. Windows of one document only do not count, however
    often they come. Texts of any length are handled whole; equal texts of different ids lose all
    their windows but for the least id's; an empty table gives no rows. Other columns are not read.
    ``window`` is at least 5.
    """
    if window < 5:
        raise ValueError("a window has at least five words")
    docs = _told_apart(docs)
    texts = _texts(docs)
    symbols = _by_document(shared_names(symbols_of_documents(docs, window), True))
    named = windows_of_documents(texts.join(symbols.hint("shuffle_hash"), ["doc", "hash"]).select("doc", "hash", "packed", "names"), window)
    windows = _by_document(shared_names(named, False))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for chunk, words, names in _unpacked(batch):
                gone = np.zeros(len(words.name), dtype=bool)
                if any(map(len, names)):
                    start = window_starts(words.bounds, window)
                    full = window_names(words.name, window)[start]
                    at = start[_among(full, np.searchsorted(start, words.bounds), names)]
                    gone = covered(len(gone), at, at + window)
                stay = (~gone).tolist()
                data, kept = chunk.data.tobytes(), []
                for r in range(chunk.rows):
                    own = data[chunk.offsets[r] : chunk.offsets[r + 1]].split()
                    kept.append(b" ".join(itertools.compress(own, stay[words.bounds[r] : words.bounds[r + 1]])))
                total = np.r_[0, np.cumsum(gone)]
                columns = [
                    batch.column("doc_id").slice(chunk.first, chunk.rows),
                    pa.array(np.diff(words.bounds)),
                    pa.array(np.diff(total[words.bounds])),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ]
                if keep_text:
                    columns.append(pa.array([x.decode() for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return texts.join(windows.hint("shuffle_hash"), ["doc", "hash"], "left").select("doc_id", "packed", "names").mapInArrow(run, kinds)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows of smaller documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
