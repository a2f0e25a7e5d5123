"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A rolling hash over seven bytes ends a chunk where its lowest bits are zero; each chunk gives one of
64 characters. The block size (the mean chunk) starts at the least power of two, from 4 on, that
cuts the text into 64 chunks or fewer, and is halved while there are fewer than 32. A fingerprint holds the
characters for the block size and for twice that size, so texts whose block sizes differ by a factor
of two still compare. Likeness is one less the edit distance as a share of the longer signature, 0
where the signatures share no run of seven characters (of the shorter one's length if it is shorter).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import CHUNK_BYTES, mix, text_column

# Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_POWERS: dict[int, np.ndarray] = {}
WINDOW = 7
LEAST_BLOCK = 4
LONGEST, FEWEST = 64, 32
COMMON_RUN = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_CODE = np.zeros(256, dtype=np.int64)
_CODE[ALPHABET] = np.arange(64)
_STEP = np.uint32(0x01000193)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; kept for the next call up to four chunks."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        kept = np.full(size, np.uint64(base), dtype=np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = kept
    return kept[:n]


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the hash of it and the six before it; the first six are not used."""
    value = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    out = value.copy()
    factor = _STEP
    for k in range(1, WINDOW):
        out[k:] += value[:-k] * factor
        factor = np.uint32(int(factor) * int(_STEP) & 0xFFFFFFFF)
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def _signature(sums: np.ndarray, inverse: np.ndarray, begin: int, end: int, cuts: np.ndarray) -> str:
    """Characters of the chunks of one text; ``cuts`` are the positions after a chunk."""
    cuts = cuts[cuts < end][: LONGEST - 1]
    if begin == end:
        return ""
    edges = np.r_[begin, cuts, end]
    name = mix((sums[edges[1:]] - sums[edges[:-1]]) * inverse[edges[:-1]])
    return ALPHABET[(name >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def _fingerprints(texts: Sequence[bytes]) -> list[tuple[int, str, str]]:
    """Block size and two signatures for each of some texts."""
    # Seven zero bytes before each text: its first windows do not see the text before.
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(np.r_[WINDOW, lengths[:-1] + WINDOW])
    end = begin + lengths
    rolled = _rolling(data)
    at = np.flatnonzero(rolled & np.uint32(LEAST_BLOCK - 1) == 0)
    low = rolled[at]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    inverse = powers(_INVERSE, len(data) + 1)
    first, last = np.searchsorted(at, begin), np.searchsorted(at, end)
    out = []
    for b, e, i, j, n in zip(begin.tolist(), end.tolist(), first.tolist(), last.tolist(), lengths.tolist(), strict=True):
        block = LEAST_BLOCK
        while block * LONGEST < n:
            block *= 2
        where, bits = at[i:j] + 1, low[i:j]
        cuts = where[bits & np.uint32(block - 1) == 0]
        while len(cuts) + 1 < FEWEST and block > LEAST_BLOCK:
            block //= 2
            cuts = where[bits & np.uint32(block - 1) == 0]
        double = where[bits & np.uint32(2 * block - 1) == 0]
        out.append((block, _signature(sums, inverse, b, e, cuts), _signature(sums, inverse, b, e, double)))
    return out


def fingerprints(texts: Sequence[bytes]) -> list[tuple[int, str, str]]:
    """As above for any number of texts, a few megabytes at a time."""
    out, part, size = [], [], 0
    for text in texts:
        if part and size + len(text) > CHUNK_BYTES:
            out += _fingerprints(part)
            part, size = [], 0
        part.append(text)
        size += len(text) + WINDOW
    return out + (_fingerprints(part) if part else [])


def edit_distances(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures, all pairs at once in 64-bit vectors."""
    n = len(left)
    one = np.uint64(1)
    m = np.array([len(s) for s in left], dtype=np.int64)
    k = np.array([len(s) for s in right], dtype=np.int64)
    equal = np.zeros((n, 64), dtype=np.uint64)
    row = np.repeat(np.arange(n), m)
    place = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    np.bitwise_or.at(equal, (row, _CODE[np.frombuffer("".join(left).encode(), dtype=np.uint8)]), one << place.astype(np.uint64))
    text = np.zeros((n, int(k.max(initial=0))), dtype=np.int64)
    row_k = np.repeat(np.arange(n), k)
    text[row_k, np.arange(len(row_k)) - np.repeat(np.cumsum(k) - k, k)] = _CODE[np.frombuffer("".join(right).encode(), dtype=np.uint8)]
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    score, top = m.copy(), np.maximum(m - 1, 0).astype(np.uint64)
    every = np.arange(n)
    for j in range(text.shape[1]):
        eq = equal[every, text[:, j]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up)
        mh = up & xh
        change = ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        score = np.where(j < k, score + change, score)
        ph = (ph << one) | one
        mh = mh << one
        up, down = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, k, score)


def _share_run(a: str, b: str) -> bool:
    run = min(COMMON_RUN, len(a), len(b))
    if not run:
        return a == b
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    return any(b[i : i + run] in grams for i in range(len(b) - run + 1))


def likeness(left: Sequence[tuple[int, str, str]], right: Sequence[tuple[int, str, str]]) -> np.ndarray:
    """Likeness of pairs of fingerprints, from 0 to 1; equal fingerprints have 1."""
    pair, a, b = [], [], []
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1
            continue
        for kx, ky in ((1, 1), (2, 2), (1, 2), (2, 1)):
            if x[0] * kx == y[0] * ky and _share_run(x[kx], y[ky]):
                pair.append(i)
                a.append(x[kx])
                b.append(y[ky])
    if pair:
        longer = np.array([max(len(s), len(t), 1) for s, t in zip(a, b, strict=True)])
        np.maximum.at(out, np.array(pair), 1 - edit_distances(a, b) / longer)
    return out


def shown(fingerprint: tuple[int, str, str]) -> str:
    return ":".join(map(str, fingerprint))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at most ``key``: first among every k-th bound, then among those between."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[step - 1 :: step]).cast("array<bigint>"), lambda b: b <= key))
    fine = F.slice(F.lit(bounds).cast("array<bigint>"), coarse * step + 1, F.lit(step))
    return coarse * step + F.size(F.filter(fine, lambda b: b <= key))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents dealt out by ranges of descending ``doc_id``, each range in order and closed by the next one's first.

    Columns ``bucket, lead, doc_id, text``; ``lead`` marks the copy of the following range's first
    document, the first range following the last. Only ids are looked at to find the ranges; the
    texts are shuffled once. ``buckets`` bounds what the driver and the broadcast hold: one id for
    each range.
    """
    spark = docs.sparkSession
    # Bitwise not turns the order around without overflow; rows without an id come last.
    key = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(2**63 - 1))
    keyed = docs.select(key.alias("key"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shares = [k / buckets for k in range(1, buckets)]
    cut = keyed.agg(F.percentile_approx("key", shares, 10 * buckets).alias("b")).first().b if shares else []
    keyed = keyed.withColumn("bucket", _bucket(F.col("key"), sorted(set(cut or []))))
    firsts = sorted((r.bucket, r.key) for r in keyed.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    leads = [(firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]
    lead = spark.createDataFrame(leads, "key long, before int")
    out = keyed.join(F.broadcast(lead), "key", "left").withColumn(
        "to",
        F.explode(
            F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("lead")))).otherwise(
                F.array(F.struct(F.col("bucket"), F.lit(False).alias("lead")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("lead")))
            )
        ),
    )
    out = out.select("to.bucket", "to.lead", "key", "doc_id", "text")
    return out.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lead", "key", "text").drop("key")


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """The result for rows of doc_id, text and the next document's text."""
    texts = [text for _, text, _ in rows]
    edited = [text[: len(text) - len(text) // 3] + follow[: len(text) // 3] for _, text, follow in rows]
    raw = [text.encode() for text in edited]
    own = fingerprints([text.encode() for text in texts])
    changed = fingerprints(raw)
    follow = [*own[1:], *fingerprints([rows[-1][2].encode()])]
    for k in range(len(rows) - 1):
        if rows[k][2] is not texts[k + 1]:  # the range ends here
            follow[k] = fingerprints([rows[k][2].encode()])[0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([doc_id for doc_id, _, _ in rows], pa.int64()),
            pa.array([len(text) for text in texts], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
            pa.array([shown(x) for x in own]),
            pa.array([shown(x) for x in changed]),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, follow)),
        ],
        schema=FOUND,
    )


def edited_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how near they and their successors are.

    The edited text has its last third (rounded down, in code points) replaced by the first as many
    of the next document's, descending by ``doc_id``. Null texts count as empty; rows with equal
    ``doc_id`` follow one another by text, rows without one come last; of a single row it is itself
    the next. Two empty texts have likeness 1, equal rows equal fingerprints; a very long text is
    handled by itself, and an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, str] | None = None
        closed = False
        rows: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            bucket, lead, doc_id = (batch.column(k).to_pylist() for k in range(3))
            for b, is_lead, d, text in zip(bucket, lead, doc_id, text_column(batch, "text").to_pylist(), strict=True):
                if is_lead and closed:
                    continue  # rows that share the first id of the next range
                if held is not None:
                    rows.append((held[1], held[2], text))
                    size += len(held[2])
                closed = is_lead
                held = None if is_lead else (b, d, text)
                if size > CHUNK_BYTES:
                    yield _compare(rows)
                    rows, size = [], 0
        if rows:
            yield _compare(rows)

    return with_next(own, buckets).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op5_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likeness for all documents."""
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
