"""Byte-level BPE: encoding by length-bucketed padded matrices of pairs, and decoding.

Distinct pieces of a batch go into matrices by length, one piece a row, bytes first. In each round
every row merges its leftmost pair of minimum rank; the pair's rank comes from a hash table in numpy
arrays, the merged cell is closed up and finished rows leave the matrix. Rows over 256 bytes merge
all leftmost occurrences of their minimum rank in a round, where that cannot change the order of the
merges, so a piece of a megabyte takes some thousand rounds and not a million.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceCoder, TextCoder
from .words import text_column

#: Above every rank.
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Rows up to this many bytes merge one pair a round.
_ONE_A_ROUND = 256
#: Cells of one matrix.
_CELLS = 1 << 20
#: Texts encoded together.
_TEXTS = 512


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class PairTable:
    """Rank of the token made of two neighbours, by open addressing over numpy arrays."""

    def __init__(self, ranks: Mapping[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        key, value = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
        bits = max(4, int(np.ceil(np.log2(max(len(key), 1) * 3))))
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._key = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self._value = np.full(1 << bits, _NONE, dtype=np.int32)
        self._probes, at = 0, self._slot(key)
        left = np.arange(len(key))
        while len(left):
            self._probes += 1
            free = self._key[at[left]] == np.iinfo(np.uint64).max
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self._key[at[put]], self._value[at[put]] = key[put], value[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where the two make no token."""
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self._slot(key)
        out = np.where(self._key[at] == key, self._value[at], _NONE)
        open_ = np.flatnonzero((self._key[at] != key) & (self._key[at] != np.iinfo(np.uint64).max))
        for _ in range(self._probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self._mask
            got = self._key[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self._value[at[open_[hit]]]
            open_ = open_[~hit & (got != np.iinfo(np.uint64).max)]
        return out.reshape(left.shape)


class MatrixEncoder:
    """Ids of pieces by the ranks of a vocabulary."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self._ranks = ranks
        self._pairs = PairTable(ranks)
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def __call__(self, pieces: Sequence[str]) -> list[bytes]:
        """The ids of each piece, little-endian unsigned 32-bit; a piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k, piece in enumerate(pieces):
            raw = piece.encode()
            token = self._ranks.get(raw)
            if token is not None:
                out[k] = token.to_bytes(4, "little")
            elif len(raw) > _ONE_A_ROUND:
                out[k] = self._long(raw)
            elif raw:
                buckets.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((k, raw))
        for width, rows in buckets.items():
            step = max(1, _CELLS // width)
            for i in range(0, len(rows), step):
                self._short(rows[i : i + step], width, out)
        return out

    def _short(self, rows: list[tuple[int, bytes]], width: int, out: list[bytes]) -> None:
        count = np.array([len(raw) for _, raw in rows])
        padded = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in rows), dtype=np.uint8)
        ids = self._byte[padded.reshape(len(rows), width)]
        where = np.array([k for k, _ in rows])
        rank = self._pairs.rank(ids[:, :-1], ids[:, 1:])
        rank[np.arange(width - 1) >= count[:, None] - 1] = _NONE
        while len(where):
            at = rank.argmin(axis=1)
            r = np.arange(len(at))
            least = rank[r, at]
            done = least == _NONE
            if done.any():
                for k, n, row in zip(where[done], count[done], ids[done], strict=True):
                    out[k] = row[:n].astype("<u4").tobytes()
                go = ~done
                where, count, ids, rank, at, least = where[go], count[go], ids[go], rank[go], at[go], least[go]
                if not len(where):
                    break
                r = np.arange(len(at))
                width = int(count.max())
                ids, rank = ids[:, :width], rank[:, : max(width - 1, 1)]
            ids[r, at] = least
            column = np.arange(width)
            ids = np.take_along_axis(ids, np.minimum(column + (column > at[:, None]), width - 1), axis=1)
            column = np.arange(rank.shape[1])
            rank = np.take_along_axis(rank, np.minimum(column + (column >= at[:, None]), rank.shape[1] - 1), axis=1)
            count = count - 1
            rank[column >= count[:, None] - 1] = _NONE
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < count - 1)
            rank[right, at[right]] = self._pairs.rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _long(self, raw: bytes) -> bytes:
        ids = self._byte[np.frombuffer(raw, dtype=np.uint8)]
        rank = self._pairs.rank(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != _NONE:
            at = np.flatnonzero(rank == least)
            # Of neighbouring occurrences, which share a symbol, every second one merges.
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[place % 2 == 0]
            merged, new_rank = self._merge(ids, rank, at, least)
            if len(at) > 1 and new_rank.min(initial=_NONE) < least:
                # A pair that comes up here goes before the other occurrences.
                merged, new_rank = self._merge(ids, rank, at[:1], least)
            ids, rank = merged, new_rank
        return ids.astype("<u4").tobytes()

    def _merge(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
        ids = ids.copy()
        ids[at] = token
        keep = np.ones(len(ids), dtype=bool)
        keep[at + 1] = False
        place = at - np.arange(len(at))
        ids, rank = ids[keep], np.append(rank, _NONE)[keep][:-1].copy()
        for near in (place - 1, place):
            near = near[(near >= 0) & (near < len(ids) - 1)]
            rank[near] = self._pairs.rank(ids[near], ids[near + 1])
        return ids, rank


class Decoder:
    """Bytes of ids, for any sequence of known ids."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self._token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._token[rank] = token

    def __call__(self, ids: bytes) -> bytes:
        token = self._token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


#: Encoders of this worker, by the digest of their ranks; tasks of one worker share them.
_CODERS: dict[str, tuple[TextCoder, Decoder]] = {}


def coder(ranks: bytes, pattern: str) -> tuple[TextCoder, Decoder]:
    """The worker's encoder and decoder for the content of a rank file."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _CODERS:
        parsed = parse_ranks(ranks)
        _CODERS[key] = (TextCoder(PieceCoder(pattern, MatrixEncoder(parsed))), Decoder(parsed))
    return _CODERS[key]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256`` for each row of documents.

    A map over rows without a shuffle. The ranks are one vocabulary file, whose size is fixed, and
    go to each executor once. A null text counts as empty (no ids), a null ``doc_id`` stays null,
    repeated rows each get their own result, other columns are not read. Of pairs of one rank the
    leftmost merges first; a piece of any length is encoded whole; an empty table gives no rows.
    ``ids=False`` leaves out
    the two columns of binary content.
    """
    content = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    if ids:
        fields += [("ids", pa.binary()), ("decoded", pa.binary())]
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(content.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(at, _TEXTS)
                coded = encoder.encode(text_column(batch, "text").to_pylist())
                plain = [decoder(x) for x in coded]
                columns = [batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64())]
                if ids:
                    columns += [pa.array(coded, pa.binary()), pa.array(plain, pa.binary())]
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (coded, plain)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kinds = "doc_id long, n_tokens long, " + "ids binary, decoded binary, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests, by the public 50k vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, ids=False)
