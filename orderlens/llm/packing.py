"""Packing of documents into token windows by the online sum-of-squares rule.

A document is its ids and one closing id. Whole windows are cut off first; the rest goes to the fill
level at which the sum of the squared counts of partially filled windows becomes least, the counts
standing in an array by level. Each task packs the rows of its own partition as they come, with
bounded memory: at most ``per_level`` windows stay open on a level. One more joins the crowded level
by being cut, and what is open at the end is cut likewise, into whole windows and windows whose
length is a power of two, which need no padding. So no sequence is padded at all.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import TextCoder
from .words import text_column

#: Texts tokenized together.
_TEXTS = 512
#: Words whose ids a worker remembers.
_KEPT_WORDS = 700_000
#: Sequences of one partition have numbers below this.
_PER_PARTITION = 1 << 40
#: A piece in the making: row number in the task, start, ids.
Piece = tuple[int, int, bytes]

PIECES = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


class SumOfSquares:
    """Places items of fewer than ``size`` ids into open windows; ``emit`` gets each finished sequence."""

    def __init__(self, size: int, emit: Callable[[list[Piece]], None], per_level: int = 16):
        self._size, self._emit, self._per_level = size, emit, per_level
        self._count = np.zeros(size + 1, dtype=np.int64)
        self._open: list[list[list[Piece]]] = [[] for _ in range(size)]

    def place(self, row: int, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        level = self.level(n)
        window = self._open[level].pop() if level else []
        if level:
            self._count[level] -= 1
        window.append((row, start, ids))
        if level + n == self._size:
            self._emit(window)
            return
        self._open[level + n].append(window)
        self._count[level + n] += 1
        if self._count[level + n] > self._per_level:
            self._count[level + n] = 0
            crowded, self._open[level + n] = self._open[level + n], []
            self._cut(crowded)

    def level(self, n: int) -> int:
        """Fill level for an item of ``n`` ids; 0 opens a window. Ties go to the fullest level."""
        count = self._count
        # From a level h with windows to h + n the sum changes by 2 (count[h + n] - count[h] + 1);
        # a full window leaves it (-2 count[h] + 1), a new one only adds (2 count[n] + 1).
        levels = np.arange(1, self._size - n + 1)
        change = 2 * (count[levels + n] - count[levels] + 1)
        change[-1:] = 1 - 2 * count[self._size - n]
        change[count[levels] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * count[n] + 1 else 0

    def close(self) -> None:
        """Cut all open windows into whole ones and one rest."""
        self._cut([window for windows in reversed(self._open) for window in windows])
        self._open = [[] for _ in range(self._size)]
        self._count[:] = 0

    def _cut(self, windows: list[list[Piece]]) -> None:
        """The windows' ids one after another: whole windows, then powers of two."""
        left = sum(len(ids) // 4 for window in windows for _, _, ids in window)
        room = self._room(left)
        made: list[Piece] = []
        free = room
        for row, start, ids in (piece for window in windows for piece in window):
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(free, n - at)
                made.append((row, start + at, ids[4 * at : 4 * (at + take)]))
                at, free, left = at + take, free - take, left - take
                if not free:
                    self._emit(made)
                    made, free = [], self._room(left)

    def _room(self, left: int) -> int:
        return self._size if left >= self._size else 1 << (left.bit_length() - 1) if left else 0


#: Words joined to one text for the tokenizer.
_TOGETHER = 1000


# Fixed value: the split pattern of byte-level vocabularies.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters below this are of one class in every edition of Unicode.
_SETTLED = "\u0250"


def _byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked_encoding(vocabulary: str) -> tiktoken.Encoding | None:
    """The same vocabulary in a form that encodes words without setting up a text each time.

    None unless the file is a plain byte-level one whose merges come in the order of their ids.
    """
    content = json.loads(vocabulary)
    model, split = content["model"], content["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or content["normalizer"] or model["type"] != "BPE" or any(model.get(o) for o in options):
        return None
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or (made and made[0] < 0):
        return None
    byte_of = _byte_characters()
    added = {t["content"] for t in content["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of many short texts by a byte-level tokenizer.

    Words of settled characters go through ``ranked``, if there is one; the rest takes few calls of
    the tokenizer.

    Texts that neither begin nor end with white space, but for one first blank, are joined by line
    feeds, which the split pattern makes pieces of their own; the ids are cut at the line feed's id.
    Texts that hold an added token are encoded alone, as such tokens are cut out before the pattern.
    """

    def __init__(self, tokenizer: tokenizers.Tokenizer, ranked: tiktoken.Encoding | None = None):
        self._tokenizer, self._ranked = tokenizer, ranked
        self._added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._feed = self._ids(["\n"])[0][0]

    def _ids(self, texts: Sequence[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        if self._ranked is None:
            return self._by_tokenizer(texts)
        out: list[bytes] = [b""] * len(texts)
        slow = []
        encode = self._ranked.encode_ordinary
        for k, text in enumerate(texts):
            if text and (text.isascii() or max(text) < _SETTLED) and not any(a in text for a in self._added):
                out[k] = array("I", encode(text)).tobytes()
            else:
                slow.append(k)
        for k, ids in zip(slow, self._by_tokenizer([texts[k] for k in slow]), strict=True):
            out[k] = ids
        return out

    def _by_tokenizer(self, texts: Sequence[str]) -> list[bytes]:
        joined = [
            k
            for k, t in enumerate(texts)
            if t and not t[-1].isspace() and (t[0] == " " or not t[0].isspace()) and "\n" not in t
            and not any(a in t for a in self._added)
        ]
        out: list[bytes] = [b""] * len(texts)
        alone = sorted(set(range(len(texts))).difference(joined))
        for k, ids in zip(alone, self._ids([texts[k] for k in alone]), strict=True):
            out[k] = np.array(ids, dtype="<u4").tobytes()
        groups = [joined[i : i + _TOGETHER] for i in range(0, len(joined), _TOGETHER)]
        for group, ids in zip(groups, self._ids(["\n".join([texts[k] for k in group]) for group in groups]), strict=True):
            data = np.array(ids, dtype="<u4")
            feeds = np.flatnonzero(data == self._feed)
            if len(feeds) != len(group) - 1:
                raise ValueError("the tokenizer does not keep line feeds apart")
            raw, edges = data.tobytes(), (4 * feeds).tolist()
            for k, a, b in zip(group, [0, *(x + 4 for x in edges)], [*edges, len(raw)], strict=True):
                out[k] = raw[a:b]
        return out


#: Text coders of this worker, by the digest of the vocabulary; its tasks share them.
_CODERS: dict[str, TextCoder] = {}


def coder(vocabulary: str) -> TextCoder:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
        _CODERS[key] = TextCoder(WordEncoder(tokenizer, ranked_encoding(vocabulary)), kept=_KEPT_WORDS)
    return _CODERS[key]


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, per_level: int = 16, keep_ids: bool = True
) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``keep_ids``, the piece's ``ids`` (little-endian unsigned 32-bit). ``vocabulary`` is the content
    of a tokenizers file of a byte-level vocabulary, whose size is fixed. Ids are those of a plain call
    without special tokens of its own, so an added token that a text spells out has its one id; such
    tokens may hold no white space. No shuffle: a partition is packed where it is read, and a lost task packs
    the same rows anew with the same sequence numbers. A null text counts as empty (the closing id
    alone), a null ``doc_id`` stays null, repeated rows are packed each, other columns are not read.
    Levels of equal merit go to the fullest; a very long text fills windows of its own but for its
    rest; an empty table gives no rows.
    ``size`` is a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    content = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = PIECES.append(pa.field("ids", pa.binary())) if keep_ids else PIECES
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(content.value)
        sequence = TaskContext.get().partitionId() * _PER_PARTITION
        done: list[list] = []
        named: dict[int, list] = {}  # doc_id, tokens and tokens not yet packed, of documents in open windows
        row = 0

        def emit(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for at, start, ids in window:
                known = named[at]
                n = len(ids) // 4
                done.append([known[0], start, n, zlib.crc32(ids), known[1], sequence, offset] + [ids] * keep_ids)
                offset += n
                known[2] -= n
                if not known[2]:
                    del named[at]
            sequence += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done.clear()
            return batch

        packer = SumOfSquares(size, emit, per_level)
        whole = 4 * size
        for large in batches:
            for first in range(0, large.num_rows, _TEXTS):
                batch = large.slice(first, _TEXTS)
                coded = encoder.encode(text_column(batch, "text").to_pylist())
                for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                    ids += end
                    tokens = len(ids) // 4
                    named[row] = [doc_id, tokens, tokens]
                    for at in range(0, len(ids), whole):
                        part = ids[at : at + whole]
                        if len(part) == whole:
                            emit([(row, at // 4, part)])
                        else:
                            packer.place(row, at // 4, part)
                    row += 1
                yield rows()
        packer.close()
        yield rows()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def pack_public(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``pack_documents`` with the public 50k vocabulary and windows of 1024 ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return pack_documents(docs, file.read(), keep_ids=keep_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack_public(spark.read.parquet(f"{sf_dir}/documents.parquet"))
