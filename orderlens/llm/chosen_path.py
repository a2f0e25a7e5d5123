"""Similarity join on word shingles by chosen paths.

A document is the set of its five-word shingles, hashed; equal sets count as copies and are joined
once. A set is embedded as 128 min-hash values. In each of several independent runs every set starts
at the run's root and goes on to one or two children a level: the node's own hash picks coordinates,
the set's values there name the children. Sets of similarity J share a picked value with chance J, so
a pair above the threshold keeps at least one common child on average and meets at the last level of
a run with a chance near two thirds; sets with little in common part at once. Nodes still crowded
then are split further by more coordinates, and those that stay crowded are compared in blocks. As a
pair may part on these further levels, sets that stood in a crowded node make more runs.

Small nodes are compared by brute force on short sketches. That gives candidate components, within
which every pair of sets is verified exactly on the shingles themselves. The numbers of runs follow
from the recall asked for, the levels, and how many of the coordinates a pair happens to share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .components import connected_components
from .groups import in_blocks, over_groups, pairs, roots
from .words import Chunk, Words, chunks, mix, slices, text_column, window_names, words_of

SHINGLE = 5
#: Links need a Jaccard similarity of NEAR / OF.
NEAR, OF = 4, 5
#: Coordinates of the embedding, levels of a run, and levels that crowded nodes may go on.
COORDINATES, LEVELS, MORE_LEVELS = 128, 3, 4
#: A node goes to a second child with chance one in so many, so children times 0.8 is one.
SECOND = 4
#: Sets compared together, and the share of equal sketch coordinates that makes a candidate.
BLOCK, CANDIDATE = 512, 0.6
RECALL = 0.99999

_CHILD, _NODE = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


def runs_needed(recall: float, levels: int = LEVELS, near: float = NEAR / OF) -> int:
    """Runs after which a pair at the threshold has met with at least this chance.

    All runs read the same coordinates, of which the pair shares a binomial number; its chance to
    have met is the mean over that number.
    """
    shared = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, k) * near**k * (1 - near) ** (COORDINATES - k) for k in shared.tolist()])
    met = np.ones(len(shared))
    for _ in range(levels):
        miss = 1 - shared / COORDINATES * met
        met = 1 - ((1 - 1 / SECOND) * miss + miss * miss / SECOND)
    runs = 1
    while chance @ (1 - met) ** runs > 1 - recall:
        runs += 1
    return runs


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the rows' bounds among them.

    A row of fewer words than a shingle has one shingle of all of them; a row without words has none.
    """
    n_words = np.diff(words.bounds)
    full = window_names(words.name, size)
    start = np.arange(len(full))
    ok = words.row[start] == words.row[start + size - 1] if len(full) else np.zeros(0, dtype=bool)
    value, row = [full[ok]], [words.row[start[ok]]]
    for n in range(1, size):
        rows = np.flatnonzero(n_words == n)
        if len(rows):
            at = words.bounds[rows]
            short = words.name[at].copy()
            for k in range(1, n):
                short = short * _NODE + words.name[at + k]
            value.append(mix(short + np.uint64(n)))
            row.append(rows)
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])][: len(value)]
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(n_words) + 1))


def _reduced(function: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    """``function`` over the values of each row."""
    filled = bounds[1:] > bounds[:-1]
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    if filled.any():
        out[filled] = function.reduceat(values, bounds[:-1][filled])
    return out


def set_keys(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, the same for equal sets."""
    size = np.diff(bounds).astype(np.uint64)
    return mix(_reduced(np.add, mix(value + _CHILD), bounds, 0) + mix(size))


def embedding(value: np.ndarray, bounds: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Min-hash values of each set, rows by coordinates."""
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * _NODE)
    out = np.zeros((len(bounds) - 1, coordinates), dtype=np.uint32)
    for k in range(coordinates):
        hashed = ((value * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = _reduced(np.minimum, hashed, bounds, 0)
    return out


def next_level(node: np.ndarray, at: np.ndarray, embedded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes; ``at`` names the row of ``embedded`` that stands at each node."""
    picks = mix(node + _NODE)
    coordinates = np.uint64(embedded.shape[1])
    second = (picks >> np.uint64(40)) % np.uint64(SECOND) == 0
    picked = np.r_[picks % coordinates, ((picks >> np.uint64(20)) % coordinates)[second]].astype(np.int64)
    parent, row = np.r_[node, node[second]], np.r_[at, at[second]]
    token = embedded[row, picked].astype(np.uint64) | (picked.astype(np.uint64) << np.uint64(32))
    return mix(parent * _CHILD + mix(token)), row


def _paths(embedded: np.ndarray, runs: int, levels: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes at the last level of the runs from ``first`` up to ``runs``, and their rows; each pair once."""
    rows = len(embedded)
    node = np.repeat(mix(np.arange(first + 1, runs + 1, dtype=np.uint64) * _CHILD), rows)
    at = np.tile(np.arange(rows), runs - first)
    for _ in range(levels):
        node, at = next_level(node, at, embedded)
    return node, at


def _own(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, hash, text``; ``doc`` orders rows, those without an id last, with ``hash`` it names one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def embedded_documents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, doc, hash, key, empty, embedded, sketch`` for each row.

    The key of its set, its min-hash values, and their lowest bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(text_column(batch, "text")):
                value, bounds = shingle_sets(words_of(chunk), size)
                values = embedding(value, bounds)
                binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(chunk.first, chunk.rows) for c in batch.columns[:3]),
                        pa.array(set_keys(value, bounds).view(np.int64)),
                        pa.array(np.diff(bounds) == 0),
                        binary(values),
                        binary(values.astype(np.uint8)),
                    ],
                    names=["doc_id", "doc", "hash", "key", "empty", "embedded", "sketch"],
                )

    return _own(docs).mapInArrow(run, "doc_id long, doc long, hash long, key long, empty boolean, embedded binary, sketch binary")


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str = "<u4") -> np.ndarray:
    """Binary values of one length as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1) if values else np.zeros((0, COORDINATES), dtype=kind)


def _nodes(keys: np.ndarray, node: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    node, key = node.view(np.int64), keys[at]
    order = np.lexsort((key, node))
    node, key = node[order], key[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (key[1:] != key[:-1])][: len(node)]
    return pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(key[new])], names=["node", "key"])


def _start(sets: DataFrame, runs: int, first_run: int = 0) -> DataFrame:
    """``node, key``: where each set stands after the first levels of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                yield _nodes(batch.column(0).to_numpy(), *_paths(_matrix(batch.column(1)), runs, LEVELS, first_run))

    return sets.select("key", "embedded").mapInArrow(run, "node long, key long")


def _onward(rows: DataFrame) -> DataFrame:
    """``node, key`` one level on, from ``node, key, embedded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            yield _nodes(batch.column(1).to_numpy(), *next_level(node, np.arange(len(node)), _matrix(batch.column(2))))

    return rows.select("node", "key", "embedded").mapInArrow(run, "node long, key long")


def _met(nodes: DataFrame) -> DataFrame:
    """``node, key, n`` for nodes at which ``n`` > 1 sets stand."""
    # Dealt out by node once; what follows keeps that layout.
    own = nodes.repartition("node").distinct()
    return own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node"))).filter("n > 1")


def _candidates(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Edges to the least key of each component of similar sketches, so different nodes give the same edges."""
    key = rows.column("key").to_numpy()
    sketch = _matrix(rows.column("sketch"), "u1")
    found = []
    for left, right in pairs(rows, starts):
        near = (sketch[left] == sketch[right]).sum(axis=1) >= CANDIDATE * COORDINATES
        found.append((left[near], right[near]))
    root = roots(len(key), *(np.concatenate([f[k] for f in found]) for k in (0, 1)))
    apart = root != np.arange(len(key))
    return pa.RecordBatch.from_arrays([pa.array(key[apart]), pa.array(key[root[apart]])], names=["a", "b"])


#: Elements of sets counted together; sets of more are counted by ranges of the elements' values.
ELEMENTS_AT_ONCE = 1 << 20


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int = ELEMENTS_AT_ONCE) -> np.ndarray:
    """Numbers of elements that the sets at ``left`` have in common with those at ``right``, as a matrix.

    Elements are hashes, so ranges of equal width hold about equally many.
    """
    parts = -(-sum(map(len, sets)) // most)
    if parts <= 1:
        return _shared_counts(sets, left, right)
    sets = [s if len(s) < 2 or bool((s[1:] > s[:-1]).all()) else np.sort(s) for s in sets]
    edges = np.array([(1 << 64) * k // parts for k in range(1, parts)], dtype=np.uint64)
    cuts = [np.r_[0, np.searchsorted(s, edges), len(s)] for s in sets]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for k in range(parts):
        total += _shared_counts([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)], left, right)
    return total


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    # An element of one set alone counts for no pair.
    kept = often[token] > 1
    token, row = (np.cumsum(often > 1) - 1)[token[kept]], row[kept]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        i, j = np.searchsorted(token, [first, first + width])
        has = np.zeros((len(sets), min(width, int(token[-1]) + 1 - first)), dtype=np.float32)
        has[row[i:j], token[i:j] - first] = 1
        common += has[left] @ has[right].T
    return common.astype(np.int64)


def linked(rows: pa.Table, near: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group's sets (``shingles``) with a Jaccard similarity of at least ``near / of``."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    own, x, y = rows.column("own").to_numpy(), rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
    a, b = (np.flatnonzero(own == x), np.flatnonzero(own == y)) if x != y else (np.arange(len(own)),) * 2
    shared = shared_counts(sets, a, b)
    found = of * shared >= near * (size[a][:, None] + size[b][None, :] - shared)
    found &= (a[:, None] < b[None, :]) if x == y else (shared > 0)
    left, right = np.nonzero(found)
    return a[left], b[right]


def _verified(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """For each linked set its number of links, weighed by copies, and an edge to its component."""
    made = []
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if j - i < 2:
            continue
        part = rows.slice(i, j - i)
        key, copies = part.column("key").to_numpy(), part.column("copies").to_numpy()
        left, right = linked(part, NEAR, OF)
        links = np.zeros(len(key), dtype=np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        found = links > 0
        made.append((key[found], key[roots(len(key), left, right)[found]], links[found]))
    columns = [np.concatenate([m[k] for m in made] or [np.zeros(0, dtype=np.int64)]) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "near", "links"])


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` (``doc, hash, key`` and more) with the shingles of a row of that ``doc`` and text."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            texts = [pack(t.encode()) for t in text_column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], names=["doc", "hash", "packed"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            place = batch.schema.get_field_index("packed")
            texts = pa.array([unpack(t) for t in batch.column(place).to_pylist()], pa.large_binary())
            for chunk in chunks(texts):
                value, bounds = shingle_sets(words_of(chunk), size)
                part = batch.slice(chunk.first, chunk.rows)
                same = np.flatnonzero(part.column(1).to_numpy() == set_keys(value, bounds).view(np.int64))
                shingles = pa.array([value[bounds[r] : bounds[r + 1]].tobytes() for r in same], pa.binary())
                columns = [c.take(pa.array(same)) for k, c in enumerate(part.columns) if k != place]
                yield pa.RecordBatch.from_arrays([*columns, shingles], names=[n for n in batch.schema.names if n != "packed"] + ["shingles"])

    # Rows without a doc_id, or with a repeated one, meet by their text: each is unpacked for its own set only.
    texts = _own(docs).select("doc", "hash", "text").mapInArrow(packed, "doc long, hash long, packed binary")
    joined = texts.join(wanted.hint("shuffle_hash"), ["doc", "hash"]).select("doc", "key", *[c for c in wanted.columns if c not in ("doc", "hash", "key")], "packed")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "packed")
    # Repeated rows have the same set.
    return joined.mapInArrow(sets, kinds + ", shingles binary").dropDuplicates(["key"])


def _joined(docs: DataFrame, recall: float, size: int) -> tuple[DataFrame, DataFrame]:
    """The embedded rows, and for each set ``key, row, least, copies, links, label``.

    Its first row, least ``doc_id``, numbers of copies and links, and the least key of its class.
    """
    rows = stored(embedded_documents(docs, size), "embedded")
    copies = rows.groupBy("key").agg(
        F.min(F.struct("doc", "hash")).alias("row"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    full = rows.filter("not empty")

    edges = None
    # A pair is missed on the first levels or, if all its nodes are crowded, on all levels; each has half the chance.
    runs, more_runs = (runs_needed((1 + recall) / 2, levels) for levels in (LEVELS, LEVELS + MORE_LEVELS))
    nodes = stored(_met(_start(full, runs)), "nodes")
    met = nodes.select("key").distinct()
    sets = stored(full.join(met, "key", "left_semi").groupBy("key").agg(F.first("embedded").alias("embedded"), F.first("sketch").alias("sketch")), "sets")
    stood = nodes.filter(F.col("n") > BLOCK).select("key").distinct()
    if not stood.isEmpty():
        again = sets.join(stood, "key", "left_semi")
        nodes = stored(nodes.union(_met(_start(again, more_runs, runs)).select(nodes.columns)), "nodes")
    for level in range(MORE_LEVELS + 1):
        last = level == MORE_LEVELS
        small = nodes if last else nodes.filter(F.col("n") <= BLOCK)
        compared = in_blocks(small, "node", BLOCK).join(sets.select("key", "sketch"), "key")
        found = over_groups(compared, ["node", "x", "y"], _candidates, "a long, b long", ("key",)).distinct()
        edges = found if edges is None else edges.union(found)
        crowded = nodes.filter(F.col("n") > BLOCK)
        if last or crowded.isEmpty():
            break
        nodes = stored(_met(_onward(crowded.join(sets.select("key", "embedded"), "key"))), "nodes")

    parts = connected_components(edges).withColumnsRenamed({"node": "key", "label": "part"})
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    wanted = copies.select("row.doc", "row.hash", "key", "copies").join(parts, "key").join(sizes, "part")
    blocks = in_blocks(_sets_of(docs, wanted.select("doc", "hash", "key", "copies", "part", "n"), size), "part", BLOCK // 2)
    verified = stored(over_groups(blocks, ["part", "x", "y"], _verified, "key long, near long, links long"), "links")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.select(F.col("key").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "key")

    known = copies.join(links, "key", "left").join(classes, "key", "left")
    links = F.coalesce("links", F.lit(0)).cast("long")
    return rows, stored(known.select("key", "row", "least", "copies", links.alias("links"), F.coalesce("label", "key").alias("label")), "classes")




def similar_documents(docs: DataFrame, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links`` for each row of documents.

    Rows are linked if the Jaccard similarity of their sets of ``size``-word shingles is 0.8 or
    more; a class is what links connect, named by its least ``doc_id``. ``n_copies`` counts rows
    with the same set, the row itself included; ``n_links`` counts rows with other sets linked to
    it. Pairs at the threshold become candidates with a chance of at least ``recall``; links are
    verified exactly. Texts of one to four words have one shingle of all their words; texts without
    words (null, empty, white space) are copies of each other and linked to nothing else. A null
    ``doc_id`` stays null and names a class only if no row of it has one. Repeated rows are copies.
    Texts of any length are compared whole; an empty table gives no rows.
    Other columns are not read. Sets are told apart by 64-bit keys.
    """
    rows, known = _joined(docs, recall, size)
    named = known.groupBy("label").agg(F.min("least").alias("class_id"))
    whole = known.join(named, "label").select("key", "class_id", F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))
    return rows.select("doc_id", "key").join(whole, "key").select("doc_id", "class_id", "n_copies", "n_links")


def first_of_each_class(docs: DataFrame, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """The first row of each class by ``doc_id`` (ties by a hash of the text), with all columns of documents."""
    _, known = _joined(docs, recall, size)
    first = known.groupBy("label").agg(F.min("row").alias("row")).select(F.col("row.doc").alias("_doc"), F.col("row.hash").alias("_hash"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("_hash", F.xxhash64(text))
    stay = named.join(first.hint("shuffle_hash"), ["_doc", "_hash"], "left_semi")
    return stay.dropDuplicates(["_doc", "_hash"]).drop("_doc", "_hash")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all documents."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
