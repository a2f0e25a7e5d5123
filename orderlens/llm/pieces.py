"""Token ids of whole texts by way of a bounded memory of words.

The split pattern of the byte-level vocabularies cuts a text into pieces that are encoded one by
one. Where no two white-space characters stand together, every blank and every line feed is a place
where the pattern cuts, so the words between them are encoded by themselves and looked up when they
come again. Other texts are encoded whole; both ways give the same ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex

from .terms import binaries

#: Turns texts into ids, as little-endian unsigned 32-bit integers.
Encode = Callable[[Sequence[str]], list[bytes]]

_TWO_SPACES = re.compile(r"\s\s")
#: Longer words and pieces are encoded each time they come.
_LONGEST_KEPT = 64


class TextCoder:
    """Ids of texts; at most about ``kept`` words are remembered, after which the memory starts anew.

    Words of the texts of a call are gathered as one Arrow array and made distinct there; only distinct
    words are looked up one by one.
    """

    def __init__(self, encode: Encode, kept: int = 500_000):
        self._encode, self._kept = encode, kept
        self._words: dict[bytes, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        words = self._words
        if len(words) > self._kept:
            words.clear()
        whole = [k for k, text in enumerate(texts) if _TWO_SPACES.search(text)]
        aside = set(whole)
        cut = [k for k in range(len(texts)) if k not in aside]
        raw = [texts[k].encode() for k in cut]
        bounds = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in raw], out=bounds[1:])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        # A word begins at its blank, a line feed is a word, and one begins after it and with the text.
        feed = data == 0x0A
        begins = feed | (data == 0x20)
        begins[1:] |= feed[:-1]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        coded = binaries(data, np.r_[starts, len(data)]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [w for w in names if w not in words]
        found = self._encode([*(w.decode() for w in new), *(texts[k] for k in whole)])
        words.update(zip(new, found, strict=False))
        ids = pa.array([words[w] for w in names], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        content = ids.buffers()[2].to_pybytes() if len(ids) and ids.buffers()[2] else b""
        edges = ends[np.searchsorted(starts, bounds)].tolist()
        out: list[bytes] = [b""] * len(texts)
        for k, first, end in zip(cut, edges, edges[1:], strict=False):
            out[k] = content[first:end]
        for k, one in zip(whole, found[len(new) :], strict=True):
            out[k] = one
        for w in new:
            if len(w) > _LONGEST_KEPT:
                del words[w]
        return out


class PieceCoder:
    """Ids of texts by the matches of a pattern; ``encode`` gets distinct matches that are not remembered."""

    def __init__(self, pattern: str, encode: Encode, kept: int = 300_000):
        self._split = regex.compile(pattern).findall
        self._encode, self._kept = encode, kept
        self._pieces: dict[str, bytes] = {}

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        known = self._pieces
        if len(known) > self._kept:
            known.clear()
        # A line feed between texts that hold no white space but a first blank is a piece by itself.
        plain = [k for k, t in enumerate(texts) if t and len(t.split()) == 1 and not t[-1].isspace() and t[:2].rstrip()]
        plain = [k for k in plain if texts[k].split()[0] == texts[k].removeprefix(" ")]
        lists: list[list[str]] = [[] for _ in texts]
        at = iter(plain)
        pieces: list[str] = []
        for piece in self._split("\n".join([texts[k] for k in plain])):
            if piece == "\n":
                lists[next(at)] = pieces
                pieces = []
            else:
                pieces.append(piece)
        if plain:
            lists[next(at)] = pieces
        done = set(plain)
        for k, text in enumerate(texts):
            if k not in done:
                lists[k] = self._split(text)
        new = list({p for pieces in lists for p in pieces if p not in known})
        known.update(zip(new, self._encode(new), strict=True))
        get = known.__getitem__
        out = [get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces)) for pieces in lists]
        for p in new:
            if len(p) > _LONGEST_KEPT:
                del known[p]
        return out
