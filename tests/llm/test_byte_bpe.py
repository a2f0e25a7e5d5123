"""The matrix encoder against tiktoken, the text coder against tokenizers, and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from orderlens.llm import byte_bpe

PIECES = ["the", " and", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "漢字", "🙂", "123", "...", "<|endoftext|>"]
PIECES += ["\x1c", " ", " ", "ſ", "á", "\0", "ab" * 40, "Ⅷ", "½", "_", "𝒜"]


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def peer(ranks):
    parsed = byte_bpe.parse_ranks(ranks)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parsed, special_tokens={})


def texts(n, seed):
    pick = random.Random(seed)
    out = ["", " ", "\n", " a", "a ", "a\n", "\na", "a\n b", "a \nb", "a  b", "a\n\n\nb", "\r", "a\rb", "x\n\r\ny"]
    for _ in range(n):
        out.append("".join(pick.choice(PIECES) + pick.choice(["", " ", "\n", "x"]) for _ in range(pick.randrange(40))))
    return out


def test_ids_equal_tiktoken(ranks, peer):
    encoder, decoder = byte_bpe.coder(ranks, public_tokenizers.PATTERN)
    own = texts(1500, 3)
    for text, ids in zip(own, encoder.encode(own), strict=True):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == peer.encode_ordinary(text), repr(text)
        assert decoder(ids).decode() == text


def test_long_pieces(ranks, peer):
    pick = random.Random(5)
    encode = byte_bpe.MatrixEncoder(byte_bpe.parse_ranks(ranks))
    long = ["a" * 5000, "ab" * 3000, "".join(pick.choice("abcdefghijklmnop") for _ in range(6000)), " " * 4001]
    long += ["".join(pick.choice(["the", "ing", "tion", "e", "s"]) for _ in range(400)) for _ in range(20)]
    for piece in long:
        ids = encode([piece])[0]
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == peer.encode_ordinary(piece)


def test_memory_starts_anew(ranks):
    parsed = byte_bpe.parse_ranks(ranks)
    made = lambda kept: byte_bpe.PieceCoder(public_tokenizers.PATTERN, byte_bpe.MatrixEncoder(parsed), kept)
    small, large = byte_bpe.TextCoder(made(5), kept=5), byte_bpe.TextCoder(made(10**6))
    own = texts(200, 9)
    assert [small.encode([t])[0] for t in own] == large.encode(own)


def test_rows_of_any_kind(spark, ranks):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "y"), (2, None, "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "decoded_sha256").collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == sorted([(1, 2, sha(b"a b")), (1, 2, sha(b"a b")), (None, 1, sha(b"c")), (2, 0, sha(b"")), (3, 0, sha(b""))], key=str)
    assert byte_bpe.encode_documents(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
