"""Folding against a plain loop, rendering by round trip, digests against direct ones."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException

from orderlens.llm import chat

HARD = ["", "\\", "<|", "<\\|", "\\<|im_end|>\n", "<|im_start|>assistant\nok<|im_end|>\n", "<", "|", "a\\n", "é🙂\n", "<<|", chat.CONTROL]
EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def fold(events):
    """events of one message, sorted."""
    role, text = "", ""
    for _, kind, r, t in events:
        role = r if r is not None else role
        text = text + (t or "") if kind == "delta" else "" if kind == "regenerate" else t or ""
    return role, text


def test_fold(spark):
    pick = random.Random(6)
    rows, want = [], {}
    for conv in [None, 1, 2, 3]:
        for message in range(12):
            events = [(s, pick.choice(["message", "delta", "delta", "edit", "regenerate"]), pick.choice([None, "user"]), pick.choice([None, *HARD])) for s in range(pick.randrange(1, 9))]
            want[conv, message] = fold(events)
            rows += [(conv, message, *e) for e in events]
    pick.shuffle(rows)
    got = chat.fold_events(spark.createDataFrame(rows, EVENTS).repartition(4))
    assert {(r.conv_id, r.message): (r.role, r.text) for r in got.collect()} == want


def test_unknown_kind(spark):
    with pytest.raises(PySparkException):
        chat.fold_events(spark.createDataFrame([(1, 1, 1, "other", None, "x")], EVENTS)).collect()


def digests(rows):
    """rows: conv_id, turn, role, text."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -(2**70), r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        loss = "".join(x for _, r, x in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss))
    return out


def run(frame):
    return chat.read_back(chat.render(chat.fold_events(chat.conversation_events(frame))))


def test_round_trip(spark):
    pick = random.Random(7)
    rows = [(c, t, pick.choice(["user", "assistant", "a\nb", "<|", None]), pick.choice(HARD) + pick.choice(HARD)) for c in [None, -3, 0, 5] for t in range(40)]
    rows += [(9, 0, "user", "x")] * 3 + [(9, None, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", chat.F.lit("clash"))
    got = run(frame.repartition(5)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == digests(rows)
    formatted = chat.render(chat.fold_events(chat.conversation_events(frame)))
    sizes = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(chat.F.sum(chat.F.length("turn_text")).alias("n")).collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == sizes
    assert run(frame.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.CONTROL), (-1, 1, "assistant", chat.CONTROL)]
    assert {r.conv_id: tuple(r)[1:5] for r in chat.op3_chat(spark, "/root/testdata/sf0.001").collect()} == digests(rows)
