"""Regex matches with positions, as array columns built from SQL functions alone.

``split`` gives the text between the matches of a pattern and ``regexp_extract_all`` the matches;
their lengths add up to positions in code points. Nothing leaves the row, so there is no shuffle and
repeated or unnamed rows need no key.

Patterns must not match the empty text. They should use possessive repetition of groups, which the
JVM runs in a loop: a greedy group that may match in several ways recurses once per repetition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the text before and after a match that labelers see.
CONTEXT = 40


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as the variable of a transform over one element.

    Inside a lambda an expression that is written twice, or that does not depend on the variable, is
    computed anew each time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """For an array of numbers the sums of all elements before each one.

    In blocks, so the work grows with the power 1.5 of the length: sums within a block plus sums of
    the blocks before.
    """
    add = lambda a, x: a + x
    zero = F.lit(0).cast("int")

    def in_blocks(x: Column) -> Column:
        blocks = F.when(F.size(x["v"]) > 0, F.sequence(F.lit(0), F.floor((F.size(x["v"]) - 1) / x["block"]).cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(blocks, lambda b: F.slice(x["v"], b * x["block"] + 1, x["block"]))

    def with_sums(blocks: Column) -> Column:
        return bound(F.transform(blocks, lambda v: F.aggregate(v, zero, add)), lambda sums: joined(blocks, sums))

    def joined(blocks: Column, sums: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda v, b: bound(F.aggregate(F.slice(sums, F.lit(1), b), zero, add), lambda s: within(v, s))))

    def within(v: Column, s: Column) -> Column:
        return F.transform(v, lambda _, i: s + F.aggregate(F.slice(v, F.lit(1), i), zero, add))

    def sized(v: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return bound(F.struct(v.alias("v"), block.alias("block")), lambda x: bound(in_blocks(x), with_sums))

    return bound(values, sized)


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, stop, found, before, after>>``.

    ``stop`` is exclusive; ``before`` and ``after`` are up to 40 code points of the neighbouring
    text without other matches. ``guard`` is a cheaper necessary condition on the row.
    """
    kind = "array<struct<start:int,stop:int,found:string,before:string,after:string>>"
    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["found"])), x["found"], lambda b, f: F.length(b) + F.length(f))
        return bound(steps, lambda s: bound(running_sums(s), lambda before: spans(x, s, before)))

    def spans(x: Column, steps: Column, before: Column) -> Column:
        stop = lambda i: F.get(before, i) + F.get(steps, i)
        return F.transform(
            x["found"],
            lambda f, i: F.struct(
                (stop(i) - F.length(f)).alias("start"),
                stop(i).alias("stop"),
                f.alias("found"),
                F.right(F.get(x["between"], i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(x["between"], i + 1), F.lit(CONTEXT)).alias("after"),
            ),
        )

    found = bound(both, placed)
    present = F.regexp_like(text, F.lit(pattern)) if guard is None else guard
    return F.when(present, found).otherwise(F.array()).cast(kind)


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of span structs by start, then place of the kind (``rank``), comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
