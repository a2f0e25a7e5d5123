"""Equal rows found in two stages: fingerprints first, whole rows only where a fingerprint repeats.

The first stage shuffles eight bytes a row. Rows whose fingerprint occurs once are certainly
distinct and are never moved. Only rows with a repeated fingerprint are compared as a whole, so two
different rows that share one are told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored

#: Repeated fingerprints that are broadcast at most, 64 MB of them. With more, repeats are no
#: exception, and whole rows are shuffled, combined by task before.
MOST_BROADCAST = 4_000_000


def row_fingerprint(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def split_repeated(
    df: DataFrame,
    fingerprint: Column | None = None,
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
    most: int = MOST_BROADCAST,
) -> tuple[DataFrame | None, DataFrame | None]:
    """``(single, among)``: rows that are certainly distinct, and rows that may equal another; None for no such rows.

    Runs a job that counts fingerprints. ``store`` may write the rows with their fingerprint and
    return them read back; then later reads need only the columns they use.
    """
    if not df.columns:
        return None, df
    marked = store(df.withColumn("_fp", row_fingerprint(df.columns) if fingerprint is None else fingerprint))
    counts = marked.groupBy("_fp").agg(F.count("*").alias("n"))
    repeated = stored(counts.filter(F.col("n") > 1).select("_fp"), "repeated")
    n = repeated.count()
    if not n:
        return marked.drop("_fp"), None
    if n > most:
        return None, marked.drop("_fp")
    known = F.broadcast(repeated)
    return (
        marked.join(known, "_fp", "left_anti").drop("_fp"),
        marked.join(known, "_fp", "left_semi").drop("_fp"),
    )


def distinct_rows(
    df: DataFrame,
    fingerprint: Column | None = None,
    store: Callable[[DataFrame], DataFrame] = lambda df: df,
    most: int = MOST_BROADCAST,
) -> DataFrame:
    """One of each set of equal rows."""
    single, among = split_repeated(df, fingerprint, store, most)
    if among is None:
        return single
    among = store(among.distinct())
    return among if single is None else single.unionByName(among)


def count_repeated(df: DataFrame, fingerprint: Column | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """``n``: rows less distinct rows."""
    _, among = split_repeated(df, fingerprint, most=most)
    if among is None:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"))
    groups = among.groupBy(*among.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n"))
