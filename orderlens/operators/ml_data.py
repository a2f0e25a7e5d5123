"""Feature tables, leakage guard and split of the late-delivery model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SHIPPING_CANCELED
from ..sources.files import stored
from .statistics import pair_correlations

# Order-time features of the two model variants.
NUMERIC = {
    "A": (
        "days_for_shipment_scheduled",
        "sales",
        "order_item_quantity",
        "order_item_discount_rate",
        "product_price",
    ),
    "B": (
        "days_for_shipment_scheduled",
        "order_item_quantity",
        "order_item_discount_rate",
        "product_price",
        "sales",
        "order_dow_num",
        "order_month_num",
    ),
}
CATEGORICAL = {
    "A": (
        "shipping_mode",
        "order_region",
        "market",
        "category_name",
        "department_name",
        "customer_segment",
        "type",
        "order_dow",
    ),
    "B": (
        "shipping_mode",
        "order_region",
        "market",
        "category_name",
        "customer_segment",
        "type",
    ),
}
TARGET = {"A": "late_delivery_risk", "B": "is_late"}
# Columns known only after the order is placed.
LEAKY = {
    "A": (
        "days_for_shipping_real",
        "delivery_status",
        "shipping_delay_days",
        "shipping_date",
        "order_status",
        "benefit_per_order",
        "order_item_profit_ratio",
        "is_late",
    ),
    "B": (
        "days_for_shipping_real",
        "delivery_status",
        "shipping_delay_days",
        "late_delivery_risk",
    ),
}
# The columns that tell one fact row from another.
IDENTITY = (
    "order_id",
    "line_no",
    "product_card_id",
    "order_item_quantity",
    "sales",
    "order_item_discount",
    "shipping_date",
)


def feature_columns(variant: str = "A") -> list[str]:
    return [*NUMERIC[variant], *CATEGORICAL[variant]]


def ml_leakage_guard(columns: Sequence[str], variant: str = "A") -> list[str]:
    """The columns unchanged; raises when one of them is known only after the outcome."""
    leaks = [c for c in columns if c in LEAKY[variant]]
    if leaks:
        raise ValueError(f"columns known only after the outcome: {', '.join(leaks)}")
    return list(columns)


def ml_leakage_report(fact: DataFrame, columns: Sequence[str], target: str, variant: str = "A") -> DataFrame:
    """Correlation of each numeric column with the target, and whether the guard rejects it."""
    features = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit(c in LEAKY[variant]).alias("rejected")) for c in columns]
    )
    return pair_correlations(fact, [(c, target) for c in columns]).select(
        features[F.col("pair")].alias("f"), F.round("r", 4).alias("r_with_target")
    ).select("f.feature", "f.rejected", "r_with_target")


def ml_feature_rows(fact: DataFrame, variant: str = "A") -> DataFrame:
    """The lines a variant learns from: A uses every line, B leaves out cancelled shipments."""
    return fact.filter(F.col("delivery_status") != SHIPPING_CANCELED) if variant == "B" else fact


def ml_feature_table(fact: DataFrame, variant: str = "A", keep: Sequence[str] = ()) -> DataFrame:
    """Order-time features and ``label``; numerics as DOUBLE.

    A uses every line; B leaves out cancelled shipments and adds weekday and month numbers.
    """
    fact = ml_feature_rows(fact, variant)
    if variant == "B":
        fact = fact.withColumns({"order_dow_num": F.weekday("order_date"), "order_month_num": F.month("order_date")})
    ml_leakage_guard(feature_columns(variant), variant)
    return fact.select(
        *keep,
        *[F.col(c).cast("double").alias(c) for c in NUMERIC[variant]],
        *CATEGORICAL[variant],
        F.col(TARGET[variant]).cast("double").alias("label"),
    )


#: Hexadecimal digits of a row's hash, and those that one pass tells apart.
_DIGITS, _PER_PASS = 15, 4


def split_hash(identity: Sequence[str] = IDENTITY, seed: int = 42) -> Column:
    """A seeded 60-bit hash of the row: the same row always has the same one."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint")


def _rank_thresholds(hashed: DataFrame, test_pct: int) -> list[tuple]:
    """``(class, hash, needed, held)``: the k-th smallest hash of each class, for k = test_pct percent of its rows.

    ``needed`` of the ``held`` rows with that very hash are among the first k. Each pass counts the
    rows of the one interval per class that holds the wanted rank, by the next digits of the hash;
    no row is sorted or moved. Classes are a handful of labels, so counts and intervals are few.
    """
    bits = 4 * _DIGITS
    sizes = hashed.groupBy("class").agg(F.count("*").alias("n")).collect()
    # Class, first hash of its interval, and how many rows are still wanted from there on.
    wanted = [(r["class"], 0, r["n"] * test_pct // 100) for r in sizes]
    wanted = [w for w in wanted if w[2] > 0]
    step = 4 * _PER_PASS
    while bits > 0 and wanted:
        bits, before = max(bits - step, 0), bits
        inside = F.lit(False)
        for label, start, _ in wanted:
            inside |= F.col("class").eqNullSafe(F.lit(label)) & (F.shiftright("hash", before) == start >> before)
        place = F.shiftright("hash", bits)
        counts = hashed.filter(inside).groupBy("class", place.alias("place")).agg(F.count("*").alias("n"))
        spec = Window.partitionBy("class").orderBy("place")
        running = counts.withColumn("until", F.sum("n").over(spec))
        hit = F.lit(False)
        for label, _, k in wanted:
            hit |= F.col("class").eqNullSafe(F.lit(label)) & (F.col("until") >= k) & (F.col("until") - F.col("n") < k)
        found = {r["class"]: r for r in running.filter(hit).collect()}
        wanted = [(c, found[c]["place"] << bits, k - (found[c]["until"] - found[c]["n"])) for c, _, k in wanted]
    return [(c, start, needed, found[c]["n"]) for c, start, needed in wanted]


def ml_stratified_split(
    df: DataFrame,
    test_pct: int = 20,
    identity: Sequence[str] = IDENTITY,
    seed: int = 42,
    label: str | None = None,
) -> DataFrame:
    """Add ``split``: "test" for exactly ``test_pct`` percent of each class, rounded down, otherwise "train".

    The test rows of a class are those with the smallest seeded hashes, so a row's side depends on
    the rows alone and never on their layout. The thresholds are order statistics found by counting
    (hashes and labels are written once, 16 bytes a row, and read in five passes); assigning the rows is then a projection without a shuffle.
    Only where rows with one hash lie on both sides of a threshold are just those numbered.
    ``label`` is by default the column of that name, or the target column in the frame. Null is a class.
    """
    label = label or next(c for c in ("label", *TARGET.values()) if c in df.columns)
    hashed = stored(df.select(F.col(label).alias("class"), split_hash(identity, seed).alias("hash")), "split-hashes")
    ties, test = F.lit(False), F.lit(False)
    tied = []
    for value, threshold, needed, held in _rank_thresholds(hashed, test_pct):
        mine = F.col(label).eqNullSafe(F.lit(value))
        test |= mine & (F.col("_hash") < threshold)
        if needed == held:
            test |= mine & (F.col("_hash") == threshold)
        else:
            ties |= mine & (F.col("_hash") == threshold)
            tied.append((mine, needed))
    rows = df.withColumn("_hash", split_hash(identity, seed))
    side = F.when(test, "test").otherwise("train")
    if not tied:
        return rows.withColumn("split", side).drop("_hash")
    # Rows of one hash that lie on both sides: equal rows are interchangeable, others go by all columns.
    order = Window.partitionBy(label).orderBy(*[F.col(c) for c in df.columns])
    among = F.lit(False)
    for mine, needed in tied:
        among |= mine & (F.row_number().over(order) <= needed)
    numbered = rows.filter(ties).withColumn("split", F.when(among, "test").otherwise("train"))
    return rows.filter(~ties).withColumn("split", side).unionByName(numbered).drop("_hash")
