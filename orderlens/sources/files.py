"""Readers and writers of the fact, query results and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import raw_csv_schema, snake_case
from ..session import free_shuffles, scratch_path

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


#: Holds a row's text if it does not fit the declared types.
MALFORMED = "_malformed"


def _read_csv(
    spark: SparkSession, path: str, schema: T.StructType, encoding: str, multi_line: bool, malformed: bool, **options: str
) -> DataFrame:
    """CSV with a header, bound by column name.

    Quotes inside quoted text are doubled. A declared column that the header lacks is null, one
    that is not declared is left out, and a file of a folder whose header differs from the first
    one's raises. ``multi_line`` lets quoted text hold line breaks, at the price that a file is read
    by one task; without it files are split, and such text ends a row. With ``malformed`` rows that
    do not fit keep their text in ``_malformed``; their other columns may be null.
    """
    reader = spark.read.options(
        header=True, encoding=encoding, escape='"', multiLine=multi_line, enforceSchema=False, **options
    )
    declared = {field.name: field for field in schema}
    header = reader.csv(path).columns
    fields = [T.StructField(name, declared[name].dataType if name in declared else T.StringType()) for name in header]
    if malformed:
        fields.append(T.StructField(MALFORMED, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", MALFORMED)
    df = reader.schema(T.StructType(fields)).csv(path)
    columns = [
        F.col(f"`{name}`") if name in header else F.lit(None).cast(field.dataType).alias(name)
        for name, field in declared.items()
    ]
    return df.select(*columns, *([MALFORMED] if malformed else []))


def read_csv_raw(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multi_line: bool = True,
    malformed: bool = False,
) -> DataFrame:
    """Raw order-line CSV: header, Latin-1, declared types; columns renamed to snake case.

    The two date columns become ``order_date`` and ``shipping_date``, still text. For the options
    see ``_read_csv``; ``malformed_rows`` counts what does not fit.
    """
    df = _read_csv(spark, path, schema or raw_csv_schema(), "ISO-8859-1", multi_line, malformed)
    named = df.withColumnsRenamed({c: snake_case(c) for c in df.columns if c != MALFORMED})
    return named.withColumnsRenamed(
        {"order_date_dateorders": "order_date", "shipping_date_dateorders": "shipping_date"}
    )


def malformed_rows(df: DataFrame) -> int:
    """How many rows of a CSV read with ``malformed`` do not fit the declared types."""
    # All columns are counted, so all are parsed: with the text column alone there would be nothing to fit.
    others = [F.count(F.col(f"`{c}`")) for c in df.columns if c != MALFORMED]
    return df.agg(F.count(MALFORMED), *others).first()[0]


def read_csv_clean(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, malformed: bool = False
) -> DataFrame:
    """A cleaned CSV, with its timestamps parsed while reading; options as in ``read_csv_raw``."""
    formats = {"timestampFormat": TIMESTAMP_FORMAT, "timestampNTZFormat": TIMESTAMP_FORMAT}
    return _read_csv(spark, path, schema, "UTF-8", multi_line, malformed, **formats)


def read_parquet_clean(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The cleaned fact; columns and filters applied to the result are pushed into the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", compression: str = "none") -> None:
    """CSV with header; blanks at the ends of text, quotes and line breaks are kept as they are.

    ``compression`` packs the files; readers know it by their names.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


def write_clean(df: DataFrame, root: str, partition_by: str = "order_year", csv: bool = True) -> dict[str, str]:
    """The cleaned fact as parquet partitioned by year, and as CSV; returns the paths.

    The rebalance hint gathers a year's rows into files of the advisory size and splits a
    year that holds much of the data over several tasks.
    """
    paths = {"parquet": f"{root}/parquet"}
    df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").partitionBy(partition_by).parquet(
        paths["parquet"]
    )
    if csv:
        paths["csv"] = f"{root}/csv"
        write_csv(df, paths["csv"])
    return paths


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to a fresh table in the shared folder and read back.

    Cuts the lineage: later reads prune columns, and a lost executor costs no recomputation
    of the steps before. What the steps before have shuffled goes once the table is written.
    """
    spark = df.sparkSession
    free_shuffles(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def listing(spark: SparkSession, root: str) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of each file below a folder and its folders, from the file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    files = []
    while found.hasNext():
        status = found.next()
        files.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(files))


def fact_view(df: DataFrame, name: str = "orders_fact") -> DataFrame:
    """Register the fact for SQL under a name, with snake-case columns."""
    renamed = snake_case_columns(df)
    renamed.createOrReplaceTempView(name)
    return renamed


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_query_results(spark: SparkSession, results: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Write each named result as parquet below ``root``; return ``query, n_rows``.

    Rows are counted while they are written, so no query runs twice.
    """
    counts = []
    for name, df in results.items():
        seen = Observation(f"rows_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}")
        counts.append((name, int(seen.get["n"])))
    return spark.createDataFrame(counts, "query string, n_rows long")


def query_preview(df: DataFrame, order: Sequence[Column | str], n: int = 15) -> DataFrame:
    """The first rows of a result in a stated order."""
    return df.orderBy(*order).limit(n)


def results_catalog(parts: Sequence[DataFrame]) -> DataFrame:
    """``(section, metric, value)`` evidence from several results under one another."""
    return reduce(DataFrame.unionByName, parts)


def as_evidence(df: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(section, metric, value, text)``: every other column of every row, by the values of its keys.

    Numbers and flags are in ``value``, everything else in ``text``; nulls have a row with neither.
    A metric's name is the keys' values and the column's name, joined by dots.
    """
    numbers = (T.NumericType, T.BooleanType)
    pairs = []
    for field in df.schema.fields:
        if field.name in keys:
            continue
        column, number = F.col(f"`{field.name}`"), isinstance(field.dataType, numbers)
        value = column.cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else column.cast("string")
        pairs.append(F.struct(F.lit(field.name).alias("name"), value.alias("value"), text.alias("text")))
    prefix = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys]
    rows = df.select(*[p.alias(f"_k{i}") for i, p in enumerate(prefix)], F.explode(F.array(*pairs)).alias("_m"))
    metric = F.concat_ws(".", *[F.col(f"_k{i}") for i in range(len(keys))], F.col("_m.name"))
    return rows.select(F.lit(section).alias("section"), metric.alias("metric"), "_m.value", "_m.text")


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder with all its files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
