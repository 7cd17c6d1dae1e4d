"""Table readers, stacking and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.dates import before, on_or_after


_schemas: dict[str, tuple[str, T.StructType]] = {}


def version(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under a path: changes whenever the table is rewritten."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(target)
    return ";".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def load(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """Read one parquet table; listed columns are all that the scan reads.

    The schema is inferred once per version of the files: reading it again from the footers
    would cost a Spark job for every mention of the table in a plan.
    """
    path = f"{folder}/{name}.parquet"
    now = version(spark, path)
    known = _schemas.get(path)
    if known and known[0] == now:
        df = spark.read.schema(known[1]).parquet(path)
    else:
        df = spark.read.parquet(path)
        _schemas[path] = (now, df.schema)
    return df.select(*columns) if columns else df


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def month_partitions(spark: SparkSession, path: str, months: Sequence[int], columns: Sequence[str],
                     month_column: str = "month") -> DataFrame:
    """Read the listed months of a ``month=NN`` partitioned table in one scan.

    The month list becomes a partition filter: other folders are never opened,
    and twelve monthly tables need no twelve-way union.
    """
    return (
        spark.read.parquet(path)
        .where(F.col(month_column).isin(list(months)))
        .select(*columns, month_column)
    )


def year_slice(df: DataFrame, date_column: str, year: int) -> DataFrame:
    """One calendar year, as a range on the raw column so that it is pushed to the scan."""
    moment = F.col(date_column)
    return df.where(on_or_after(moment, f"{year}-01-01") & before(moment, f"{year + 1}-01-01"))


def stack_years(frames: Mapping[int, DataFrame], year_column: str = "year") -> DataFrame:
    """UNION ALL by name of yearly tables, tagged with their year."""
    tagged = [df.withColumn(year_column, F.lit(year)) for year, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


def read_code_list(spark: SparkSession, path: str, columns: Mapping[str, str], separator: str = ",",
                   quote_mark: str | None = None) -> DataFrame:
    """Read a delimited code list as text, strip quote marks and blanks, rename.

    ``columns`` maps file headers to result names. Every field stays text, so
    leading zeros survive. Duplicate rows are removed.
    """
    raw = spark.read.csv(path, header=True, sep=separator)
    return raw.select(*[clean_code(F.col(f"`{old}`"), quote_mark).alias(new) for old, new in columns.items()]).distinct()


def clean_code(source: Column, quote_mark: str | None = "'") -> Column:
    trimmed = F.trim(source)
    if quote_mark:
        trimmed = F.trim(F.regexp_replace(trimmed, f"^{quote_mark}+|{quote_mark}+$", ""))
    return trimmed


def read_area_rates(spark: SparkSession, path: str, rates: Mapping[str, str], county: str = "COUNTYFIPS",
                    state: str = "STATE") -> DataFrame:
    """County attribute export (CSV with header): county code as text, rates as doubles."""
    header = spark.read.csv(path, header=True).columns
    schema = T.StructType(
        [T.StructField(c, T.DoubleType() if c in rates else T.StringType()) for c in header]
    )
    raw = spark.read.csv(path, header=True, schema=schema)
    return raw.select(
        F.col(county).alias("county"), F.col(state).alias("state"),
        *[F.col(old).alias(new) for old, new in rates.items()],
    )


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite one stage table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Overwrite a catalog table bucketed and sorted by the member key.

    Feature blocks stored this way with one bucket count join on the key without a
    shuffle, so assembling ten of them costs ten scans.
    """
    writer = df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace just those partitions of a stored table that ``df`` has rows for."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """Overwrite a small report as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)
