"""Reading and writing: CSV with declared columns, Parquet data sets partitioned by task, split and shard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventloom.plans.timeline import lay_out

PARTITION_COLUMNS = ["task", "split", "shard"]
LABEL_COLUMNS = ["boolean_value", "integer_value", "float_value", "categorical_value"]

# Columns of the raw CSV tables with types other than text. Everything else is read as text, which
# keeps leading zeros of codes and ids.
NUMBERS = "subject_id hadm_id stay_id itemid seq_num anchor_age anchor_year".split()
MEASURES = "temperature heartrate resprate o2sat sbp dbp acuity valuenum".split()


# Quotes inside quoted text are doubled; quoted text may hold line breaks; a row that does not fit the columns is an error.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}


def csv_schema(columns: Sequence[str], types: Mapping[str, str] | None = None) -> StructType:
    """Explicit schema: known ids as bigint, known measures as double, the rest as text unless `types` says so."""
    known = {c: "bigint" for c in NUMBERS} | {c: "double" for c in MEASURES} | dict(types or {})
    parts = [f"`{c}` {known.get(c, 'string')}" for c in columns]
    return StructType.fromDDL(", ".join(parts))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header of the file or of one file of the folder."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Standard CSV (plain or .gz) without type inference; an empty field without quotes is null.

    `columns` are the file's columns in order, read from the header if absent. `multi_line=False` lets Spark split large
    plain files whose quoted text has no line breaks.
    """
    columns = columns or csv_header(spark, path)
    options = CSV_OPTIONS | {"multiLine": multi_line, "enforceSchema": False}
    return spark.read.schema(csv_schema(columns, types)).options(**options).csv(path)


def read_all_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with every column as text, for code lookups."""
    columns = columns or csv_header(spark, path)
    return read_csv(spark, path, columns, dict.fromkeys(columns, "string"), multi_line)


def read_raw_tables(spark: SparkSession, root: str, names: Sequence[str], suffix: str = ".csv.gz") -> dict[str, DataFrame]:
    """Raw tables by name, such as `hosp/admissions`; code lookups entirely as text."""
    tables = {}
    for name in names:
        path = f"{root}/{name}{suffix}"
        if suffix == ".parquet":
            tables[name] = spark.read.parquet(path)
        elif "/d_icd_" in name:
            tables[name] = read_all_text(spark, path)
        else:
            tables[name] = read_csv(spark, path)
    return tables


def read_partitioned(
    spark: SparkSession, root: str, tasks: Sequence[str] | None = None, split: str | None = None
) -> DataFrame:
    """A data set written by `write_partitioned`; filters on task and split prune directories.

    Hidden directories are skipped, and partition values stay text.
    """
    found = spark.read.parquet(root).schema
    named = [f if f.name not in PARTITION_COLUMNS else StructField(f.name, StringType()) for f in found]
    df = spark.read.schema(StructType(named)).parquet(root)
    if tasks is not None:
        df = df.filter(F.col("task").isin(list(tasks)))
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


def write_partitioned(
    df: DataFrame, root: str, by: Sequence[str] = PARTITION_COLUMNS, mode: str = "overwrite", rebalance: bool = True
) -> None:
    """One directory per value of `by`. Only the partitions written to are replaced.

    Rows are gathered by directory first, with small ones merged and large ones split over several files by adaptive
    execution. Pass `rebalance=False` for data that is already sorted by these columns.
    """
    present = [c for c in by if c in df.columns]
    gathered = df.hint("rebalance", *present) if rebalance else df
    gathered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*present).parquet(root)


def discovered(df: DataFrame, by: Sequence[str] = PARTITION_COLUMNS) -> DataFrame:
    """The combinations of task, split and shard that occur, with their row counts."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def cap_rows(
    df: DataFrame, n: int | None, by: Sequence[str] = PARTITION_COLUMNS, order=("subject_id", "prediction_time")
) -> DataFrame:
    """The first `n` rows of each shard of each split in a fixed order; no cap when `n` is None or 0.

    Columns of `by` that the table does not have are left out.
    """
    if not n:
        return df
    numbered = lay_out(df, [c for c in by if c in df.columns], order).numbered("__row")
    return numbered.rows().filter(F.col("__row") <= n).drop("__row")
