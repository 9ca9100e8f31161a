"""Reading uploaded tables with spreadsheet row numbers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.operators.sequence import join_groups
from shopfloor.sources.contracts import ROW_NO, Contract, IngestError

# Cell texts read as missing.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def _split_counts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a file scan with their place in the scan, and one row per file split with its row count."""
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )
    return placed, placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_head"))


def _numbered(df: DataFrame, placed: DataFrame, splits: DataFrame, order: Window, out: str, first: int) -> DataFrame:
    """Rows numbered by their place in the split plus the rows of earlier splits in ``order``."""
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_block", "_head", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_place") - F.col("_head") + F.col("_before") + first
    return join_groups(placed, splits, ["_file", "_block"]).select(*df.columns, number.alias(out))


def number_file_rows(df: DataFrame, out: str, first: int = 0) -> DataFrame:
    """Number the rows of a file scan in file order, per file, without sorting.

    Rows keep their order inside a file split, so a row's number is its place in
    the split plus the rows of the file's earlier splits. Only the split counts
    (one row per split) are shuffled.
    """
    placed, splits = _split_counts(df)
    return _numbered(df, placed, splits, Window.partitionBy("_file").orderBy("_block"), out, first)


def natural_order(name: Column) -> Column:
    """A sort key that puts part-2 before part-10: runs of digits compare as numbers."""
    pieces = F.split(name, r"(?<=\D)(?=\d)|(?<=\d)(?=\D)")
    longest = 24
    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\d") & (F.length(p) < longest), F.lpad(p, longest, "0")).otherwise(p))


def number_file_set(df: DataFrame, out: str, first: int = 0) -> DataFrame:
    """Number the rows of a scan over an ordered set of files: by file name, then place in the file.

    The files of a folder written in order read as one long file. As with one file
    nothing is sorted: the running total goes over one row per file split, and only
    that small table is brought together.
    """
    placed, splits = _split_counts(df)
    return _numbered(df, placed, splits, Window.orderBy(natural_order(F.col("_file")), "_block"), out, first)


def read_table(spark: SparkSession, path: str, *, multiline: bool = False) -> DataFrame:
    """A ``.csv`` (or parquet) table as text cells plus ``_row_no``.

    The header counts as row 1, so row numbers match a spreadsheet. Quoted line
    breaks need ``multiline``, which makes each file a single split.
    """
    lowered = path.lower().rstrip("/")
    if not lowered.endswith((".csv", ".parquet")):
        raise IngestError(f"Unsupported file type: '{path}'. Please provide a .csv or .parquet file.")
    try:
        if lowered.endswith(".csv"):
            reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
            raw = reader.option("ignoreLeadingWhiteSpace", False).csv(path)
        else:
            raw = spark.read.parquet(path)
        columns = raw.columns
    except AnalysisException as exc:
        raise IngestError(
            f"Could not read '{path}'. The file may be corrupt, empty, missing, or not a valid CSV file."
        ) from exc
    if not columns:
        raise IngestError(f"Could not read '{path}'. The file may be corrupt, empty, missing, or not a valid CSV file.")
    numbered = number_file_rows(raw, ROW_NO, first=2)
    if lowered.endswith(".parquet"):
        return numbered
    return numbered.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in columns], ROW_NO)


def load_table(spark: SparkSession, path: str, contract: Contract, *, multiline: bool = False) -> DataFrame:
    """Read, validate strictly and type a table in one call."""
    return contract.require_valid(read_table(spark, path, multiline=multiline)).drop(ROW_NO)
