"""Headerless sensor matrices and their label files, each one file or an ordered set of part files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.functions import fixed
from shopfloor.sources.contracts import IngestError
from shopfloor.sources.ingest import number_file_set

TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"


def _lines(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The lines that hold anything, numbered from 0 over all files of the path."""
    try:
        return number_file_set(spark.read.text(path).where(F.trim("value") != ""), "row_id")
    except AnalysisException as exc:
        raise IngestError(f"Could not read sensor {what} file: {path}") from exc


def _cells(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, "data").select("row_id", F.split(F.trim("value"), r"\s+").alias("cells"))


def _width(cells: DataFrame) -> int:
    width = cells.agg(F.max(F.size("cells"))).first()[0]
    if not width:
        raise IngestError("Could not read sensor data file: no rows")
    return width


def _long(cells: DataFrame, width: int, *others: str) -> DataFrame:
    padded = cells.select("row_id", *others, F.posexplode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i", "pos"), "cells")
    number = F.try_element_at("cells", F.col("pos") + 1).try_cast("double")
    return padded.select(
        "row_id",
        F.format_string("sensor_%03d", "pos").alias("signal"),
        F.when(~F.isnan(number), number).alias("value"),
        *others,
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated matrix straight to long form: row_id, signal, value.

    Sensors are named by position (sensor_000, ...) from the widest row found;
    NaN and absent cells are null. Going long while reading avoids a plan with
    one expression per sensor. Blank lines do not count as rows.
    """
    cells = _cells(spark, path)
    return _long(cells, _width(cells))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label and quoted timestamp per row; an unreadable timestamp is null."""
    line = F.trim("value")
    label = F.regexp_extract(line, r"^(\S+)", 1).try_cast("int")
    stamp = F.regexp_replace(F.regexp_extract(line, r"^\S+\s+(.*)$", 1), '"', "")
    return _lines(spark, path, "labels").select(
        "row_id", label.alias("label"), F.try_to_timestamp(stamp, F.lit(TIMESTAMP_FORMAT)).alias("timestamp")
    )


def _check_aligned(rows: int, labels: DataFrame) -> None:
    outside: Column = F.count_if(F.col("label").isNull() | ~F.col("label").isin(fixed.UNIT_PASS, fixed.UNIT_FAIL))
    found = labels.agg(F.count(F.lit(1)).alias("n"), outside.alias("bad")).first()
    if rows != found["n"]:
        raise IngestError(f"Sensor data/labels row-count mismatch: {rows} feature rows vs {found['n']} label rows.")
    if found["bad"]:
        raise IngestError(f"Sensor labels must be in {{-1, 1}}; found {found['bad']} out-of-domain value(s)")


def load_sensor_study(spark: SparkSession, data_path: str, labels_path: str) -> tuple[DataFrame, DataFrame]:
    """Matrix and labels, row for row; raises when their lengths or the label domain disagree."""
    matrix, labels = read_matrix(spark, data_path), read_labels(spark, labels_path)
    _check_aligned(_lines(spark, data_path, "data").count(), labels)
    return matrix, labels


def read_labelled(spark: SparkSession, data_path: str, labels_path: str) -> DataFrame:
    """The matrix in long form with each unit's label and timestamp: row_id, signal, value, label, timestamp.

    The k-th line of the matrix belongs to the k-th label, however either set is
    cut into files. Lines are matched as whole units and made long afterwards, so a
    wide matrix shuffles a row per unit, not one per reading.
    """
    cells, labels = _cells(spark, data_path), read_labels(spark, labels_path)
    found = cells.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("width")).first()
    if not found["rows"]:
        raise IngestError("Could not read sensor data file: no rows")
    _check_aligned(found["rows"], labels)
    return _long(cells.join(labels, "row_id"), found["width"], "label", "timestamp")


def with_labels(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach each unit's label and timestamp to its readings by row number."""
    return matrix.join(labels, "row_id")


def write_matrix(units: DataFrame, path: str, order: str, cells: str = "cells", files: int | None = None) -> None:
    """Write an array column as whitespace-separated lines, null cells as NaN, in part files that read back in ``order``."""
    line = F.array_join(F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit("NaN"))), " ")
    _write_ordered(units, line, path, order, files)


def write_labels(units: DataFrame, path: str, order: str, files: int | None = None) -> None:
    """Write label and timestamp lines in part files that read back in ``order``."""
    stamp = F.date_format("timestamp", TIMESTAMP_FORMAT)
    _write_ordered(units, F.concat(F.col("label").cast("string"), F.lit(' "'), stamp, F.lit('"')), path, order, files)


def _write_ordered(units: DataFrame, line: Column, path: str, order: str, files: int | None) -> None:
    spread = units.repartitionByRange(files, order) if files else units.repartitionByRange(order)
    spread.sortWithinPartitions(order).select(line.alias("value")).write.text(path)
