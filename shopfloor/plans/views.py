"""The shared test tables seen as manufacturing-quality inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.operators.sequence import dense_sequence, join_groups


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Individual measurements of five streams, with their time."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("stream"), F.col("event_id").alias("row_id"), "ts", "value"
    )


def spc_var(spark: SparkSession, folder: str) -> DataFrame:
    """Individual measurements numbered by time in each stream."""
    return dense_sequence(measurements(spark, folder), ["stream"], ["ts", "row_id"]).drop("ts")


def spc_subgroups(spark: SparkSession, folder: str, size: int = 5) -> DataFrame:
    """Complete rational subgroups of ``size`` consecutive measurements."""
    rows = spc_var(spark, folder)
    totals = table(spark, folder, "events").groupBy(F.col("event_type").alias("stream")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = F.col("n") - F.col("n") % size
    return (
        join_groups(rows, totals, ["stream"])
        .where(F.col("seq") < whole)
        .select("stream", (F.floor(F.col("seq") / size) + 1).cast("long").alias("subgroup"), "seq", "value")
    )


def spc_p(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a type per day (count) out of the day's events (sample size)."""
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("stream"), F.col("ts").cast("date").alias("d")
    )
    daily = events.groupBy("stream", "d").agg(F.count(F.lit(1)).alias("value"))
    sizes = daily.groupBy("d").agg(F.sum("value").alias("sample_size"))
    numbered = dense_sequence(daily.join(sizes, "d"), ["stream"], ["d"], out="subgroup")
    return numbered.select(
        "stream",
        (F.col("subgroup") + 1).alias("subgroup"),
        F.col("value").cast("double").alias("value"),
        F.col("sample_size").cast("double").alias("sample_size"),
    )


def spc_u(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines per 100 shipped lines, by line status and month."""
    lines = table(spark, folder, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return (
        lines.groupBy(F.col("l_linestatus").alias("stream"), month.cast("long").alias("subgroup"))
        .agg(
            F.count_if(F.col("l_returnflag") == "R").cast("double").alias("value"),
            (F.count(F.lit(1)).cast("double") / 100.0).alias("sample_size"),
        )
        .select("stream", "subgroup", "value", "sample_size")
    )


def spc_limits(spark: SparkSession) -> DataFrame:
    """Specification limits: two-sided, one-sided and none."""
    return spark.sql(
        "select stream, cast(lsl as double) as lsl, cast(usl as double) as usl from values "
        "('click', 0.0, 250.0), ('error', null, 200.0), ('purchase', 0.0, null), "
        "('signup', null, null), ('view', 5.0, 95.0) as t(stream, lsl, usl)"
    )


def fmea_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Failure-mode rows, many links per failure mode."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        (key + 1).alias("ID"),
        F.col("p_type").alias("Process_Step"),
        F.concat(F.lit("Unit "), (key % 5).cast("string")).alias("Component"),
        F.concat(F.lit("Provide "), "p_type").alias("Function"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("Failure_Mode"),
        F.concat(F.lit("Effect "), (size % 7).cast("string")).alias("Effect"),
        (1 + size % 10).cast("int").alias("Severity"),
        F.concat(F.lit("Cause "), (size % 4).cast("string")).alias("Cause"),
        (1 + (F.floor(key / 5.0) + size) % 10).cast("int").alias("Occurrence"),
        F.concat(F.lit("Control "), "p_brand").alias("Current_Control"),
        (1 + (F.floor(key / 50.0) + 3 * size) % 10).cast("int").alias("Detection"),
    )


def fmea_actions(spark: SparkSession, folder: str) -> DataFrame:
    """A tracked action on every failure-mode row."""
    ident = F.col("ID")
    return fmea_flat(spark, folder).select(
        ident.alias("row_id"),
        F.concat(F.lit("Owner "), (ident % 3).cast("string")).alias("owner"),
        F.when(ident % 3 == 0, "Open").when(ident % 3 == 1, "In-Progress").otherwise("Closed").alias("status"),
        F.lit(None).cast("date").alias("due"),
        F.lit(None).cast("int").alias("s_after"),
        F.when(ident % 8 == 0, F.greatest(F.lit(1), F.col("Occurrence") - 2)).cast("int").alias("o_after"),
        F.greatest(F.lit(1), F.col("Detection") - 3).cast("int").alias("d_after"),
    )


def gage(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced 10 x 3 x 3 studies, every order line a reading.

    Lines are dealt to studies by return flag and order range; the trial of a cell
    is the mean of its lines with equal line number modulo 3.
    """
    lines = table(spark, folder, "lineitem")
    part, appraiser = F.col("l_partkey") % 10, F.col("l_suppkey") % 3
    noise = F.when(F.col("l_returnflag") == "A", 0.02).when(F.col("l_returnflag") == "N", 0.2).otherwise(1.0)
    reading = part * 10.0 + appraiser * 0.1 + F.col("l_quantity") * noise
    study = F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.floor(F.col("l_orderkey") / 2000.0).cast("string"))
    return lines.groupBy(
        study.alias("study_id"),
        part.cast("string").alias("part"),
        appraiser.cast("string").alias("appraiser"),
        (F.col("l_linenumber") % 3 + 1).cast("long").alias("trial"),
    ).agg(F.round(F.avg(reading), 9).alias("measurement"))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Long sensor table: honest gaps, a constant, a near-constant and a sparse signal."""
    largest = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("int").alias("n")
    ).agg(F.max("l_extendedprice").alias("v"))
    by_line = F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("_by")  # seven lines at most
    units = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("label")
    )
    n, row = F.col("n"), F.col("row_id")
    value = (
        F.when(n <= 7, F.col("_by")[n])
        .when(n == 8, 5.0)
        .when(n == 9, F.when(row % 50 == 0, 1.0).otherwise(0.0))
        .when(row < 60, row * 1.0)
    )
    # Ten rows come of one: spread by number, as the small rows before would be packed into few tasks.
    spread = units.repartition(spark.sparkContext.defaultParallelism, "row_id")
    grid = spread.join(largest.groupBy("row_id").agg(by_line), "row_id", "left")
    return grid.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10)))).select(
        "row_id",
        "label",
        F.concat(F.lit("sensor_"), F.lpad(n.cast("string"), 3, "0")).alias("signal"),
        value.cast("double").alias("value"),
    )
