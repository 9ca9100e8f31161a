"""Row positions, halo chunks and running totals that survive hot groups.

A window partitioned by stream puts a whole stream into one task. One stream may
hold a third of all rows, so the order-dependent operators never do that:

* ``dense_sequence`` numbers rows per group through a range partitioning on
  (group, order), which splits a hot group over many tasks;
* ``chunked`` cuts the numbered rows into pieces of bounded length, each with
  copies of the few rows before it, so a bounded ROWS frame can run per piece;
* ``running_sum`` adds per-piece totals to per-piece running sums;
* ``join_on`` and ``join_groups`` match null keys like any other, as grouping does.

Inputs of every size take the same way.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.sources.staging import stage

CHUNK_ROWS = "shopfloor.chunkRows"
LONGEST_LEAD_IN = 14
_DEFAULTS = {CHUNK_ROWS: 32_768}
ROWS_A_TASK = 1_000_000
"""Rows that a task sorts for its windows, about; a chunk stays whole."""


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def chunk_rows(spark: SparkSession) -> int:
    return max(setting(spark, CHUNK_ROWS), LONGEST_LEAD_IN + 1)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions that keep a task's rows bounded. Sizes in bytes do not: sorted rows compress many times over."""
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, usual, -(-rows // ROWS_A_TASK))


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys too; the columns of ``left``, then the other columns of ``right``."""
    if how not in ("inner", "left"):
        raise ValueError("the left side's rows are kept: inner or left")
    keys = list(keys)
    others = [c for c in right.columns if c not in keys]
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(renamed, same, how).select(*left.columns, *others)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-key ``groups`` onto rows whose keys may be badly skewed.

    The exchange of its own that ``groups`` gets shows its real size, so a small
    side is broadcast, and leaves the join free to split the partitions of hot keys.
    """
    return join_on(rows, groups.hint("rebalance"), keys, how)


def dense_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "seq", tasks: int | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its group.

    ``order`` must be total inside a group. The frame is range partitioned by
    (keys, order), staged once (range bounds come from sampling, so a second
    evaluation could cut elsewhere), and the position is the row's place in its
    partition plus the group's rows in earlier partitions. ``tasks`` is the number
    of ranges where the caller knows how many rows there are.
    """
    keys = list(keys)
    sort = [F.col(k) for k in keys] + _columns(order)
    placed = stage(
        df.repartitionByRange(*([tasks] if tasks else []), *sort).sortWithinPartitions(*sort).withColumn("_seq_place", F.monotonically_increasing_id()),
        "sequence",
    ).withColumn("_seq_part", F.shiftright("_seq_place", 33))
    # One row per (group, range partition) pair: at most groups + partitions rows. On file their size is known, so the
    # join need not move the numbered rows while they are few.
    spans = placed.groupBy(*keys, "_seq_part").agg(F.count(F.lit(1)).alias("_seq_rows"), F.min("_seq_place").alias("_seq_head"))
    before = Window.partitionBy(*keys).orderBy("_seq_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_seq_rows").over(before), F.lit(0))
    spans = stage(spans.select(*keys, "_seq_part", (start - F.col("_seq_head")).alias("_seq_shift")), "spans")
    found = join_on(placed, spans, [*keys, "_seq_part"])
    return found.select(*df.columns, (F.col("_seq_place") + F.col("_seq_shift")).alias(out))


def chunked(
    df: DataFrame, keys: Sequence[str], seq: str, lead_in: int = LONGEST_LEAD_IN, most: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Cut groups into bounded chunks, each led in by copies of the rows before it.

    Returns the frame with ``_chunk`` and ``_own`` (false on the copies) and the
    columns to partition windows by. ``lead_in`` is how many earlier rows the
    longest frame looks back on; ``most`` rows make a chunk where the setting has more.
    """
    size = max(min(chunk_rows(df.sparkSession), most or sys.maxsize), lead_in + 1)
    home = F.floor(F.col(seq) / size).cast("long")
    if lead_in == 0:
        return df.withColumn("_chunk", home).withColumn("_own", F.lit(True)), [*keys, "_chunk"]
    near_end = F.col(seq) - home * size >= size - lead_in
    spread = df.withColumn("_chunk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
    return spread.withColumn("_own", F.col("_chunk") == home), [*keys, "_chunk"]


def attach_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-group values onto chunked rows without a hot join key.

    ``groups`` gets one copy per chunk that the rows have, so the join key is
    (group, chunk): evenly spread, whatever the group's size.
    """
    chunks = rows.select(*keys, "_chunk").distinct()
    return join_on(rows, join_on(chunks, groups, keys), [*keys, "_chunk"])


def running_sum(df: DataFrame, keys: Sequence[str], seq: str, sums: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums along ``seq`` inside each group."""
    keys = list(keys)
    size = chunk_rows(df.sparkSession)
    rows = df.withColumn("_chunk", F.floor(F.col(seq) / size).cast("long"))
    totals = rows.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums],
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return join_on(rows, totals, [*keys, "_chunk"]).select(
        *df.columns,
        *[(F.col(f"_b_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()],
    )
