"""Sequences with gaps, cut into segments that sum up and join on.

Rows numbered along a group may have no value. Counting the values seen so far,
finding the run a value lies in, or pairing it with the value before it looks
back without bound, so it is done segment by segment: each segment of bounded
length is summed up on its own (first and last value, counts, sums, the last few
values), a running total over the few summaries of a group carries what earlier
segments hand on, and a segment's rows add it to what they know themselves. That
takes no second numbering and no running sum over the rows. The rows are moved and
sorted once, by as many tasks as keep each one's rows bounded, and then lie on file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.operators.sequence import LONGEST_LEAD_IN, chunk_rows, join_on, tasks_for
from shopfloor.sources.staging import stage


@dataclass(frozen=True)
class Segments:
    """``rows`` know their segment (``_chunk``), the value right before them inside it (``_before``) and how many
    values and runs of values the segment has held so far (``_nth``, ``_nth_run``); ``tasks`` keep them bounded. ``carried`` has one row per segment: ``_first`` and ``_last``
    (values of the first and last row, null where missing), ``_present``, ``_total``, ``_moved`` and ``_moves`` (sum
    and number of moving ranges, the one across the segment's head included), and from earlier segments ``_previous``
    (value of the row before the segment), ``_seen`` (values), ``_runs`` (runs begun) and ``_lead`` (the last values);
    ``_joins`` is 1 where the segment's first run began before it, else 0."""

    keys: list[str]
    size: int
    position: str
    value: str
    tasks: int
    rows: DataFrame
    carried: DataFrame

    def with_carried(self, groups: DataFrame | None = None) -> DataFrame:
        """The rows that have a value, each with what its segment was handed and the columns of its group."""
        keep = ["_previous", "_seen", "_runs", "_joins", "_lead"]
        small = self.carried.where("_present > 0").select(*self.keys, "_chunk", *keep)
        if groups is not None:
            small = join_on(small, groups, self.keys)
        rows = self.rows.where(F.col(self.value).isNotNull())
        return join_on(rows, small, [*self.keys, "_chunk"])

    def before(self) -> Column:
        """The value of the row right before this one, across segments; null at the start and after a gap."""
        return F.when(F.col(self.position) % self.size == 0, F.col("_previous")).otherwise(F.col("_before"))


def segments(df: DataFrame, keys: Sequence[str], position: str, value: str, lead: int = LONGEST_LEAD_IN) -> Segments:
    """Cut rows with a dense 0-based ``position`` into segments and sum them up.

    A NaN is a value; only null is a gap. ``lead`` is how many earlier values a
    segment is handed.
    """
    keys, v = list(keys), F.col(value)
    size = chunk_rows(df.sparkSession)
    part = [*keys, "_chunk"]
    ordered = Window.partitionBy(*part).orderBy(position)
    rows = df.withColumn("_chunk", F.floor(F.col(position) / size).cast("long"))
    tasks = tasks_for(df.sparkSession, df.count())
    rows = rows.repartition(tasks, *part).withColumn("_before", F.lag(value).over(ordered))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "_nth": F.count(value).over(so_far),
            "_nth_run": F.count(F.when(v.isNotNull() & F.col("_before").isNull(), 1)).over(so_far),
            "_all": F.count(value).over(Window.partitionBy(*part)),
        }
    )
    rows = stage(rows, "cut")
    counted = rows.withColumn("_move", F.abs(v - F.col("_before")))
    late = v.isNotNull() & (F.col("_all") - F.col("_nth") < lead)
    summary = counted.groupBy(*part).agg(
        F.min_by(v, position).alias("_first"),
        F.max_by(v, position).alias("_last"),
        F.count(v).alias("_present"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_total"),
        F.coalesce(F.sum("_move"), F.lit(0.0)).alias("_inside"),
        F.count("_move").alias("_inside_moves"),
        F.count_if(v.isNotNull() & F.col("_before").isNull()).alias("_starts"),
        F.sort_array(F.collect_list(F.when(late, F.struct(F.col(position).alias("p"), v.alias("v"))))).alias("_tail"),
    )

    # From here on there is a row per segment.
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    linked = summary.withColumn("_previous", F.lag("_last").over(along))
    joins = F.col("_first").isNotNull() & F.col("_previous").isNotNull()
    across = F.abs(F.col("_first") - F.col("_previous"))
    linked = linked.withColumns(
        {
            "_joins": joins.cast("long"),
            "_moved": F.col("_inside") + F.coalesce(across, F.lit(0.0)),
            "_moves": F.col("_inside_moves") + joins.cast("long"),
            "_begun": F.col("_starts") - joins.cast("long"),
        }
    )
    handed = linked.withColumns(
        {
            "_seen": F.coalesce(F.sum("_present").over(earlier), F.lit(0)),
            "_runs": F.coalesce(F.sum("_begun").over(earlier), F.lit(0)),
        }
    )
    # Segments without a value hand nothing on, so the last ones that have any are enough.
    filled = Window.partitionBy(*keys, F.col("_present") > 0).orderBy("_chunk").rowsBetween(-lead, -1)
    values = F.transform(F.flatten(F.collect_list("_tail").over(filled)), lambda s: s["v"])
    handed = handed.withColumn("_lead", values)
    last = F.slice("_lead", F.greatest(F.lit(1), F.size("_lead") - lead + 1), lead)
    # A row a segment, read by limits and points alike; on file its size is known, so the join onto the rows need not
    # move them while the table is small.
    return Segments(keys, size, position, value, tasks, rows.drop("_all"), stage(handed.withColumn("_lead", last).drop("_tail"), "segments"))
