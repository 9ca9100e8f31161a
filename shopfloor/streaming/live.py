"""Live monitor: re-chart the last subgroups of each stream as measurements arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shopfloor.functions import fixed
from shopfloor.operators.charts import ControlChart, control_chart
from shopfloor.operators.rules import rule_count
from shopfloor.operators.sequence import chunked, dense_sequence, join_groups, join_on
from shopfloor.sources.staging import scope, stage, workspace

WINDOW = 50
BLOCK = 2_048
"""Windows charted at a time."""
CHARTED = 65_536
"""Subgroups of a stream that one task charts at most, besides those that lead in."""
OUTPUT = (
    "stream string, subgroup long, n_points int, center double, sigma_hat double, ucl double, lcl double, violations int"
)
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
STATE = "completed long, open array<double>, means array<double>, ranges array<double>"


def _runs_of(mask: np.ndarray, length: int) -> np.ndarray:
    """How many of each ``length`` consecutive flags of a row are set."""
    if mask.shape[1] < length:
        return np.zeros((len(mask), 0), dtype=int)
    sums = np.cumsum(np.pad(mask.astype(int), ((0, 0), (1, 0))), axis=1)
    return sums[:, length:] - sums[:, :-length]


def count_violations(points: np.ndarray, center: float, sigma: float, rule_set: str) -> int:
    """Number of (point, rule) violations of one chart window; none when sigma is not positive."""
    return int(violations_of(points[None], np.array([center]), np.array([sigma]), rule_set)[0])


def violations_of(points: np.ndarray, center: np.ndarray, sigma: np.ndarray, rule_set: str) -> np.ndarray:
    """Number of (point, rule) violations of each row of points; none where sigma is not positive."""
    c, s = points - center[:, None], sigma[:, None]
    total = (np.abs(c) > 3 * s).sum(axis=1)
    for multiple, length, needed in ((2.0, 3, 2), (1.0, 5, 4)):
        up, down = _runs_of(c > multiple * s, length), _runs_of(c < -multiple * s, length)
        total += (((up >= needed) & (down == 0)) | ((down >= needed) & (up == 0))).sum(axis=1)
    total += (_runs_of(c > 0, 8) == 8).sum(axis=1) + (_runs_of(c < 0, 8) == 8).sum(axis=1)
    if rule_count(rule_set) > 4:
        step = np.sign(np.diff(points, axis=1))
        turn = step[:, 1:] * step[:, :-1]
        outside = _runs_of(np.abs(c) > s, 8) == 8
        total += (_runs_of(step > 0, 5) == 5).sum(axis=1) + (_runs_of(step < 0, 5) == 5).sum(axis=1)
        total += (_runs_of(turn < 0, 12) == 12).sum(axis=1)
        total += (_runs_of(np.abs(c) < s, 15) == 15).sum(axis=1)
        total += (outside & (_runs_of(c > 0, 8) > 0) & (_runs_of(c < 0, 8) > 0)).sum(axis=1)
    return np.where(sigma > 0, total, 0)


def chart_windows(points: np.ndarray, ranges: np.ndarray, size: int, rule_set: str) -> tuple[np.ndarray, ...]:
    """Center, sigma, limits and violation count of each row of means, all rows as long as their windows."""
    if size == 1:
        spread, reach, d2 = np.abs(np.diff(points, axis=1)).mean(axis=1), fixed.IMR_LIMIT, fixed.IMR_SIGMA
    else:
        spread = ranges.mean(axis=1)
        reach, d2 = {row[0]: (row[1], row[4]) for row in fixed.XBAR_R}[size]
    center, sigma = points.mean(axis=1), spread / d2
    found = violations_of(points, center, sigma / size**0.5, rule_set)
    return center, sigma, center + reach * spread, center - reach * spread, found


def charts_along(
    means: np.ndarray, ranges: np.ndarray, first: int, size: int, rule_set: str, window: int
) -> Iterator[tuple[np.ndarray, int, tuple[np.ndarray, ...]]]:
    """The chart at every place from ``first`` on: (places, points of each window, what chart_windows gives).

    Only the first places of a stream have short windows; all others go through in blocks.
    """
    n = len(means)
    for k in range(first, min(window - 1, n)):
        if k >= (size == 1):
            yield np.array([k]), k + 1, chart_windows(means[None, : k + 1], ranges[None, : k + 1], size, rule_set)
    if n < window or window <= (size == 1):
        return
    all_means, all_ranges = (np.lib.stride_tricks.sliding_window_view(x, window) for x in (means, ranges))
    for at in range(max(first, window - 1), n, BLOCK):
        places = np.arange(at, min(at + BLOCK, n))
        rows = slice(at - window + 1, int(places[-1]) - window + 2)
        yield places, window, chart_windows(all_means[rows], all_ranges[rows], size, rule_set)


def _present(measurements: DataFrame, stream: str, order: Sequence[str], value: str) -> DataFrame:
    """Stream, order and reading; a missing reading is no point of a chart, in the batch twin neither."""
    there = measurements.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return there.select(F.col(stream).alias("stream"), *order, F.col(value).cast("double").alias("value"))


def _checked(subgroup_size: int, rule_set: str) -> None:
    if subgroup_size != 1 and subgroup_size not in {row[0] for row in fixed.XBAR_R}:
        raise ValueError("subgroup_size must be 1 or between 2 and 10")
    rule_count(rule_set)


def live_monitor(
    measurements: DataFrame,
    subgroup_size: int,
    *,
    stream: str = "stream",
    value: str = "value",
    order: Sequence[str] = ("ts", "row_id"),
    rule_set: str = "we",
    watermark: str | None = None,
    idle_ms: int | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """Streaming frame with one row per completed subgroup.

    State per stream is bounded: the open subgroup and the last ``window``
    means and ranges. Rows of a micro-batch are taken in ``order`` (its first
    column is the event time); a stream's rows of one micro-batch meet in one
    task, so the source's rate options must bound the batch. Where they do not,
    ``monitor_in_batches`` spreads them. With a ``watermark`` rows later than it are dropped, and the state of
    a stream without rows for ``idle_ms`` of event time is forgotten. Null and NaN
    readings are left out.
    """
    _checked(subgroup_size, rule_set)
    if idle_ms is not None and not watermark:
        raise ValueError("idle_ms needs a watermark")
    order = list(order)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = _NAMES
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        completed, open_, means, ranges = state.get if state.exists else (0, [], [], [])
        arrived = pd.concat(list(batches)).sort_values(order)
        values = np.concatenate([open_, arrived["value"].to_numpy(np.float64)])
        whole = len(values) // subgroup_size
        groups = values[: whole * subgroup_size].reshape(whole, subgroup_size)
        all_means = np.concatenate([means, groups.mean(axis=1)])
        all_ranges = np.concatenate([ranges, groups.max(axis=1) - groups.min(axis=1)]) if whole else np.asarray(ranges)
        out = [pd.DataFrame([], columns=columns)]
        for places, n_points, charted in charts_along(all_means, all_ranges, len(means), subgroup_size, rule_set, window):
            numbers = completed + places + 1 - len(means)
            out.append(pd.DataFrame(dict(zip(columns, (key[0], numbers, n_points, *charted)))))
        state.update((completed + whole, values[whole * subgroup_size :].tolist(), all_means[-window:].tolist(), all_ranges[-window:].tolist()))
        if idle_ms is not None:
            state.setTimeoutTimestamp(int(arrived[order[0]].max().timestamp() * 1000) + idle_ms)
        yield from out

    rows = _present(measurements, stream, order, value)
    timeout = GroupStateTimeout.NoTimeout
    if watermark:
        rows, timeout = rows.withWatermark(order[0], watermark), GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("stream").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)


def advance_charts(
    rows: DataFrame, state: DataFrame, subgroup_size: int, order: Sequence[str], rule_set: str, window: int
) -> tuple[DataFrame, DataFrame]:
    """One step of the monitor over any number of rows: the charts it completes, and the next state.

    Rows are numbered, cut into subgroups and averaged on Spark; subgroups are
    charted a chunk at a time, each led in by the ``window - 1`` before it.
    """
    kind = rows.schema["stream"].dataType.simpleString()
    held = state.select("stream", "completed", F.size("open").alias("_open"), F.size("means").alias("_kept"))
    placed = join_groups(dense_sequence(rows, ["stream"], order), held, ["stream"], "left")
    placed = placed.select("stream", (F.col("seq") + F.coalesce("_open", F.lit(0))).alias("place"), "value")
    every = placed.unionByName(state.select("stream", F.posexplode("open").alias("place", "value")))
    counts = stage(every.groupBy("stream").agg(F.count(F.lit(1)).alias("_n")), "live-counts")

    v = F.col("value")
    groups = every.groupBy("stream", F.floor(F.col("place") / subgroup_size).alias("_g")).agg(
        F.count(v).alias("_n"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("range")
    )
    fresh = join_groups(groups.where(F.col("_n") == subgroup_size), held, ["stream"], "left").select(
        "stream",
        (F.col("_g") + F.coalesce("_kept", F.lit(0))).cast("long").alias("idx"),
        (F.col("_g") + F.coalesce("completed", F.lit(0)) + 1).cast("long").alias("number"),
        "mean",
        "range",
    )
    old = state.select("stream", F.posexplode(F.arrays_zip("means", "ranges")).alias("idx", "_x"))
    old = old.select("stream", F.col("idx").cast("long"), F.lit(None).cast("long").alias("number"), "_x.means", "_x.ranges")
    points = stage(fresh.union(old), "live-points")

    def chart(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        number = table.column("number").to_numpy()
        wanted = np.flatnonzero(table.column("_own").to_numpy() & ~np.isnan(number))
        means, ranges = (table.column(c).to_numpy() for c in ("mean", "range"))
        parts = [] if not len(wanted) else [
            (places, n_points, *charted)
            for places, n_points, charted in charts_along(means, ranges, int(wanted[0]), subgroup_size, rule_set, window)
        ]
        places = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
        columns = [table.column("stream").take(places), table.column("number").take(places)]
        columns.append(np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32))
        for k, as_type in zip(range(2, 7), (*[np.float64] * 4, np.int32)):
            columns.append(np.concatenate([p[k] for p in parts]).astype(as_type) if parts else np.zeros(0, as_type))
        return pa.table(dict(zip(_NAMES, columns)))

    rows_, partition = chunked(points, ["stream"], "idx", lead_in=window - 1, most=CHARTED)
    charts = rows_.groupBy(*partition).applyInArrow(chart, OUTPUT.replace("stream string", f"stream {kind}", 1))

    ends = points.groupBy("stream").agg(F.max("idx").alias("_last"))
    tail = join_groups(points, ends, ["stream"]).where(F.col("idx") > F.col("_last") - window)
    tail = tail.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("idx", "mean", "range"))).alias("_tail"))
    left = join_groups(every, counts, ["stream"]).where(F.col("place") >= F.col("_n") - F.col("_n") % subgroup_size)
    left = left.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("_left"))
    streams = counts.select("stream").union(state.select("stream")).distinct()
    known = join_on(streams, held, ["stream"], "left")
    for part in (counts, tail, left):
        known = join_on(known, part, ["stream"], "left")
    none = F.array().cast("array<double>")
    after = known.select(
        "stream",
        (F.coalesce("completed", F.lit(0)) + F.coalesce(F.floor(F.col("_n") / subgroup_size), F.lit(0))).cast("long").alias("completed"),
        F.coalesce(F.col("_left.value"), none).alias("open"),
        F.coalesce(F.col("_tail.mean"), none).alias("means"),
        F.coalesce(F.col("_tail.range"), none).alias("ranges"),
    )
    return charts, after


@dataclass(frozen=True)
class Release:
    """What one micro-batch lets through: rows to chart, rows to hold, rows that came too late, the new watermark."""

    ready: DataFrame
    waiting: DataFrame
    late: DataFrame
    watermark: datetime | None


def released(arrived: DataFrame, waiting: DataFrame, watermark: datetime | None, time: str, delay: str) -> Release:
    """Sort rows by the watermark, which trails the latest event time seen by ``delay``.

    Arrived rows before the old watermark are late: what lies there is charted
    already. Of the others and those held so far, rows before the new watermark
    are ready; the rest waits, as earlier rows may still come. Rows without an
    event time have no place among the others and count as late.
    """
    old = F.lit(watermark).cast(arrived.schema[time].dataType)
    in_time = F.col(time).isNotNull() & F.coalesce(F.col(time) >= old, F.lit(True))
    reached = arrived.agg((F.max(time) - F.expr(f"interval {delay}")).cast("timestamp").alias("w")).first()["w"]
    new = max((w for w in (watermark, reached) if w is not None), default=None)
    pending = arrived.where(in_time).unionByName(waiting)
    passed = F.lit(False) if new is None else F.col(time) < F.lit(new).cast(arrived.schema[time].dataType)
    return Release(pending.where(passed), pending.where(~passed), arrived.where(~in_time), new)


def monitor_in_batches(
    measurements: DataFrame,
    subgroup_size: int,
    out: str,
    checkpoint: str,
    *,
    stream: str = "stream",
    value: str = "value",
    order: Sequence[str] = ("ts", "row_id"),
    rule_set: str = "we",
    window: int = WINDOW,
    delay: str | None = None,
    idle: str | None = None,
    late: str | None = None,
) -> DataStreamWriter:
    """The live monitor for micro-batches of any size and streams of any share of them.

    Each batch writes its charts to ``out/batch=N``, and the open subgroup and
    last ``window`` means and ranges of every stream to ``checkpoint/charts/N``;
    a batch that is run again replaces both. Without ``delay`` rows are charted in
    the batch they come in, nothing is late and no stream is forgotten.

    With ``delay`` (an interval such as ``10 minutes``) rows wait in
    ``checkpoint/waiting/N`` until the latest event time (the first column of
    ``order``, a timestamp) is that far ahead, and are charted in ``order``
    whatever order they came in; what waits is bounded by the rows of one delay.
    Rows that come after their time was charted go to ``late/batch=N`` and into no
    chart; the folder is needed, so that none goes unseen. With ``idle`` a stream
    whose last charted row lies that far behind the watermark is forgotten: if it
    comes back it begins anew at subgroup 1.
    """
    _checked(subgroup_size, rule_set)
    if (delay is None) != (late is None):
        raise ValueError("delay and late go together")
    if idle and not delay:
        raise ValueError("idle needs a delay")
    order = list(order)
    spark = measurements.sparkSession
    rows = _present(measurements, stream, order, value)
    time = order[0]
    kind = rows.schema["stream"].dataType.simpleString()
    held = f"stream {kind}, {STATE}"
    if delay:
        held += f", last {rows.schema[time].dataType.simpleString()}"
    mark = "watermark timestamp"

    def stored(label: str, number: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{checkpoint}/{label}/{number}") if number >= 0 else spark.createDataFrame([], schema)

    def advance(batch: DataFrame, number: int) -> None:
        with scope() as staged:
            # The stream's own session has no adaptive execution, so the batch is written down and read in the caller's.
            landed = f"{workspace(spark)}/live-rows-{uuid4().hex}"
            batch.write.parquet(landed)
            staged.paths.append(landed)
            before = stored("charts", number - 1, held)
            arrived = spark.read.schema(rows.schema).parquet(landed)
            if delay:
                seen = stored("watermark", number - 1, mark).first()
                split = released(arrived, stored("waiting", number - 1, rows.schema), seen and seen[0], time, delay)
                ready = stage(split.ready, "live-ready")
                split.late.write.mode("overwrite").parquet(f"{late}/batch={number}")
                split.waiting.write.mode("overwrite").parquet(f"{checkpoint}/waiting/{number}")
                spark.createDataFrame([(split.watermark,)], mark).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/watermark/{number}")
                arrived, known = ready, before.drop("last")
            else:
                known = before
            charts, after = advance_charts(arrived, known, subgroup_size, order, rule_set, window)
            if delay:
                ends = arrived.select("stream", F.col(time).alias("last")).unionByName(before.select("stream", "last"))
                after = join_on(after, ends.groupBy("stream").agg(F.max("last").alias("last")), ["stream"], "left")
                if idle and split.watermark:
                    after = after.where(F.col("last") >= F.lit(split.watermark).cast("timestamp") - F.expr(f"interval {idle}"))
            charts.write.mode("overwrite").parquet(f"{out}/batch={number}")
            after.write.mode("overwrite").parquet(f"{checkpoint}/charts/{number}")
            staged.release(spark)
            # The batch before last is committed, so its state is not asked for again.
            staged.paths += [f"{checkpoint}/{label}/{number - 2}" for label in (("charts", "waiting", "watermark") if delay else ("charts",))]
            staged.release(spark)

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in (out, late):
        if path:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).mkdirs(folder)
    return rows.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint)


def last_window_rows(df: DataFrame, subgroup_size: int, window: int = WINDOW, stream: str = "stream") -> DataFrame:
    """Measurements of the last ``window`` complete subgroups of each stream.

    ``df`` carries the 0-based position ``seq`` of rows that reach their stream's
    end; the rows wanted follow from the last position, so nothing is sorted.
    """
    sizes = df.groupBy(stream).agg((F.max("seq") + 1).alias("_n"))
    whole = F.col("_n") - F.col("_n") % subgroup_size
    first = F.greatest(F.lit(0), whole - window * subgroup_size)
    kept = join_groups(df, sizes, [stream]).where((F.col("seq") >= first) & (F.col("seq") < whole))
    return kept.select(
        *df.columns,
        (F.col("seq") - first).alias("place"),
        (F.floor((F.col("seq") - first) / subgroup_size) + 1).cast("long").alias("subgroup"),
    )


def newest_rows(df: DataFrame, most: int, order: Sequence[str], stream: str = "stream") -> DataFrame:
    """The last ``most`` rows of each stream in ``order``, with their 0-based position ``seq`` in the whole stream.

    Each task keeps its own last rows before anything moves, and positions follow
    from the streams' row counts, so the table is neither sorted nor numbered.
    """
    back = Window.partitionBy(stream).orderBy(*[F.col(c).desc() for c in order])
    kept = df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= most)
    sizes = df.groupBy(stream).agg(F.count(F.lit(1)).alias("_all"))
    return join_groups(kept, sizes, [stream]).select(*df.columns, (F.col("_all") - F.col("_back")).alias("seq"))


def live_snapshot(
    df: DataFrame,
    subgroup_size: int,
    *,
    order: Sequence[str] | None = None,
    rule_set: str = "we",
    window: int = WINDOW,
    stream: str = "stream",
) -> ControlChart:
    """Batch twin of the live monitor: the chart of each stream's last window.

    With ``order`` (total inside a stream) only the newest rows of each stream are
    kept; without it the rows carry their position ``seq``.
    """
    if order:
        newest = newest_rows(df, window * subgroup_size + subgroup_size - 1, order, stream)
        # A bounded table, read several times by the chart.
        rows = stage(last_window_rows(newest, subgroup_size, window, stream), "newest")
    else:
        rows = last_window_rows(df, subgroup_size, window, stream)
    # A stream holds a window of points at most, so its subgroups are numbered as they are.
    if subgroup_size == 1:
        return control_chart(rows, "I-MR", [stream], position="place", rule_set=rule_set)
    return control_chart(rows, "Xbar-R", [stream], rule_set=rule_set)
