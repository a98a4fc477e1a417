"""Interval data: sessions, containment, de-duplication of overlapping rows.

Containment and sessions use prefix scans (``scan.py``), never a pair join: a sample is
inside some half-open interval exactly when the largest end among intervals that started at
or before it lies after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import DAY_US, SUBJECT, Keys, bucket, epoch_us, seconds_after, shift_hours
from kymo.functions.clock import local_date
from kymo.functions.vocab import SLEEP_STAGES
from kymo.operators.scan import prefix_scan
from kymo.session import materialized


def flag_inside(
    points: DataFrame,
    intervals: DataFrame,
    t: str = "time",
    start: str = "start",
    end: str = "end",
    keys: Keys = SUBJECT,
    closed_end: bool = False,
    out: str = "inside",
) -> DataFrame:
    """TRUE when t lies in any [start, end) (or [start, end] with ``closed_end``)."""
    p = points.withColumns({"_t": F.col(t), "_kind": F.lit(1), "_end": F.lit(None).cast("long")})
    spans = intervals.select(
        *keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), epoch_us(end).alias("_end")
    )
    both = p.unionByName(spans, allowMissingColumns=True)
    scanned = prefix_scan(both, {"_reach": ("max", F.col("_end"))}, keys, "_t", ["_kind"])
    now = epoch_us("_t")
    hit = F.col("_reach") >= now if closed_end else F.col("_reach") > now
    return scanned.where(F.col("_kind") == 1).select(
        *points.columns, F.coalesce(hit, F.lit(False)).alias(out)
    )


def point_in_interval_join(
    points: DataFrame,
    intervals: DataFrame,
    t: str = "time",
    start: str = "time",
    seconds: str = "seconds",
    keys: Keys = SUBJECT,
) -> DataFrame:
    """Semi-join: points inside any [start, start + seconds), each once."""
    spans = intervals.select(
        *keys, F.col(start).alias("start"), seconds_after(F.col(start), F.col(seconds)).alias("end")
    )
    return flag_inside(points, spans, t, "start", "end", keys).where("inside").drop("inside")


def asleep(stages: DataFrame, stage: str = "stage") -> DataFrame:
    return stages.where(F.col(stage).isin(*SLEEP_STAGES))


def sample_in_session_join(
    samples: DataFrame, sessions: DataFrame, t: str = "time", keys: Keys = SUBJECT
) -> DataFrame:
    """Samples inside [start, end] of their day's session. A day has one main session, so
    the equi-join on (keys, date) cannot fan out."""
    on = [*keys, "date"]
    spans = sessions.select(*on, F.col("start").alias("_a"), F.col("end").alias("_b"))
    return samples.join(spans, on).where(F.col(t).between(F.col("_a"), F.col("_b"))).select(*samples.columns)


def best_stages_for_day(
    stages: DataFrame,
    daily: DataFrame,
    keys: Keys = SUBJECT,
    t: str = "time",
    tz_offset: float = 0,
) -> DataFrame:
    """Stages in [sleep_start, sleep_end) of each daily row, or in the overnight window
    [date - 6 h, date + 14 h) when the row has no sleep bounds. Equi-join on day buckets."""
    midnight = shift_hours(F.col("date").cast("timestamp"), -tz_offset)
    known = F.col("sleep_start").isNotNull() & F.col("sleep_end").isNotNull()
    spans = daily.select(
        *keys,
        "date",
        F.when(known, F.col("sleep_start")).otherwise(shift_hours(midnight, -6)).alias("_a"),
        F.when(known, F.col("sleep_end")).otherwise(shift_hours(midnight, 14)).alias("_b"),
    ).where(F.col("_b") > F.col("_a"))
    first = bucket(epoch_us("_a"), DAY_US)
    last = bucket(epoch_us("_b") - 1, DAY_US)
    spans = spans.withColumn("_cell", F.explode(F.sequence(first, last)))
    rows = stages.withColumn("_cell", bucket(epoch_us(t), DAY_US))
    drop_date = [c for c in stages.columns if c != "date"]
    return (
        rows.drop("date")
        .join(spans, [*keys, "_cell"])
        .where((F.col(t) >= F.col("_a")) & (F.col(t) < F.col("_b")))
        .select(*keys, "date", *[c for c in drop_date if c not in keys])
    )


def proximity_anti_join(
    a: DataFrame, b: DataFrame, t: str = "time", tolerance_seconds: int = 300, keys: Keys = SUBJECT
) -> DataFrame:
    """Rows of ``a`` with no row of ``b`` within the tolerance (both ends included).

    ``b`` is reduced to the first and last time of each tolerance-wide cell. Any b in the
    same cell is near enough; neighbours matter only by their nearest edge. The lookup side
    has one row per cell, so the join never fans out.
    """
    width = tolerance_seconds * 1_000_000
    cells = b.groupBy(*keys, bucket(epoch_us(t), width).alias("_cell")).agg(
        F.min(epoch_us(t)).alias("_lo"), F.max(epoch_us(t)).alias("_hi")
    )
    spread = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct((F.col("_cell") + 1).alias("c"), F.col("_hi").alias("before"),
                         F.lit(None).cast("long").alias("after"), F.lit(False).alias("same")),
                F.struct(F.col("_cell").alias("c"), F.lit(None).cast("long").alias("before"),
                         F.lit(None).cast("long").alias("after"), F.lit(True).alias("same")),
                F.struct((F.col("_cell") - 1).alias("c"), F.lit(None).cast("long").alias("before"),
                         F.col("_lo").alias("after"), F.lit(False).alias("same")),
            )
        ).alias("_x"),
    )
    lookup = spread.groupBy(*keys, F.col("_x.c").alias("_cell")).agg(
        F.max("_x.before").alias("_before"), F.min("_x.after").alias("_after"), F.bool_or("_x.same").alias("_same")
    )
    now = epoch_us(t)
    near = (
        F.coalesce(F.col("_same"), F.lit(False))
        | F.coalesce(now - F.col("_before") <= width, F.lit(False))
        | F.coalesce(F.col("_after") - now <= width, F.lit(False))
    )
    return (
        a.withColumn("_cell", bucket(now, width))
        .join(lookup, [*keys, "_cell"], "left")
        .where(~near)
        .select(*a.columns)
    )


def same_day_anti_join(
    a: DataFrame, b: DataFrame, t: str = "time", keys: Keys = SUBJECT, tz_offset: float = 0
) -> DataFrame:
    days = b.select(*keys, local_date(t, tz_offset).alias("_d")).distinct()
    return (
        a.withColumn("_d", local_date(t, tz_offset)).join(days, [*keys, "_d"], "left_anti").select(*a.columns)
    )


def skip_if_existing(
    new: DataFrame,
    old: DataFrame,
    preferred: Column,
    t: str = "time",
    seconds: str = "seconds",
    keys: Keys = SUBJECT,
    tz_offset: float = 0,
) -> DataFrame:
    """Drop the imported days whose [first start, last row's end) holds a preferred old row.

    Preferred rows before each bound are counted by one prefix scan over rows and bounds
    together; a day is skipped when the two counts differ.
    """
    day = local_date(t, tz_offset)
    end = seconds_after(F.col(t), F.col(seconds))
    spans = new.groupBy(*keys, day.alias("_d")).agg(
        F.min(t).alias("_a"), F.max_by(end, F.struct(F.col(t), F.col(seconds))).alias("_b")
    )
    bounds = spans.select(
        *keys,
        "_d",
        F.explode(
            F.array(
                F.struct(F.col("_a").alias("at"), F.lit(-1).alias("sign")),
                F.struct(F.col("_b").alias("at"), F.lit(1).alias("sign")),
            )
        ).alias("_x"),
    ).select(*keys, "_d", F.col("_x.at").alias("_t"), F.col("_x.sign").alias("_sign"), F.lit(0).alias("_kind"))
    marks = old.where(preferred).select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"))
    scanned = prefix_scan(
        bounds.unionByName(marks, allowMissingColumns=True),
        {"_n": ("sum", F.col("_kind"))}, keys, "_t", ["_kind"],
    )
    taken = (
        scanned.where(F.col("_kind") == 0)
        .groupBy(*keys, "_d")
        .agg(F.sum(F.col("_n") * F.col("_sign")).alias("_hits"))
        .where(F.col("_hits") > 0)
        .select(*keys, "_d")
    )
    return new.withColumn("_d", day).join(taken, [*keys, "_d"], "left_anti").select(*new.columns)


def gap_sessionize(
    df: DataFrame,
    start: str = "start",
    end: str = "end",
    gap_seconds: int = 1800,
    keys: Keys = SUBJECT,
    tie: Sequence[str] | None = None,
    out: str = "session_no",
) -> DataFrame:
    """Number sessions per key: a new one when start - previous row's end exceeds the gap.

    The previous row is the one just before by start and ``tie``, not the running latest end. Without
    ``tie`` equal starts are ordered by their end: two scans must see the same order.
    """
    tie = [end] if tie is None else tie
    prev = prefix_scan(df, {"_prev": ("prev", epoch_us(end))}, keys, start, tie)
    opens = F.when(
        F.col("_prev").isNull() | (epoch_us(start) - F.col("_prev") > gap_seconds * 1_000_000), 1
    ).otherwise(0)
    return prefix_scan(prev, {out: ("sum", opens)}, keys, start, tie).drop("_prev")


def main_session(
    sessions: DataFrame, keys: Keys = SUBJECT, duration: str = "duration_min", start: str = "start"
) -> DataFrame:
    """Longest session per (keys, date); the earliest wins a tie."""
    group = [*keys, "date"]
    rest = [c for c in sessions.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(F.col(duration), -epoch_us(start))).alias("_s")
    return sessions.groupBy(*group).agg(best).select(*group, "_s.*")


def longest_session_per_source(
    sessions: DataFrame,
    source_rank: str = "source_rank",
    keys: Keys = SUBJECT,
    start: str = "start",
    end: str = "end",
    tie: str = "row_id",
) -> DataFrame:
    """Longest session per (day, source), then the session of the highest source rank."""
    group = [*keys, "date"]
    rest = [c for c in sessions.columns if c not in group]
    order = F.struct(
        F.col(source_rank), epoch_us(end) - epoch_us(start), -F.col(tie)
    )
    # Highest rank first, then duration: one aggregate gives the longest of the best source.
    return sessions.groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*group, "_s.*")


def short_wake_flag(df: DataFrame, limit_seconds: int = 180, out: str = "is_short") -> DataFrame:
    return df.withColumn(out, (F.col("stage") == "wake") & (F.col("seconds") < limit_seconds))


def main_log_filter(
    df: DataFrame, log_id: str = "log_id", seconds: str = "seconds", keys: Keys = (*SUBJECT, "date")
) -> DataFrame:
    """Rows of the log with the most seconds per group; the smallest log id wins a tie."""
    totals = df.groupBy(*keys, log_id).agg(F.sum(seconds).alias("_n"))
    best = totals.groupBy(*keys).agg(
        F.max_by(F.col(log_id), F.struct(F.col("_n"), -F.col(log_id))).alias(log_id)
    )
    return df.join(best, [*keys, log_id], "left_semi")


def _islands(df: DataFrame, start: str, seconds: str, keys: Keys, tie: Sequence[str], abutting: bool) -> DataFrame:
    """Adds ``_reach`` (latest end so far) and ``_island`` (time of the island's first row)."""
    end = epoch_us(F.col(start)) + F.col(seconds).cast("long") * 1_000_000
    reach = prefix_scan(df, {"_reach": ("max_before", end)}, keys, start, tie)
    now = epoch_us(start)
    opens = F.col("_reach").isNull() | (now > F.col("_reach") if abutting else now >= F.col("_reach"))
    return prefix_scan(reach, {"_island": ("max", F.when(opens, now))}, keys, start, tie)


def overlap_chain_dedup(
    df: DataFrame,
    start: str = "time",
    seconds: str = "seconds",
    keys: Keys = (*SUBJECT, "date"),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Greedy pass in start order: drop a row that starts before the last kept row ends.

    The row kept after a row is the first one that starts at or after its end, which a backward scan
    finds for all rows at once. A row starting at or after every earlier end is always kept, so
    chains begin at the first row of each island of overlapping rows; they are followed by pointer
    doubling, in a number of rounds logarithmic in the longest island. No island is folded in a task.
    Rows equal in start and ``tie`` come in any order.
    """
    islands = _islands(df, start, seconds, keys, tie, abutting=False)
    rows = prefix_scan(islands, {"_pos": ("sum", F.lit(1).cast("long"))}, keys, start, tie)
    opener = F.col("_reach").isNull() | (epoch_us(start) >= F.col("_reach"))
    rows = materialized(rows.withColumn("_opens", opener).select(*df.columns, "_pos", "_opens"), "chain")
    end = epoch_us(F.col(start)) + F.col(seconds).cast("long") * 1_000_000
    before, none = F.timestamp_micros(-epoch_us(start)), F.lit(None).cast("long")
    starts = rows.select(*keys, before.alias("_t"), F.lit(0).alias("_kind"), none.alias("_pos"), (-F.col("_pos")).alias("_v"))
    ends = rows.select(*keys, F.timestamp_micros(-end).alias("_t"), F.lit(1).alias("_kind"), "_pos", none.alias("_v"))
    found = prefix_scan(starts.unionByName(ends.where("_t IS NOT NULL")), {"_next": ("max", F.col("_v"))}, keys, "_t", ["_kind"])
    following = F.greatest(-F.col("_next"), F.col("_pos") + 1)  # a row without length is followed by the next row
    onward = found.where("_kind = 1 AND _next IS NOT NULL").select(*keys, "_pos", following.alias("_next"))
    inner = rows.where("NOT _opens").select(*keys, F.col("_pos").alias("_next"))
    onward = onward.join(inner, [*keys, "_next"], "left_semi")  # openers are kept anyway
    kept = _reached(rows.where("_opens").select(*keys, "_pos"), onward, keys, "_pos")
    return rows.join(kept, [*keys, "_pos"], "left_semi").select(*df.columns)


def _reached(seeds: DataFrame, onward: DataFrame, keys: Keys, node: str) -> DataFrame:
    """All (keys, node) that ``onward`` (keys, node, _next) leads to from ``seeds``, by pointer
    doubling: after round k, those fewer than 2^k steps away are marked, and pointers span 2^k steps.
    Where a node has several successors, a pointer becomes as many rows as there are ends."""
    marked, step = seeds.distinct(), materialized(onward.distinct(), "pointers")
    while step.limit(1).count():
        more = marked.join(step, [*keys, node]).select(*keys, F.col("_next").alias(node))
        known = materialized(marked.unionByName(more).distinct(), "marked")
        ahead = step.select(*keys, F.col(node).alias("_next"), F.col("_next").alias("_far"))
        step = materialized(step.join(ahead, [*keys, "_next"]).select(*keys, node, F.col("_far").alias("_next")).distinct(), "pointers")
        marked = known
    return marked


def chain_trace(
    df: DataFrame,
    start: str = "time",
    seconds: str = "seconds",
    log_id: str = "log_id",
    keys: Keys = SUBJECT,
) -> DataFrame:
    """Rows reachable from the first row of each log by end = next start.

    A chain cannot jump a gap, so only the log's first run of touching or overlapping rows takes
    part. Its times are nodes that rows lead on from start to end; they are followed by pointer
    doubling, so no run is folded in a task.
    """
    group = [*keys, log_id]
    end = epoch_us(F.col(start)) + F.col(seconds).cast("long") * 1_000_000
    reach = prefix_scan(df, {"_reach": ("max_before", end)}, group, start, [seconds])
    gap = F.when(epoch_us(start) > F.col("_reach"), 1).otherwise(0)
    run = prefix_scan(reach, {"_gaps": ("sum", gap)}, group, start, [seconds]).where("_gaps = 0")
    run = materialized(run.withColumns({"_at": epoch_us(start), "_next": end}).select(*df.columns, "_at", "_next"), "runs")
    times = _reached(run.groupBy(*group).agg(F.min("_at").alias("_at")), run.where("_next > _at").select(*group, "_at", "_next"), group, "_at")
    return run.join(times, [*group, "_at"], "left_semi").select(*df.columns)
