"""Sessions, budgets, throttles and rings over event tables. Order is explicit everywhere: (time, id)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a column of timestamps without zone; the session's zone plays no part."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def _along(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def stage_durations(events: DataFrame, key: str, t: str, order: str, stage: str) -> DataFrame:
    """Events with ``ms``: how long the key stayed in the event's stage, null for its last."""
    nxt = F.lead(t).over(_along(key, t, order))
    return events.withColumn("ms", F.floor((nxt - F.col(t)) / 1000).cast("bigint"))


def stalls(durations: DataFrame, budgets: dict[str, int], stage: str, default: int) -> DataFrame:
    """Events whose stage outlived its budget (ms)."""
    budget = F.coalesce(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])[F.col(stage)], F.lit(default))
    return durations.withColumn("budget_ms", budget.cast("bigint")).where(F.col("ms") > F.col("budget_ms"))


def forward_stages(events: DataFrame, key: str, t: str, order: str, rank: str) -> DataFrame:
    """Events that move a key's stage forward; a repeat or a step back does not re-arm its watchdog."""
    before = F.max(rank).over(_along(key, t, order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(rank) > F.col("_before"))).drop("_before")


def attempts(events: DataFrame, key: str, t: str, order: str, cap: int = 3) -> DataFrame:
    """Events with ``attempt`` (1-based, all attempts count) and ``exhausted``."""
    n = F.row_number().over(_along(key, t, order))
    return events.withColumn("attempt", n).withColumn("exhausted", F.col("attempt") >= cap)


def recent(events: DataFrame, key: str, kind: str, t: str, order: str, limits: dict[str, int], value: str) -> DataFrame:
    """(key, kind, recent): the last values of each kind in order of time, as many as its limit."""
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(kind)]
    k = F.row_number().over(Window.partitionBy(key, kind).orderBy(F.col(t).desc(), F.col(order).desc()))
    kept = events.withColumn("_k", k).where(F.col("_k") <= most)
    return kept.groupBy(key, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda r: r["v"]), ",").alias("recent"))


def known_sum(usd: Column) -> Column:
    """A sum that stays unknown if any part of it is."""
    return F.when(F.count("*") == F.count(usd), F.sum(usd))


def throttle(events: DataFrame, key: str, t: str, order: str, least_gap: int) -> DataFrame:
    """(key, order) of a greedy sample of each key's events: one is kept if ``least_gap`` has passed since the last kept one.

    Which event is kept depends on all before it, so a task streams its keys in order; it holds the last kept time alone.
    """
    rows = events.select(key, order, t).repartition(key).sortWithinPartitions(key, t, order)
    schema = StructType([rows.schema[key], rows.schema[order]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, begun = None, None, False
        for b in batches:
            keep = []
            for k, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                fresh = not begun or k != now or last is None or at is not None and at - last >= least_gap
                keep.append(fresh)
                if fresh:
                    now, last, begun = k, at, True
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], schema.names)

    return rows.mapInArrow(run, schema)


def changes(events: DataFrame, key: str, t: str, order: str, state: str) -> DataFrame:
    """Events at which a key's state differs from the one before; the first always does."""
    last = F.lag(state).over(_along(key, t, order))
    return events.withColumn("previous", last).where(~F.col("previous").eqNullSafe(F.col(state)) | F.col("previous").isNull())


def debounce(events: DataFrame, key: str, t: str, order: str, gap: int) -> DataFrame:
    """(key, session, first, last, n): bursts of events closer than ``gap`` to each other."""
    w = _along(key, t, order)
    fresh = F.coalesce((F.col(t) - F.lag(t).over(w) >= gap).cast("int"), F.lit(1))
    marked = events.withColumn("_fresh", fresh)
    marked = marked.withColumn("session", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))


def ring(events: DataFrame, t: str, order: str, size: int = 200) -> DataFrame:
    """The last ``size`` events: a distributed top-k, no global sort."""
    return events.orderBy(F.col(t).desc(), F.col(order).desc()).limit(size)


def plan_stops(steps: DataFrame, plan: str, order: str, stop: Column, cap: int = 20) -> DataFrame:
    """(plan, n_steps, stop_at, n_run): the first step that ends each plan, and how many steps run."""
    idx = F.row_number().over(Window.partitionBy(plan).orderBy(order)) - 1
    rows = steps.withColumn("idx", idx.cast("bigint")).withColumn("_stop", stop)
    out = rows.groupBy(plan).agg(F.count("*").alias("n_steps"), F.min(F.when(F.col("_stop"), F.col("idx"))).alias("stop_at"))
    return out.withColumn("n_run", F.least(F.coalesce(F.col("stop_at") + 1, F.col("n_steps")), F.lit(cap).cast("bigint")))


def _null_safe(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``by``; null keys meet."""
    named = right.select(*[F.col(c).alias("_on_" + c) for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col("_on_" + c))
    return left.join(named, on).drop(*["_on_" + c for c in by])


def at_rank(values: DataFrame, value: str, rank, *by: str, bins: int = 4096) -> DataFrame:
    """(by, value): each group's value at the 0-based place ``rank(n)`` of its n values in order, null ones left out.

    Values are counted in bins of equal width first; only the bin that holds the place is ranked, so no task sorts a group.
    """
    rows = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    span = F.when(F.col("_high") > F.col("_low"), (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    binned = _null_safe(rows, ends, by).withColumn("_bin", F.least(F.floor(span * bins), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = rank(F.col("_n")).cast("bigint")
    bin_of = counts.withColumn("_k", place - before).where((F.col("_k") >= 0) & (F.col("_k") < F.col("_c"))).select(*by, "_bin", "_k")
    inside = _null_safe(binned.select(*by, "_bin", "_v"), bin_of, (*by, "_bin"))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1)
    return ranked.where("_r = _k").select(*by, F.col("_v").alias("value"))


def percentile_rounded(values: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """The element at index round_half_even(p * (n - 1)) of each group's sorted values."""
    return at_rank(values, value, lambda n: F.bround(F.lit(p) * (n - 1), 0), *by)


def percentile_nearest(values: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """The element at index ceil(p * n) - 1 of each group's sorted values, 0 at least."""
    return at_rank(values, value, lambda n: F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0)), *by)
