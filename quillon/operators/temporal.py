"""Time alignment, gaps and weather rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_asof(left: DataFrame, right: DataFrame, by: str, on: str, carry: str) -> DataFrame:
    """Each left row with the nearest right time, before or after (ties: the earlier), and signed hours.

    Both sides go through a window in either direction; each takes the last right time
    seen so far, so a key costs two sorts and linear time, however many rows it has.
    """
    a = left.withColumn("_side", F.lit(0)).withColumn("_at", F.lit(None).cast("timestamp"))
    b = right.select(by, on).distinct().withColumn("_side", F.lit(1)).withColumn("_at", F.col(on))
    rows = a.unionByName(b, allowMissingColumns=True)
    seen = lambda *order: F.last("_at", ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_b", seen(on, F.desc("_side"))).withColumn("_f", seen(F.desc(on), F.desc("_side"))).where("_side = 0")
    gap = lambda c: F.abs(F.unix_micros(F.col(on)) - F.unix_micros(F.col(c)))
    pick = F.when(F.col("_f").isNull() | (gap("_b") <= gap("_f")), F.col("_b")).otherwise(F.col("_f"))
    out = rows.withColumn(carry, F.coalesce(pick, "_b", "_f")).drop("_b", "_f", "_at", "_side")
    return out.withColumn("diff_hours", (F.unix_micros(F.col(on)) - F.unix_micros(F.col(carry))) / F.lit(3.6e9))


def asof_position(track: DataFrame, ticks: DataFrame, by: str, end: str, tick: str) -> DataFrame:
    """How many of a key's ends lie at or before each tick; a running count over both, in one sort."""
    a = track.select(by, F.col(end).alias("_t"), F.lit(1).alias("_one"), F.lit(None).cast("timestamp").alias(tick))
    b = ticks.select(by, F.col(tick).alias("_t"), F.lit(0).alias("_one"), tick)
    order = Window.partitionBy(by).orderBy("_t", F.desc("_one")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("position", F.sum("_one").over(order)).where("_one = 0").select(by, tick, "position")


def segments(track: DataFrame, by: str, order: str, counter: str, place: list[str]) -> DataFrame:
    """(by, start and end of order, start places, end places) of neighbours without a gap of the counter.

    A row after a gap (or the first one) is no end and no start, as the source does: a
    segment needs two rows in a row that each follow their predecessor by one.
    """
    w = Window.partitionBy(by).orderBy(order)
    step = F.col(counter) - F.lag(counter).over(w)
    ok = F.coalesce(step == 1, F.lit(False))
    for p in place:
        ok = ok & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    rows = track.withColumn("_ok", ok)
    before = [F.lag(c).over(w).alias(f"start_{c}") for c in (order, *place)]
    out = rows.select(by, "_ok", F.lag("_ok").over(w).alias("_before"), *before, *(F.col(c).alias(f"end_{c}") for c in (order, *place)))
    return out.where("_ok and _before").drop("_ok", "_before")


def gaps(rows: DataFrame, by: str, on: str, tie: str) -> DataFrame:
    """Hours since the previous row of the key."""
    before = F.lag(on).over(Window.partitionBy(by).orderBy(on, tie))
    return rows.withColumn("gap_hours", (F.unix_micros(F.col(on)) - F.unix_micros(before)) / F.lit(3.6e9))


SCALED = ["temp", "dew", "pressure", "wind", "precip_1h", "precip_6h"]


def prepare_weather(rows: DataFrame, scaled: list[str] = SCALED) -> DataFrame:
    """-9999 to null; trace (-1) flagged and null; wind from 0 is null, from 360 is 0; tenths to units."""
    numbers = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "double") and c in {*scaled, "wind_dir", "sky"}]
    out = rows.withColumns({c: F.when(F.col(c) != -9999, F.col(c)) for c in numbers})
    for hours in ("1h", "6h"):
        trace = F.coalesce(F.col(f"precip_{hours}") == -1, F.lit(False))
        out = out.withColumn(f"trace_{hours}", trace).withColumn(f"precip_{hours}", F.when(~trace, F.col(f"precip_{hours}")))
    out = out.withColumn("wind_dir", F.when(F.col("wind_dir") == 360, 0).when(F.col("wind_dir") != 0, F.col("wind_dir")))
    return out.withColumns({c: F.col(c) / F.lit(10.0) for c in scaled if c in rows.columns})


def weather_cases() -> dict[str, Column]:
    """The overlapping cases as flags; missing rain counts as dry, a case with missing input is false."""
    t, rain, sky = F.col("temp"), F.col("precip_1h"), F.col("sky").isin(2, 3, 4)
    mild = t.between(15, 25) & (F.coalesce(rain, F.lit(0.0)) == 0)
    calm = (F.col("wind") > 0) & (F.col("wind") <= 2)
    cases = {
        "perfect": mild & calm & sky,
        "not_sure": mild & (calm | F.col("wind").isNull()) & (sky | F.col("sky").isNull()),
        "too_cold": t <= 15, "too_hot": t >= 25, "rain": rain > 0,
    }
    return {name: F.coalesce(c, F.lit(False)) for name, c in cases.items()}


def humidity(temp: str, dew: str) -> tuple[Column, Column]:
    """relative humidity (0-100) from the Magnus formula, and Stull's wet-bulb temperature (fixed values)."""
    e = lambda c: 6.1094 * F.exp(17.625 * F.col(c) / (243.04 + F.col(c)))
    rh = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * e(dew) / e(temp)))
    t = F.col(temp)
    wet = t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035
    return rh, wet


def best_epoch(log: DataFrame) -> DataFrame:
    """The metric at the least loss of each run, the first epoch on ties, nulls ignored."""
    ok = log.where(F.col("loss").isNotNull() & ~F.isnan("loss"))
    return ok.groupBy("run").agg(F.min(F.struct("loss", "epoch", "metric")).alias("b")).select("run", "b.epoch", "b.loss", "b.metric")


def running_best(log: DataFrame) -> DataFrame:
    """Least loss so far."""
    return log.withColumn("best", F.min("loss").over(Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)))


def early_stop(log: DataFrame, patience: int, min_delta: float, mode: str = "min") -> DataFrame:
    """Epoch at which each run stops, null if it never does; ``mode`` max stops when a score no longer grows.

    A fold in epoch order: a run's (epoch, loss) pairs are one row's array.
    """
    sign = -1 if mode == "max" else 1
    steps = F.array_sort(F.collect_list(F.struct("epoch", (sign * F.col("loss")).alias("loss"))))
    start = F.expr("named_struct('best', cast(null as double), 'wait', 0, 'stop', cast(null as bigint))")
    packed = log.groupBy("run").agg(steps.alias("s")).withColumn("z", start)
    fold = F.expr(
        f"""aggregate(s, z, (a, x) -> case when a.stop is not null then a
        when a.best is null or a.best - x.loss > cast({min_delta} as double) then named_struct('best', x.loss, 'wait', 0, 'stop', cast(null as bigint))
        when a.wait + 1 >= {patience} then named_struct('best', a.best, 'wait', a.wait + 1, 'stop', cast(x.epoch as bigint))
        else named_struct('best', a.best, 'wait', a.wait + 1, 'stop', cast(null as bigint)) end)"""
    )
    return packed.select("run", fold.getField("stop").alias("stop_epoch"))
