"""New observations into an existing history and forecast state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.operators.cleanse import deduplicate
from stratacast.operators.scaling import usable_std
from stratacast.plans.design import Design, held_columns
from stratacast.plans.recursive import series_state
from stratacast.schemas import KEYS, ewm_name
from stratacast.sources.scratch import new_folder


def merge_observations(history: DataFrame, latest: DataFrame) -> DataFrame:
    """Union of both, a new row replacing an old one of the same series and day.

    Only the keys of `latest` meet the history, in an anti join that Spark
    broadcasts when the update is small, so a daily update does not shuffle
    the whole history.
    """
    fresh = deduplicate(latest, order_by=[c for c in latest.columns if c not in KEYS])
    kept = history.join(fresh.select(*KEYS), KEYS, "left_anti")
    return kept.unionByName(fresh)


def _after(combined: Column, base: Column, start: Column, stop: Column, first: Column, alpha: float) -> Column:
    """s advanced over values start..stop (series positions) of `combined`, s_0 = the first."""
    steps = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, first, lambda acc, i: F.lit(1.0 - alpha) * acc + F.lit(alpha) * F.element_at(combined, (i - base + 1).cast("int")))


def advance_state(state: DataFrame, fresh: DataFrame, design: Design = Design()) -> DataFrame:
    """The state of each series of `fresh` (unique_id, ds, y, and the held columns the state
    has) after rows that all come after its `last_ds`, from the state alone.

    Count, mean and sum of squared deviations of the series in its own units merge with
    those of the new rows (Chan's formulas); the tail of raw values and the smoothed
    values go on with the new ones; then z-values follow from the new mean and deviation,
    since standardising is affine and the smoothing weights sum to one.
    """
    spec = design.lag_spec
    keep = max(spec.lookback, 1)
    held = [c for c in ("last_price", *held_columns(state, design)) if c in state.columns]
    sources = {"last_price": "close"}
    wanted = [sources.get(c, c) for c in held]
    missing = [c for c in wanted if c not in fresh.columns]
    if missing:
        raise ValueError(f"the state holds {held}; new rows lack {missing}")
    rows = fresh.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"), *wanted))).alias("_new"))
    df = state.join(rows, "unique_id")
    ys = F.col("_new.y")
    k = F.size("_new")
    if design.differenced:
        before = F.concat(F.array(F.col("level").cast("double")), F.slice(ys, 1, k - 1))
        raw = F.zip_with(ys, before, lambda a, b: a - b)
    else:
        raw = ys
    df = df.withColumn("_raw", raw)
    added = F.aggregate("_raw", F.lit(0.0), lambda acc, v: acc + v)
    df = df.withColumn("_k", k.cast("long")).withColumn("_mean_new", added / F.col("_k"))
    df = df.withColumn("_m2_new", F.aggregate("_raw", F.lit(0.0), lambda acc, v: acc + (v - F.col("_mean_new")) * (v - F.col("_mean_new"))))
    n = F.col("raw_n") + F.col("_k")
    delta = F.col("_mean_new") - F.col("raw_mean")
    df = df.withColumns({
        "_n": n,
        "_mean": F.col("raw_mean") + delta * F.col("_k") / n,
        "_m2": F.col("raw_m2") + F.col("_m2_new") + delta * delta * F.col("raw_n") * F.col("_k") / n,
        "_combined": F.concat("raw_tail", "_raw"),
        "_base": F.col("raw_n") - F.size("raw_tail"),
    })
    df = df.withColumn("_std", usable_std(F.sqrt(F.col("_m2") / F.col("_n"))))
    smoothed = {}
    for lag, alpha in spec.ewm:
        name = ewm_name(lag, alpha)
        old_at, new_at = F.col("raw_n") - lag, F.col("_n") - lag
        old = F.col(name) * F.col("std") + F.col("mean")
        from_start = _after("_combined", F.col("_base"), F.lit(1), new_at, F.element_at("_combined", (1 - F.col("_base")).cast("int")), alpha)
        going_on = _after("_combined", F.col("_base"), old_at + 1, new_at, old, alpha)
        value = F.when(new_at < 0, F.lit(None)).when(old_at < 0, from_start).otherwise(going_on)
        smoothed[name] = (value - F.col("_mean")) / F.col("_std")
    tail = F.slice("_combined", F.greatest(F.size("_combined") - keep + 1, F.lit(1)), keep)
    last = F.element_at("_new", -1)
    out = df.withColumns({
        "last_ds": last["ds"], "level": last["y"], "n": F.col("_n"),
        "total": F.lit(0.0),  # z is centred on the mean of all rows
        "squares": F.col("_m2") / (F.col("_std") * F.col("_std")),
        "hist": F.transform(tail, lambda r: (r - F.col("_mean")) / F.col("_std")),
        **smoothed,
        **{c: last[sources.get(c, c)] for c in held},
        "raw_n": F.col("_n"), "raw_mean": F.col("_mean"), "raw_m2": F.col("_m2"), "raw_tail": tail,
    }).withColumns({"mean": F.col("_mean"), "std": F.col("_std")})
    return out.select(*state.columns)


def refresh_state(
    state: DataFrame | None, history: DataFrame, latest: DataFrame, design: Design = Design()
) -> DataFrame:
    """State after `latest`, with the same rows a rebuild from the merged history gives.

    Rule for what comes in: a series whose new rows all lie after its `last_ds` goes on
    from its state alone (`advance_state`); a series with a late or replaced day, or one
    that the state does not know, is rebuilt from its history merged with the new rows;
    the others are kept. Only when some series needs a rebuild is `history` read, and then
    only for those series. `history` and `latest` are (unique_id, ds, y), or panels with
    all columns that the state was made from; a state that also holds prices refuses
    bare ones. Model weights do not change.
    """
    if state is None:
        raise RuntimeError("no forecast state: fit first")
    fresh = deduplicate(latest, order_by=[c for c in latest.columns if c not in KEYS])
    ends = state.select("unique_id", "last_ds")
    flagged = fresh.join(ends, "unique_id", "left").groupBy("unique_id").agg(
        F.max(F.col("last_ds").isNull() | (F.col("ds") <= F.col("last_ds"))).alias("_rebuild"))
    # one row per touched series, written once: every branch below sees the same decision
    path = new_folder(state.sparkSession, "update-flags")
    flagged.write.parquet(path)
    flagged = state.sparkSession.read.parquet(path)
    rebuild = flagged.filter("_rebuild").select("unique_id")
    going_on = fresh.join(flagged.filter("NOT _rebuild").select("unique_id"), "unique_id", "left_semi")
    advanced = advance_state(state, going_on, design)
    kept = state.join(flagged.select("unique_id"), "unique_id", "left_anti")
    out = kept.unionByName(advanced)
    if not rebuild.isEmpty():
        affected = history.join(rebuild, "unique_id", "left_semi")
        rebuilt = series_state(merge_observations(affected, fresh.join(rebuild, "unique_id", "left_semi")), design)
        out = out.unionByName(rebuilt.select(*state.columns))
    return out
