"""Window analytics: numbering, ranks, running and moving aggregates, sessions, gaps.

Raw rows go through ``plans.ordered`` so that no group, however large, is sorted in one
task. Series that hold one row per day or month are windowed directly: their length is
bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dwops.functions.values import amount_total, date_series, exact_avg, exact_sum, micros, money_total
from dwops.operators.relational import top_per_key
from dwops.plans.keyed import join_on_same, with_group_values
from dwops.plans.ordered import (
    all_small, chunk_rows, large_groups, ntile_from_number, previous_value, rank_values, row_frames, scan_groups, sort_columns,
)
from dwops.session import stored, stored_counted


def daily(df: DataFrame, ts: str, value: str, name: str = "revenue") -> DataFrame:
    """One row per day: date, exact total and row count."""
    return df.groupBy(F.col(ts).cast("date").alias("day")).agg(
        money_total(value).alias(name), F.count(F.lit(1)).alias("num_rows")
    )


# --- numbering and ranks ---------------------------------------------------

def row_number_by(df: DataFrame, keys: list[str], order: list[str], name: str = "row_num") -> DataFrame:
    return scan_groups(df, keys, order, number=name)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order."""
    return top_per_key(df, keys, order, 1).drop("_rn")


def dedup(df: DataFrame, keys: list[str], priority: list[str]) -> DataFrame:
    """One row per key, chosen by priority."""
    return latest_per_key(df, keys, priority)


def rank_all(df: DataFrame, keys: list[str], value: str, tail: list[str]) -> DataFrame:
    """RANK, DENSE_RANK and ROW_NUMBER by a value, numbered within ties by ``tail``."""
    small = all_small(df, keys)
    ranked = rank_values(df, keys, value, bounded=small).withColumnsRenamed({"_rank": "rank", "_dense": "dense_rank"})
    return scan_groups(ranked.drop("_upto", "_total"), keys, [value, *tail], number="row_num", bounded=small, derived=True)


def ntile_by(df: DataFrame, tiles: dict[str, int], order: list[str], keys: list[str] = ()) -> DataFrame:
    """NTILE buckets; several bucket counts share one ordering. The input is computed once."""
    df, found = stored_counted(df)
    small = found <= chunk_rows(df)
    numbered = scan_groups(df, keys, order, number="_rn", bounded=small)
    if not keys:
        sized = numbered.withColumn("_size", F.lit(found).cast("long"))
    elif small:
        sized = numbered.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        sized = with_group_values(numbered, keys, {"_size": F.count(F.lit(1))})
    cells = {name: ntile_from_number(F.col("_rn"), F.col("_size"), n) for name, n in tiles.items()}
    return sized.withColumns(cells).drop("_rn", "_size")


def percent_ranks(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """PERCENT_RANK and CUME_DIST of a value in its group."""
    ranked = rank_values(df, keys, value)
    rest = F.col("_total") - 1
    share = F.when(rest == 0, 0.0).otherwise((F.col("_rank") - 1) / F.greatest(rest, F.lit(1)))
    return (
        ranked.withColumn("pct_rank", share)
        .withColumn("cume_dist", F.col("_upto") / F.col("_total"))
        .drop("_rank", "_dense", "_upto", "_total")
    )


def category_rank(df: DataFrame, category: str, value: str) -> DataFrame:
    """RANK within a category and PERCENT_RANK over everything, both by descending value."""
    df, found = stored_counted(df)
    small = found <= chunk_rows(df)
    inside = rank_values(df, [category], f"-{value}", bounded=small).withColumnRenamed("_rank", "category_rank").drop("_dense", "_upto", "_total")
    overall = rank_values(inside if small else stored(inside), [], f"-{value}", bounded=small)
    share = (F.col("_rank") - 1) / F.greatest(F.col("_total") - 1, F.lit(1))
    return overall.withColumn("overall_percentile", share).drop("_rank", "_dense", "_upto", "_total")


# --- running and moving aggregates -----------------------------------------

# Microseconds per unit.
DURATIONS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def running(df: DataFrame, value: Column, order: list[str], keys: list[str] = (), frame: str = "rows",
            name: str = "running_total", rows: int | None = None) -> DataFrame:
    """Running total. ``rows`` counts row by row; ``range`` gives peers the same total.

    For ``range`` with a large group, the peers are summed first and the totals joined
    back to their rows.
    """
    if frame == "rows":
        return scan_groups(df, keys, order, sums={name: value}, rows=rows)
    kind = df.agg(F.sum(value)).schema[0].dataType
    if large_groups(df, keys, rows or chunk_rows(df)).isEmpty():
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*sort_columns(order))))
    peers = [*keys, *[o.lstrip("-") for o in order]]
    sums = df.groupBy(*peers).agg(F.sum(value).alias("_peer_sum"))
    totals = scan_groups(sums, keys, order, sums={name: F.col("_peer_sum")}, rows=rows, derived=True).drop("_peer_sum")
    totals = totals.withColumn(name, F.col(name).cast(kind))
    return join_on_same(df, totals, peers, "left")


def moving_rows(df: DataFrame, order: list[str], before: int, after: int, columns: dict[str, Column],
                keys: list[str] = (), **remarks: bool) -> DataFrame:
    """Aggregates over the last ``before`` and next ``after`` rows."""
    frames = {n: (lambda w, c=c: c.over(w.rowsBetween(-before, after))) for n, c in columns.items()}
    return row_frames(df, keys, order, before, after, frames, **remarks)


# Rows per group up to which each frame is simply summed row by row.
FRAME_ROWS = 10_000


def _interval_spans(timed: DataFrame, keys: list[str], back: int, ahead: int, sums: dict[str, Column]) -> DataFrame:
    """Interval sums per span of time; a row at ``_t`` is in the frames of ``_t - ahead`` to ``_t + back``."""
    width = back + ahead + 1
    span = lambda shift: F.expr(f"(_t + ({shift}) - pmod(_t + ({shift}), {width}L)) div {width}L")
    reached = F.coalesce(F.sequence(span(-ahead), span(back)), F.array(F.lit(None).cast("long")))
    copies = timed.withColumn("_home", span(0)).withColumn("_span", F.explode(reached))
    w = Window.partitionBy(*keys, "_span").orderBy("_t").rangeBetween(-back, ahead)
    summed = copies.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    return summed.where(F.col("_span").eqNullSafe(F.col("_home"))).drop("_span", "_home")


def moving_interval(df: DataFrame, ts: str, before: str, after: str, sums: dict[str, Column],
                    keys: list[str] = (), rows: int = FRAME_ROWS, bounded: bool = False) -> DataFrame:
    """Sums over a time interval around each row, e.g. ``7 days`` back.

    In groups beyond ``rows`` rows a frame may hold very many of them. There, sums of whole
    numbers and decimals are taken as differences of running sums: each distinct time of a
    group asks for the running sum where its frame ends and just before it starts.
    Differences of double sums would lose digits; these groups are cut into spans of time
    at least as long as a frame, and each row is copied to the neighbouring span whose
    frames reach it. Count with a sum of 1.
    """
    keys = list(keys)
    back, ahead = (int(n) * DURATIONS[unit.rstrip("s")] for n, unit in (before.split(), after.split()))
    timed = df.withColumn("_t", micros(ts))
    if bounded or large_groups(timed, keys, rows).isEmpty():
        w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-back, ahead)
        return timed.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).drop("_t")
    names = list(sums)
    kinds = timed.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).schema
    if any(isinstance(k.dataType, T.DoubleType) for k in kinds):
        return _interval_spans(timed, keys, back, ahead, sums).drop("_t")
    # A NULL sum means no value in the frame; counting values keeps that apart from 0.
    parts = {f"_s{i}": F.coalesce(F.sum(c), F.lit(0)) for i, c in enumerate(sums.values())}
    parts |= {f"_n{i}": F.count(c) for i, c in enumerate(sums.values())}
    times = timed.groupBy(*keys, "_t").agg(*[c.alias(n) for n, c in parts.items()])
    nothing = [F.lit(0).cast(times.schema[n].dataType).alias(n) for n in parts]
    # At equal times: a frame's start (0) comes before the rows (1), its end (2) after them.
    starts = times.select(*keys, (F.col("_t") - back).alias("_at"), F.lit(0).alias("_kind"), *nothing)
    values = times.select(*keys, F.col("_t").alias("_at"), F.lit(1).alias("_kind"), *parts)
    ends = times.select(*keys, (F.col("_t") + ahead).alias("_at"), F.lit(2).alias("_kind"), *nothing)
    line = scan_groups(starts.unionByName(values).unionByName(ends), keys, ["_at", "_kind"],
                       sums={f"_run{n}": F.col(n) for n in parts}, derived=True)
    home = F.when(F.col("_kind") == 0, F.col("_at") + back).otherwise(F.col("_at") - ahead)
    sign = F.when(F.col("_kind") == 0, F.lit(-1)).otherwise(F.lit(1))
    asked = line.where("_kind <> 1").groupBy(*keys, home.alias("_t")).agg(
        *[F.sum(sign * F.col(f"_run{n}")).alias(n) for n in parts]
    )
    per_time = asked.select(*keys, "_t", *[F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}")).cast(kinds[n].dataType).alias(n) for i, n in enumerate(names)])
    return join_on_same(timed, per_time, [*keys, "_t"], "left").drop("_t")


# Aggregates of an interval frame: the parts kept of it, each with how two parts are put together.
FRAME_PARTS = {"sum": ["sum"], "count": ["count"], "avg": ["sum", "count"], "min": ["min"], "max": ["max"]}
_OF_ROWS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_OF_PARTS = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def interval_frames(df: DataFrame, ts: str, before: str, after: str, columns: dict[str, tuple[str, Column]],
                    keys: list[str] = (), rows: int | None = None) -> DataFrame:
    """Aggregates over a time interval around each row: name -> (sum, count, avg, min or max; of what).

    Time is cut into blocks as long as a frame, so a frame is the end of one block and the
    beginning of the next. Running aggregates forward and backward within the blocks give both
    parts, and every frame is put together from two of them, however many rows it holds. Rows of
    one time are summed up first. Blocks too large for a task are cut in chunks like any group.
    Nothing is subtracted, so sums of doubles lose no digits to other frames.

    As in SQL, NULL values are not counted, a frame without values has a NULL sum, and rows
    without a time are one another's frame.
    """
    keys = list(keys)
    unknown = {fn for fn, _ in columns.values()} - set(FRAME_PARTS)
    if unknown:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    back, ahead = (int(n) * DURATIONS[unit.rstrip("s")] for n, unit in (before.split(), after.split()))
    width = back + ahead + 1
    timed = df.withColumn("_t", micros(ts))
    parts = {f"_{part}{i}": (part, value) for i, (fn, value) in enumerate(columns.values()) for part in FRAME_PARTS[fn]}
    times = stored(timed.groupBy(*keys, "_t").agg(*[_OF_ROWS[part](value).alias(n) for n, (part, value) in parts.items()]))
    kinds = {n: times.schema[n].dataType for n in parts}

    def scanned(asked: DataFrame, kind: int, order: list[str]) -> DataFrame:
        """Running parts at the asked places; rows of one place come before (kind 2) or after (0) the asking one."""
        place = lambda df, at, kind: df.withColumns({"_at": at, "_kind": F.lit(kind)}).withColumn("_block", F.expr(f"(_at - pmod(_at, {width}L)) div {width}L"))
        values = place(times.where("_t is not null"), F.col("_t"), 1)
        nothing = asked.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})
        shift = ahead if kind == 2 else -back
        line = values.unionByName(place(nothing, F.col("_t") + shift, kind))
        runs = {how: {f"_run{n}": F.col(n) for n, (part, _) in parts.items() if part in of} for how, of in
                (("sums", ("sum", "count")), ("lowest", ("min",)), ("highest", ("max",)))}
        line = scan_groups(line, [*keys, "_block"], order, rows=rows, derived=True, **runs)
        return line.where(F.col("_kind") == kind).select(*keys, "_t", *[F.col(f"_run{n}").alias(n) for n in parts])

    asked = times.where("_t is not null").select(*keys, "_t")
    ends = scanned(asked, 0, ["-_at", "-_kind"])
    # A frame that starts where a block starts is that whole block, which its first part covers.
    starts = scanned(asked.where(F.expr(f"pmod(_t - {back}L, {width}L) <> 0")), 2, ["_at", "_kind"])
    # A row without a time has only the rows of its own group and no time.
    alone = times.where("_t is null").select(*keys, "_t", *parts)
    frames = ends.unionByName(starts).unionByName(alone).groupBy(*keys, "_t").agg(*[_OF_PARTS[part](n).alias(n) for n, (part, _) in parts.items()])
    out = {}
    for i, (name, (fn, value)) in enumerate(columns.items()):
        if fn == "avg":
            out[name] = F.col(f"_sum{i}").cast("double") / F.nullif(F.col(f"_count{i}"), F.lit(0).cast("long"))
        else:
            got = F.col(f"_{fn}{i}")
            out[name] = F.coalesce(got, F.lit(0).cast("long")) if fn == "count" else got.cast(kinds[f"_{fn}{i}"])
    per_time = frames.select(*keys, "_t", *[c.alias(n) for n, c in out.items()])
    return join_on_same(timed, per_time, [*keys, "_t"], "left").drop("_t")


def partition_share(df: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """Mean of the group and share of the group's total, on every row; exact for ``digits`` decimals."""
    sized = with_group_values(df, keys, {"group_avg": exact_avg(value, digits), "_sum": exact_sum(value, digits)})
    return sized.withColumn("pct_of_total", F.col(value) / F.nullif(F.col("_sum"), F.lit(0.0))).drop("_sum")


def period_total(df: DataFrame, period: Column, value: str, name: str, digits: int | None = None) -> DataFrame:
    """Total of the derived period each row falls into, as in ``amount_total``."""
    return with_group_values(df.withColumn("period", period), ["period"], {name: amount_total(value, digits).cast("double")})


def lag_lead(df: DataFrame, value: str, order: list[str], keys: list[str] = (), n: int = 1, **remarks: bool) -> DataFrame:
    """Value ``n`` rows before and after, and the change against the one before."""
    out = row_frames(df, keys, order, n, n, {
        "previous_value": lambda w: F.lag(value, n).over(w),
        "next_value": lambda w: F.lead(value, n).over(w),
    }, **remarks)
    return out.withColumn("change", F.col(value) - F.col("previous_value"))


def yoy_lag(df: DataFrame, month: str, value: str, n: int = 12) -> DataFrame:
    """Value ``n`` months earlier. ``df`` has one row per month; missing months are filled
    in first so that the row ``n`` back is the month ``n`` back."""
    bounds = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    months = bounds.select(F.explode(date_series("lo", "hi", "1 month")).alias(month))
    w = Window.partitionBy().orderBy(month)
    full = months.join(df, month, "left")
    return full.withColumn("previous_value", F.lag(value, n).over(w))


# --- gaps and sessions -----------------------------------------------------

def time_gaps(df: DataFrame, ts: str, keys: list[str], min_days: int, tail: list[str]) -> DataFrame:
    """Rows that come more than ``min_days`` days after the one before."""
    seen = previous_value(df, keys, [ts, *tail], {"prev_date": F.col(ts)})
    return seen.withColumn("days_since_last", F.date_diff(ts, "prev_date").cast("long")).where(
        F.col("days_since_last") > min_days
    )


def sessionize(df: DataFrame, key: str, ts: str, tail: list[str], gap_minutes: int = 30) -> DataFrame:
    """Minutes since the user's previous action, new-session flag and session number.

    A user's first action has no previous one: flag 0, session 0.
    """
    small = all_small(df, [key])
    seen = previous_value(df, [key], [ts, *tail], {"prev_action": F.col(ts)}, bounded=small)
    seconds = (micros(ts) - micros("prev_action")) / F.lit(1_000_000.0)
    flagged = seen.withColumn("minutes_since_last", seconds / 60).withColumn(
        "new_session", F.when(F.col("minutes_since_last") > gap_minutes, F.lit(1)).otherwise(0).cast("long")
    )
    return scan_groups(flagged, [key], [ts, *tail], sums={"session_id": F.col("new_session")}, bounded=small, derived=True)


def sequence_gaps(df: DataFrame, key: str) -> DataFrame:
    """Holes in an integer sequence: the id before, the id after and the missing count.

    The next greater id is found by looking one row ahead among the distinct ids.
    """
    ids = df.select(F.col(key).alias("current_id")).where(F.col(key).isNotNull()).distinct()
    ahead = row_frames(ids, [], ["current_id"], 0, 1, {"next_id": lambda w: F.lead("current_id").over(w)}, derived=True)
    return ahead.withColumn("gap_size", F.col("next_id") - F.col("current_id") - 1).where("gap_size > 0")


def fill_dates(df: DataFrame, day: str, value: str, before: int = 6, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """One row per calendar day with the value (0 when missing) and the mean of the
    present values among the last ``before + 1`` days.

    The calendar runs from the first to the last day of the data, or from ``lo`` to ``hi``.
    ``df`` has one row per day, as has the calendar, so the window is short.
    """
    edge = lambda given, found: F.lit(given).cast("date") if given else found(F.col(day).cast("date"))
    bounds = df.agg(edge(lo, F.min).alias("lo"), edge(hi, F.max).alias("hi"))
    days = bounds.select(F.explode(date_series("lo", "hi")).alias(day))
    w = Window.partitionBy().orderBy(day).rowsBetween(-before, 0)
    mean = F.sum(value).over(w).cast("double") / F.count(value).over(w)
    joined = days.join(df.select(day, value), day, "left").withColumn("ma_7day", mean)
    return joined.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))


# --- first, last, nth, filtered --------------------------------------------

def first_last(df: DataFrame, value: str, order: list[str], keys: list[str]) -> DataFrame:
    """First and last value of the group on every row, and the change since the first.

    Taken by MIN_BY / MAX_BY, which combine on the map side.
    """
    place = F.struct(*order)
    ends = {"initial_value": F.min_by(value, place), "current_value": F.max_by(value, place)}
    out = with_group_values(df, keys, ends)
    return out.withColumn("change_from_start", F.col(value) - F.col("initial_value"))


def nth_value_by(df: DataFrame, value: str, n: int, order: list[str], keys: list[str], name: str) -> DataFrame:
    """The group's ``n``-th value on every row, NULL in shorter groups."""
    nth = top_per_key(df.select(*keys, value, *[o.lstrip("-") for o in order if o.lstrip("-") not in (*keys, value)]),
                      keys, order, n)
    picked = nth.where(F.col("_rn") == n).select(*keys, F.col(value).alias(name))
    return join_on_same(df, picked, keys, "left")


def filtered_running(df: DataFrame, condition: Column, value: Column, order: list[str], keys: list[str], name: str) -> DataFrame:
    """SUM(value) FILTER (WHERE condition) running per group; NULL until a row qualifies."""
    return running(df, F.when(condition, value), order, keys, "range", name)


def filtered_totals(df: DataFrame, keys: list[str], aggs: dict[str, tuple[Column, Column | None, str]]) -> DataFrame:
    """COUNT / AVG over the rows of the group that meet a condition, on every row."""
    columns = {}
    for name, (condition, value, kind) in aggs.items():
        if kind == "count":
            columns[name] = F.count_if(condition)
        else:
            kept = F.when(condition, value)
            columns[name] = F.sum(kept).cast("double") / F.nullif(F.count(kept), F.lit(0))
    return with_group_values(df, keys, columns)

