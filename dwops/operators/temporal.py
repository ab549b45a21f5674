"""Versioned dimensions and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dwops.functions.values import all_of, any_of, micros
from dwops.plans.keyed import APART, apart, once_per_key
from dwops.plans.ordered import all_small, chunk_rows, row_frames, scan_groups
from dwops.session import stored, stored_counted

OPEN_END = "9999-12-31"


def open_ended(c: str | Column) -> Column:
    """End of a version; NULL means still valid."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(value, F.lit(OPEN_END).cast("date"))


def asof_join(fact: DataFrame, dim: DataFrame, key: str, ts: str, valid_from: str, valid_to: str,
              attributes: list[str]) -> DataFrame:
    """Each fact with the version valid at its time (``from <= ts < to``, open end far away).

    ``dim`` holds non-overlapping versions per key. Facts and versions are laid on one
    time line per key and the latest version so far is carried along, so a fact never
    meets all versions of its key, as it would in a join on the key alone. Times are
    compared to the instant; a date stands for its midnight. Facts of one key and time
    are told apart by a hash of their values, so that they need not share a chunk.
    """
    instant = lambda c: F.col(c).cast("timestamp_ntz").alias("_t")
    hashed = [f.name for f in fact.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    version = F.struct(*attributes, valid_from, valid_to)
    versions = dim.select(F.col(key).alias("_key"), instant(valid_from), F.lit(0).alias("_kind"),
                          F.lit(0).cast("long").alias("_tie"), version.alias("_version"), F.lit(None).cast(fact.schema).alias("_fact"))
    facts = fact.select(F.col(key).alias("_key"), instant(ts), F.lit(1).alias("_kind"), F.xxhash64(*hashed).alias("_tie"),
                        F.lit(None).cast(versions.schema["_version"].dataType).alias("_version"),
                        F.struct(*fact.columns).alias("_fact"))
    line = scan_groups(versions.unionByName(facts), ["_key"], ["_t", "_kind", "_tie"],
                       last={"_seen": F.col("_version")}, derived=True)
    met = line.where((F.col("_kind") == 1) & F.col("_seen").isNotNull() & (F.col("_t") < open_ended(F.col(f"_seen.{valid_to}"))))
    return met.select("_fact.*", "_seen.*")


def overlap_conflicts(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows whose interval ``[start, end)`` overlaps others of the same key, with how many.

    Two rows overlap when each starts before the other ends. Others that overlap = those
    started before this one ends, minus those ended by its start, minus itself. An empty
    interval (``start = end``) does not start before its own end, so for an empty row those
    at the same point are not among the first and are left out of the second. All counts
    are running sums over the key's distinct points in time, so no pairs are formed.
    """
    empty = (F.col(start) == F.col(end)).cast("int")
    point = lambda c, s, e: df.select(
        F.col(key), F.col(c).alias("_t"), F.lit(s).alias("_s"), F.lit(e).alias("_e"), (F.lit(s) * empty).alias("_z"))
    points = (
        point(start, 1, 0).unionByName(point(end, 0, 1)).groupBy(key, "_t")
        .agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"), F.sum("_z").alias("_z"))
    )
    line = scan_groups(points, [key], ["_t"], sums={"_started": F.col("_s"), "_ended": F.col("_e")}, derived=True)
    started = line.select(key, F.col("_t").alias(end), (F.col("_started") - F.col("_s")).alias("_started_before"))
    ended = line.select(key, F.col("_t").alias(start), F.col("_ended").alias("_ended_by"), F.col("_z").alias("_empty_here"))
    counted = df.join(started, [key, end]).join(ended, [key, start])
    own = F.when(F.col(start) == F.col(end), F.col("_empty_here")).otherwise(F.lit(-1))
    conflicts = F.col("_started_before") - F.col("_ended_by") + own
    return counted.withColumn("conflicts", conflicts).where("conflicts > 0").select(*df.columns, "conflicts")


def overlap_pairs(df: DataFrame, key: str, start: str, end: str, row_id: str) -> DataFrame:
    """The conflicting pairs of an exclusion constraint: rows of one key whose intervals ``[start, end)`` overlap.

    Returns (key, first_id, second_id, overlap_start, overlap_end), a pair once with the smaller id first.

    Intervals of like length form a level, and time is cut into buckets as wide as a level's
    intervals at most are long, so an interval covers two buckets of its own level or of a
    coarser one. A pair is looked for at the coarser level of the two, by an equality join on key,
    level and bucket, and is reported in the first bucket both cover. A busy key is spread over its buckets, a
    year-long interval costs no more rows than a short one, and levels are few: at most one
    per doubling of the length, of which the driver sees the numbers. NULL keys, ids and ends match nothing.
    """
    complete = all_of([F.col(c).isNotNull() for c in (key, start, end, row_id)])
    timed = df.where(complete).select(
        F.col(key).alias("_key"), F.col(row_id).alias("_id"), F.col(start).alias("_from"), F.col(end).alias("_to"), micros(start).alias("_s"), micros(end).alias("_e"))
    length = F.greatest(F.col("_e") - F.col("_s"), F.lit(1).cast("long"))
    # Wide enough whatever the logarithm rounds to.
    timed = timed.withColumn("_level", F.ceil(F.log2(length)).cast("int") + 1)
    levels = sorted(r[0] for r in timed.select("_level").distinct().collect())
    if not levels:
        levels = [0]

    def buckets(level: str) -> dict[str, Column]:
        # The last instant inside; an empty interval covers the bucket of its point.
        return {"_first": F.expr(f"shiftright(_s, {level})"), "_last": F.expr(f"shiftright(greatest(_e - 1, _s), {level})")}

    own = timed.withColumns(buckets("_level"))
    reach = timed.withColumnRenamed("_level", "_own").withColumn("_level", F.explode(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("_own"))))
    side = lambda df, name: df.withColumn("_bucket", F.explode(F.sequence("_first", "_last"))).select(
        F.col("_key"), "_level", "_bucket", F.struct(*[c for c in df.columns if c not in ("_key", "_level")]).alias(name))
    coarse, other = side(own, "a"), side(reach.withColumns(buckets("_level")), "b")
    met = coarse.join(other, ["_key", "_level", "_bucket"]).where("a._from < b._to and b._from < a._to and _bucket = greatest(a._first, b._first)")
    # Of one level, both orders meet; of two, only this one.
    met = met.where((F.col("b._own") < F.col("_level")) & (F.col("a._id") != F.col("b._id")) | (F.col("b._own") == F.col("_level")) & (F.col("a._id") < F.col("b._id")))
    return met.select(F.col("_key").alias(key), F.least("a._id", "b._id").alias("first_id"), F.greatest("a._id", "b._id").alias("second_id"),
                      F.greatest("a._from", "b._from").alias("overlap_start"), F.least("a._to", "b._to").alias("overlap_end"))


def scd2_from_changes(df: DataFrame, key: str, ts: str, columns: list[str], tail: str) -> DataFrame:
    """Version history from a change log: ``valid_from``, ``valid_to``, ``is_current``.

    ``valid_from`` keeps the type of ``ts``, so every instant counts (pass a date for one
    version a day). Of several entries at one instant the last by ``tail`` wins, entries
    repeating the state before them are dropped, and a version ends where the next begins.
    """
    state = F.struct(*columns)
    entries, found = stored_counted(df.groupBy(key, F.col(ts).alias("valid_from")).agg(F.max_by(state, F.col(tail)).alias("_state")))
    # One look at the sizes: the second step has the same groups, or fewer rows of them.
    small = found <= chunk_rows(df) or all_small(entries, [key])
    seen = row_frames(entries, [key], ["valid_from"], 1, 0, {"_before": lambda w: F.lag("_state").over(w)}, bounded=small)
    # A first state whose attributes are all NULL is a version too.
    changed = seen.where(F.col("_before").isNull() | ~F.col("_state").eqNullSafe(F.col("_before"))).drop("_before")
    closed = row_frames(changed, [key], ["valid_from"], 0, 1, {"valid_to": lambda w: F.lead("valid_from").over(w)}, bounded=small, derived=True)
    return closed.select(key, "_state.*", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def scd2_current(dim: DataFrame, is_current: str = "is_current") -> DataFrame:
    return dim.where(F.col(is_current))


def scd2_at(dim: DataFrame, day: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """The version valid on a day."""
    when = F.lit(day).cast("date")
    return dim.where((F.col(valid_from) <= when) & (when < open_ended(valid_to)))


def _same(columns: list[str], old: str, new: str) -> Column:
    return ~any_of([~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns])


def scd2_apply(dim: DataFrame, stage: DataFrame, key: str, columns: list[str], ts: str,
               close_missing: bool = False, surrogate: str | None = None) -> DataFrame:
    """Next state of a version table with ``valid_from``, ``valid_to`` and ``is_current``.

    A key whose tracked ``columns`` changed gets its current version closed at ``ts`` and a new
    one opened, an unknown key a first version. Keys missing from the stage stay open, or are
    closed with ``close_missing`` (a full snapshot). All columns of the dimension are carried:
    untracked ones keep their values in the versions there are, and a new version takes them
    from the stage, or from the version before where the stage has no such column. New
    versions are numbered on from the highest ``surrogate`` key, in order of their key. A key
    staged twice fails the job; rows without a key match nothing and open a version each.
    """
    when = F.lit(ts).cast("date")
    fields, types = dim.columns, dim.schema
    fixed = {"valid_from": when, "valid_to": F.lit(None), "is_current": F.lit(True)}
    history = dim.where(~F.col("is_current"))
    old_rows = dim.where("is_current")
    current = old_rows.select(F.col(key).alias("_k"), apart(old_rows, [key]), F.struct(*fields).alias("_old"))
    staged = once_per_key(stage.withColumn("_k", F.col(key)), ["_k"], "_new")
    both = current.join(staged, ["_k", APART], "full")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    keep = is_old & (is_new & _same(columns, "_old", "_new") | ~is_new & F.lit(not close_missing))
    row = lambda values: F.struct(*[values[f].cast(types[f].dataType).alias(f) for f in fields])
    old_values = {f: F.col(f"_old.{f}") for f in fields}
    new_values = {f: F.col(f"_new.{f}") if f in stage.columns else F.col(f"_old.{f}") for f in fields} | fixed
    if surrogate:
        new_values[surrogate] = F.lit(None)
    closed = row(old_values | {"valid_to": when, "is_current": F.lit(False)})
    rows = F.array(F.when(keep, row(old_values)), F.when(is_old & ~keep, closed), F.when(is_new & ~keep, row(new_values)))
    moved = both.select(F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("_i", "_r"), (is_new & ~keep).alias("_opens")).select(
        "_r.*", (F.col("_opens") & F.col("_r.is_current")).alias("_opened"))
    if not surrogate:
        return history.unionByName(moved.drop("_opened"))
    moved = stored(moved)
    top = dim.agg(F.coalesce(F.max(surrogate), F.lit(0)).cast("long").alias("top")).scalar()
    numbered = scan_groups(moved.where("_opened"), [], [key], number="_n").withColumn(surrogate, (top + F.col("_n")).cast(types[surrogate].dataType))
    return history.unionByName(moved.where("not _opened").drop("_opened")).unionByName(numbered.select(*fields))


def scd3_apply(dim: DataFrame, stage: DataFrame, key: str, column: str) -> DataFrame:
    """Overwrite one attribute, keeping the value it replaces in ``previous_<column>``.

    A key staged twice fails the job; keys the dimension does not have, and NULL ones, change nothing.
    """
    new = once_per_key(stage.where(F.col(key).isNotNull()).select(key, column), [key], "_new").drop(APART)
    joined = dim.join(new, key, "left")
    changed = F.col("_new").isNotNull() & ~F.col(column).eqNullSafe(F.col(f"_new.{column}"))
    previous = f"previous_{column}"
    kept = F.col(previous) if previous in dim.columns else F.lit(None).cast(dim.schema[column].dataType)
    return (
        joined.withColumn(previous, F.when(changed, F.col(column)).otherwise(kept))
        .withColumn(column, F.when(changed, F.col(f"_new.{column}")).otherwise(F.col(column)))
        .drop("_new")
    )


def version_table(history: DataFrame, snapshot: DataFrame, key: str, ts: str) -> DataFrame:
    """System-versioned table: every column tracked, rows missing from the snapshot closed."""
    columns = [c for c in snapshot.columns if c != key]
    return scd2_apply(history, snapshot, key, columns, ts, close_missing=True)


def first_versions(df: DataFrame, ts: str) -> DataFrame:
    """A snapshot as the opening state of a version table."""
    return df.withColumns({
        "valid_from": F.lit(ts).cast("date"), "valid_to": F.lit(None).cast("date"), "is_current": F.lit(True),
    })
