"""Trailing event-time aggregates per entity, linear in rows and safe for hot keys.

For a row at time t the window is [t - w, t], limited to rows that come no
later in the canonical order (us, id). Two costs have to be avoided:

* a sliding RANGE frame re-aggregates its buffer for every row, which is
  quadratic for an entity with many rows per window;
* partitioning by the entity alone puts the whole history of a hot entity into
  one task.

So rows are partitioned by (entity, time slice), and only growing frames are
used. With slice length S:

* windows up to S: every row is also sent to the next slice, and a count or sum
  is the difference of two growing frames, "rows up to me" minus "rows before
  t - w". A distinct count is the number of value sessions opened minus the
  number expired: a session opens when its value was unseen for w.
* longer windows (multiples of S) are split into my slice up to me, whole slices
  in between (from a small per-slice aggregate), and the part of the oldest slice
  not before t - w. The last part comes from copies of the rows shifted by w,
  which land in my slice, so "not before t - w" becomes "not before me".
* lifetime values (last known, running totals) are my slice up to me plus a
  carry from the per-slice aggregate.

A hot entity is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
HOUR = 3600


@dataclass(frozen=True)
class Trailing:
    """One output column of :func:`trailing`.

    ``kind``: count, sum, max, nunique (windowed by ``seconds``); running_sum
    (lifetime, including the row); last (latest non-null value strictly before
    the row). ``column`` is the input column, unused for count.
    """

    name: str
    kind: str
    column: str | None = None
    seconds: int | None = None


def _is_short(spec: Trailing, slice_seconds: int) -> bool:
    return spec.kind in ("count", "sum", "nunique") and (spec.seconds or 0) <= slice_seconds


def _check(specs: Sequence[Trailing], slice_seconds: int) -> None:
    for spec in specs:
        if spec.kind in ("running_sum", "last") or _is_short(spec, slice_seconds):
            continue
        if spec.kind == "nunique":
            raise ValueError(f"{spec.name}: a distinct count needs seconds <= slice_seconds")
        if spec.seconds is None or spec.seconds % slice_seconds:
            raise ValueError(f"{spec.name}: window must be a multiple of slice_seconds")


def trailing(df: DataFrame, key: str | Sequence[str], specs: Sequence[Trailing],
             slice_seconds: int = HOUR, id_col: str = "transaction_id",
             time_col: str = "us", keep: Sequence[str] = ()) -> DataFrame:
    """Trailing aggregates per entity: one row per input row, narrow output.

    ``time_col`` holds integer microseconds; ``id_col`` is unique and breaks
    ties. The result has ``id_col``, ``keep`` and one column per spec.
    """
    _check(specs, slice_seconds)
    keys = [key] if isinstance(key, str) else list(key)
    step = slice_seconds * MICROS
    inputs = sorted({s.column for s in specs if s.column})
    extra = [c for c in keep if c != id_col]

    base = df.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(time_col).cast("bigint").alias("_us"),
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_v_{c}") for c in inputs],
        *[F.col(c).alias(f"_x_{c}") for c in extra],
    )
    key_cols = [f"_k{i}" for i in range(len(keys))]
    base = base.withColumn("_slice", _slice_of(F.col("_us"), step))

    short = [s for s in specs if _is_short(s, slice_seconds)]
    lifetime = [s for s in specs if s.kind in ("running_sum", "last")]
    long = [s for s in specs if s not in short and s not in lifetime]
    shifts = sorted({s.seconds for s in long})

    # One exchange for every frame below, whatever its ordering or sub-key.
    laid_out = _lay_out(base, bool(short), shifts, step).repartition(*key_cols, "_slice")
    result = _window_columns(laid_out, key_cols, short, long, lifetime)
    result = result.where(F.col("_role") == 0)

    needs_carry = lifetime + [s for s in long if s.seconds > slice_seconds]
    if needs_carry:
        carry = _carry(base, key_cols, needs_carry, slice_seconds)
        result = result.join(carry, [*key_cols, "_slice"], "left")
    return result.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_x_{c}").alias(c) for c in extra],
        *[_final(s, short, slice_seconds).alias(s.name) for s in specs],
    )


def _slice_of(us: Column, step: int) -> Column:
    """Floor division of integer microseconds (also right before 1970)."""
    step_lit = F.lit(step).cast("bigint")
    return F.call_function("div", us - F.pmod(us, step_lit), step_lit)


def _lay_out(base: DataFrame, next_copy: bool, shifts: Sequence[int], step: int) -> DataFrame:
    """Each row once for itself (role 0), for the next slice (1), per shift (2..)."""
    def copy(role: int, slice_: Column, us: Column) -> Column:
        return F.struct(F.lit(role).alias("_role"), slice_.alias("_slice"), us.alias("_us"))

    copies = [copy(0, F.col("_slice"), F.col("_us"))]
    if next_copy:
        copies.append(copy(1, F.col("_slice") + 1, F.col("_us")))
    for i, seconds in enumerate(shifts):
        moved = F.lit(seconds * MICROS).cast("bigint")
        copies.append(copy(2 + i, F.col("_slice") + F.lit(seconds * MICROS // step),
                           F.col("_us") + moved))
    if len(copies) == 1:
        return base.withColumn("_role", F.lit(0))
    others = [c for c in base.columns if c not in ("_us", "_slice")]
    return base.select(*others, F.inline(F.array(*copies)))


def _upto(spec: Trailing, short: list[Trailing]) -> str:
    """Column of the growing frame up to the row; specs with equal input share it."""
    if spec.kind == "nunique":
        return f"_upto_{spec.name}"
    reach = "near" if spec in short else "own"
    return f"_upto_{reach}_{spec.kind}_{spec.column}"


def _gone(spec: Trailing) -> str:
    if spec.kind == "nunique":
        return f"_gone_{spec.name}"
    return f"_gone_{spec.kind}_{spec.column}_{spec.seconds}"


def _unit(spec: Trailing, opened: bool = True) -> Column:
    """What one row contributes to a count, sum or distinct count."""
    if spec.kind == "count":
        return F.lit(1).cast("bigint")
    if spec.kind == "nunique":
        return F.col(f"_{'open' if opened else 'shut'}_{spec.name}")
    return F.col(f"_v_{spec.column}")


def _window_columns(laid_out: DataFrame, key_cols: list[str], short: list[Trailing],
                    long: list[Trailing], lifetime: list[Trailing]) -> DataFrame:
    part = Window.partitionBy(*key_cols, "_slice")
    upto = part.orderBy("_us", "_id").rowsBetween(Window.unboundedPreceding, 0)
    prior = part.orderBy("_us", "_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sorted({s.seconds for s in long})
    near = F.col("_role") <= 1
    own = F.col("_role") == 0
    df = laid_out

    # Value sessions for distinct counts: one extra local sort, no exchange.
    flags = []
    for spec in (s for s in short if s.kind == "nunique"):
        value = F.when(near, F.col(f"_v_{spec.column}"))
        sessions = Window.partitionBy(*key_cols, "_slice", value).orderBy("_us", "_id")
        gap = F.lit(spec.seconds * MICROS).cast("bigint")
        before = F.lag("_us").over(sessions)
        after = F.lead("_us").over(sessions)
        flags += [
            (value.isNotNull() & (before.isNull() | (F.col("_us") - before > gap)))
            .cast("bigint").alias(f"_open_{spec.name}"),
            (value.isNotNull() & (after.isNull() | (after - F.col("_us") > gap)))
            .cast("bigint").alias(f"_shut_{spec.name}"),
        ]
    if flags:
        df = df.select("*", *flags)

    # The part of the oldest slice not before t - w, as a growing frame backwards.
    maxima = [s for s in long if s.kind == "max"]
    if maxima:
        back = part.orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, 0)
        df = df.select("*", *[
            F.max(F.when(F.col("_role") == 2 + shifts.index(s.seconds), F.col(f"_v_{s.column}")))
            .over(back).alias(f"_tail_{s.name}") for s in maxima])

    # Growing frames up to the row, in canonical order.
    columns = {}
    for spec in short:
        columns[_upto(spec, short)] = F.sum(F.when(near, _unit(spec))).over(upto)
    for spec in long:
        agg = F.max if spec.kind == "max" else F.sum
        columns[_upto(spec, short)] = agg(F.when(own, _unit(spec))).over(upto)
    for spec in lifetime:
        value = F.when(own, F.col(f"_v_{spec.column}"))
        columns[_upto(spec, short)] = (
            F.last(value, ignorenulls=True).over(prior) if spec.kind == "last"
            else F.sum(value).over(upto))
    df = df.select("*", *[c.alias(name) for name, c in columns.items()])

    # Growing frames that end before the window starts; same sort, by time only.
    columns = {}
    by_time = part.orderBy("_us")
    for spec in short:
        frame = by_time.rangeBetween(Window.unboundedPreceding, -(spec.seconds * MICROS + 1))
        columns[_gone(spec)] = F.sum(F.when(near, _unit(spec, opened=False))).over(frame)
    earlier = by_time.rangeBetween(Window.unboundedPreceding, -1)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for spec in (s for s in long if s.kind != "max"):
        moved = F.when(F.col("_role") == 2 + shifts.index(spec.seconds), _unit(spec))
        columns[f"_tail_{spec.name}"] = (F.coalesce(F.sum(moved).over(whole), F.lit(0))
                                         - F.coalesce(F.sum(moved).over(earlier), F.lit(0)))
    if not columns:
        return df
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def _carry(base: DataFrame, key_cols: list[str], specs: list[Trailing],
           slice_seconds: int) -> DataFrame:
    """Per (entity, slice): what the earlier slices contribute.

    Runs on the per-slice aggregate (partial aggregation before the shuffle), so
    an entity has at most one row per slice here.
    """
    aggs = []
    for spec in specs:
        value = F.col(f"_v_{spec.column}") if spec.column else F.lit(1).cast("bigint")
        if spec.kind == "last":
            order = F.struct("_us", "_id")
            agg = F.max_by(value, F.when(value.isNotNull(), order))
        else:
            agg = F.max(value) if spec.kind == "max" else F.sum(value)
        aggs.append(agg.alias(f"_s_{spec.name}"))
    slices = base.groupBy(*key_cols, "_slice").agg(*aggs)
    ordered = Window.partitionBy(*key_cols).orderBy("_slice")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    columns = []
    for spec in specs:
        value = F.col(f"_s_{spec.name}")
        if spec.kind == "last":
            over = F.last(value, ignorenulls=True).over(before)
        elif spec.kind == "running_sum":
            over = F.sum(value).over(before)
        else:
            between = ordered.rangeBetween(-(spec.seconds // slice_seconds - 1), -1)
            over = (F.max if spec.kind == "max" else F.sum)(value).over(between)
        columns.append(over.alias(f"_mid_{spec.name}"))
    return slices.select(*key_cols, "_slice", *columns)


def _final(spec: Trailing, short: list[Trailing], slice_seconds: int) -> Column:
    upto = F.col(_upto(spec, short))
    if spec in short:
        return upto - F.coalesce(F.col(_gone(spec)), F.lit(0))
    if spec.kind == "last":
        return F.coalesce(upto, F.col(f"_mid_{spec.name}"))
    if spec.kind == "running_sum":
        return F.coalesce(upto, F.lit(0)) + F.coalesce(F.col(f"_mid_{spec.name}"), F.lit(0))
    parts = [upto, F.col(f"_tail_{spec.name}")]
    if spec.seconds > slice_seconds:
        parts.append(F.col(f"_mid_{spec.name}"))
    if spec.kind == "max":
        return F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = F.coalesce(parts[0], F.lit(0))
    for part in parts[1:]:
        total = total + F.coalesce(part, F.lit(0))
    return total


def default_slice(seconds: int) -> int:
    """Slice length for a single window: the window itself, hours for long ones."""
    return HOUR if seconds > HOUR and seconds % HOUR == 0 else seconds


def trailing_count(df: DataFrame, key: str | Sequence[str], seconds: int,
                   name: str = "trailing_count", **options) -> DataFrame:
    options.setdefault("slice_seconds", default_slice(seconds))
    return trailing(df, key, [Trailing(name, "count", None, seconds)], **options)


def trailing_sum(df: DataFrame, key: str | Sequence[str], column: str, seconds: int,
                 name: str = "trailing_sum", **options) -> DataFrame:
    options.setdefault("slice_seconds", default_slice(seconds))
    return trailing(df, key, [Trailing(name, "sum", column, seconds)], **options)


def trailing_max(df: DataFrame, key: str | Sequence[str], column: str, seconds: int,
                 name: str = "trailing_max", **options) -> DataFrame:
    options.setdefault("slice_seconds", default_slice(seconds))
    return trailing(df, key, [Trailing(name, "max", column, seconds)], **options)


def trailing_nunique(df: DataFrame, key: str | Sequence[str], column: str, seconds: int,
                     name: str = "trailing_nunique", **options) -> DataFrame:
    options.setdefault("slice_seconds", seconds)
    return trailing(df, key, [Trailing(name, "nunique", column, seconds)], **options)


def last_before(df: DataFrame, key: str | Sequence[str], column: str,
                name: str = "last_before", **options) -> DataFrame:
    """Latest non-null value of ``column`` strictly before each row."""
    return trailing(df, key, [Trailing(name, "last", column)], **options)
