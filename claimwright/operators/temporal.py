"""Filters, latest values and as-of joins over validity periods.

Every function takes its date; none reads a clock.  Periods include both ends
and a null bound is open.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(on: date | str | Column) -> Column:
    return on if isinstance(on, Column) else F.lit(str(on)).cast("date")


def _from(col: str = "valid_from") -> Column:
    return F.coalesce(F.col(col), F.lit("0001-01-01").cast("date"))


def in_force(on: date | str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Covers the day, open bounds included."""
    day = _day(on)
    return (F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) >= day))


def dated_in_force(on: date | str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """``in_force``, but what is undated is not (no hindsight)."""
    return F.col(start).isNotNull() & in_force(on, start, end)


def valid_at(claims: DataFrame, predicate: str | None, on: date | str | Column | None, *, require_period: bool = False) -> DataFrame:
    """Claims of a predicate in force on a day; without a day, all of them."""
    rows = claims if predicate is None else claims.filter(F.col("predicate") == predicate)
    if on is None:
        return rows
    return rows.filter(dated_in_force(on) if require_period else in_force(on))


def started_by(rows: DataFrame, on: date | str | Column, start: str = "valid_from") -> DataFrame:
    """Rows that began by a day, whether or not they ended since."""
    return rows.filter(has_begun(on, start))


def has_begun(on: date | str | Column, start: str = "valid_from") -> Column:
    return F.col(start).isNotNull() & (F.col(start) <= _day(on))


def latest_at(claims: DataFrame, predicate: str | None, on: date | str | Column | None, keys: list[str], *, tiebreak: str = "object_repr") -> DataFrame:
    """The newest claim in force for each key; ties to the larger tiebreak."""
    order = Window.partitionBy(*keys).orderBy(_from().desc(), F.col(tiebreak).desc_nulls_last())
    return valid_at(claims, predicate, on).withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def history_at(claims: DataFrame, predicate: str | None, on: date | str | Column | None, keys: list[str], *, tiebreak: str = "object_repr") -> DataFrame:
    """Claims in force with their place, oldest first, for each key."""
    order = Window.partitionBy(*keys).orderBy(_from().asc(), F.col(tiebreak).asc_nulls_first())
    return valid_at(claims, predicate, on).withColumn("place", F.row_number().over(order))


def status_at(history: DataFrame, on: Column | date | str, keys: list[str], *, status: str = "status", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The status whose covering period began last; ties to the larger status."""
    covering = history.filter(in_force(on, start, end))
    return covering.groupBy(*keys).agg(F.max_by(status, F.struct(_from(start), F.col(status))).alias(status))


def first_status_at(history: DataFrame, on: Column | date | str, keys: list[str], *, status: str = "status", position: str = "seq", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """The first covering period in list order, as a sheet shows it."""
    return history.filter(in_force(on, start, end)).groupBy(*keys).agg(F.min_by(status, position).alias(status))


def first_transition(history: DataFrame, flagged: Column, keys: list[str], *, start: str = "valid_from", status: str = "status") -> DataFrame:
    """The first dated period whose status is flagged."""
    rows = history.filter(flagged & F.col(start).isNotNull())
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col(start), F.col(status))).alias("x")).select(*keys, F.col(f"x.{start}").alias("event_date"), F.col(f"x.{status}").alias("event"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], *, tiebreak: str) -> DataFrame:
    """Each left row with the newest right row at or before it, or nulls.

    Both sides are put in one stream per key and the last right row so far is
    carried along, so a key's rows are sorted once and never paired.
    """
    carried = F.struct(F.col(right_ts).alias("__ts"), *values)
    a = left.select(*keys, F.col(left_ts).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.schema[tiebreak].dataType).alias("__tie"))
    b = right.select(*keys, F.col(right_ts).alias("__at"), F.lit(0).alias("__side"), carried.alias("__r"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(tiebreak).alias("__tie"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__r", ignorenulls=True).over(order))
    return both.filter("__side = 1").select("__l.*", F.col("__last.__ts").alias(right_ts), *(F.col(f"__last.{v}").alias(v) for v in values))


def intersect_periods(a: tuple[str, str], b: tuple[str, str]) -> tuple[Column, Column]:
    """Start and end of the common period; null bounds are open."""
    return F.greatest(a[0], b[0]), F.least(a[1], b[1])


def known_by(day: str, by: str | Column) -> Column:
    """Whether a partial date (YYYY, YYYY-MM or YYYY-MM-DD) has wholly passed at another."""
    pad = lambda c: F.concat(c, F.substr(F.lit("-99-99"), F.length(c) - F.lit(3)))
    full = lambda c: F.when(F.length(c) < 10, pad(c)).otherwise(c)
    other = by if isinstance(by, Column) else F.lit(by)
    return F.coalesce(full(F.col(day)) <= full(other), F.lit(False))


def standing(records: DataFrame, undone: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Records of an append-only log that no later undo of their id withdrew."""
    last = undone.groupBy(F.col(key).alias("__key")).agg(F.max(seq).alias("__undone"))
    return records.join(last, F.col(key) == F.col("__key"), "left").filter(F.col("__undone").isNull() | (F.col("__undone") < F.col(seq))).drop("__key", "__undone")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def stale_days(as_of: date | str | Column, changed: str, registered: str) -> Column:
    """Days since the later of two changes if the page is the older one, else minus its lead; null without a page."""
    day, a, b = _day(as_of), F.col(changed), F.col(registered)
    return F.when(a < b, F.datediff(day, F.greatest(a, b))).otherwise(-F.datediff(a, b))
