"""Ordered looks along a key without putting the whole key into one task.

A plain ``Window.partitionBy(session).orderBy(time)`` sorts one session in one
task; a session that holds a third of the table would then hold up the job.
``Slices`` cuts the time line of large keys at rows picked by a hash. Windows run
inside a (key, slice), and what a slice has to know of the slices before it comes
from a table with one row per slice. The picks depend on row values alone, so a
retry after a lost executor finds the same slices, and results never depend on
where the cuts fall.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
_CUT = "_is_cut"
ROWS_PER_SLICE = 1_000_000
_STEP = 64


@dataclass(frozen=True)
class _Look:
    inside: Column  # value within the slice
    tail: Column    # what the slice hands on
    fold: str       # how the tails of earlier slices combine
    zero: bool = False


class Slices:
    """``df`` as rows of (key, slice), each slice of bounded expected size."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 rows_per_slice: int = ROWS_PER_SLICE):
        self.keys, self.order, self.parts = list(keys), list(order), [*keys, SLICE]
        by = self.order[0]
        # one row in rows_per_slice is a cut, so slices keep their size however large the
        # table is, and the cuts that are broadcast are some 16 bytes for a million rows:
        # 5 MB where the table has 100 TB
        picked = df.select(*self.keys, by).where(
            F.pmod(F.xxhash64(*self.keys, by), F.lit(rows_per_slice)) == 0
        )
        cuts = picked.groupBy(*self.keys).agg(F.array_sort(F.collect_set(by)).alias("_cuts"))
        # every 64th cut on its own, so that a row compares with 2 x 64 cuts at most
        # where a key has thousands
        self.cuts = cuts.withColumn(
            "_coarse", F.filter("_cuts", lambda _, i: i % _STEP == _STEP - 1)
        )
        below = lambda cut: cut < F.col(by)
        coarse = F.size(F.filter("_coarse", below))
        fine = F.size(F.filter(F.slice("_cuts", coarse * _STEP + 1, F.lit(_STEP)), below))
        self.rows = (
            df.join(F.broadcast(self.cuts), self.keys, "left")
            .withColumn(SLICE, F.coalesce(coarse * _STEP + fine, F.lit(0)))
            .withColumn(_CUT, F.col("_cuts").isNotNull())
            .drop("_cuts", "_coarse")
        )
        self._bounded = True

    @classmethod
    def of_numbers(cls, df: DataFrame, keys: list[str], order: list[str],
                   size: int = 1000) -> "Slices":
        """Slices of ``size`` consecutive numbers, for tables with few rows per number."""
        self = cls.__new__(cls)
        self.keys, self.order, self.parts = list(keys), list(order), [*keys, SLICE]
        self.cuts = None
        self.rows = df.withColumn(SLICE, F.floor(F.col(order[0]) / size)).withColumn(
            _CUT, F.lit(True)
        )
        self._bounded = False
        return self

    def replace(self, rows: DataFrame) -> "Slices":
        """The same slices over rows derived from these."""
        other = Slices.__new__(Slices)
        other.__dict__.update(self.__dict__, rows=rows)
        return other

    # what can be looked up ------------------------------------------------
    @property
    def _window(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def per_key(self, **totals: Callable[[Column], Column]) -> "Slices":
        """Add minima, maxima or counts of the first order column over all slices of a key, its rows as they lie.

        From here on windows also name the column that tells keys with cuts, the same for all rows of a key: so what
        slices hand on is worked out from the rows of such keys alone.
        """
        parts = [*self.keys, SLICE, _CUT]
        by, here = F.col(self.order[0]), Window.partitionBy(*parts)
        whole = self.rows.where(_CUT).groupBy(*self.keys).agg(*[total(by).alias(f"_w_{name}") for name, total in totals.items()])
        rows = self.rows.select("*", *[total(by).over(here).alias(name) for name, total in totals.items()]).join(
            F.broadcast(whole), self.keys, "left")  # keys that have cuts, so few
        other = self.replace(rows.withColumns({name: F.coalesce(f"_w_{name}", name) for name in totals}).drop(
            *[f"_w_{name}" for name in totals]))
        other.parts = parts
        return other

    def grouped(self, by: str, *parts: Column) -> "Slices":
        """Rows of a key, slice and ``by``, which grows with the order, as one; in order of ``by``. A group that a cut
        divides is a row in either slice."""
        other = self.replace(self.rows.groupBy(*self.keys, SLICE, _CUT, by).agg(*parts))
        other.order, other.parts = [by], [*self.keys, SLICE, _CUT]
        return other

    def previous(self, *columns) -> _Look:
        """The row just before, as a struct; NULL on a key's first row."""
        row = F.struct(*columns)
        return _Look(F.lag(row).over(self._window), F.max_by(row, F.struct(*self.order)), "lag")

    def following(self, *columns) -> _Look:
        """The row just after, as a struct; NULL on a key's last row."""
        row = F.struct(*columns)
        return _Look(F.lead(row).over(self._window), F.min_by(row, F.struct(*self.order)), "lead")

    def last_known(self, value: Column) -> _Look:
        """The last non-NULL value on the rows before this one."""
        known = F.when(value.isNotNull(), F.struct(*self.order))
        before = self._window.rowsBetween(Window.unboundedPreceding, -1)
        return _Look(F.last(value, ignorenulls=True).over(before), F.max_by(value, known), "last")

    def running_sum(self, value: Column) -> _Look:
        """The sum up to and with this row."""
        upto = self._window.rowsBetween(Window.unboundedPreceding, 0)
        return _Look(F.sum(value).over(upto), F.sum(value), "sum", zero=True)

    def look_back(self, **looks: _Look) -> "Slices":
        """Add one column per look: one sort, and one small table of hand-overs."""
        inside = self.rows.select(
            "*", *[look.inside.alias(name) for name, look in looks.items()]
        )
        tails = (
            self.rows.where(_CUT).groupBy(*self.keys, SLICE)
            .agg(*[look.tail.alias(f"_t_{name}") for name, look in looks.items()])
        )
        slices = Window.partitionBy(*self.keys).orderBy(SLICE)
        before = slices.rowsBetween(Window.unboundedPreceding, -1)
        folds = {
            "lag": lambda c: F.lag(c).over(slices),
            "lead": lambda c: F.lead(c).over(slices),
            "last": lambda c: F.last(c, ignorenulls=True).over(before),
            "sum": lambda c: F.sum(c).over(before),
        }
        handed = tails.select(
            *self.keys, SLICE, F.row_number().over(slices).alias("_nth"),
            *[folds[look.fold](f"_t_{name}").alias(f"_c_{name}") for name, look in looks.items()],
        )
        if all(look.fold != "lead" for look in looks.values()):  # nothing comes to a key's first slice
            handed = handed.where("_nth > 1")
        handed = handed.drop("_nth")
        if self._bounded:  # one row per cut
            handed = F.broadcast(handed)
        joined = inside.join(handed, [*self.keys, SLICE], "left")
        for name, look in looks.items():
            carry = F.col(f"_c_{name}")
            nothing = F.lit(0)
            value = (
                F.coalesce(F.col(name), nothing) + F.coalesce(carry, nothing) if look.zero
                else F.coalesce(F.col(name), carry)
            )
            joined = joined.withColumn(name, value).drop(f"_c_{name}")
        return self.replace(joined)

    def join_per_key(self, per_key: DataFrame) -> DataFrame:
        """Join one row per key to the rows; a large key's row goes to each of its slices."""
        copies = per_key.join(
            F.broadcast(self.cuts.select(*self.keys, F.size("_cuts").alias("_n"))),
            self.keys, "left",
        ).withColumn(
            SLICE, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(0))))
        ).drop("_n")
        return self.done(self.rows.join(copies, [*self.keys, SLICE]))

    @staticmethod
    def done(rows: DataFrame) -> DataFrame:
        return rows.drop(SLICE, _CUT)

    @property
    def result(self) -> DataFrame:
        return self.done(self.rows)


def time_order(df: DataFrame, time: str = "timestamp_wall") -> list[str]:
    """Time, then the packet number where there is one, so that ties have one order."""
    return [time] + [c for c in ("packet_id",) if c in df.columns]


def order_key(df: DataFrame, time: str = "timestamp_wall") -> Column:
    """Time and packet number as one number.

    ``max_by`` over a number is a hash aggregate; over a struct it would sort all rows.
    """
    if "packet_id" not in df.columns:
        return F.col(time)
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(20,0)")
    return micros * F.lit(10 ** 18).cast("decimal(19,0)") + F.col("packet_id").cast("decimal(20,0)")


def first_of_each(df: DataFrame, keys: list[str], order: list[str], n: int,
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The first n rows of each key.

    First n of each slice, which Spark already cuts down before the shuffle; so what
    is left of a key are n rows for each of its slices.
    """
    slices = Slices(df, keys, order, rows_per_slice)
    inside = slices.rows.withColumn("_nth", F.row_number().over(slices._window)).where(
        F.col("_nth") <= n)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return slices.done(inside).withColumn("_nth", F.row_number().over(whole)).where(
        F.col("_nth") <= n).drop("_nth")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no",
             rows_per_slice: int = ROWS_PER_SLICE) -> Slices:
    """Rows numbered from 1 within their key."""
    slices = Slices(df, keys, order, rows_per_slice)
    return slices.look_back(**{name: slices.running_sum(F.lit(1))})
