"""Comparisons: ordered levels over a pair, and the gamma columns that they give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weldrow.functions.text import haversine_km, jaro_winkler

def side(s: str, name: str) -> Column:
    return F.col(f"{name}_{s}")


@dataclass(frozen=True)
class Level:
    """One way to agree. ``test`` maps the pair's similarity columns to a predicate; ``tf`` names a frequency-adjusted column, ``equal`` the one that is equal."""

    label: str
    test: Callable[[Callable[[str], Column]], Column]
    tf: str | None = None
    equal: str | None = None


@dataclass(frozen=True)
class Comparison:
    """Null level first (gamma -1), then levels from the strongest down; the first that holds wins, none is gamma 0."""

    name: str
    columns: tuple[str, ...]
    null: Callable[[], Column]
    levels: tuple[Level, ...]
    jw: tuple[str, ...] = ()

    def gamma(self, similarity: Callable[[str], Column]) -> Column:
        out = F.when(self.null(), F.lit(-1))
        for i, level in enumerate(self.levels):
            out = out.when(F.coalesce(level.test(similarity), F.lit(False)), F.lit(len(self.levels) - i))
        return out.otherwise(F.lit(0))

    def equality(self) -> str | None:
        """The column whose equality is all that this compares, if it is so."""
        column = self.levels[0].equal if len(self.levels) == 1 else None
        return column if column and getattr(self.null, "columns", None) == (column,) else None

    def labels(self) -> dict[int, str]:
        return {len(self.levels) - i: x.label for i, x in enumerate(self.levels)} | {0: "all other"}


def exact(column: str, label: str | None = None, tf: bool = False) -> Level:
    return Level(label or f"exact {column}", lambda _: side("l", column) == side("r", column), column if tf else None, column)


def similar(column: str, threshold: float) -> Level:
    return Level(f"{column} similarity >= {threshold}", lambda jw: jw(column) >= threshold)


def overlapping(column: str, label: str, least: int = 1) -> Level:
    if least == 1:
        return Level(label, lambda _: F.arrays_overlap(side("l", column), side("r", column)))
    return Level(label, lambda _: F.size(F.array_intersect(side("l", column), side("r", column))) >= least)


def reversed_columns(a: str, b: str, symmetrical: bool = False) -> Level:
    """Columns swapped between the two records: left a with right b, and the other way round if ``symmetrical``."""

    def test(_) -> Column:
        one = side("l", a) == side("r", b)
        return one & (side("l", b) == side("r", a)) if symmetrical else one

    return Level(f"{a} and {b} swapped", test)


def both(label: str, *levels: Level) -> Level:
    def test(jw):
        out = F.lit(True)
        for x in levels:
            out = out & x.test(jw)
        return out

    return Level(label, test)


def within_km(lat: str, lon: str, km: float) -> Level:
    return Level(f"within {km:g} km", lambda _: haversine_km(side("l", lat), side("l", lon), side("r", lat), side("r", lon)) <= km)


def missing(*columns: str) -> Callable[[], Column]:
    """Null level: for each column, a side is null. Built when used, as profiles exist before any session."""

    def test() -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & (side("l", c).isNull() | side("r", c).isNull())
        return out

    test.columns = columns
    return test


def gammas(pairs: DataFrame, comparisons: list[Comparison]) -> DataFrame:
    """``pairs`` (columns ``<c>_l`` and ``<c>_r``) with ``gamma_<comparison>`` each.

    Each string similarity is computed once a pair for all thresholds, and reaches Python only where both sides are
    there and differ.
    """
    wanted = {c for x in comparisons for c in x.jw}
    out = pairs
    for c in sorted(wanted):
        a, b = side("l", c), side("r", c)
        need = a.isNotNull() & b.isNotNull() & (a != b)
        out = out.withColumn(f"_jw_{c}", F.coalesce(jaro_winkler(F.when(need, a), F.when(need, b)), F.when(a == b, F.lit(1.0))))
    return out.withColumns({f"gamma_{x.name}": x.gamma(lambda c: F.col(f"_jw_{c}")) for x in comparisons}).drop(*[f"_jw_{c}" for c in wanted])
