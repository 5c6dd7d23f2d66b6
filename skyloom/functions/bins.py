"""The nine scoreable dimensions and their bin expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.geo import STUDY_LAT, STUDY_LON


def _even(lo: float, hi: float, bins: int) -> tuple[float, ...]:
    return tuple(lo + (hi - lo) * i / bins for i in range(bins + 1))


@dataclass(frozen=True)
class Dimension:
    """Bin edges and where the binned value comes from.

    ``kind``: ``even`` (fixed width, clamped), ``breaks`` (irregular edges,
    clamped), ``quarter`` (labels per quarter) or ``extent`` (a coordinate,
    marked from a group's minimum to its maximum).
    """

    name: str
    column: str
    edges: tuple
    kind: str = "even"

    @property
    def n_bins(self) -> int:
        return len(self.edges) if self.kind == "quarter" else len(self.edges) - 1

    @property
    def lower_edges(self) -> tuple:
        return self.edges if self.kind == "quarter" else self.edges[:-1]

    def bin_of(self, value: Column) -> Column:
        if self.kind == "breaks":
            return clamp(break_bin(value, self.edges), self.n_bins)
        width = self.edges[1] - self.edges[0]
        return clamp(F.floor((value - F.lit(self.edges[0])) / F.lit(width)), self.n_bins)

    def bin_expr(self) -> Column:
        if self.kind == "quarter":
            # Integer quarters: January to March are the first one.
            q = (F.col("year") - F.lit(int(self.edges[0][:4]))) * 4 + F.floor(
                (F.col("month_of_year") - 1) / 3
            )
            return clamp(q, self.n_bins)
        return self.bin_of(F.col(self.column).cast("double"))


def clamp(index: Column, n_bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), index.cast("int")))


def break_bin(value: Column, edges) -> Column:
    """Index of the last edge not above the value."""
    breaks = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(breaks, lambda e: e <= value)) - 1


# Dimensions, ranges and bin counts.
DIMENSIONS: dict[str, Dimension] = {
    d.name: d
    for d in (
        Dimension("temperature", "temperature", tuple(float(v) for v in range(-10, 61, 2))),
        Dimension(
            "timestamp", "year",
            tuple(f"{y:04d}-Q{q}" for y in range(2000, 2026) for q in range(1, 5)), "quarter",
        ),
        Dimension("year", "year", tuple(float(v) for v in range(2000, 2027))),
        Dimension("month_of_year", "month_of_year", tuple(float(v) for v in range(1, 14))),
        Dimension("day_of_month", "day_of_month", tuple(float(v) for v in range(1, 33))),
        Dimension(
            "day_of_year", "day_of_year",
            (1, 32, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335, 367), "breaks",
        ),
        Dimension("hour_of_day", "hour_of_day", tuple(float(v) for v in range(25))),
        Dimension("longitude", "longitude", _even(*STUDY_LON, 29), "extent"),
        Dimension("latitude", "latitude", _even(*STUDY_LAT, 25), "extent"),
    )
}


def dense_counts(pairs: Column, n_bins: int) -> Column:
    """Array of ``n_bins`` counts from an array of (bin, n) structs."""
    counts = F.map_from_entries(pairs)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)),
        lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0).cast("long")),
    )


def closed_histogram_bin(value: Column, edges) -> Column:
    """Equal-width bin with a closed last edge; null for NaN and outside values."""
    lo, hi, n = float(edges[0]), float(edges[-1]), len(edges) - 1
    index = F.least(F.lit(n - 1), F.floor((value - F.lit(lo)) / F.lit((hi - lo) / n)).cast("int"))
    ok = ~F.isnan(value) & (value >= F.lit(lo)) & (value <= F.lit(hi))
    return F.when(ok, index)


