"""Row statistics over columns, labels by threshold, intervals, class balance and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import placed


def present(cols: list[Column]) -> Column:
    """The values of a row's columns as doubles, without nulls and -1."""
    return F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull() & (v != -1))


def complete(scores: list[Column], content: Column | None = None, missing: int = -1) -> Column:
    """Whether all scores are there, above the number that stands for a missing one, and the text isn't empty. A null
    score or text is missing."""
    there = F.forall(F.array(*scores), lambda v: F.coalesce(v > missing, F.lit(False)))
    return there if content is None else there & F.coalesce(F.length(content) > 0, F.lit(False))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def _moment(values: Column, k: int) -> Column:
    n, mean = F.size(values), _mean(values)
    total = F.aggregate(F.transform(values, lambda v: F.pow(v - mean, F.lit(k))), F.lit(0.0), lambda a, v: a + v)
    return F.when(n > 0, total / n)


def variance(values: Column) -> Column:
    return _moment(values, 2)


def skewness(values: Column) -> Column:
    """m3 / m2^1.5; 0 where all values are equal."""
    m2 = _moment(values, 2)
    return F.when(m2 < 1e-12, F.lit(0.0)).otherwise(_moment(values, 3) / F.pow(m2, F.lit(1.5)))


def kurtosis(values: Column) -> Column:
    """m4 / m2^2 - 3; -3 where all values are equal."""
    m2 = _moment(values, 2)
    return F.when(m2 < 1e-12, F.lit(-3.0)).otherwise(_moment(values, 4) / (m2 * m2) - 3)


def spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


#: What a row's values can be described by.
STATISTICS = {"variance": variance, "skewness": skewness, "kurtosis": kurtosis, "range": spread}


def curated(name: str, values: Column, threshold: float | None = None) -> Column:
    """The attribute of that name: a statistic of the values, or "label", by their mean against the threshold."""
    if name == "label":
        if threshold is None:
            raise ValueError("a label needs a threshold")
        return label(_mean(values), threshold)
    if name not in STATISTICS:
        raise ValueError(f"no such attribute: {name}")
    return STATISTICS[name](values)


def label(x: Column, threshold: float) -> Column:
    return F.when(x >= threshold, "pos").otherwise("neg")


@dataclass(frozen=True)
class Interval:
    """From low to high; None is without bound. A closed interval of one point has both ends in."""

    low: float | None
    high: float | None
    low_in: bool = False
    high_in: bool = False

    def __post_init__(self):
        if self.low is None and self.low_in or self.high is None and self.high_in:
            raise ValueError("an end without bound is open")
        if self.low is not None and self.high is not None:
            if self.low > self.high:
                raise ValueError("the lower end is above the upper")
            if (self.low_in and self.high_in) != (self.low == self.high):
                raise ValueError("an interval with both ends in is one point, and a point has both ends in")

    @property
    def name(self) -> str:
        return f"{'-inf' if self.low is None else f'{self.low:g}'}_{'inf' if self.high is None else f'{self.high:g}'}"

    def holds(self, x: Column) -> Column:
        low = F.lit(True) if self.low is None else (x >= self.low if self.low_in else x > self.low)
        high = F.lit(True) if self.high is None else (x <= self.high if self.high_in else x < self.high)
        return low & high


#: Fixed values.
PRESETS = {
    "variance": (Interval(0, 0, True, True), Interval(0, 1, False, True), Interval(1, None)),
    "skewness": (Interval(None, 0), Interval(0, 0, True, True), Interval(0, None)),
    "kurtosis": (Interval(None, -3, False, True), Interval(-3, 0, False, True), Interval(0, None)),
    "range": (Interval(0, 0, True, True), Interval(0, 3, False, True), Interval(3, None)),
}

#: Fixed values of a second preset; ranges have none there.
COARSE_PRESETS = {
    "variance": (Interval(None, 1, False, True), Interval(1, None)),
    "skewness": (Interval(None, 0), Interval(0, 0, True, True), Interval(0, None)),
    "kurtosis": (Interval(None, 3, False, True), Interval(3, None)),
}


def interval_name(x: Column, intervals: tuple[Interval, ...]) -> Column:
    """Name of the first interval that holds x; null if none does."""
    return F.coalesce(*[F.when(i.holds(x), i.name) for i in intervals])


def _draw(seed: int) -> Column:
    return F.md5(F.concat_ws("#", F.col("id").cast("string"), F.lit(str(seed))))


def resampled(rows: DataFrame, cls: str, to: str, seed: int = 41) -> DataFrame:
    """rows (id, cls, ...) with classes of equal size: to "major" repeats rows of the smaller classes in the order
    of a hash of id and seed, to "minor" keeps the first of the larger ones in that order."""
    sizes = rows.groupBy(cls).agg(F.count("*").alias("n"))
    target = sizes.agg((F.max if to == "major" else F.min)("n").alias("target"))
    held = placed(rows, [_draw(seed), F.col("id")], [cls]).join(F.broadcast(sizes), cls).join(F.broadcast(target))
    # copy j of the row at place p stands at place p + j * n
    copies = F.floor((F.col("target") - F.col("place")) / F.col("n")).cast("int")
    return (
        held.filter("place <= target")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))
        .drop("place", "n", "target")
    )


def hash_split(id_col: Column, percent: int) -> Column:
    """True for about percent of the rows, by their id alone."""
    return F.pmod(F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent
