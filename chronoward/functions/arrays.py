"""Scalar statistics of array columns, JVM-side (higher-order functions).

All take an ``array<double>`` column without nulls; an empty array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(arr: Column) -> Column:
    """Array of doubles without nulls, NaN and infinities."""
    return F.filter(arr.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda would recompute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def median(arr: Column) -> Column:
    """Middle of the sorted values, the mean of the two middle ones for an even number."""
    n = F.size(arr)
    lower, upper = F.floor((n + 1) / 2).cast("int") - 1, F.floor(n / 2).cast("int")
    return bind(F.array_sort(arr), lambda s: (F.get(s, lower) + F.get(s, upper)) / 2.0)


def std(arr: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(central_moment(arr, 2))


def mad(arr: Column) -> Column:
    """Median absolute deviation from the median."""
    return bind(median(arr), lambda m: median(F.transform(arr, lambda x: F.abs(x - m))))


def robust_scale(arr: Column) -> Column:
    """1.4826 times the median absolute deviation; where that vanishes the standard deviation, at least 1."""
    scale = bind(mad(arr), lambda m: F.when(1.4826 * m > 1e-8, 1.4826 * m).otherwise(F.greatest(std(arr), F.lit(1.0))))
    return F.coalesce(scale, F.lit(1.0))


def differences(arr: Column) -> Column:
    """Neighbour differences; empty for fewer than two values."""
    tail, head = F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))), F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda a, b: a - b)


def share(arr: Column, test) -> Column:
    """Share of the values for which ``test`` holds."""
    return F.when(F.size(arr) > 0, F.size(F.filter(arr, test)) / F.size(arr))


def flatline_fraction(arr: Column, window: int, least_std: float = 1e-4) -> Column:
    """Share of the windows of ``window`` values (the last may be shorter) that hardly vary; 1 for no values."""
    n = F.size(arr)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(window)).cast("int") - 1, F.lit(0)))
    flat = F.transform(starts, lambda i: std(F.slice(arr, i * window + 1, F.lit(window))) < least_std)
    return F.when(n > 0, F.size(F.filter(flat, lambda x: x)) / F.size(flat)).otherwise(1.0)


def extreme_fraction(arr: Column, share_of_range: float = 0.01) -> Column:
    """Share of values within ``share_of_range`` of the range of the least or greatest value; 1 without a range."""
    low, high = F.array_min(arr), F.array_max(arr)
    return bind(
        F.struct(low.alias("a"), high.alias("b")),
        lambda r: F.when(r["b"] - r["a"] < 1e-8, 1.0).otherwise(share(
            arr, lambda x: F.least(x - r["a"], r["b"] - x) <= F.greatest((r["b"] - r["a"]) * share_of_range, F.lit(1e-8))
        )),
    )


def central_moment(arr: Column, order: int) -> Column:
    return bind(mean(arr), lambda m: mean(F.transform(arr, lambda x: F.pow(x - m, F.lit(float(order))))))


def slope(arr: Column) -> Column:
    """Least-squares slope over the position."""
    n = F.size(arr)
    centre = (n - 1) / 2.0
    num = bind(mean(arr), lambda m: total(F.transform(arr, lambda x, i: (i - centre) * (x - m))))
    return F.when(n > 1, num / (n * (n * n - 1) / 12.0))


def resample(arr: Column, points: int) -> Column:
    """Linear interpolation at ``points`` equally spaced positions."""
    n = F.size(arr)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.lit(float(points - 1))
        lo = F.least(F.floor(x), n - 2).cast("int")
        a, b = F.get(arr, lo), F.get(arr, lo + 1)
        return a + (b - a) * (x - lo)

    return F.when(n > 1, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def poincare_axes(spread: Column, step_spread: Column) -> tuple[Column, Column]:
    """SD1 and SD2 from the standard deviations of the values and of their successive differences."""
    along = F.greatest(2.0 * spread * spread - 0.5 * step_spread * step_spread, F.lit(0.0))
    return F.sqrt(F.lit(0.5)) * step_spread, F.sqrt(along)


def poincare(arr: Column, min_pairs: int = 20) -> Column:
    """Struct of SD1, SD2 and their ratio (null if SD2 vanishes); null for fewer than ``min_pairs`` successive pairs."""
    both = F.struct(std(arr).alias("v"), bind(differences(arr), std).alias("d"))

    def axes(b: Column) -> Column:
        sd1, sd2 = poincare_axes(b["v"], b["d"])
        return F.struct(sd1.alias("sd1"), sd2.alias("sd2"), F.when(sd2 > 1e-8, sd1 / sd2).alias("ratio"))

    return F.when(F.size(arr) > min_pairs, bind(both, axes))


def quantile(arr: Column, p: float) -> Column:
    """Linearly interpolated quantile."""
    at = F.lit(float(p)) * (F.size(arr) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return bind(F.array_sort(arr), lambda s: F.get(s, low) + (F.get(s, high) - F.get(s, low)) * (at - low))


def iqr(arr: Column) -> Column:
    """Interquartile range."""
    return quantile(arr, 0.75) - quantile(arr, 0.25)


def variation_coefficient(arr: Column, least: int = 3) -> Column:
    """Standard deviation over the magnitude of the mean; null for few values or a vanishing mean."""
    return bind(mean(arr), lambda m: F.when((F.size(arr) >= least) & (F.abs(m) >= 1e-8), std(arr) / F.abs(m)))


def relative_variation(arr: Column) -> Column:
    """Range in percent of the middle of the range; null for fewer than two values or a vanishing middle."""
    low, high = F.array_min(arr), F.array_max(arr)
    middle = (high + low) / 2.0
    return F.when((F.size(arr) >= 2) & (F.abs(middle) >= 1e-8), 100.0 * (high - low) / F.abs(middle))


def peak_variation(arr: Column) -> Column:
    """Range in percent of the magnitude of the greatest value."""
    low, high = F.array_min(arr), F.array_max(arr)
    return F.when((F.size(arr) >= 2) & (F.abs(high) >= 1e-8), 100.0 * (high - low) / F.abs(high))


def longest_true_span(arr: Column, test) -> Column:
    """Struct (start, end exclusive) of the first longest run of values for which ``test`` holds; null if none does."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "now", "best", "stop")])

    def step(acc: Column, x: Column) -> Column:
        now = F.when(test(x), acc["now"] + 1).otherwise(0)
        longer = now > acc["best"]
        return F.struct(
            (acc["at"] + 1).alias("at"), now.alias("now"), F.when(longer, now).otherwise(acc["best"]).alias("best"),
            F.when(longer, acc["at"] + 1).otherwise(acc["stop"]).alias("stop"),
        )

    return F.aggregate(arr, zero, step, lambda acc: F.when(
        acc["best"] > 0, F.struct((acc["stop"] - acc["best"]).alias("start"), acc["stop"].alias("end"))
    ))


def longest_true_run(arr: Column, test) -> Column:
    """Length of the longest run of values for which ``test`` holds."""
    return bind(longest_true_span(arr, test), lambda s: F.coalesce(s["end"] - s["start"], F.lit(0)))


def zero_crossings(arr: Column) -> Column:
    """Number of sign changes between neighbours."""
    head = F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))
    tail = F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(head, tail, lambda a, b: a * b < 0), lambda x: x))
