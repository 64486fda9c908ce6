"""Checks that fail the query when it runs: identifiers, rates, shapes, column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(value: Column, ok: Column, message: str) -> Column:
    """``value`` where ``ok`` holds; elsewhere (or where it is unknown) the query fails."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def integral_id(value: Column, name: str = "id") -> Column:
    """A numeric id as a whole number; null, not finite or fractional ids fail the query."""
    v = value.cast("double")
    return checked(value.cast("long"), v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v == F.rint(v)), f"{name} is not integral")


def identifier(value: Column, name: str = "identifier") -> Column:
    """A trimmed text id; null, empty and ``nan`` fail the query."""
    text = F.trim(value)
    return checked(text, text.isNotNull() & (text != "") & (F.lower(text) != "nan"), f"{name} is empty")


def rate_class(rate: Column, tolerance: float = 1e-3) -> Column:
    """``per_second``, ``per_minute`` or ``other`` sampling rate (null for null)."""
    return F.when(rate.isNull(), None).when(F.abs(rate - 1.0) <= tolerance, "per_second").when(
        F.abs(rate - 1.0 / 60.0) <= tolerance, "per_minute"
    ).otherwise("other")


def swap_for(item: Column, special: list, then: Column, otherwise: Column) -> Column:
    """``then`` for special items, else ``otherwise`` (some items record their rate in another column)."""
    return F.when(item.isin(special), then).otherwise(otherwise)


def find_column(columns: list[str], wanted: str, fallbacks: list[str]) -> str:
    """The wanted column or the first fallback there is; an error if several fallbacks differ only by case, or none is there."""
    if wanted in columns:
        return wanted
    for name in fallbacks:
        near = [c for c in columns if c.lower() == name.lower()]
        if len(near) > 1:
            raise ValueError(f"ambiguous column {name}: {near}")
        if near:
            return near[0]
    raise ValueError(f"no column for {wanted} among {columns}")


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """``df`` if its columns are exactly the expected ones in order, else an error."""
    if df.columns != expected:
        raise ValueError(f"columns are {df.columns}, expected {expected}")
    return df


def group_id(scope: str, segment: Column, recording: Column, stay: Column, patient: Column) -> Column:
    """The key an exclusion works on: segment, recording, icu-stay (else its segment), patient, or none."""
    if scope == "none":
        return F.lit("")
    if scope == "segment":
        return segment.cast("string")
    if scope == "recording":
        return checked(recording.cast("string"), recording.isNotNull() & (recording.cast("string") != ""), "no recording id")
    if scope == "icu-stay":
        return F.coalesce(stay.cast("string"), segment.cast("string"))
    if scope == "patient":
        return patient.cast("string")
    raise ValueError(f"unsupported scope: {scope}")


def record_of_segment(name: Column) -> Column:
    """Record id of a segment name: a numeric suffix ``_0003`` is cut off."""
    return F.regexp_replace(name, r"_\d+$", "")
