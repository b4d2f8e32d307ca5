"""Scalar expressions, all of them built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(text: Column) -> Column:
    """Text to double; text that is no number becomes null."""
    return F.trim(text).try_cast("double")


def leading_year(text: Column) -> Column:
    """The year in the first four characters, whatever marks follow it."""
    return F.substring(text, 1, 4).try_cast("int")


def link_id(link: Column, prefix_len: int) -> Column:
    """The id inside a link: cut at the first dot, then drop a prefix of fixed length."""
    return F.regexp_replace(link, r"(?s)\..*$", "").substr(F.lit(prefix_len + 1), F.length(link))


def prefix_match(a: Column, b: Column, n: int) -> Column:
    """True where both texts start with the same n characters."""
    return F.substring(a, 1, n) == F.substring(b, 1, n)


def feet_inches(text: Column) -> Column:
    """Height text such as ``6-2`` in inches."""
    dash = F.lit("-")
    return number(F.split_part(text, dash, F.lit(1))) * 12 + number(F.split_part(text, dash, F.lit(2)))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1 between two bounds; null where the bounds coincide."""
    return F.try_divide(x - low, high - low)


def un_min_max(scaled: Column, low: Column, high: Column) -> Column:
    """Undo ``min_max``."""
    return low + scaled * (high - low)


def z_score(x: Column, mean: Column, spread: Column) -> Column:
    """Distance from the mean in standard deviations; null for a constant column."""
    return F.try_divide(x - mean, spread)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two numeric arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
