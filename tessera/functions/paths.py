"""Paths: escapes, components, and the version-insensitive comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape(path: Column) -> Column:
    r"""Drops the backslash before a space or a backslash, and no other."""
    return F.regexp_replace(path, r"\\([ \\])", "$1")


def escape(path: Column) -> Column:
    return F.regexp_replace(path, r"([ \\])", r"\\$1")


def components(path: Column) -> Column:
    return F.split(path, "/")


def shape(path: Column) -> Column:
    """Every run of ASCII digits as one #: paths that differ in versions only have one shape."""
    return F.regexp_replace(path, "[0-9]+", "#")


def basename(path: Column) -> Column:
    return F.element_at(components(path), -1)


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def differing(a: Column, b: Column) -> Column:
    """How many components differ between paths of one shape."""
    return F.size(F.filter(F.zip_with(components(a), components(b), lambda x, y: x != y), lambda d: d))


def fuzzy_match(a: Column, b: Column) -> Column:
    """0 if the shapes differ, 1 if the paths are equal, 1 + k if k components differ in digits only."""
    return F.when(shape(a) == shape(b), 1 + differing(a, b)).otherwise(0)
